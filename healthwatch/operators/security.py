"""Key-flood detectors: denylisted ids, hot-key share and burst rate.

Every count is a hash aggregate with map-side partial aggregation, so an id
holding a third of all rows collapses to one partial row per input
partition before the shuffle — the hot key never lands whole on one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from healthwatch.functions import fields as fd


def denylist_flood(df: DataFrame, ids: list[str] | None = None, min_events: int = fd.DENYLIST_MIN_EVENTS,
                   key: str = "patient_id", keys: list[str] | None = None) -> DataFrame:
    """Events per denylisted id; ``is_flood`` when the count exceeds ``min_events``."""
    ids = ids or [fd.ATTACKER_ID]
    keys = keys or []
    return (df.filter(F.col(key).isin(ids)).groupBy(*keys, key)
              .agg(F.count(F.lit(1)).alias("event_count"))
              .withColumn("is_flood", F.col("event_count") > min_events))


def hot_keys(df: DataFrame, share: float = fd.HOT_KEY_SHARE, key: str = "patient_id") -> DataFrame:
    """Every key's event count and share of all events; ``is_hot`` when the
    share exceeds ``share``.  The total is a scalar subquery (computed once,
    broadcast as a value), not a join or a single-partition window."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("event_count"))
              .withColumn("share", F.round(F.col("event_count") / total, 4))
              .withColumn("is_hot", F.col("event_count") > F.lit(share) * total))


#: Counters of the frequency sketch per wanted key: its error is then below a sixth of the share asked for.
SKETCH_ITEMS = 16


def heavy_hitters(df: DataFrame, share: float = fd.HOT_KEY_SHARE, key: str = "patient_id", floor: float | None = None) -> DataFrame:
    """Keys with more than ``floor`` (default: ``share``) of all events, their
    exact count and share, and ``is_hot`` above ``share``.

    Unlike :func:`hot_keys` this never shuffles the keys.  One pass fills a
    mergeable frequency sketch per task; a key above the floor is among its
    2 / floor largest estimates, as the sketch errs by less than floor / 6 of
    the events.  A second pass counts these few candidates exactly.  Rows
    without a key count for the total only."""
    floor = share if floor is None else floor
    if not 0 < floor <= share:
        raise ValueError("the floor must lie between 0 and the share")
    wanted = math.ceil(2 / floor)
    seen = df.agg(F.expr(f"approx_top_k(`{key}`, {wanted}, {max(SKETCH_ITEMS * wanted, 64)}) FILTER (WHERE `{key}` IS NOT NULL)").alias("top"),
                  F.count(F.lit(1)).alias("_total"))
    candidates = seen.select(F.explode("top.item").alias(key), "_total")           # at most 2 / floor rows
    counted = df.select(key).join(F.broadcast(candidates), key).groupBy(key, "_total").agg(F.count(F.lit(1)).alias("event_count"))
    return counted.filter(F.col("event_count") > F.lit(floor) * F.col("_total")).select(
        key, "event_count", F.round(F.col("event_count") / F.col("_total"), 4).alias("share"),
        (F.col("event_count") > F.lit(share) * F.col("_total")).alias("is_hot"))


def _slide_counts(df: DataFrame, key: str, ts: str, slide_seconds: int) -> DataFrame:
    """Events per key per slide step — collapsed map-side before any window
    copies are made, so a burst of many events costs one row per step."""
    from healthwatch.functions.columns import epoch_micros
    step = slide_seconds * 1_000_000
    us = epoch_micros(ts, df.schema[ts].dataType)
    return df.groupBy(key, F.floor(us / step).alias("_s")).agg(F.count(F.lit(1)).alias("_c"))


def _window_counts(df: DataFrame, key: str, ts: str, seconds: int, slide_seconds: int) -> DataFrame:
    """Counts per (key, sliding window): each step's count is added to the
    ``seconds / slide_seconds`` windows that contain it (window starts are
    multiples of the slide, as in ``F.window``)."""
    if seconds % slide_seconds:
        raise ValueError("window length must be a multiple of the slide")
    k = seconds // slide_seconds
    c = _slide_counts(df, key, ts, slide_seconds)
    shifted = c.select(key, F.explode(F.sequence(F.col("_s") - (k - 1), F.col("_s"))).alias("_w"), "_c")
    return shifted.groupBy(key, "_w").agg(F.sum("_c").alias("event_count"))


def burst_windows(df: DataFrame, events: int = fd.BURST_EVENTS, seconds: int = fd.BURST_SECONDS,
                  slide_seconds: int = 1, key: str = "patient_id", ts: str = "ts") -> DataFrame:
    """Sliding windows (``seconds`` long, ``slide_seconds`` apart) per key
    holding at least ``events`` events."""
    from healthwatch.functions.columns import from_epoch_micros
    step = slide_seconds * 1_000_000
    dtype = df.schema[ts].dataType
    w = _window_counts(df, key, ts, seconds, slide_seconds).filter(F.col("event_count") >= events)
    return w.select(key, from_epoch_micros(F.col("_w") * step, dtype).alias("window_start"),
                    from_epoch_micros(F.col("_w") * step + seconds * 1_000_000, dtype).alias("window_end"),
                    "event_count")


def burst_rate(df: DataFrame, events: int = fd.BURST_EVENTS, seconds: int = fd.BURST_SECONDS,
               slide_seconds: int = 1, key: str = "patient_id", ts: str = "ts") -> DataFrame:
    """Per key: the most events in any sliding window and ``is_burst``."""
    w = _window_counts(df, key, ts, seconds, slide_seconds)
    return (w.groupBy(key).agg(F.max("event_count").alias("max_events"))
             .withColumn("is_burst", F.col("max_events") >= events))
