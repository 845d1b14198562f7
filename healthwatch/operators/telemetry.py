"""Stall, latency and consumer-lag detectors over event and telemetry tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from healthwatch.functions import fields as fd

TELEMETRY_FIELDS = ["consumer_lag", "db_latency_sec", "cpu_percent", "memory_percent"]


def stall_gaps(df: DataFrame, gap_seconds: float = fd.STALL_SECONDS, ts: str = "ts",
               keys: list[str] | None = None, super_seconds: int = 86400) -> DataFrame:
    """Idle periods longer than ``gap_seconds`` between consecutive events
    (per ``keys`` group when given).

    No window over raw rows: with buckets of width ``gap_seconds`` two events
    in one bucket are less than ``gap_seconds`` apart, so every longer gap
    runs from the last event of a non-empty bucket to the first event of the
    next non-empty one.  A partially aggregated ``min/max`` per bucket (hot
    buckets collapse map-side) leaves one row per non-empty bucket.  Those
    rows are ordered inside super-buckets of ``super_seconds`` (a window
    partitioned by super-bucket, so the work spreads over many tasks); the
    first bucket of each super-bucket takes its predecessor from the previous
    non-empty super-bucket, found on the tiny per-super-bucket table."""
    from healthwatch.functions.columns import epoch_micros, from_epoch_micros
    keys = keys or []
    width = int(gap_seconds * 1_000_000)
    sw = int(super_seconds * 1_000_000)
    dtype = df.schema[ts].dataType
    us = epoch_micros(ts, dtype)
    buckets = (df.select(*keys, us.alias("us"))
                 .filter(F.col("us").isNotNull())
                 .groupBy(*keys, F.floor(F.col("us") / width).alias("bucket"))
                 .agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"))
                 .withColumn("sb", F.floor(F.col("first_us") / sw)))
    w_in = Window.partitionBy(*keys, "sb").orderBy("bucket")
    within = buckets.withColumn("prev_us", F.lag("last_us").over(w_in))
    # previous non-empty super-bucket's last event: one row per super-bucket
    per_sb = buckets.groupBy(*keys, "sb").agg(F.max("last_us").alias("sb_last"))
    w_sb = Window.partitionBy(*keys).orderBy("sb") if keys else Window.orderBy("sb")
    carry = per_sb.select(*keys, "sb", F.lag("sb_last").over(w_sb).alias("carry_us"))
    stitched = (within.join(carry, [*keys, "sb"], "left")           # one row per super-bucket
                      .withColumn("prev_us", F.coalesce("prev_us", "carry_us")))
    gaps = stitched.filter(F.col("first_us") - F.col("prev_us") > width)
    return gaps.select(*keys,
                       from_epoch_micros(F.col("prev_us"), dtype).alias("gap_start"),
                       from_epoch_micros(F.col("first_us"), dtype).alias("gap_end"),
                       ((F.col("first_us") - F.col("prev_us")) / F.lit(1e6)).alias("gap_seconds"))


#: Empty batches that one row is expanded to.
CALENDAR = 10_000


def batch_gaps(df: DataFrame, batch_seconds: int, ts: str = "ts") -> DataFrame:
    """Runs of empty batch windows between two batches with events: start and
    end of the run and its number of batches.  One row a run, however long."""
    from healthwatch.functions.columns import epoch_micros, from_epoch_micros
    width = batch_seconds * 1_000_000
    dtype = df.schema[ts].dataType
    first = from_epoch_micros(F.floor(epoch_micros(ts, dtype) / width) * width, dtype)
    gaps = stall_gaps(df.select(first.alias(ts)), batch_seconds, ts, super_seconds=max(86400, 1000 * batch_seconds))
    length = (epoch_micros("gap_end", dtype) - epoch_micros("gap_start", dtype)) / width
    return gaps.select(from_epoch_micros(epoch_micros("gap_start", dtype) + width, dtype).alias("gap_start"), "gap_end",
                       (F.round(length).cast("long") - 1).alias("batches"))


def empty_batches(df: DataFrame, batch_seconds: int, ts: str = "ts") -> DataFrame:
    """Batch windows (of ``batch_seconds``) between the first and last event
    that received no event at all -- the empty-batch stall signal.  A long run
    is expanded in pieces of :data:`CALENDAR` rows (``batch_gaps`` keeps it as
    one row)."""
    from healthwatch.functions.columns import epoch_micros, from_epoch_micros
    width = batch_seconds * 1_000_000
    dtype = df.schema[ts].dataType
    runs = batch_gaps(df, batch_seconds, ts).select(epoch_micros("gap_start", dtype).alias("us"), "batches")
    blocks = runs.select("us", "batches", F.explode(F.sequence(F.lit(0), F.floor((F.col("batches") - 1) / F.lit(CALENDAR * CALENDAR)))).alias("k"))
    blocks = blocks.select("us", "batches", (F.col("k") * CALENDAR * CALENDAR).alias("at"))
    pieces = blocks.select("us", "batches", F.explode(F.sequence(F.col("at"), F.least(F.col("batches"), F.col("at") + CALENDAR * CALENDAR) - 1, F.lit(CALENDAR))).alias("at"))
    rows = pieces.select("us", F.explode(F.sequence(F.col("at"), F.least(F.col("batches"), F.col("at") + CALENDAR) - 1)).alias("at"))
    start = F.col("us") + F.col("at") * width
    return rows.select(from_epoch_micros(start, dtype).alias("batch_start"), from_epoch_micros(start + width, dtype).alias("batch_end"))


def latency_breaches(tel: DataFrame, threshold_sec: float = fd.LATENCY_SECONDS,
                     col: str = "db_latency_sec") -> DataFrame:
    """Telemetry rows whose warehouse latency exceeds the threshold."""
    return tel.filter(F.col(col) > threshold_sec)


def consumer_lag(offsets: DataFrame) -> DataFrame:
    """Lag per topic: sum over partitions of ``high - committed`` when an
    offset was committed, else ``high`` when the partition holds data."""
    lag = (F.when(F.col("committed") >= 0, F.col("high") - F.col("committed"))
            .when(F.col("high") > 0, F.col("high")).otherwise(F.lit(0)))
    return offsets.groupBy("topic").agg(F.sum(lag).cast("long").alias("consumer_lag"))
