"""Stalls of a whole stream: gaps between events, and silence that lasts.

Each task first folds its rows into one row per (key, bucket of the gap
width), so a stream with one key costs a few rows a task and micro-batch,
however busy it is.  ``transformWithState`` then keeps one small state per
key: the newest event time and the deadline of its timer.

* ``gap``: two consecutive events lie further apart than the threshold, also
  across micro-batches;
* ``silent``: nothing came for ``silence_seconds`` of processing time.  The
  timer needs no further input, fires once per silence, and is part of the
  checkpoint, so a restart neither repeats nor loses it.  A clock source adds
  one tick a second and no rows: a restarted query would otherwise look at its
  timers only when new events come.

With ``ttl_seconds`` the state of a key that never returns is freed."""

from __future__ import annotations

import contextlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from healthwatch.functions import fields as fd
from healthwatch.session import ship_package

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "key string, kind string, gap_start_us long, gap_end_us long"


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which
    ``transformWithState`` needs; the session's setting is put back."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)


def _fold(gap_us: int):
    """Rows (key, us) of one task to (key, bucket, first_us, last_us)."""
    def run(frames):
        for pdf in frames:
            pdf = pdf[pdf["us"].notna()]
            if len(pdf):
                bucket = pdf["us"].astype("int64") // gap_us
                out = pdf["us"].astype("int64").groupby([pdf["key"], bucket]).agg(["min", "max"]).reset_index()
                out.columns = ["key", "bucket", "first_us", "last_us"]
                yield out
    return run


class Silence(StatefulProcessor):
    def __init__(self, gap_us: int, silence_ms: int, ttl_ms: int | None):
        self.gap_us, self.silence_ms, self.ttl_ms = gap_us, silence_ms, ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last_us long, deadline long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        rows = pd.concat(list(rows))
        span = rows.groupby("bucket").agg(lo=("first_us", "min"), hi=("last_us", "max")).sort_index()
        last, deadline = self.seen.get() if self.seen.exists() else (None, None)
        starts, ends = [], []
        for lo, hi in zip(span["lo"].tolist(), span["hi"].tolist()):
            if last is not None and lo - last > self.gap_us:
                starts.append(last)
                ends.append(lo)
            last = hi if last is None else max(last, hi)
        if deadline is not None:
            self.handle.deleteTimer(deadline)
        deadline = timerValues.getCurrentProcessingTimeInMs() + self.silence_ms
        self.handle.registerTimer(deadline)
        self.seen.update((last, deadline))
        yield pd.DataFrame({"key": pd.Series([key[0]] * len(starts), dtype="object"), "kind": pd.Series(["gap"] * len(starts), dtype="object"),
                            "gap_start_us": pd.Series(starts, dtype="Int64"), "gap_end_us": pd.Series(ends, dtype="Int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.seen.exists():
            last, _ = self.seen.get()
            yield pd.DataFrame({"key": [key[0]], "kind": ["silent"], "gap_start_us": pd.array([last], "Int64"), "gap_end_us": pd.array([None], "Int64")})

    def close(self) -> None:
        pass


def stalls(stream: DataFrame, gap_seconds: float = fd.STALL_SECONDS, silence_seconds: float | None = None, key: str | None = None,
           ts: str = "ts", ttl_seconds: float | None = None) -> DataFrame:
    """Streaming rows (key, kind, gap_start, gap_end, gap_seconds) of the
    whole stream (key ``all``) or of every value of ``key``.  Start the query
    inside :func:`rocksdb_state`.  Events older than the newest one seen close
    no gap; rows without a time are ignored."""
    from healthwatch.functions.columns import epoch_micros
    ship_package(stream.sparkSession)
    gap_us = int(gap_seconds * 1_000_000)
    silence_ms = int((gap_seconds if silence_seconds is None else silence_seconds) * 1000)
    named = (F.lit("all") if key is None else F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("key")
    rows = stream.select(named, epoch_micros(ts, stream.schema[ts].dataType).alias("us"))
    ticks = stream.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    rows = rows.unionByName(ticks.filter("value < 0").select(F.lit("").alias("key"), F.col("value").alias("us")))
    folded = rows.mapInPandas(_fold(gap_us), "key string, bucket long, first_us long, last_us long")
    found = folded.groupBy("key").transformWithStateInPandas(
        Silence(gap_us, silence_ms, None if ttl_seconds is None else int(ttl_seconds * 1000)), OUT, "Append", "ProcessingTime")
    return found.select("key", "kind", F.timestamp_micros("gap_start_us").alias("gap_start"), F.timestamp_micros("gap_end_us").alias("gap_end"),
                        ((F.col("gap_end_us") - F.col("gap_start_us")) / F.lit(1e6)).alias("gap_seconds"))


def open_stalls(found: DataFrame) -> DataFrame:
    """The gaps, and of the silent rows those that no later event ended: their
    start is the newest event time known of their key."""
    newest = found.groupBy("key").agg(F.max(F.coalesce("gap_end", "gap_start")).alias("newest"))   # one row per key
    silent = found.filter("kind = 'silent'").join(newest, "key").filter("gap_start = newest").drop("newest").distinct()
    return found.filter("kind = 'gap'").unionByName(silent)
