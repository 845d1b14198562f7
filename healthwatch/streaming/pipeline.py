"""Structured Streaming: the batch detectors inside micro-batches, windowed
statistics, burst windows and idle sessions.

* ``read_table_stream`` — a file stream over one table of a folder.
* ``stream_detect`` — ``foreachBatch``: each micro-batch is persisted once,
  every detector runs on it, and its alert rows are appended (with the batch
  id) to a table under the shared checkpoint folder.
* ``window_stats`` / ``burst_windows`` / ``idle_sessions`` — event-time
  aggregations with a watermark (the event clock is cast to TIMESTAMP first:
  watermarks reject TIMESTAMP_NTZ).
* ``run_to_table`` — drives a streaming aggregate to a parquet table via
  ``foreachBatch``.  ``append`` mode emits each window once the watermark
  closes it (state stays bounded) and writes each batch as its own partition;
  ``complete`` rewrites a result of bounded size per batch.
* ``stream_latest_n`` — the newest n events, kept across micro-batches.
* ``streaming.silence``, ``streaming.late`` and ``streaming.running`` hold the
  stall timers, the once-only intake and the growing baseline.

Results always go to tables in the folder named by ``spark.checkpoint.dir``
(shared storage on a cluster), never to driver memory.
"""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from healthwatch.functions import fields as fd
from healthwatch.operators import alerts as al
from healthwatch.session import checkpoint_dir, scratch_tables


def read_table_stream(spark: SparkSession, folder: str, name: str, max_files: int | None = None) -> DataFrame:
    """Stream the parquet table ``name`` from ``folder``, whether it is one
    file or a directory of part files."""
    path = os.path.join(folder, f"{name}.parquet")
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if _is_directory(spark, path):
        return r.parquet(path)
    return r.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _is_directory(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def event_time(df: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Cast the event clock to TIMESTAMP and declare the watermark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def _scratch(spark: SparkSession, name: str) -> tuple[str, str]:
    base = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:8]}")
    return os.path.join(base, "table"), os.path.join(base, "checkpoint")


def run_to_table(agg: DataFrame, name: str, mode: str = "complete", trigger: dict | None = None, out: str | None = None,
                 checkpoint: str | None = None, feed: Callable[[StreamingQuery], None] | None = None) -> DataFrame:
    """Run a streaming DataFrame and return the written result as a batch
    DataFrame.  It ends when the available input is consumed, or with ``feed``
    when that function (which may add input) returns.

    ``out`` and ``checkpoint`` name the result table and the checkpoint; with
    both given a stopped query goes on where it ended.  In ``append`` mode a
    batch is its own partition ``batch_id=<n>``, which a replayed batch
    overwrites, so nothing is written twice."""
    spark = agg.sparkSession
    path, ckpt = _scratch(spark, name)
    path, ckpt = out or path, checkpoint or ckpt

    def write(batch: DataFrame, batch_id: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(path)
        else:
            (batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))

    q = (agg.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", ckpt)
            .trigger(**(trigger or ({"processingTime": "0 seconds"} if feed else {"availableNow": True}))).start())
    try:
        feed(q) if feed else q.awaitTermination()
    finally:
        q.stop()
    schema = agg.schema if mode == "complete" else agg.schema.add("batch_id", "long")
    return _read_or_empty(spark, path, schema).select(*agg.columns)


def caught_up(query: StreamingQuery, offsets: dict[int, int], seconds: float = 300) -> None:
    """Wait until the query has finished a batch that ends at ``offsets``
    (of a ``sources.offset_log``).  Unlike ``processAllAvailable`` this also
    ends for queries whose timers keep them busy."""
    import ast
    import time
    until = time.monotonic() + seconds
    while time.monotonic() < until:
        if query.exception() is not None:
            raise query.exception()
        for p in query.recentProgress[-1:]:
            end = p["sources"][0]["endOffset"]
            end = ast.literal_eval(end) if isinstance(end, str) else (end or {})
            if all(end.get(str(k), -1) >= v for k, v in offsets.items()):
                return
        time.sleep(0.1)
    raise TimeoutError("the stream did not reach the end of its input")


def window_stats(stream: DataFrame, size: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Tumbling event-time windows: events, mean heart rate (from an exact
    decimal sum, so it does not depend on the order in which micro-batches and
    tasks add up), impossible-vitals count."""
    from healthwatch.functions.predicates import impossible
    return (stream.groupBy(F.window(ts, size).alias("w"))
                  .agg(F.count(F.lit(1)).alias("events"),
                       F.avg(F.col("heart_rate").try_cast("decimal(28,10)")).cast("double").alias("avg_heart_rate"),
                       F.count_if(F.coalesce(impossible(), F.lit(False))).alias("impossible_events")))


def burst_windows(stream: DataFrame, seconds: int = fd.BURST_SECONDS, slide_seconds: int = 1,
                  min_events: int = fd.BURST_EVENTS, key: str = "patient_id", ts: str = "ts") -> DataFrame:
    """Sliding windows per key with their event count and the burst flag.

    Two chained aggregations: events are counted in panes of one slide step,
    and a pane that the watermark closed is added to the ``seconds /
    slide_seconds`` windows that hold it.  In ``append`` mode panes and windows
    leave the state once the watermark passes them, and a burst costs one row
    a pane instead of one per event and window."""
    if seconds % slide_seconds:
        raise ValueError("window length must be a multiple of the slide")
    panes = stream.groupBy(key, F.window(ts, f"{slide_seconds} seconds").alias("pane")).agg(F.count(F.lit(1)).alias("n"))
    return (panes.groupBy(key, F.window("pane", f"{seconds} seconds", f"{slide_seconds} seconds").alias("w"))
                 .agg(F.sum("n").alias("events")).withColumn("is_burst", F.col("events") >= min_events))


def idle_sessions(stream: DataFrame, gap_seconds: int = fd.STALL_SECONDS, key: str = "ward",
                  ts: str = "ts") -> DataFrame:
    """Activity sessions per key: a gap of ``gap_seconds`` or more ends a session."""
    return (stream.groupBy(key, F.session_window(ts, f"{gap_seconds} seconds").alias("s"))
                  .agg(F.count(F.lit(1)).alias("events")))


@contextlib.contextmanager
def local_sessions(spark: SparkSession):
    """Queries started inside merge the sessions of a key in each task before
    the shuffle, so a key that holds most events costs its sessions there."""
    name = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def stream_detect(stream: DataFrame, stats: DataFrame, base_hist: DataFrame, name: str = "alerts",
                  trigger: dict | None = None, out: str | None = None, checkpoint: str | None = None,
                  feed: Callable[[StreamingQuery], None] | None = None) -> DataFrame:
    """Run the full detector fan-in on every micro-batch and keep the alerts
    by batch id.

    ``out`` and ``checkpoint`` name the result table and the stream's
    checkpoint: with both given a stopped stream goes on where it ended.  A
    batch's alerts are its own partition ``batch_id=<n>``, which a replayed
    batch overwrites, so nothing is written twice.  The intermediate tables of
    a batch are removed when it ends.  Baseline tables are small and reused
    per batch."""
    spark = stream.sparkSession
    path, ckpt = _scratch(spark, name)
    path, ckpt = out or path, checkpoint or ckpt
    stats = stats.cache()
    base_hist = base_hist.cache()

    def each(batch: DataFrame, batch_id: int) -> None:
        b = batch.persist()
        try:
            with scratch_tables(spark):
                found = al.detect_all(b, stats, base_hist).withColumn("batch_id", F.lit(batch_id).cast("long"))
                (found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                    .partitionBy("batch_id").parquet(path))
        finally:
            b.unpersist()

    q = (stream.writeStream.foreachBatch(each).option("checkpointLocation", ckpt)
               .trigger(**(trigger or ({"processingTime": "0 seconds"} if feed else {"availableNow": True}))).start())
    try:
        feed(q) if feed else q.awaitTermination()
    finally:
        q.stop()
        stats.unpersist()
        base_hist.unpersist()
    schema = "detector string, priority int, signal_count long, detail string, batch_id long"
    return _read_or_empty(spark, path, schema)


def _read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """The written table, or an empty frame when no batch ran (no input)."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    r = spark.read
    return (r.schema(schema) if schema is not None else r).parquet(path)


def stream_latest_n(stream: DataFrame, order: list[str], n: int = 50, name: str = "latest-n", trigger: dict | None = None,
                    out: str | None = None, checkpoint: str | None = None,
                    feed: Callable[[StreamingQuery], None] | None = None) -> DataFrame:
    """The newest ``n`` events of a stream, kept across micro-batches.

    Each micro-batch is reduced with a top-k (per-partition top-n, one merge
    of n x partitions rows), merged with the previous n-row state and written
    as folder ``bid=<batch id>`` of the table ``out``.  The state before the
    previous one is removed, so two remain whatever the stream's length: a
    batch that is run again after a failure finds the state it began with.
    With ``out`` and ``checkpoint`` given a stopped query resumes."""
    from healthwatch.sources.events import latest_n
    spark = stream.sparkSession
    path, ckpt = _scratch(spark, name)
    path, ckpt = out or path, checkpoint or ckpt

    def states() -> list[int]:
        return sorted(int(f.split("=")[1]) for f in _folders(spark, path) if f.startswith("bid="))

    def each(batch: DataFrame, batch_id: int) -> None:
        top = latest_n(batch, order, n)
        before = [b for b in states() if b < batch_id]
        if before:
            top = top.unionByName(spark.read.schema(batch.schema).parquet(os.path.join(path, f"bid={before[-1]}")))
        latest_n(top, order, n).write.mode("overwrite").parquet(os.path.join(path, f"bid={batch_id}"))
        for old in before[:-1]:
            _remove(spark, os.path.join(path, f"bid={old}"))

    q = (stream.writeStream.foreachBatch(each).option("checkpointLocation", ckpt)
               .trigger(**(trigger or ({"processingTime": "0 seconds"} if feed else {"availableNow": True}))).start())
    try:
        feed(q) if feed else q.awaitTermination()
    finally:
        q.stop()
    kept = states()
    return spark.read.schema(stream.schema).parquet(os.path.join(path, f"bid={kept[-1]}")) if kept else spark.createDataFrame([], stream.schema)


def folder_after(spark: SparkSession, path: str, batch_id: int) -> bool:
    """Whether a batch after ``batch_id`` has written rows to ``path``."""
    return any(int(f.split("=")[1]) > batch_id for f in _folders(spark, path) if f.startswith("batch_id="))


def _folders(spark: SparkSession, path: str) -> list[str]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
