"""Repeated, replayed and late events of a stream.

``accept_once`` lets every event id through once: Spark keeps the ids seen
within the watermark's delay in state and frees them afterwards.  Each
micro-batch is written as its own partition, which a replayed batch overwrites,
so the accepted table holds every event once whatever is repeated.

An event older than the watermark can no longer be checked against the state
and is left out there.  ``late_rows`` finds these events afterwards: rows of
the input whose id was never accepted, so a repeat of an accepted event does
not count as late."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accept_once(stream: DataFrame, ids: list[str], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The stream without repeats of the same ids within ``delay``."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.dropDuplicatesWithinWatermark(ids)


def late_rows(read: DataFrame, accepted: DataFrame, ids: list[str]) -> DataFrame:
    """Side table: rows of ``read`` (the events of the offsets processed) whose
    ids were never accepted, each id once."""
    return read.dropDuplicates(ids).join(accepted.select(*ids), ids, "left_anti")


def late_counts(query) -> int:
    """Rows that the stream's stateful operators left out as late, from the
    progress that Spark keeps of a query."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
