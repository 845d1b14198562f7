"""A baseline that grows with the stream: one state row per field.

The state of a field is its moments (count, mean, squared deviations, which
Spark merges exactly as in a batch aggregate), minimum, maximum and a KLL
quantile sketch of a fixed size.  Nothing else is kept, so a field with
continuous values costs the same as one with few."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from healthwatch.operators.baseline import SKETCH_K, melt, sketch_aggregates


def running_baseline(stream: DataFrame, fields: list[str] | None = None, k: int = SKETCH_K) -> DataFrame:
    """Streaming table (field, n_samples, mean, std, min_value, max_value,
    sketch).  Run it in ``complete`` mode: the result has one row a field, and
    ``baseline.from_sketch`` turns it into what ``detect_all`` takes."""
    return melt(stream, fields).groupBy("field").agg(*sketch_aggregates(F.col("value"), k))
