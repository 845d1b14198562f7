"""Column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def combine_rows(*frames: DataFrame) -> DataFrame:
    """Merge one-row aggregates with disjoint columns into one row.

    A union of the rows (each padded with nulls) and a global ``first``
    aggregate — no join, so no cartesian product even in principle."""
    cols: list[str] = []
    for f in frames:
        cols += [c for c in f.columns if c not in cols]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return u.agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])


def join_or_null(arr: Column, sep: str = ",") -> Column:
    """``array_join`` that yields NULL (not "") for an empty array."""
    return F.when(F.size(arr) > 0, F.array_join(arr, sep))


def safe_abs_hash(c: Column) -> Column:
    """``abs(hash(c))`` widened to BIGINT first: plain abs on INT_MIN fails
    under ANSI mode."""
    return F.abs(F.hash(c).cast("long"))


_NTZ_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_micros(name: str, dtype) -> Column:
    """Microseconds since the epoch of a timestamp column.  A TIMESTAMP_NTZ
    wall clock is measured directly (independent of the session time zone);
    a TIMESTAMP instant via ``unix_micros``."""
    from pyspark.sql.types import TimestampNTZType
    if isinstance(dtype, TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, {_NTZ_EPOCH}, `{name}`)")
    return F.unix_micros(F.col(name).cast("timestamp"))


def from_epoch_micros(us: Column, dtype) -> Column:
    """Inverse of ``epoch_micros`` for the given timestamp type."""
    from pyspark.sql.types import TimestampNTZType
    if isinstance(dtype, TimestampNTZType):
        return F.timestamp_add("MICROSECOND", us, F.expr(_NTZ_EPOCH))
    return F.timestamp_micros(us)
