"""Running sums and exact quantiles over collapsed ``(group, value, count)``
tables, without a window that puts a whole group in one task.

One plan serves every size.  The number of ranges follows from the data: the
largest group's distinct values over :data:`RANGE_VALUES`.  Each group is cut
at approximate quantiles of its distinct values, the per-range totals give
each range's starting offset, and a window per ``(group, range)`` finishes the
sums, so a window task holds about :data:`RANGE_VALUES` rows however large the
group is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from healthwatch.operators.baseline import melt
from healthwatch.session import write_table

RANGE_VALUES = 1_000_000


def range_count(g: DataFrame, by: list[str], range_values: int = RANGE_VALUES) -> int:
    """Ranges a group is cut into: its distinct values over ``range_values``,
    for the largest group (one aggregation of the collapsed table)."""
    most = g.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return max(1, -(-most // range_values))


def running_sums(g: DataFrame, counts: list[str], by: list[str] | None = None,
                 range_values: int = RANGE_VALUES) -> DataFrame:
    """Add ``cum_<c>`` = sum of ``c`` over values <= this row's value, per
    ``by`` group (default: per field)."""
    by = by or ["field"]
    ranges = range_count(g, by, range_values)
    cuts = (F.percentile_approx("value", [i / ranges for i in range(1, ranges)], max(10000, 100 * ranges))
            if ranges > 1 else F.first(F.array().cast("array<double>")))
    bounds = g.groupBy(*by).agg(cuts.alias("_bounds"))                      # one row per group
    gb = g.join(bounds, by).withColumn("_range", F.size(F.filter("_bounds", lambda b: b < F.col("value")))).drop("_bounds") \
        if ranges > 1 else g.withColumn("_range", F.lit(0))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per = gb.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_b_{c}") for c in counts])
    offs = per.select(*by, "_range", *[F.coalesce(F.sum(f"_b_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in counts])
    gb = gb.join(offs, [*by, "_range"])                                     # groups x ranges rows
    within = Window.partitionBy(*by, "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    out = gb.withColumns({f"cum_{c}": F.col(f"_o_{c}") + F.sum(c).over(within) for c in counts})
    return out.drop("_range", *[f"_o_{c}" for c in counts])


def exact_quantiles(df: DataFrame, fields: list[str], qs: list[float], range_values: int = RANGE_VALUES) -> DataFrame:
    """``(field, q, value)``: exact quantiles with linear interpolation
    (position ``(N-1) q`` in the sorted sample), computed from the collapsed
    value counts — memory per task is bounded whatever the row count."""
    g = write_table(melt(df, fields).groupBy("field", "value").agg(F.count(F.lit(1)).alias("c")), "quantiles")
    return quantiles_from_counts(g, qs, range_values)


def quantiles_from_counts(g: DataFrame, qs: list[float], range_values: int = RANGE_VALUES) -> DataFrame:
    """Exact quantiles from a collapsed ``(field, value, c)`` table: the two
    values around each position are picked by their running sums, one formula
    at every size."""
    n = g.groupBy("field").agg(F.sum("c").alias("_n"))           # one row per field
    r = running_sums(g.select("field", "value", "c"), ["c"], range_values=range_values).join(n, "field")
    start, end = F.col("cum_c") - F.col("c"), F.col("cum_c")    # 0-based ranks [start, end)
    hits = []
    for q in qs:
        h = (F.col("_n") - 1) * F.lit(q)
        for kind, k in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            hits.append(F.when((k >= start) & (k < end),
                               F.struct(F.lit(q).alias("q"), F.lit(kind).alias("kind"), h.alias("h"))))
    picked = (r.select("field", "value", F.explode(F.array_compact(F.array(*hits))).alias("t"))
               .groupBy("field", "t.q")
               .agg(F.max(F.when(F.col("t.kind") == "lo", F.col("value"))).alias("vlo"),
                    F.max(F.when(F.col("t.kind") == "hi", F.col("value"))).alias("vhi"),
                    F.max("t.h").alias("h")))
    return picked.select("field", "q", (F.col("vlo") + (F.col("h") - F.floor("h")) * (F.col("vhi") - F.col("vlo")))
                         .alias("value"))
