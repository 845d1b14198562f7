"""Gold baseline (per-field statistics) of a clean event table.

``fit_baseline`` computes every statistic of every field in ONE aggregation
pass over the wide table (partial aggregates per partition, a single tiny
merge) and only then reshapes the one-row result to one row per field.
``percentile`` keeps a value->count map, so its memory follows the number of
distinct values, not rows; ``approx=True`` switches to ``percentile_approx``
for continuous high-cardinality fields at scale.

``baseline_histogram`` keeps the baseline sample as a collapsed
``(field, value, n)`` table instead of a raw sample list, so the KS detector
never needs the full sample on one machine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from healthwatch.functions.fields import NUMERIC_FIELDS

#: Size of a quantile sketch: ranks are within about 0.4 % (99 % confidence), 20 KB a field.
SKETCH_K, SKETCH_ERROR = 800, 0.005
#: Quantiles that stand for a field's sample when the baseline comes from a sketch.
SKETCH_POINTS = 1000

STAT_COLUMNS = ["n_samples", "mean", "std", "min_value", "max_value", "p25", "p75"]


def _pct(c, q, approx):
    if approx:
        return F.percentile_approx(c, q, 10000).cast("double")
    return F.percentile(c, F.lit(q))


def fit_baseline(df: DataFrame, fields: list[str] | None = None, approx: bool = False,
                 digits: int = 4, method: str | None = None) -> DataFrame:
    """Per field: count, mean, population std, min, max, p25, p75 (linear
    interpolation), rounded to ``digits``.  Null values are not samples;
    fields without any sample produce no row.

    Percentile ``method``: ``"ecdf"`` (default) — exact, from collapsed value
    counts and distributed running sums, safe for continuous fields at any
    scale; ``"builtin"`` — Spark's ``percentile`` (exact; its buffer holds
    every distinct value and is merged in one task, fine for bounded
    resolution); ``"approx"`` (or ``approx=True``) — ``percentile_approx``."""
    fields = fields or NUMERIC_FIELDS
    method = "approx" if approx else (method or "ecdf")
    if method == "ecdf":
        return fit(df, fields, digits)[0]
    aggs = []
    for f in fields:
        c = F.col(f).cast("double")
        aggs += [
            F.count(c).alias(f"{f}__n_samples"),
            F.round(F.avg(c), digits).alias(f"{f}__mean"),
            F.round(F.stddev_pop(c), digits).alias(f"{f}__std"),
            F.round(F.min(c), digits).alias(f"{f}__min_value"),
            F.round(F.max(c), digits).alias(f"{f}__max_value"),
        ]
        aggs += [F.round(_pct(c, 0.25, method == "approx"), digits).alias(f"{f}__p25"),
                 F.round(_pct(c, 0.75, method == "approx"), digits).alias(f"{f}__p75")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(f).alias("field"),
                     *[F.col(f"{f}__{s}").alias(s) for s in STAT_COLUMNS])
            for f in fields]
    return (wide.select(F.explode(F.array(*rows)).alias("r"))
                .select("r.*")
                .filter(F.col("n_samples") > 0))


def baseline_moments(df: DataFrame, fields: list[str] | None = None, digits: int = 4) -> DataFrame:
    """``(field, n_samples, mean, std)`` — the part of the baseline the
    z-score and KS detectors use, without the percentile aggregates (same
    rounding as ``fit_baseline``)."""
    fields = fields or NUMERIC_FIELDS
    aggs = []
    for f in fields:
        c = F.col(f).cast("double")
        aggs += [F.count(c).alias(f"{f}__n_samples"), F.round(F.avg(c), digits).alias(f"{f}__mean"),
                 F.round(F.stddev_pop(c), digits).alias(f"{f}__std")]
    rows = [F.struct(F.lit(f).alias("field"), *[F.col(f"{f}__{s}").alias(s) for s in ("n_samples", "mean", "std")])
            for f in fields]
    return (df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
              .filter(F.col("n_samples") > 0))


def melt(df: DataFrame, fields: list[str] | None = None, ids: list[str] | None = None,
         keep_null: bool = False) -> DataFrame:
    """Wide -> long ``(ids..., field, value)``; null values dropped by default."""
    fields = fields or NUMERIC_FIELDS
    long = df.select(*(ids or []), *[F.col(f).cast("double").alias(f) for f in fields]) \
             .unpivot(ids or [], fields, "field", "value")
    return long if keep_null else long.filter(F.col("value").isNotNull())


def baseline_histogram(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Collapsed baseline sample: ``(field, value, n)``.  The group-by runs
    with map-side partial aggregation, so a heavy value never skews a task."""
    return melt(df, fields).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def stats_map(stats: DataFrame, max_fields: int = 1024) -> dict[str, tuple[float, float]]:
    """Bring the per-field (mean, std) to the driver.  The table has one row
    per monitored field (a schema property, not a data size), checked here."""
    rows = stats.select("field", "mean", "std").limit(max_fields + 1).collect()
    if len(rows) > max_fields:
        raise ValueError(f"baseline has more than {max_fields} fields")
    return {r["field"]: (r["mean"], r["std"]) for r in rows}


def stats_from_histogram(hist: DataFrame, digits: int = 4, quantiles: bool = True) -> DataFrame:
    """Baseline statistics from the collapsed ``(field, value, n)`` table:
    count, mean, population std (two passes over the small table, so no
    cancellation), min, max and exact p25/p75."""
    from healthwatch.operators.ranks import quantiles_from_counts
    a = hist.groupBy("field").agg(F.sum("n").alias("_n"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("_mean"),
                                  F.min("value").alias("_min"), F.max("value").alias("_max"))
    m2 = (hist.join(F.broadcast(a.select("field", "_mean")), "field")          # one row per field
              .groupBy("field").agg(F.sum(F.col("n") * (F.col("value") - F.col("_mean")) ** 2).alias("_m2")))
    st = a.join(m2, "field").select(
        "field", F.col("_n").cast("long").alias("n_samples"), F.round("_mean", digits).alias("mean"),
        F.round(F.sqrt(F.col("_m2") / F.col("_n")), digits).alias("std"),
        F.round("_min", digits).alias("min_value"), F.round("_max", digits).alias("max_value"))
    if not quantiles:
        return st
    qv = quantiles_from_counts(hist.withColumnRenamed("n", "c"), [0.25, 0.75]).groupBy("field").agg(
        F.round(F.max(F.when(F.col("q") == 0.25, F.col("value"))), digits).alias("p25"),
        F.round(F.max(F.when(F.col("q") == 0.75, F.col("value"))), digits).alias("p75"))
    return st.join(F.broadcast(qv), "field", "left").select("field", *STAT_COLUMNS)   # one row per field


def fit(df: DataFrame, fields: list[str] | None = None, digits: int = 4,
        quantiles: bool = True) -> tuple[DataFrame, DataFrame]:
    """(stats, histogram) from ONE scan of the clean table: the collapsed
    value counts are written once and every statistic — and the KS baseline
    sample — is derived from them.  ``quantiles=False`` skips p25/p75 (the
    detectors need mean and std only)."""
    from healthwatch.session import write_table
    hist = write_table(baseline_histogram(df, fields), "baseline-histogram")
    return stats_from_histogram(hist, digits, quantiles), hist


# ------------------------------------------------------------ sketched baseline
def sketch_aggregates(value: Column, k: int = SKETCH_K) -> list[Column]:
    """Mergeable state of one field: moments, range and a KLL sketch."""
    return [F.count(value).alias("n_samples"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min_value"),
            F.max(value).alias("max_value"), F.kll_sketch_agg_double(value, k).alias("sketch")]


def fit_sketch(df: DataFrame, fields: list[str] | None = None, k: int = SKETCH_K) -> DataFrame:
    """The same state from a batch in one pass: per task one sketch a field is
    shuffled, no table of value counts is written.  For continuous fields,
    where :func:`fit` would write nearly every value."""
    return melt(df, fields).groupBy("field").agg(*sketch_aggregates(F.col("value"), k))


def from_sketch(state: DataFrame, digits: int = 4, points: int = SKETCH_POINTS) -> tuple[DataFrame, DataFrame]:
    """(stats, histogram) for the detectors from sketched state.  Moments and
    range are exact; p25, p75 and the histogram have the sketch's rank error:
    the histogram spreads the count over ``points`` equally spaced ranks."""
    quantile = lambda q: F.kll_sketch_get_quantile_double("sketch", q)
    stats = state.select("field", "n_samples", *[F.round(c, digits).alias(c) for c in ("mean", "std", "min_value", "max_value")],
                         F.round(quantile(F.lit(0.25)), digits).alias("p25"), F.round(quantile(F.lit(0.75)), digits).alias("p75"))
    ranks = F.array(*[F.lit((i + 0.5) / points) for i in range(points)])
    spread = state.select("field", "n_samples", F.posexplode(quantile(ranks)).alias("i", "value"))
    share = F.floor(F.col("n_samples") * (F.col("i") + 1) / points) - F.floor(F.col("n_samples") * F.col("i") / points)
    return stats.select("field", *STAT_COLUMNS), spread.groupBy("field", "value").agg(F.sum(share).cast("long").alias("n")).filter("n > 0")
