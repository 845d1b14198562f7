"""Two-sample Kolmogorov-Smirnov drift test, distributed.

A naive plan orders every sample row in one window per field (one task per
field holds all rows).  Instead:

1. collapse both samples to ``(field, value) -> (n_base, n_inc)`` with a
   partially aggregated group-by (a heavy value never skews a task) and
   write the collapsed table once (it has several consumers);
2. rank it with ``ranks.running_sums``: fields are cut into ranges of about
   ``RANGE_VALUES`` distinct values whose offsets come from the per-range
   totals, one plan at every size;
3. ``D = max |F_base - F_inc|`` per field, p-value on one row per field.

``ks_drift_by`` does the same for many batches at once without replicating
the baseline per batch.  The p-value is the asymptotic Kolmogorov series as a
built-in ``aggregate`` expression (``method="asymp"``), the exact lattice-path
p (``"exact"``, which raises above ``exact_max_n`` values instead of changing
the method) or, by the caller's choice, the exact one up to that size and the
asymptotic one beyond (``"auto"``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from healthwatch.functions.fields import KS_ALPHA, KS_MIN_SAMPLES
from healthwatch.functions.columns import combine_rows
from healthwatch.operators.baseline import melt
from healthwatch.operators.ranks import RANGE_VALUES, running_sums
from healthwatch.session import ship_package, write_table



def ks_pvalue(lam: Column, terms: int = 100) -> Column:
    """Asymptotic p = 2 * sum_{k=1..terms} (-1)^(k-1) exp(-2 k^2 lam^2); 1 when lam < 0.3."""
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, F.lit(1)).otherwise(F.lit(-1))
        * F.exp(-2 * k * k * lam * lam))
    return F.when(lam < 0.3, F.lit(1.0)).otherwise(2 * series)


def collapse(base_hist: DataFrame, incoming: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """``(field, value, na, nb)``: counts of each distinct value in the
    baseline (a) and incoming (b) samples."""
    inc = melt(incoming, fields).select("field", "value", F.lit(0).cast("long").alias("na"),
                                        F.lit(1).cast("long").alias("nb"))
    if fields:
        base_hist = base_hist.filter(F.col("field").isin(fields))
    base = base_hist.select("field", "value", F.col("n").cast("long").alias("na"),
                            F.lit(0).cast("long").alias("nb"))
    return (base.unionByName(inc).groupBy("field", "value")
                .agg(F.sum("na").cast("double").alias("na"), F.sum("nb").cast("double").alias("nb")))


def field_summary(g: DataFrame) -> DataFrame:
    """One aggregation over the collapsed table per field: sample sizes,
    distinct-value count and sums for the means."""
    aggs = [F.sum("na").alias("n"), F.sum("nb").alias("m"), F.count(F.lit(1)).alias("n_values"),
            F.sum(F.col("value") * F.col("na")).alias("sum_a"), F.sum(F.col("value") * F.col("nb")).alias("sum_b")]
    return g.groupBy("field").agg(*aggs)


def ecdf_gap(g: DataFrame, per_field: DataFrame | None = None, range_values: int = RANGE_VALUES) -> DataFrame:
    """Per field: ``ks = max |F_a(v) - F_b(v)|`` over all distinct v, with
    ``n`` (baseline) and ``m`` (incoming) sample sizes.

    Running sums come from ``ranks.running_sums``, so a window partition
    holds about ``range_values`` distinct values whatever the field's size."""
    fs = per_field if per_field is not None else field_summary(g)
    r = running_sums(g.select("field", "value", "na", "nb"), ["na", "nb"], range_values=range_values)
    cum = (r.join(F.broadcast(fs.select("field", "n", "m")), "field")          # one row per field
            .select("field", "n", "m", F.try_divide(F.col("cum_na"), F.col("n")).alias("fa"),
                    F.try_divide(F.col("cum_nb"), F.col("m")).alias("fb")))
    return cum.groupBy("field").agg(F.max(F.abs(F.col("fa") - F.col("fb"))).alias("ks"),
                                    F.max("n").alias("n"), F.max("m").alias("m"))


def ks_drift(incoming: DataFrame, base_hist: DataFrame, fields: list[str] | None = None,
             alpha: float = KS_ALPHA, min_samples: int = KS_MIN_SAMPLES,
             range_values: int = RANGE_VALUES, base_stats: DataFrame | None = None,
             method: str = "asymp", exact_max_n: int = 10000) -> DataFrame:
    """Per field with >= ``min_samples`` incoming values: ``ks_statistic``
    (round 4), ``p_value`` (round 6), ``drifted`` (unrounded p < alpha),
    sample sizes and, from the collapsed table, incoming/baseline means and
    their shift (round 2; the baseline mean is the stored 4-digit one)."""
    # The collapsed table feeds four consumers whose pruned subtrees differ,
    # so exchange reuse cannot share it: cut its lineage once.  It holds one
    # row per distinct (field, value) — bounded by value resolution, not by
    # row count — and the reliable checkpoint survives executor loss.
    g = write_table(collapse(base_hist, incoming, fields), "ks-collapsed")
    fs = field_summary(g)
    d = ecdf_gap(g, fs, range_values).filter((F.col("m") >= min_samples) & (F.col("n") > 0))
    means = fs.select("field", F.try_divide(F.col("sum_b"), F.col("m")).alias("inc_mean"),
                      F.round(F.try_divide(F.col("sum_a"), F.col("n")), 4).alias("base_mean"))
    if base_stats is not None:
        means = means.drop("base_mean").join(
            F.broadcast(base_stats.select("field", F.col("mean").alias("base_mean"))), "field")
    if method in ("exact", "auto"):
        # "auto" (the common library default) takes the asymptotic p above
        # exact_max_n values, "exact" raises there
        d = _exact_p(d, exact_max_n, strict=method == "exact")
    else:
        lam = F.col("ks") * F.sqrt(F.col("n") * F.col("m") / (F.col("n") + F.col("m")))
        d = d.withColumn("p", ks_pvalue(lam))
    return (d.join(F.broadcast(means), "field")                     # one row per field
             .select("field",
                     F.round("ks", 4).alias("ks_statistic"),
                     F.round("p", 6).alias("p_value"),
                     (F.col("p") < alpha).alias("drifted"),
                     F.col("n").cast("long").alias("n_baseline"),
                     F.col("m").cast("long").alias("n_incoming"),
                     F.round("inc_mean", 2).alias("incoming_mean"),
                     F.round("base_mean", 2).alias("baseline_mean"),
                     F.round(F.col("inc_mean") - F.col("base_mean"), 2).alias("mean_shift")))


def ks_summary(drift: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row: events_tested (all incoming events), drift_detected and the
    sorted drifted fields.  The two one-row aggregates are combined by a
    union and a global aggregate, not a join."""
    d = drift.agg(F.array_sort(F.collect_list(F.when(F.col("drifted"), F.col("field"))))
                  .alias("drifted_fields"))
    n = incoming.agg(F.count(F.lit(1)).alias("events_tested"))
    return combine_rows(n, d).select(
        "events_tested", (F.size("drifted_fields") > 0).alias("drift_detected"), "drifted_fields")


# ---------------------------------------------------------------- exact p
def ks_exact_pvalue(d: float, n: int, m: int) -> float:
    """Exact two-sided p-value ``P(D >= d)`` for sample sizes n, m.

    Counts monotone lattice paths (0,0)->(n,m) that stay strictly inside the
    band ``|i/n - j/m| < d`` (Hodges 1957).  The band is a contiguous range of
    j in each row, so each row is one cumulative sum; rows are rescaled to
    avoid overflow and the scale is carried in logs."""
    import numpy as np

    if d <= 0:
        return 1.0
    g = math.gcd(n, m)
    # D is a multiple of g/(n*m); work in integer units of |i*m - j*n|.
    h = round(d * n * m / g) * g
    j = np.arange(m + 1)
    prev = np.where(np.abs(0 * m - j * n) < h, 1.0, 0.0)
    prev = np.cumprod(prev)                     # row 0: contiguous from j=0
    logscale = 0.0
    for i in range(1, n + 1):
        inside = np.abs(i * m - j * n) < h
        cur = np.zeros(m + 1)
        idx = np.nonzero(inside)[0]
        if idx.size == 0:
            return 1.0
        lo, hi = idx[0], idx[-1]
        cur[lo:hi + 1] = np.cumsum(prev[lo:hi + 1])
        s = cur.max()
        if s <= 0:
            return 1.0
        prev = cur / s
        logscale += math.log(s)
    if prev[m] <= 0:
        return 1.0
    logtotal = math.lgamma(n + m + 1) - math.lgamma(n + 1) - math.lgamma(m + 1)
    inside_p = math.exp(math.log(prev[m]) + logscale - logtotal)
    return min(1.0, max(0.0, 1.0 - inside_p))


def _exact_p(d: DataFrame, max_n: int, strict: bool) -> DataFrame:
    """Add ``p``: exact where both samples have at most ``max_n`` values;
    above, an error if ``strict``, else asymptotic.  A pandas function over the per-field result (one
    row per field), never over sample rows."""
    import pandas as pd

    ship_package(d.sparkSession)
    lam = F.col("ks") * F.sqrt(F.col("n") * F.col("m") / (F.col("n") + F.col("m")))
    d = d.withColumn("p", ks_pvalue(lam))

    def fn(it):
        for pdf in it:
            if strict and ((pdf["n"] > max_n) | (pdf["m"] > max_n)).any():
                raise ValueError(f"the exact p-value is limited to {max_n} values a sample; choose method='asymp' or 'auto'")
            ps = [ks_exact_pvalue(float(k), int(n), int(m)) if n <= max_n and m <= max_n else p
                  for k, n, m, p in zip(pdf["ks"], pdf["n"], pdf["m"], pdf["p"])]
            yield pdf.assign(p=pd.Series(ps, index=pdf.index, dtype="float64"))

    return d.mapInPandas(fn, d.schema)


# ---------------------------------------------------------------- per-batch KS
def ks_drift_by(incoming: DataFrame, base_hist: DataFrame, keys: list[str], fields: list[str] | None = None,
                alpha: float = KS_ALPHA, min_samples: int = KS_MIN_SAMPLES,
                range_values: int = RANGE_VALUES) -> DataFrame:
    """KS drift of every batch (``keys`` group) against one baseline.

    The supremum of |F_a - F_b| is reached at an incoming value v, either at
    v itself or just below it, so each batch needs the baseline CDF only at
    its own values: ``F_a(v)`` and ``F_a(v-)``.  Those depend on (field, v)
    alone, so they are computed ONCE for the distinct incoming values of all
    batches (the same collapsed-ECDF machinery as ``ks_drift``) and
    equi-joined back.  The batches' own running sums use the same ranges per
    (batch, field), so a large batch is split too — and the baseline is never
    replicated per batch."""
    inc = (melt(incoming, fields, ids=keys).groupBy(*keys, "field", "value")
           .agg(F.count(F.lit(1)).cast("double").alias("nb")))
    inc = write_table(inc, "ks-batches")
    points = inc.select("field", "value").distinct().select(
        "field", "value", F.lit(0).cast("long").alias("na"), F.lit(1).cast("long").alias("nb"))
    if fields:
        base_hist = base_hist.filter(F.col("field").isin(fields))
    base = base_hist.select("field", "value", F.col("n").cast("long").alias("na"), F.lit(0).cast("long").alias("nb"))
    g = (base.unionByName(points).groupBy("field", "value")
             .agg(F.sum("na").cast("double").alias("na"), F.max("nb").alias("is_point")))
    g = write_table(g, "ks-points")
    n = g.groupBy("field").agg(F.sum("na").alias("n"))                       # one row per field
    cdf = (running_sums(g, ["na"], range_values=range_values)
           .filter(F.col("is_point") == 1)
           .join(F.broadcast(n), "field")
           .select("field", "value", "n",
                   F.try_divide(F.col("cum_na"), F.col("n")).alias("fa"),
                   F.try_divide(F.col("cum_na") - F.col("na"), F.col("n")).alias("fa_lt")))
    sizes = inc.groupBy(*keys, "field").agg(F.sum("nb").alias("m"))         # one row per (batch, field)
    ranked = running_sums(inc, ["nb"], [*keys, "field"], range_values).withColumnRenamed("cum_nb", "cb")
    per = (ranked.join(sizes, [*keys, "field"]).join(cdf, ["field", "value"])
              .select(*keys, "field", "n", "m",
                      F.greatest(F.abs(F.col("fa") - F.col("cb") / F.col("m")),
                                 F.abs(F.col("fa_lt") - (F.col("cb") - F.col("nb")) / F.col("m"))).alias("gap")))
    d = (per.groupBy(*keys, "field").agg(F.max("gap").alias("ks"), F.max("n").alias("n"), F.max("m").alias("m"))
            .filter((F.col("m") >= min_samples) & (F.col("n") > 0)))
    lam = F.col("ks") * F.sqrt(F.col("n") * F.col("m") / (F.col("n") + F.col("m")))
    p = ks_pvalue(lam)
    return d.select(*keys, "field", F.round("ks", 4).alias("ks_statistic"), F.round(p, 6).alias("p_value"),
                    (p < alpha).alias("drifted"), F.col("n").cast("long").alias("n_baseline"),
                    F.col("m").cast("long").alias("n_incoming"))
