"""Z-score outlier detection against a per-field baseline.

All per-event work is a narrow projection: the baseline (one row per field)
is inlined as literals, so there is no join and no shuffle.  Summaries are
single global aggregations with map-side partial aggregation; per-field
summaries reshape the one-row aggregate, never the event rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from healthwatch.functions.fields import ZSCORE_THRESHOLD
from healthwatch.operators.baseline import stats_map


def zscore(value: Column, mean: Column | float, std: Column | float) -> Column:
    """``abs((v - mean) / std)``, 0.0 when std == 0; null when v is null."""
    mean = mean if isinstance(mean, Column) else F.lit(mean)
    std = std if isinstance(std, Column) else F.lit(std)
    return F.when(value.isNull(), F.lit(None).cast("double")) \
            .when(std == 0, F.lit(0.0)) \
            .otherwise(F.abs((value - mean) / std))


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def zscore_flags(df: DataFrame, stats: DataFrame | dict, threshold: float = ZSCORE_THRESHOLD,
                 fields: list[str] | None = None) -> DataFrame:
    """Add per-field ``z_<f>`` plus ``anomalous_fields`` (sorted names with
    unrounded z > threshold), ``n_anomalous``, ``max_zscore`` (rounded 2) and
    ``is_anomalous``.  Fields absent from the frame or the baseline are
    skipped; a null value is never flagged.  The expressions are SQL text
    with the baseline inlined as literals (one parse each, no join)."""
    sm = stats if isinstance(stats, dict) else stats_map(stats)
    fields = [f for f in (fields or list(sm)) if f in sm and f in df.columns]

    def z(f):
        mean, std = sm[f]
        v = f"CAST({_q(f)} AS DOUBLE)"
        if std is None or mean is None:
            return "CAST(NULL AS DOUBLE)"
        return (f"CASE WHEN {v} IS NULL THEN CAST(NULL AS DOUBLE) WHEN CAST({std!r} AS DOUBLE) = 0 "
                f"THEN CAST(0 AS DOUBLE) ELSE abs(({v} - CAST({mean!r} AS DOUBLE)) / CAST({std!r} AS DOUBLE)) END")

    out = df.withColumns({f"z_{f}": F.expr(z(f)) for f in fields})
    zc = [_q(f"z_{f}") for f in fields]
    if fields:
        names = sorted(zip(fields, zc))
        flagged = "array(" + ", ".join(f"CASE WHEN {c} > {threshold!r} THEN '{f}' END" for f, c in names) + ")"
        maxz = "greatest(" + ", ".join(f"CASE WHEN {c} > {threshold!r} THEN round({c}, 2) END" for c in zc) + ")" \
            if len(zc) > 1 else f"CASE WHEN {zc[0]} > {threshold!r} THEN round({zc[0]}, 2) END"
    else:
        flagged, maxz = "CAST(array() AS ARRAY<STRING>)", "CAST(NULL AS DOUBLE)"
    return (out.withColumn("anomalous_fields", F.expr(f"array_compact({flagged})"))
               .withColumns({"n_anomalous": F.size("anomalous_fields"),
                             "is_anomalous": F.size("anomalous_fields") > 0,
                             "max_zscore": F.expr(maxz)}))


def zscore_summary(flags: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """total_events, flagged_events, flag_rate (round 3; 0 when empty),
    fault_detected — per ``keys`` group or over the whole frame."""
    keys = keys or []
    g = flags.groupBy(*keys) if keys else flags
    agg = g.agg(F.count(F.lit(1)).alias("total_events"),
                F.count_if(F.col("is_anomalous")).alias("flagged_events"))
    return agg.select(*keys, "total_events", "flagged_events",
                      F.when(F.col("total_events") > 0,
                             F.round(F.col("flagged_events") / F.col("total_events"), 3))
                       .otherwise(F.lit(0.0)).alias("flag_rate"),
                      (F.col("flagged_events") > 0).alias("fault_detected"))


def zscore_by_field(flags: DataFrame, threshold: float = ZSCORE_THRESHOLD,
                    fields: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Per anomalous field: count, max and mean of the already-rounded z
    (each rounded 2).  One aggregation pass over the wide flags."""
    keys = keys or []
    fields = fields or [c[2:] for c in flags.columns if c.startswith("z_")]
    aggs = []
    for f in fields:
        z = F.col(f"z_{f}")
        rz = F.when(z > threshold, F.round(z, 2))
        aggs += [F.count_if(z > threshold).alias(f"{f}__count"),
                 F.round(F.max(rz), 2).alias(f"{f}__max"),
                 F.round(F.avg(rz), 2).alias(f"{f}__avg")]
    g = flags.groupBy(*keys) if keys else flags
    wide = g.agg(*aggs)
    rows = [F.struct(F.lit(f).alias("field"), F.col(f"{f}__count").alias("count"),
                     F.col(f"{f}__max").alias("max_zscore"),
                     F.col(f"{f}__avg").alias("avg_zscore")) for f in fields]
    return (wide.select(*keys, F.explode(F.array(*rows)).alias("r"))
                .select(*keys, "r.*").filter(F.col("count") > 0))
