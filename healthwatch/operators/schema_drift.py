"""Structural schema drift: distance of each event's field set to contract
versions, the best-matching contract, and batch summaries.

Contracts are a handful of literal name lists, so each event is scored by
narrow expressions — no join with a contracts table and no shuffle until the
summary group-bys.  Table presence (a NULL value = a missing key) becomes an
integer bitmask and the set algebra ``bit_count``; JSON key presence (any key
may appear) uses ``array_except`` / ``array_intersect`` on the key arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from healthwatch.functions.fields import CONTRACTS, SCHEMA_THRESHOLD

# Column -> event key name where the table renames a key (ts holds "timestamp").
DEFAULT_RENAME = {"ts": "timestamp"}


def present_fields(df: DataFrame, columns: list[str] | None = None, presence: str = "non_null",
                   json_col: str = "raw", rename: dict | None = None) -> Column:
    """Sorted array of the event keys that are present.

    ``presence="non_null"``: a column counts when its value is not null (a
    NULL-valued key is treated as missing).  ``presence="json"``: the keys
    of the JSON object in ``json_col`` (NULL for malformed text)."""
    if presence == "json":
        return F.array_sort(F.json_object_keys(F.col(json_col)))
    rename = DEFAULT_RENAME if rename is None else rename
    columns = columns or df.columns
    return F.array_sort(F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull(), F.lit(rename.get(c, c))) for c in columns])))


def contract_distance(present: Column, expected: list[str]) -> tuple[Column, Column, Column, Column]:
    """(distance, match_rate, missing, extra) of a present-key array to one
    contract: ``(n_missing + n_extra) / (n_expected + n_extra)`` rounded 4,
    0 for an empty contract."""
    exp = F.array(*[F.lit(x) for x in expected]) if expected else F.array().cast("array<string>")
    missing = F.array_sort(F.array_except(exp, present))
    extra = F.array_sort(F.array_except(present, exp))
    matched = F.size(F.array_intersect(exp, present))
    n_exp = len(set(expected))
    if n_exp == 0:
        return F.lit(0.0), F.lit(0.0), missing, extra
    dist = F.round((F.size(missing) + F.size(extra)) / (F.lit(n_exp) + F.size(extra)), 4)
    rate = F.round(matched / F.lit(n_exp), 4)
    return dist, rate, missing, extra


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _s(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _mask_columns(df: DataFrame, contracts, threshold, rename, columns) -> DataFrame | None:
    """Bitmask form for table presence: bit i = column i is non-null.  Set
    algebra becomes integer ops (``bit_count(E & ~P)``), so per-row cost is a
    few machine instructions instead of array building and sorting.  The
    expressions are written as SQL text (one parse each) to keep plan
    construction cheap."""
    columns = columns or df.columns
    names = [rename.get(c, c) for c in columns]
    if len(names) > 62:
        return None
    full = (1 << len(names)) - 1
    bit = {n: 1 << i for i, n in enumerate(names)}
    pm = " + ".join(f"CASE WHEN {_q(c)} IS NOT NULL THEN {1 << i} ELSE 0 END" for i, c in enumerate(columns))
    out = df.withColumn("_pm", F.expr(f"CAST({pm or '0'} AS BIGINT)"))
    d_cols, miss, extra, absent, rates = [], [], [], [], []
    for ver, fields in contracts:
        exp = set(fields)
        e_mask = sum(bit[f] for f in exp if f in bit)
        k_absent = sorted(f for f in exp if f not in bit)        # never a column: always missing
        mm = f"(CAST({e_mask} AS BIGINT) & ~_pm)"
        em = f"(_pm & CAST({~e_mask & full} AS BIGINT))"
        n_exp = len(exp)
        if n_exp == 0:
            dist, rate = "CAST(0 AS DOUBLE)", "CAST(0 AS DOUBLE)"
        else:
            dist = (f"ROUND((bit_count({mm}) + {len(k_absent)} + bit_count({em})) / "
                    f"CAST({n_exp} + bit_count({em}) AS DOUBLE), 4)")
            rate = f"ROUND(bit_count(CAST({e_mask} AS BIGINT) & _pm) / CAST({n_exp} AS DOUBLE), 4)"
        d_cols.append(f"d_{ver}")
        miss.append(mm)
        extra.append(em)
        absent.append(k_absent)
        rates.append(rate)
        out = out.withColumn(f"d_{ver}", F.expr(dist))
    bi = "0"
    bd = d_cols[0]
    for idx in range(1, len(d_cols)):
        bi = f"CASE WHEN {d_cols[idx]} < {bd} THEN {idx} ELSE {bi} END"    # strict: ties keep the earlier
        bd = f"LEAST({bd}, {d_cols[idx]})"
    out = out.withColumns({"_bi": F.expr(bi), "distance": F.expr(bd)})

    def pick(exprs):
        e = exprs[0]
        for idx in range(1, len(exprs)):
            e = f"CASE WHEN _bi = {idx} THEN {exprs[idx]} ELSE {e} END"
        return e

    def names_of(mask_col, extra_names):
        items = ", ".join(f"CASE WHEN ({mask_col} & {bit[n]}) <> 0 THEN {_s(n)} END" for n in names)
        arr = f"array_compact(array({items}))"
        return F.expr(f"array_sort(concat({arr}, {extra_names}))")

    out = out.withColumns({"_mm": F.expr(pick(miss)), "_em": F.expr(pick(extra))})
    none = "CAST(array() AS ARRAY<STRING>)"
    absent_arr = pick([f"array({', '.join(_s(a) for a in ab)})" if ab else none for ab in absent])
    return (out.withColumns({
                "best_schema": F.expr(pick([_s(v) for v, _ in contracts])),
                "match_rate": F.expr(pick(rates)),
                "missing_fields": names_of("_mm", absent_arr),
                "extra_fields": names_of("_em", none),
                "anomaly_detected": F.col("distance") > threshold})
               .drop("_pm", "_bi", "_mm", "_em"))


def schema_check(df: DataFrame, contracts: list[tuple[str, list[str]]] | None = None,
                 threshold: float = SCHEMA_THRESHOLD, present: Column | None = None,
                 presence: str = "non_null", columns: list[str] | None = None,
                 rename: dict | None = None, json_col: str = "raw") -> DataFrame:
    """Add ``d_<version>`` per contract and the best match: ``best_schema``
    (smallest rounded distance, earliest version on a tie), ``distance``,
    ``match_rate``, ``missing_fields``, ``extra_fields`` and
    ``anomaly_detected`` (distance > threshold).

    Table presence (NULL = missing) uses integer bitmasks; JSON key presence
    (arbitrary extra keys) uses array set operations on ``present``."""
    contracts = contracts or CONTRACTS
    rename = DEFAULT_RENAME if rename is None else rename
    if present is None and presence == "non_null":
        out = _mask_columns(df, contracts, threshold, rename, columns)
        if out is not None:
            return out
    if present is None:
        present = present_fields(df, columns, presence, json_col, rename)
    out = df.withColumn("present", present)
    cands = []
    for idx, (ver, fields) in enumerate(contracts):
        dist, rate, miss, extra = contract_distance(F.col("present"), fields)
        out = out.withColumn(f"d_{ver}", dist)
        cands.append(F.struct(F.col(f"d_{ver}").alias("distance"), F.lit(idx).alias("idx"),
                              F.lit(ver).alias("best_schema"), rate.alias("match_rate"),
                              miss.alias("missing_fields"), extra.alias("extra_fields")))
    best = F.array_sort(F.array(*cands))[0]
    return (out.withColumn("best", best)
               .withColumns({"best_schema": F.col("best.best_schema"),
                             "distance": F.col("best.distance"),
                             "match_rate": F.col("best.match_rate"),
                             "missing_fields": F.col("best.missing_fields"),
                             "extra_fields": F.col("best.extra_fields")})
               .drop("best", "present")
               .withColumn("anomaly_detected", F.col("distance") > threshold))


def schema_summary(checked: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """total_events, flagged_events, flag_rate (round 3), fault_detected."""
    keys = keys or []
    g = checked.groupBy(*keys) if keys else checked
    return (g.agg(F.count(F.lit(1)).alias("total_events"),
                  F.count_if("anomaly_detected").alias("flagged_events"))
             .select(*keys, "total_events", "flagged_events",
                     F.when(F.col("total_events") > 0,
                            F.round(F.col("flagged_events") / F.col("total_events"), 3))
                      .otherwise(F.lit(0.0)).alias("flag_rate"),
                     (F.col("flagged_events") > 0).alias("fault_detected")))


def schema_field_counts(checked: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``(kind, field, count)``: how often each field was missing / extra,
    over flagged events only.  One explode of both tagged lists (a single
    scan), then a partially aggregated group-by."""
    keys = keys or []
    tagged = F.concat(F.transform("missing_fields", lambda x: F.struct(F.lit("missing").alias("kind"), x.alias("field"))),
                      F.transform("extra_fields", lambda x: F.struct(F.lit("extra").alias("kind"), x.alias("field"))))
    return (checked.filter("anomaly_detected").select(*keys, F.explode(tagged).alias("t"))
                   .groupBy(*keys, "t.kind", "t.field").agg(F.count(F.lit(1)).alias("count")))
