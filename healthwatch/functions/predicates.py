"""Row predicates and display projections over vitals events (narrow
expressions only: no shuffle, whole-stage codegen end to end)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from healthwatch.functions import fields as fd


def has(c: str) -> Column:
    """Key presence in the table form (a NULL value counts as missing)."""
    return F.col(c).isNotNull()


def suspicious(attacker: str = fd.ATTACKER_ID) -> Column:
    """spo2 absent OR diagnosis_code present OR heart_rate > 200 (absent => 80)
    OR the attacker id."""
    return (~has("spo2") | has("diagnosis_code")
            | (F.coalesce(F.col("heart_rate"), F.lit(80.0)) > 200)
            | F.coalesce(F.col("patient_id") == attacker, F.lit(False)))


def unknown_keys(present: Column, known: list[str] | None = None) -> Column:
    known = known or fd.DASHBOARD_KNOWN_FIELDS
    return F.array_except(present, F.array(*[F.lit(k) for k in known]))


def row_anomaly(present: Column, known: list[str] | None = None,
                attacker: str = fd.ATTACKER_ID) -> Column:
    """spo2 absent OR any unknown key OR hr > 200 OR spo2 < 70 OR attacker."""
    return (~has("spo2") | (F.size(unknown_keys(present, known)) > 0)
            | F.coalesce(F.col("heart_rate") > 200, F.lit(False))
            | F.coalesce(F.col("spo2") < 70, F.lit(False))
            | F.coalesce(F.col("patient_id") == attacker, F.lit(False)))


def impossible(hr: float = fd.IMPOSSIBLE_HR, bp: float = fd.IMPOSSIBLE_BP,
               spo2: float = fd.IMPOSSIBLE_SPO2) -> Column:
    """SQL three-valued ``hr > 200 OR bp_systolic > 180 OR spo2 < 70``."""
    return (F.col("heart_rate") > hr) | (F.col("bp_systolic") > bp) | (F.col("spo2") < spo2)


def display_rows(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Dashboard table: values rounded to 1 decimal as text; a missing
    heart_rate shows a dash, a missing spo2 ``MISSING``; a null or zero
    bp_systolic / respiratory_rate shows a dash."""
    dash = F.lit("—")

    def r1(c):
        return F.round(F.col(c), 1).cast("string")

    def truthy(c):
        return F.col(c).isNotNull() & (F.col(c) != 0)

    return df.select(
        *(keep or []),
        F.coalesce(F.col("patient_id"), F.lit("")).alias("patient_id"),
        F.coalesce(r1("heart_rate"), dash).alias("heart_rate"),
        F.coalesce(r1("spo2"), F.lit("MISSING")).alias("spo2"),
        F.when(truthy("bp_systolic"), r1("bp_systolic")).otherwise(dash).alias("bp_systolic"),
        F.when(truthy("respiratory_rate"), r1("respiratory_rate")).otherwise(dash).alias("resp_rate"),
        F.coalesce(F.col("ward"), F.lit("")).alias("ward"))


def contract_violations(df: DataFrame, required: list[str] | None = None,
                        enums: dict | None = None, bounds: dict | None = None,
                        rename: dict | None = None) -> Column:
    """Sorted array of violated declared rules: ``required:<f>`` (absent),
    ``enum:<f>`` (value outside the list), ``min:<f>`` / ``max:<f>``."""
    required = fd.CONTRACT_REQUIRED if required is None else required
    enums = fd.CONTRACT_ENUMS if enums is None else enums
    bounds = fd.CONTRACT_BOUNDS if bounds is None else bounds
    rename = {"timestamp": "ts"} if rename is None else rename
    checks = []
    for f in required:
        c = rename.get(f, f)
        checks.append(F.when(F.col(c).isNull(), F.lit(f"required:{f}")))
    for f, allowed in enums.items():
        checks.append(F.when(~F.col(f).isin(allowed), F.lit(f"enum:{f}")))
    for f, (lo, hi) in bounds.items():
        checks.append(F.when(F.col(f) < lo, F.lit(f"min:{f}")))
        checks.append(F.when(F.col(f) > hi, F.lit(f"max:{f}")))
    return F.array_sort(F.array_compact(F.array(*checks)))


def range_violations(df: DataFrame, ranges: dict | None = None) -> DataFrame:
    """Per field: values checked and values outside the normal range — one
    aggregation pass over the wide table, reshaped afterwards."""
    ranges = ranges or fd.NORMAL_RANGES
    aggs = []
    for f, (lo, hi) in ranges.items():
        aggs += [F.count(f).alias(f"{f}__n"),
                 F.count_if(~F.col(f).between(lo, hi)).alias(f"{f}__out")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(f).alias("field"), F.col(f"{f}__n").alias("n_checked"),
                     F.col(f"{f}__out").alias("n_outside")) for f in ranges]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def classify_log_lines(df: DataFrame, col: str = "line", rules: DataFrame | None = None) -> DataFrame:
    """Drop blank lines, trim, and tag each line with the category of the first
    ``log`` rule whose pattern it contains (``plain`` without one)."""
    from healthwatch.operators import rules as rl
    t = F.regexp_replace(F.col(col), r"^\s+|\s+$", "")
    trimmed = df.withColumn(col, t).filter(F.length(col) > 0)
    ruled = rl.with_rule(trimmed, rl.default_rules(df.sparkSession) if rules is None else rules, "log", col)
    return ruled.withColumn("category", F.coalesce("rule.code", F.lit("plain"))).drop("rule")
