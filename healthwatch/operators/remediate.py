"""Table repairs as pure DataFrame rewrites (UPDATE / DELETE semantics on
immutable files), their affected-row counts, and steady-state validation.

Every fix is narrow (a projection or filter — no shuffle).  An UPDATE's
predicate is evaluated on the *old* values inside one projection, exactly
like a SQL UPDATE.  Persisting a fix writes a new table path; callers swap
paths afterwards and never overwrite the path they read from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from healthwatch.functions import fields as fd
from healthwatch.functions import predicates as pr
from healthwatch.functions.columns import safe_abs_hash


def jitter_hash(key: Column, method: str = "murmur3") -> Column:
    """Non-negative per-key integer driving the imputation jitter.

    ``murmur3``: ``abs(hash(key))`` — Spark's ``hash`` is Murmur3 with seed
    42, the same function SQL warehouses on Spark evaluate; widened to BIGINT
    before ``abs``.  ``md5``: the first 8 hex digits of ``md5(key)``, a form
    any SQL engine can reproduce."""
    if method == "md5":
        return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
    return safe_abs_hash(key)


def jitter(h: Column, base: float, modulus: int) -> Column:
    """``base + (h % modulus) / 10``."""
    return F.lit(float(base)) + (h % modulus) / F.lit(10.0)


def impute_null(df: DataFrame, col: str = "spo2", key: str = "patient_id", method: str = "murmur3",
                base: float | None = None, modulus: int | None = None) -> DataFrame:
    """UPDATE t SET col = jitter WHERE col IS NULL."""
    b, m = fd.JITTER[col] if base is None else (base, modulus)
    h = jitter_hash(F.col(key), method)
    return df.withColumn(col, F.when(F.col(col).isNull(), jitter(h, b, m)).otherwise(F.col(col)))


def impute_impossible(df: DataFrame, key: str = "patient_id", method: str = "murmur3",
                      predicate: Column | None = None) -> DataFrame:
    """UPDATE t SET heart_rate, bp_systolic, spo2 = jitter WHERE hr > 200 OR
    bp_systolic > 180 OR spo2 < 70 — all three replaced, the predicate read
    from the old values (a NULL predicate leaves the row unchanged)."""
    pred = F.coalesce(predicate if predicate is not None else pr.impossible(), F.lit(False))
    h = jitter_hash(F.col(key), method)
    return df.withColumns({c: F.when(pred, jitter(h, b, m)).otherwise(F.col(c))
                           for c, (b, m) in fd.JITTER.items()})


def impute_constant(df: DataFrame, fill: dict | None = None) -> DataFrame:
    """Runbook form: hr = 80, bp_systolic = 120 WHERE hr > 200 OR bp > 180;
    then spo2 = 97.6 WHERE spo2 IS NULL."""
    fill = fill or fd.CONSTANT_FILL
    pred = F.coalesce((F.col("heart_rate") > fd.IMPOSSIBLE_HR) | (F.col("bp_systolic") > fd.IMPOSSIBLE_BP),
                      F.lit(False))
    return df.withColumns({
        "heart_rate": F.when(pred, F.lit(fill["heart_rate"])).otherwise(F.col("heart_rate")),
        "bp_systolic": F.when(pred, F.lit(fill["bp_systolic"])).otherwise(F.col("bp_systolic")),
        "spo2": F.coalesce(F.col("spo2"), F.lit(fill["spo2"])),
    })


def drop_impossible(df: DataFrame, predicate: Column | None = None) -> DataFrame:
    """DELETE FROM t WHERE pred — rows whose predicate is NULL are kept."""
    pred = predicate if predicate is not None else pr.impossible()
    return df.filter(~F.coalesce(pred, F.lit(False)))


def clean_id(raw: str) -> str:
    """Strip whitespace, then surrounding quotes, from a typed-in id."""
    return raw.strip().strip("'").strip('"')


def quarantine(df: DataFrame, patient_id: str, key: str = "patient_id") -> tuple[DataFrame, DataFrame]:
    """(kept, removed): DELETE FROM t WHERE key = id, plus the removed rows
    for a quarantine table.  NULL keys are kept."""
    pid = clean_id(patient_id)
    hit = F.coalesce(F.col(key) == pid, F.lit(False))
    return df.filter(~hit), df.filter(hit)


def evolve_schema(df: DataFrame, add: dict | None = None, drop_null: list[str] | None = None) -> DataFrame:
    """ADD COLUMN IF NOT EXISTS for each ``name -> type``; then drop rows
    with NULL in ``drop_null`` columns."""
    for name, typ in (add or {}).items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(typ))
    return df.na.drop(subset=drop_null) if drop_null else df


def fix_impact(df: DataFrame, attacker: str = fd.ATTACKER_ID) -> DataFrame:
    """Rows each fix would touch, from one aggregation pass before any fix."""
    imp = F.coalesce(pr.impossible(), F.lit(False))
    agg = df.agg(F.count_if(F.col("spo2").isNull()).alias("impute_spo2"),
                 F.count_if(imp).alias("impute_vitals"),
                 F.count_if(imp).alias("delete_impossible"),
                 F.count_if(F.coalesce(F.col("patient_id") == attacker, F.lit(False))).alias("quarantine"))
    names = ["impute_spo2", "impute_vitals", "delete_impossible", "quarantine"]
    return agg.select(F.explode(F.array(*[F.struct(F.lit(n).alias("fix"), F.col(n).cast("long").alias("affected_rows"))
                                          for n in names])).alias("r")).select("r.*")


def apply_plan(df: DataFrame, codes: list[str], mode: str = "jitter", method: str = "murmur3",
               attacker: str = fd.ATTACKER_ID) -> tuple[DataFrame, DataFrame, list[str]]:
    """Carry out the repair steps of an action plan in its order.

    ``codes`` are the plan's action codes (a handful, see
    ``triage.plan_codes``): D quarantines ``attacker``; A repairs impossible
    vitals by ``mode`` (``jitter``, ``constant`` or ``delete``); B imputes a
    missing spo2.  Other codes change no rows.  Returns (repaired rows,
    quarantined rows, codes that changed the table): what an incident reports
    as done is what was done."""
    if mode not in ("jitter", "constant", "delete"):
        raise ValueError(f"unknown repair mode {mode!r}")
    removed, done = df.filter(F.lit(False)), []
    for code in codes:
        if code == "D":
            df, removed = quarantine(df, attacker)
        elif code == "A":
            df = {"jitter": lambda x: impute_impossible(x, method=method), "constant": impute_constant,
                  "delete": drop_impossible}[mode](df)
        elif code == "B":
            df = impute_null(df, "spo2", method=method)
        else:
            continue
        done.append(code)
    return df, removed, done


def write_fixed(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Persist a repaired table to a NEW path (swap afterwards)."""
    df.write.mode("overwrite").format(fmt).save(path)


SINK_DDL = T.StructType([
    T.StructField("event_id", T.StringType()), T.StructField("patient_id", T.StringType()),
    T.StructField("ward", T.StringType()), T.StructField("heart_rate", T.DoubleType()),
    T.StructField("bp_systolic", T.DoubleType()), T.StructField("bp_diastolic", T.DoubleType()),
    T.StructField("spo2", T.DoubleType()), T.StructField("temperature_c", T.DoubleType()),
    T.StructField("respiratory_rate", T.DoubleType()), T.StructField("timestamp", T.StringType()),
])


def reset_table(spark, path: str) -> DataFrame:
    """(Re)create the empty sink table with its 10 typed columns."""
    empty = spark.createDataFrame([], SINK_DDL)
    empty.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def repair_vitals(df: DataFrame, mode: str = "jitter", key: str = "patient_id",
                  method: str = "murmur3") -> DataFrame:
    """Repair impossible vitals and missing spo2 in one call.

    ``jitter`` (default): all three vitals of an impossible row get per-key
    jitter, then NULL spo2 gets jitter; ``constant``: the runbook constants;
    ``delete``: impossible rows are removed, then NULL spo2 gets jitter."""
    if mode == "jitter":
        return impute_null(impute_impossible(df, key, method), "spo2", key, method)
    if mode == "constant":
        return impute_constant(df)
    if mode == "delete":
        return impute_null(drop_impossible(df), "spo2", key, method)
    raise ValueError(f"unknown repair mode {mode!r}")
