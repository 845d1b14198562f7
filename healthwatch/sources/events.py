"""Event sources and sinks: last-N reads, JSON decode, schema-aligned
appends, fixed projections, counts, topic totals and file round trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from healthwatch.functions.fields import NUMERIC_FIELDS

# Sink table: the 10 event columns (timestamp kept as the event's own type).
SINK_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("event_id", "patient_id", "ward")]
    + [T.StructField(c, T.DoubleType()) for c in NUMERIC_FIELDS]
    + [T.StructField("timestamp", T.StringType())])

# Decoded JSON event: all known keys plus the corrupt-record holder.
EVENT_JSON_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("event_id", "patient_id", "ward")]
    + [T.StructField(c, T.DoubleType()) for c in NUMERIC_FIELDS]
    + [T.StructField("diagnosis_code", T.StringType()),
       T.StructField("timestamp", T.StringType()),
       T.StructField("_corrupt", T.StringType())])

IOT_COLUMNS = ["patient_id", "heart_rate", "spo2", "timestamp"]


def latest_n(df: DataFrame, order: list[str | Column], n: int = 50, by: list[str] | None = None,
             salt: int = 16) -> DataFrame:
    """The newest ``n`` rows by ``order`` (descending).

    Without ``by`` this is a global top-k: Spark plans TakeOrderedAndProject
    (per-partition top-k, then one merge of n x partitions rows).  With
    ``by`` it is the newest n per key; a hot key is first cut by a salt so no
    task ranks more than ~1/salt of one key, then the per-salt winners
    (<= n x salt per key) are ranked again."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    desc = [c.desc() for c in cols]
    if not by:
        return df.orderBy(*desc).limit(n)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salt)))
    w1 = Window.partitionBy(*by, "_salt").orderBy(*desc)
    first = salted.withColumn("_rn", F.row_number().over(w1)).filter(F.col("_rn") <= n)
    w2 = Window.partitionBy(*by).orderBy(*desc)
    return (first.withColumn("_rn", F.row_number().over(w2)).filter(F.col("_rn") <= n)
                 .drop("_rn", "_salt"))


def decode_events(df: DataFrame, col: str = "raw", schema: T.StructType = EVENT_JSON_SCHEMA,
                  keep_corrupt: bool = False) -> DataFrame:
    """Parse JSON text once into a ``map<string,string>``: its keys are the
    present keys (a key with a JSON null is still present, a repeated key is
    listed once and its last value counts) and the known fields are cast from
    it; a value of the wrong type becomes NULL and the row stays.  Malformed
    rows parse to NULL and are skipped, or kept with ``keep_corrupt`` (fields
    NULL, ``_corrupt`` = the text).  The parsed map is exploded as a
    one-element array, so each text is parsed once and the filter does not
    repeat the parse."""
    m = F.from_json(F.col(col), T.MapType(T.StringType(), T.StringType()), {"mode": "PERMISSIVE"})
    one = F.array(m) if keep_corrupt else F.filter(F.array(m), lambda x: x.isNotNull())
    parsed = df.select("*", F.explode(one).alias("_m"))
    names = [f for f in schema.fields if f.name != "_corrupt"]
    keep = [c for c in df.columns if c != col and c not in schema.fieldNames()]
    keys = F.map_keys("_m")
    repeated = F.size(keys) != F.size(F.array_distinct(keys))

    def value(name: str) -> Column:
        last = F.element_at(F.filter(F.map_entries("_m"), lambda e: e["key"] == name), -1)["value"]
        return F.when(repeated & F.array_contains(keys, name), last).otherwise(F.col("_m")[name])

    out = parsed.select(*keep, *[value(f.name).try_cast(f.dataType).alias(f.name) for f in names],
                        F.when(F.col("_m").isNull(), F.col(col)).alias("_corrupt"),
                        F.array_sort(F.array_distinct(keys)).alias("keys"))
    return out if keep_corrupt else out.drop("_corrupt")


def decode_variant(df: DataFrame, col: str = "raw", schema: T.StructType = EVENT_JSON_SCHEMA, name: str = "event") -> DataFrame:
    """Parse JSON text once to VARIANT: the known fields with their types, the
    present ``keys`` (a key with a JSON null is present), ``key_types`` (the
    type of each key's value) and the variant itself as ``name``.  Malformed
    text and values that are no object are skipped; a value of another type
    than its field becomes NULL.  A key that occurs twice in one object makes
    it malformed (``decode_events`` takes the last one instead)."""
    v = F.try_parse_json(F.col(col))
    keep = [F.col(c) for c in df.columns if c != col and c not in schema.fieldNames()]
    parsed = df.select("*", F.explode(F.array(v)).alias(name)).filter(F.startswith(F.schema_of_variant(name), F.lit("OBJECT<")))
    members = parsed.withColumn("_m", F.expr(f"CAST({name} AS MAP<STRING, VARIANT>)"))
    fields = [F.try_variant_get(F.col(name), F.lit(f"$['{f.name}']"), f.dataType.simpleString()).alias(f.name) for f in schema.fields if f.name != "_corrupt"]
    return members.select(*keep, *fields, F.array_sort(F.map_keys("_m")).alias("keys"),
                          F.transform_values("_m", lambda k, x: F.schema_of_variant(x)).alias("key_types"), name)


def corrupt_count(df: DataFrame, col: str = "raw") -> DataFrame:
    """Number of malformed JSON rows (the skipped-record metric)."""
    return df.agg(F.count_if(F.json_object_keys(F.col(col)).isNull()).alias("corrupt_rows"),
                  F.count(F.lit(1)).alias("total_rows"))


def align_to_schema(df: DataFrame, target: T.StructType, rename: dict | None = None) -> DataFrame:
    """Keep the target's columns (cast to its types, NULL where a value does
    not fit), drop unknown ones and
    add missing ones as typed NULLs — the schema-aligned append shape.  If the
    target has no columns, the frame passes unchanged."""
    if not target.fields:
        return df
    rename = rename or {}
    src = {rename.get(c, c): c for c in df.columns}
    return df.select(*[
        (F.col(src[f.name]).try_cast(f.dataType) if f.name in src else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in target.fields])


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append rows to a table folder (atomic per task commit)."""
    df.write.mode("append").format(fmt).save(path)


def iot_projection(df: DataFrame, rename: dict | None = None) -> DataFrame:
    """The IoT table's fixed columns (the insert clock column is added by the
    writer with ``current_timestamp()``)."""
    rename = rename or {"timestamp": "ts"}
    return df.select(*[F.col(rename.get(c, c)).alias(c) for c in IOT_COLUMNS])


def with_insert_time(df: DataFrame) -> DataFrame:
    return df.withColumn("inserted_at", F.current_timestamp())


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def topic_total(offsets: DataFrame) -> DataFrame:
    """Messages ever written per topic: the sum of partition high watermarks."""
    return offsets.groupBy("topic").agg(F.sum("high").alias("total_messages"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV sink with a header; array columns are written as comma-joined text
    (CSV has no nested types)."""
    out = df.select(*[F.array_join(F.col(f.name).cast("array<string>"), ",").alias(f.name)
                      if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema.fields])
    out.write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    """JSON-lines sink: one object a line, null fields written out, times to
    the microsecond."""
    (df.write.mode(mode).option("ignoreNullFields", "false").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
       .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path))


def read_jsonl(spark, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON-lines source; blank and malformed lines are skipped, a fixed schema
    avoids an inference pass over the data."""
    if schema is None:
        return spark.read.option("mode", "DROPMALFORMED").json(path)
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    lines = spark.read.text(path).filter(F.trim("value") != "")
    full = T.StructType([*fields.fields, T.StructField("_corrupt_line", T.StringType())])
    parsed = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_line"}).alias("r"))
    return parsed.filter(F.col("r._corrupt_line").isNull()).select(*[F.col(f"r.`{f.name}`") for f in fields.fields])


def malformed_lines(spark, path: str) -> DataFrame:
    """How many non-blank lines of a JSON-lines file are no JSON objects."""
    return corrupt_count(spark.read.text(path).filter(F.trim("value") != ""), "value")
