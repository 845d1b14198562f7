"""Rules as rows: which rule applies to a name or a line of text.

A rule table has the columns ``kind``, ``pattern``, ``exact`` (the text equals
the pattern, else contains it), ``folded`` (letter case does not count),
``priority`` (the smallest that matches applies; ties: the pattern first in
code-point order) and the payload ``code``, ``rank`` and ``text``.  A user adds
a rule by adding a row.

A table of at most :data:`INLINE` rules of a kind is counted, read and evaluated
as one narrow expression, without a join.  A larger one is joined: containment
becomes an equi-join on the substrings of the distinct texts that have the
length of some pattern, so there is no pair of every text with every rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from healthwatch.functions import fields as fd

SCHEMA = "kind string, pattern string, exact boolean, folded boolean, priority int, code string, rank int, text string"
PAYLOAD = ["code", "rank", "text"]
#: Rules of one kind that are evaluated inside the plan.
INLINE = 256

#: Repair steps per signal (the deterministic part of the runbooks).
ACTIONS = [
    ("security", "D", 0, "quarantine attacker id"),
    ("zscore", "A", 1, "impute impossible vitals with jitter"),
    ("ks_test", "A", 1, "impute impossible vitals with jitter"),
    ("schema_entropy", "B", 2, "impute missing spo2 with jitter"),
    ("latency", "E", 3, "alert the on-call team"),
    ("warehouse_monitor", "E", 3, "alert the on-call team"),
    ("resource_limit", "E", 3, "alert the on-call team"),
    ("stall", "F", 4, "check the connector status"),
]


def default_rows() -> list[tuple]:
    """The fixed rules of :mod:`functions.fields` as rows."""
    rows = [("action", p, False, True, i, code, rank, text) for i, (p, code, rank, text) in enumerate(ACTIONS)]
    for i, (patterns, text) in enumerate(fd.GOAL_RULES):
        rows += [("goal", p, False, p == "latency", i, None, None, text) for p in patterns]
    for i, (names, parts) in enumerate(fd.DETECTOR_COMPONENTS):
        rows += [("component", n, True, False, i, None, None, ",".join(parts)) for n in names]
    for i, (name, patterns) in enumerate(fd.LOG_TAGS):
        rows += [("log", p, False, False, i, name, None, None) for p in patterns]
    return rows


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(default_rows(), SCHEMA)


def _inline(rows: list, text: Column) -> Column:
    """The payload of the first matching rule, or null."""
    kind = "struct<code:string,rank:int,text:string>"
    if not rows:
        return F.lit(None).cast(kind)
    table = F.array(*[F.struct(F.lit(r["pattern"].lower() if r["folded"] else r["pattern"]).alias("pattern"), F.lit(r["exact"]).alias("exact"),
                               F.lit(r["folded"]).alias("folded"), *[F.lit(r[c]).cast("int" if c == "rank" else "string").alias(c) for c in PAYLOAD])
                      for r in sorted(rows, key=lambda r: (r["priority"], r["pattern"]))])

    def applies(r):
        seen = F.when(r["folded"], F.lower(text)).otherwise(text)
        return F.when(r["exact"], seen == r["pattern"]).otherwise(F.contains(seen, r["pattern"]))

    hit = F.get(F.filter(table, applies), F.lit(0))
    return F.when(hit.isNotNull(), F.struct(*[hit[c].alias(c) for c in PAYLOAD]))


def with_rule(df: DataFrame, rules: DataFrame, kind: str, text: str, name: str = "rule", inline: int = INLINE) -> DataFrame:
    """Add ``name``: struct (code, rank, text) of the rule of ``kind`` that
    applies to the column ``text``, null where none does."""
    own = rules.filter((F.col("kind") == kind) & F.col("pattern").isNotNull() & (F.col("pattern") != ""))
    rows = own.limit(inline + 1).collect()
    if len(rows) <= inline:
        return df.withColumn(name, _inline(rows, F.col(text)))
    texts = df.select(F.col(text).alias("__text")).filter("__text is not null").distinct()
    shape = own.select(F.length("pattern").alias("n")).distinct().agg(F.array_sort(F.collect_list("n")).alias("lengths"))   # one row
    folds = own.withColumn("needle", F.when(F.col("folded"), F.lower("pattern")).otherwise(F.col("pattern")))
    spread = texts.withColumn("lengths", shape.scalar()).withColumn("n", F.explode("lengths")).filter(F.length("__text") >= F.col("n"))
    pieces = spread.select("__text", F.explode(F.sequence(F.lit(1), F.length("__text") - F.col("n") + 1)).alias("at"), "n")
    piece = F.substring(F.col("__text"), F.col("at"), F.col("n"))
    both = F.array(F.struct(F.lit(False).alias("folded"), piece.alias("needle")), F.struct(F.lit(True).alias("folded"), F.lower(piece).alias("needle")))
    needles = pieces.select("__text", F.explode(both).alias("p")).select("__text", "p.folded", "p.needle").distinct()
    hits = needles.join(folds, ["folded", "needle"]).filter(~F.col("exact") | (F.length("__text") == F.length("needle")))
    first = hits.groupBy("__text").agg(F.min_by(F.struct(*PAYLOAD), F.struct("priority", "pattern")).alias(name))
    return df.join(first, df[text].eqNullSafe(first["__text"]), "left").drop("__text")
