"""Quality rules: a threshold table compiled into one Spark projection.

Every measure and every verdict is a built-in column expression; no user
function, pandas, Arrow or RDD code runs.  A document's row never leaves its
input partition, so there is no shuffle at any size."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from healthwatch.llm.common import WORD, bind, text_of, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Function words of the four languages, lower case.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as at by this from or an are not "
    "der die das und ist ein eine zu den von mit für auf sich dem des im "
    "le la les de des et un une en que qui est pour dans sur pas du au "
    "el los las y es por con su para lo como una se del al"
).split()

STOP_FORMS = sorted({form for s in STOP_WORDS for form in (s, s.capitalize())})


@dataclass(frozen=True)
class Rule:
    """One row of the threshold table: a document fails the rule when it has
    at least ``from_words`` words and ``measure op bound`` holds."""

    name: str
    measure: str
    op: str
    bound: float
    from_words: int = 0


#: The production table.  Ratios are per word unless named otherwise.
RULES = [
    Rule("too_short", "n_words", "<", 20),
    Rule("repeats", "repeat_ratio", ">", 0.30),
    Rule("symbols", "symbol_ratio", ">", 0.10),
    Rule("word_length_low", "mean_word_chars", "<", 2.0),
    Rule("word_length_high", "mean_word_chars", ">", 25.0),
    Rule("exclamations", "bang_ratio", ">", 0.20),
    Rule("no_stop_words", "stop_ratio", "<", 0.01, from_words=60),
    Rule("echoes", "echo_ratio", ">", 0.25),
    Rule("duplicate_lines", "dup_line_ratio", ">", 0.75),
]

_COMPARE = {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}


def repeated_window_words(words: Column, size: int = WINDOW) -> Column:
    """Words covered by ``size``-word windows that occur twice or more in the
    array (first occurrence included).  Words become 64-bit hashes, windows
    hashes of those; only when two windows agree are positions sorted, so the
    cost is one pass for ordinary texts and n log n for repetitive ones."""

    def joined(h: Column, step: int) -> Column:
        """Hash of each entry with the one ``step`` later: doubles the window."""
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - F.lit(step), F.lit(0))),
                           lambda x, i: F.xxhash64(x, F.get(h, i + F.lit(step))))

    def windows(h: Column, width: int = 1) -> Column:
        return h if width == size else bind(joined(h, width), lambda x: windows(x, 2 * width))

    def starts(wh: Column) -> Column:
        placed = F.array_sort(F.transform(wh, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return bind(placed, lambda s: F.array_sort(F.transform(
            F.filter(s, lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"])),
            lambda e: e["p"])))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(size), x - F.coalesce(F.get(p, i - 1), x - F.lit(size))))
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    if size & (size - 1):
        raise ValueError("the window size must be a power of two")
    return bind(hashes, lambda h: bind(windows(h), lambda wh: F.when(
        F.size(F.array_distinct(wh)) == F.size(wh), F.lit(0)).otherwise(bind(starts(wh), covered)))).cast("bigint")


def _count(marks: Column, chars: str) -> Column:
    """How many characters of the (short) string ``marks`` are in ``chars``."""
    return (F.char_length(marks) - F.char_length(F.translate(marks, chars, ""))).cast("bigint")


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and every measure, in two projections (split texts,
    then figures).  Null texts have no words; all ratios of a document
    without words are 0."""
    split = docs.select(*keep, text_of().alias("__t")).select(
        *keep, words_of(F.col("__t")).alias("__w"),
        F.filter(F.split(F.col("__t"), "\n"), lambda x: x.rlike(WORD[:-1])).alias("__l"),
        F.regexp_replace(F.col("__t"), f"[^{SYMBOLS}!]+", "").alias("__m"))
    w, lines, marks = F.col("__w"), F.col("__l"), F.col("__m")
    figures = split.select(
        *keep,
        F.size(w).cast("bigint").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        _count(marks, SYMBOLS).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        repeated_window_words(w).alias("n_repeat_words"),
        F.size(lines).cast("bigint").alias("n_lines"),
        _count(marks, "!").alias("n_bangs"),
        F.size(F.filter(F.transform(w, lambda x, i: (x == F.get(w, i - 1))), lambda same: same)).cast("bigint").alias("n_echoes"),
        F.size(F.filter(w, lambda x: x.isin(STOP_FORMS))).cast("bigint").alias("n_stop_words"))
    n = F.greatest(F.col("n_words"), F.lit(1))
    return figures.select(
        "*", (F.col("n_symbols") / n).alias("symbol_ratio"), (F.col("word_chars") / n).alias("mean_word_chars"),
        (F.col("n_bangs") / n).alias("bang_ratio"), (F.col("n_stop_words") / n).alias("stop_ratio"),
        (F.col("n_echoes") / n).alias("echo_ratio"), (F.col("n_repeat_words") / n).alias("repeat_ratio"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_ratio"))


def verdict(rules: list[Rule] = RULES) -> Column:
    """The table compiled to one array expression: names of failed rules."""
    fails = [F.when((F.col("n_words") >= r.from_words) & _COMPARE[r.op](F.col(r.measure), F.lit(r.bound)), F.lit(r.name))
             for r in rules]
    return F.array_compact(F.array(*fails))


def quality(docs: DataFrame, rules: list[Rule] = RULES, keep: list[str] | None = None) -> DataFrame:
    """One row per document: measures, ``base_failed``, ``failed_rules`` and
    ``kept``.

    Defined cases: null or empty text has 0 words and fails; any text length
    is read whole; repeated rows give equal rows; an empty table gives an
    empty result; extra columns of the input are ignored (only ``keep``,
    default ``doc_id``, is carried), so clashing names do no harm."""
    m = measures(docs, keep or ["doc_id"])
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (m.withColumn("base_failed", base).withColumn("failed_rules", verdict(rules))
             .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go; columns stay as they are."""
    cols = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__doc"), F.col("text"))
    judged = quality(row, keep=["__doc"]).select("__doc", "kept", F.monotonically_increasing_id().alias("__row"))
    # the row number keeps the optimizer from pushing the filter below the measures, which would compute each of them several times
    kept = judged.filter(F.col("kept") & (F.col("__row") >= 0))
    return kept.select(*[F.col("__doc").getField(c).alias(c) for c in cols])
