"""Mixing sources to target weights by pivotal dependent rounding.

Every document gets a fractional number of copies (its source's target over
its source's size).  Whole copies are taken at once.  Fractions are settled in
pairs: word mass moves at random from one document to the other until one of
the two fractions is 0 or 1, so the expected copies of each document and the
exact word total of each pair are kept.  Each leaf of a (source, leaf) tree
leaves one unsettled document; these residuals are combined level by level
until one per source remains, which is rounded last.  What that adds to or
takes from the total is made up by documents of the last group, larger ones
first, as far as they fit: a source's total ends near its target, at the price
of the expectation of these few documents.

Leaves have about :data:`LEAF_ROWS` rows whatever the size of the source, so a
source with a third of all rows is settled by as many tasks as its rows need.
Rows repeated very often are numbered and hashed with their number, which
spreads them over the leaves; which of the equal rows has which number does
not change the outcome.
All draws are hashes of the documents, so reruns and recomputed tasks agree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from healthwatch.llm.common import RID, map_arrow, ship_package, sized, with_row_id, write_table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
LEAF_ROWS = 4096
#: Texts whose words are counted together (about 20 bytes of memory a character).
SLICE_ROWS = 256
FAN_IN = 1024
EPS = 1e-9

_ROW = (f"{RID[0]} bigint, {RID[1]} bigint, doc_id bigint, source string, size bigint, source_size bigint, "
        "target double, h bigint, p double, leaf bigint, copies int, settled boolean")

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_counts(texts: pa.Array) -> np.ndarray:
    """Words per text of a string column, from its bytes (null: 0)."""
    texts = texts.cast(pa.large_binary()).fill_null(b"") if texts.null_count else texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    buf = texts.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[offsets[0]:offsets[-1]] if buf is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    solid = ~_BLANK[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    at = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[at] = solid[at]
    total = np.concatenate([[0], np.cumsum(begins)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _size_batches(batches):
    for whole in batches:
        for i in range(0, whole.num_rows, SLICE_ROWS):
            b = whole.slice(i, SLICE_ROWS)
            cols = [b.column(c) for c in (*RID, "doc_id", "source")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(word_counts(b.column("text")), pa.int64()), b.column("h")],
                                             names=[*RID, "doc_id", "source", "size", "h"])


def sized_rows(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Narrow rows: row id, doc_id, source, size in words, content hash."""
    rows = with_row_id(docs, ["doc_id", "text", "source"]).select(
        *RID, F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "source", "text"))
    return map_arrow(rows, _size_batches, f"{RID[0]} bigint, {RID[1]} bigint, doc_id bigint, source string, size bigint, h bigint")


def targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: size, weight and target.

    Sources in code-point order (null last) get the weights in turn and share
    ``share`` times all sizes.  A target stops at ``most`` times its source;
    the excess is reshared by weight: with sources ordered by cap over weight,
    those before the first one whose level stays under its cap are capped,
    the rest get that level times their weight.  The windows run over one row
    per source, never over documents."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = ((F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / F.sum("weight").over(after))
    per = per.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    first = F.min(F.when(F.col("open"), F.col("cap") / F.col("weight"))).over(whole)
    chosen = F.min(F.when(F.col("open") & (F.col("cap") / F.col("weight") == first), F.col("level"))).over(whole)
    capped = F.col("cap") / F.col("weight") < F.coalesce(first, F.lit(float("inf")))
    return (per.withColumn("chosen", chosen).withColumn("capped", capped)
            .select("source", "source_size", "n", F.when(F.col("capped"), F.col("cap"))
                    .otherwise(F.least(F.col("chosen") * F.col("weight"), F.col("cap"))).alias("target")))


def _draw(a: int, b: int) -> float:
    """Uniform in (0, 1) from two row hashes."""
    x = (a * 0x9E3779B97F4A7C15 ^ (b + 0x632BE59BD9B4E019) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 32)) + 0.5) / 2.0 ** 64


def pivotal(sizes, fractions, hashes, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Settle fractions in pairs.  Returns (fractions after, settled flags);
    one entry may stay unsettled unless ``last``.  Larger documents come
    first: the one with less room settles, so what is left over shrinks as it
    meets many small ones, but may be large where these are few."""
    order = np.lexsort((hashes, -np.asarray(sizes)))
    p, done = np.asarray(fractions, float).copy(), np.zeros(len(order), bool)
    held = -1
    for j in order:
        if held >= 0:
            i = held
            s, t, a, b = float(sizes[i]), float(sizes[j]), p[i], p[j]
            up, down = min((1 - a) * s, b * t), min(a * s, (1 - b) * t)
            move = up if _draw(int(hashes[i]), int(hashes[j])) * (up + down) < down else -down
            p[i], p[j] = a + move / s, b - move / t
        held_next = -1
        for k in ((held, j) if held >= 0 else (j,)):
            if p[k] <= EPS or p[k] >= 1 - EPS:
                p[k], done[k] = round(p[k]), True
            else:
                held_next = k
        held = held_next
    if last and held >= 0:
        p[held], done[held] = float(_draw(int(hashes[held]), 1) < p[held]), True
    return p, done


def made_up(sizes, before, after, hashes) -> np.ndarray:
    """Whole numbers ``after`` changed where that brings the group's total
    nearer to that of ``before``: larger documents first, ties by hash, each
    only if less is missing (or too much) afterwards."""
    sizes, p = np.asarray(sizes, float), np.asarray(after, float).copy()
    short = float((sizes * before).sum() - (sizes * p).sum())
    for j in np.lexsort((hashes, -sizes)):
        if 0 < sizes[j] < 2 * abs(short) and p[j] == (0.0 if short > 0 else 1.0):
            p[j] = 1.0 - p[j]
            short += sizes[j] * (1 - 2 * p[j])
    return p


def _settle(last: bool):
    def run(t: pa.Table) -> pa.Table:
        p, done = pivotal(t["size"].to_numpy(), t["p"].to_numpy(), t["h"].to_numpy(), last)
        if last:
            p = made_up(t["size"].to_numpy(), t["p"].to_numpy(), p, t["h"].to_numpy())
        copies = t["copies"].to_numpy() + np.where(done, p, 0).astype(np.int32)
        names = t.column_names
        t = t.set_column(names.index("p"), "p", pa.array(np.where(done, 0.0, p)))
        t = t.set_column(names.index("copies"), "copies", pa.array(copies.astype(np.int32)))
        return t.set_column(names.index("settled"), "settled", pa.array(done))
    return run


def spread_repeats(rows: DataFrame) -> DataFrame:
    """``rows`` with a content hash of its own for every row of a content held
    more than LEAF_ROWS / 4 times.  Such rows are numbered in slots of about
    :data:`LEAF_ROWS` rows; the slots' counts give each its first number, so
    the numbers are 0, 1, ... whatever the layout."""
    often = (rows.groupBy("h").agg(F.count("*").alias("held")).filter(F.col("held") > max(1, LEAF_ROWS // 4))
             .select("h", F.ceil(F.col("held") / F.lit(LEAF_ROWS)).alias("slots")))
    often = write_table(often, "mix-repeats")
    if often.isEmpty():
        return rows
    often = sized(often, 100_000)
    hot = write_table(rows.join(often, "h").withColumn("slot", F.pmod(F.xxhash64(*RID), "slots")), "mix-repeated")
    earlier = Window.partitionBy("h").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    first = hot.groupBy("h", "slot").agg(F.count("*").alias("held")).select("h", "slot", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("first"))
    first = write_table(first, "mix-slots")
    number = F.col("first") + F.row_number().over(Window.partitionBy("h", "slot").orderBy(*RID)) - 1
    numbered = hot.join(sized(first), ["h", "slot"]).withColumn("h", F.xxhash64("h", number))
    return rows.join(often, "h", "left_anti").select(*rows.columns).unionByName(numbered.select(*rows.columns))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0) -> DataFrame:
    """One row per input row: row id, doc_id, source, size, source_size,
    target, copies.

    Defined cases: null text has size 0; null source is a source of its own,
    last in order; a document without words gets the whole part of its copies
    (its words do not count); repeated rows are separate documents that are
    settled one by one; an empty table gives an empty result; other columns
    are ignored."""
    ship_package(docs.sparkSession)
    rows = write_table(sized_rows(docs, seed), "mix-rows")
    per = write_table(targets(rows, weights, share, most), "mix-targets")
    share_of = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(share_of + EPS)
    rest = F.greatest(share_of - whole, F.lit(0.0))
    open_ = (F.col("size") > 0) & (rest > EPS)
    leaves = F.greatest(F.ceil(F.col("n") / F.lit(LEAF_ROWS)), F.lit(1))
    level = (spread_repeats(rows).join(sized(per.withColumnRenamed("source", "__s"), 100_000), F.col("source").eqNullSafe(F.col("__s")))
             .select(*RID, "doc_id", "source", "size", "source_size", "target", "h", rest.alias("p"),
                     F.pmod(F.xxhash64("h"), leaves).alias("leaf"), whole.cast("int").alias("copies"), (~open_).alias("settled")))
    level = write_table(level, "mix-level")
    most_leaves = max(1, -(-(per.agg(F.max("n")).first()[0] or 0) // LEAF_ROWS))
    settled = [level.filter("settled")]
    todo = level.filter("not settled")
    while True:
        last = most_leaves == 1
        out = write_table(todo.groupBy("source", "leaf").applyInArrow(_settle(last), _ROW), "mix-level")
        settled.append(out.filter("settled"))
        if last:
            break
        todo = out.filter("not settled").withColumn("leaf", F.floor(F.col("leaf") / F.lit(FAN_IN)))
        most_leaves = -(-most_leaves // FAN_IN)
    result = settled[0]
    for part in settled[1:]:
        result = result.unionByName(part)
    return result.select(*RID, "doc_id", "source", "size", "source_size", "target", "copies")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document is repeated as often as the mix takes it
    and left out when it takes none."""
    cols = docs.columns
    taken = write_table(mix(docs).filter("copies > 0").select(*RID, F.col("copies").alias("__copies")), "mix-copies")
    rows = with_row_id(docs, cols).join(taken.hint("merge"), RID)
    return (rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
            .select(*[F.col(f"`{c}`") for c in cols]))
