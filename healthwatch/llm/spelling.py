"""Grouping of spelling variants by k-d trees over letter-count vectors.

*Points.*  A word is the vector of its letter counts.  One replaced letter
changes two counts by one, one inserted or deleted letter changes one count,
so words one edit apart lie within L1 distance two (equal length) or one
(lengths that differ by one).

*Top of the trees.*  There is one tree per word length.  Its upper splits are
made in Spark: a round counts, for every cell that is still too large, how many
of its words have each number of each letter, and cuts the cell at the
best-balanced (letter, count).  Members go to one side.  Searches, one in the
tree of their own length and one in the tree of the next, go to every side that
they can reach within their radius; what they spent on each letter is carried
along, which is the L1 distance to the cell's box.

*Leaves.*  One task builds the k-d tree of one cell and answers the searches
that reached it, pruning by the boxes of its nodes; the letters of the
candidates are then compared in order.  A cell with many searches is given to
several tasks.  Words of equal counts are permutations, never one edit apart,
so a cell that no letter can split needs no further care."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from healthwatch.llm.common import map_arrow, ship_package, sized, write_table

MIN_LENGTH, MIN_COUNT, PLANT = 5, 3, 97
#: Words a cell may hold, letters its words may have together, and searches one task answers for it.
CELL_WORDS, CELL_LETTERS, CELL_SEARCHES = 32_768, 1_000_000, 65_536
#: Points of a leaf, and (search, node) pairs looked at together.
LEAF, PAIRS = 64, 20_000
#: Distinct words of a task that are counted together before they are handed on.
HELD_WORDS = 200_000

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Place of a letter in a count vector: a to z, then U+00C0 to U+00FF.
LETTERS = 26 + 64


# ------------------------------------------------------------------ counting

def planted(seed: int, run: str, plant: int = PLANT) -> str:
    """The run, or the run without one letter when ``plant`` divides the hash
    of the document's name (``seed``, hashed with the colon) and the run."""
    h = zlib.crc32(run.encode(), seed)
    if h % plant:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _word_batches(min_length: int):
    def run(batches):
        held: Counter = Counter()

        def handed():
            rows = [(w, n) for w, n in held.items() if len(w) >= min_length]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.large_binary())):
                found = Counter(_RUN.findall((text.as_py() or b"").lower().decode()))   # lowers A-Z only
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in found.items():
                    if len(word) >= min_length:
                        held[planted(seed, word)] += n
                if len(held) >= HELD_WORDS:
                    yield handed()
        yield handed()
    return run


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): tasks count their own words first, so a word that makes up a
    third of all runs is a few rows."""
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = map_arrow(named, _word_batches(min_length), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# -------------------------------------------------------- upper splits (Spark)

def _count_of(letter) -> F.Column:
    """How often ``letter`` occurs in the row's word."""
    return F.length("word") - F.length(F.replace(F.col("word"), letter, F.lit("")))


def _splits(members: DataFrame, large: DataFrame) -> DataFrame:
    """(cell, letter, least): words with at least ``least`` of ``letter`` go
    right.  The cut with the larger smaller side wins; cells that no cut
    divides are left out."""
    letters = F.filter(F.array_distinct(F.split("word", "")), lambda c: c != "")
    rows = members.join(sized(large), "cell").select("cell", "total", "word", F.explode(letters).alias("letter"))
    steps = rows.select("cell", "total", "letter", F.explode(F.sequence(F.lit(1), _count_of(F.col("letter")))).alias("least"))
    sides = steps.groupBy("cell", "total", "letter", "least").agg(F.count("*").alias("right")).filter("right < total")
    best = F.max(F.struct(F.least("right", F.col("total") - F.col("right")).alias("small"), "letter", "least"))
    return sides.groupBy("cell").agg(best.alias("b")).select("cell", F.col("b.letter").alias("letter"), F.col("b.least").alias("least"))


def _routed(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows (word, n, reach, cell, spent) sent to the children of their cell
    that they can reach; ``spent`` names a letter once per unit of distance."""
    joined = rows.join(splits, "cell", "left").withColumn("c", _count_of(F.coalesce("letter", F.lit("-"))))
    used = F.size(F.filter("spent", lambda s: s == F.col("letter")))

    def child(mark: str, cost):
        more = F.greatest(cost - used, F.lit(0))
        return F.struct(F.concat("cell", F.lit(mark)).alias("cell"), F.concat("spent", F.array_repeat(F.col("letter"), more)).alias("spent"))

    stay = F.struct("cell", "spent")
    sides = F.array(child("0", F.greatest(F.col("c") - F.col("least") + 1, F.lit(0))), child("1", F.greatest(F.col("least") - F.col("c"), F.lit(0))))
    parts = F.explode(F.when(F.col("letter").isNull(), F.array(stay)).otherwise(sides))
    moved = joined.select("word", "n", "reach", parts.alias("p")).select("word", "n", "reach", "p.cell", "p.spent")
    return moved.filter(F.size("spent") <= F.col("reach"))


def cells(words: DataFrame, cell_words: int = CELL_WORDS) -> tuple[DataFrame, DataFrame]:
    """(members, searches), both (word, n, reach, cell): members in their one
    cell, searches in every cell within their reach."""
    length = F.length("word")
    none = F.array().cast("array<string>")

    def rooted(shift: int, reach: int) -> DataFrame:
        return words.select("word", "n", F.lit(reach).alias("reach"), F.concat((length + shift).cast("string"), F.lit(":")).alias("cell"), none.alias("spent"))

    members = write_table(rooted(0, 0), "members")
    searches = write_table(rooted(0, 2).unionByName(rooted(1, 1)), "searches")
    stuck = None
    while True:
        bound = F.greatest(F.lit(LEAF), F.least(F.lit(cell_words), F.floor(F.lit(CELL_LETTERS) / F.first("size"))))
        sizes = members.withColumn("size", length).groupBy("cell").agg(F.count("*").alias("total"), bound.alias("bound")).filter("total > bound")
        large = sizes.select("cell", "total")
        large = write_table(large if stuck is None else large.join(sized(stuck), "cell", "left_anti"), "large-cells")
        splits = write_table(_splits(members, large), "splits")
        if splits.isEmpty():
            return members, searches
        stuck_now = large.join(sized(splits), "cell", "left_anti").select("cell")
        stuck = write_table(stuck_now if stuck is None else stuck.unionByName(stuck_now), "whole-cells")
        members = write_table(_routed(members, sized(splits)), "members")
        searches = write_table(_routed(searches, sized(splits)), "searches")


# ------------------------------------------------------------- leaves (tasks)

def letter_codes(words: list[str]) -> np.ndarray:
    """Places 0 .. LETTERS-1 of the letters of words of one length."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.int32)
    return np.where(codes < 0xC0, codes - 97, codes - 0xC0 + 26)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    flat = np.repeat(np.arange(len(codes)), codes.shape[1]) * LETTERS + codes.ravel()
    return np.bincount(flat, minlength=len(codes) * LETTERS).reshape(-1, LETTERS)


def odd_letters(points: np.ndarray) -> np.ndarray:
    """A bit per letter (some share one) that is set for odd counts: vectors
    at L1 distance d differ in at most d bits."""
    bits = np.zeros(len(points), np.uint64)
    for j in range(points.shape[1]):
        bits ^= (points[:, j] & 1).astype(np.uint64) << np.uint64(j % 64)
    return bits


class KdTree:
    """Median splits on the widest letter; nodes keep the box of their points.
    Letters that no point has are left out: what a search has of them counts
    against its radius from the start."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.letters = np.flatnonzero(points.any(axis=0))
        self.kind = np.int16 if points.max(initial=0) < 10_000 else np.int32
        self.points = points[:, self.letters].astype(self.kind)
        self.bits = odd_letters(points)
        self.order = np.arange(len(points))
        low, high, left, right, span = [], [], [], [], []
        todo = [(0, len(points), None, None)]
        while todo:
            a, z, parent, side = todo.pop()
            own = self.points[self.order[a:z]]
            node = len(low)
            low.append(own.min(axis=0)), high.append(own.max(axis=0)), left.append(-1), right.append(-1), span.append((a, z))
            if parent is not None:
                (left if side == 0 else right)[parent] = node
            axis = int(np.argmax(high[node] - low[node]))
            if z - a <= leaf or high[node][axis] == low[node][axis]:
                continue
            values = own[:, axis]
            goes = values >= max(int(np.median(values)), int(low[node][axis]) + 1)
            part = self.order[a:z]
            self.order[a:z] = np.concatenate([part[~goes], part[goes]])
            middle = z - int(goes.sum())
            todo += [(a, middle, node, 0), (middle, z, node, 1)]
        self.low, self.high, self.span = np.array(low), np.array(high), np.array(span)
        self.left, self.right = np.array(left), np.array(right)

    def within(self, searches: np.ndarray, radius: int):
        """(search, point) pairs at L1 distance of at most ``radius``."""
        outside = searches.sum(axis=1) - searches[:, self.letters].sum(axis=1)
        bits, searches, left = odd_letters(searches), searches[:, self.letters].astype(self.kind), radius - outside
        start = np.flatnonzero(left >= 0)
        todo = [(start, np.zeros(len(start), np.int64))]
        while todo:
            s, node = todo.pop()
            if len(s) > PAIRS:
                todo += [(s[k:k + PAIRS], node[k:k + PAIRS]) for k in range(0, len(s), PAIRS)]
                continue
            q = searches[s]
            away = np.maximum(self.low[node] - q, 0) + np.maximum(q - self.high[node], 0)
            near = away.sum(axis=1, dtype=np.int64) <= left[s]
            s, node = s[near], node[near]
            end = self.left[node] < 0
            if end.any():
                yield from self._leaves(s[end], node[end], searches, bits, left, radius)
            if not end.all():
                s, node = s[~end], node[~end]
                todo.append((np.concatenate([s, s]), np.concatenate([self.left[node], self.right[node]])))

    def _leaves(self, s, node, searches, bits, left, radius: int):
        """Points of the leaves, first by their odd letters, then exactly."""
        size = self.span[node, 1] - self.span[node, 0]
        for k in np.array_split(np.arange(len(s)), max(1, int(size.sum()) // (50 * PAIRS) + 1)):
            many = size[k]
            at = np.repeat(self.span[node[k], 0], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            who, point = np.repeat(s[k], many), self.order[at]
            maybe = np.bitwise_count(bits[who] ^ self.bits[point]) <= radius
            who, point = who[maybe], point[maybe]
            gap = np.abs(searches[who] - self.points[point]).sum(axis=1, dtype=np.int64)
            yield who[gap <= left[who]], point[gap <= left[who]]


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of codes that differ by exactly one replaced letter, or by one
    letter that ``b`` has more."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    front = np.cumprod(a == b[:, :-1], axis=1).sum(axis=1)
    back = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= a.shape[1]


def _search(members: pa.Table, searches: pa.Table) -> pa.Table:
    parts = []
    if members.num_rows and searches.num_rows:
        codes = letter_codes(members["word"].to_pylist())
        tree = KdTree(letter_counts(codes))
        reach = np.asarray(searches["reach"], np.int64)
        for radius in (1, 2):
            mine = np.flatnonzero(reach == radius)
            for k in range(0, len(mine), PAIRS):
                some = mine[k:k + PAIRS]
                own = letter_codes(searches["word"].take(pa.array(some)).to_pylist())
                pairs = [(s[hit], p[hit]) for s, p in tree.within(letter_counts(own), radius) for hit in [one_edit(own[s], codes[p])]]
                s, p = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
                asked, found = searches.take(pa.array(some[s])), members.take(pa.array(p))
                parts.append(pa.table({"word": asked["word"], "other": found["word"], "other_n": found["n"]}))
                if radius == 1:  # the longer word does not search for the shorter
                    parts.append(pa.table({"word": found["word"], "other": asked["word"], "other_n": asked["n"]}))
    return pa.concat_tables(parts) if parts else pa.table({"word": pa.array([], pa.string()), "other": pa.array([], pa.string()), "other_n": pa.array([], pa.int64())})


def near_words(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, other, other_n): every ordered pair of words one edit apart."""
    members, searches = cells(words, cell_words)
    slices = searches.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(CELL_SEARCHES)).cast("int").alias("slices"))
    slices = write_table(slices, "slices")
    asked = searches.join(sized(slices), "cell").withColumn("slice", F.pmod(F.xxhash64("word"), F.col("slices")).cast("int"))
    held = members.join(sized(slices), "cell").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    ship_package(words.sparkSession)
    columns = ("cell", "slice", "word", "n", "reach")
    return (held.select(*columns).groupBy("cell", "slice").cogroup(asked.select(*columns).groupBy("cell", "slice"))
            .applyInArrow(_search, "word string, other string, other_n bigint"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for a table (word, form): pointers double each round, and
    as n at least doubles from word to form there are few rounds."""
    current = write_table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = write_table(current.join(sized(step), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if further.filter("moved").isEmpty():
            return further.select("word", "root")
        current = further.select("word", "root")


def spelling_variants(docs: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Defined cases: null texts have no words; a null doc_id hashes as an empty
    one; repeated rows count again; of near words with equal n the smallest in
    code-point order is the form; a word without a form is its own root; very
    long words are compared whole (a cell then holds fewer of them); other
    columns are ignored; an empty table gives an empty result."""
    words = write_table(word_counts(docs), "words")
    near = write_table(near_words(words, cell_words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("top")), "near-words")
    found = write_table(words.join(near.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(-F.col("top.minus") >= 2 * F.col("n"), F.struct(F.col("top.other").alias("form"), (-F.col("top.minus")).alias("form_n"))).alias("f")), "variants")
    linked = roots(found.filter("f is not null").select("word", F.col("f.form").alias("form")))
    return found.join(linked.hint("merge"), "word", "left").select(
        "word", F.col("f.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("f.form_n").alias("form_n"))
