"""Near-duplicate classes by DartMinHash signatures and banded joining.

Elements are shingles of five words; two texts are linked when the Jaccard
similarity of their shingle sets is at least 0.8, and classes are the
connected components of the links.

*Signatures.*  Every element owns a strip of the (weight, rank) plane.  Darts
fall on it as a Poisson process drawn from hashes of the element alone: unit
weight cells, exponential rank steps.  A document keeps the darts inside its
weights, thrown until about k (ln k + 3) of them lie below its rank limit; each
dart belongs to one of k coordinates and the earliest dart of a coordinate is
its signature entry.  Two documents agree in a coordinate with probability
equal to their weighted Jaccard similarity, at a cost of about k log k darts
instead of k hashes per element.

*Joining.*  Signatures are cut into bands; documents that agree in a band
share a bucket.  Copies are collapsed to one node first.  Members whose
shingles are mostly found in no other candidate cannot reach the threshold with
anyone and leave; this is decided by counting, not by pairs.  A bucket emits a
star (every member with the bucket's pivot), never all pairs.  Links are checked on
the whole shingle sets.  Where a star left members
of a bucket in different components, whole buckets, the largest of each member
first, are compared block by block inside tasks until no bucket holds an
unchecked pair of different components, so no candidate is dropped.  With 32 bands of 5 a pair of similarity 0.8 misses every bucket with
probability 3e-6."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from healthwatch.llm.common import RID, map_arrow, ship_package, sized, with_row_id, write_table
from healthwatch.llm.exact_dedup import drop_rows

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
#: Bytes of text whose signatures are computed together.
BATCH_BYTES = 4_000_000
#: Rows whose whole shingle sets a task holds together.
SLICE_ROWS = 256
#: Nodes of a bucket that one task compares with as many others, and shingles they have together on average.
BLOCK_NODES, BLOCK_SHINGLES = 512, 500_000

_U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


# ------------------------------------------------------------------ shingles

def shingle_sets(texts: list[bytes], size: int = SHINGLE):
    """(document number, shingle hash) of every distinct shingle, sorted, and
    the words per document.  A text with 1 to size-1 words has one shingle."""
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    solid = ~_BLANK[data]
    edge = np.diff(np.concatenate([[0], solid.view(np.int8)]))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    prefix = np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * _powers(_BASE, len(data)), dtype=_U)])
    back = _powers(_INVERSE, len(data) + 1)
    word = mix((prefix[stop] - prefix[start]) * back[start] + (stop - start).astype(_U))
    doc = np.searchsorted(begins, start, side="right") - 1
    words = np.bincount(doc, minlength=len(texts))
    # hash of the words from each position on, up to ``size`` of the same text
    total = np.zeros(len(word), _U)
    first = np.cumsum(words) - words
    left = (first + words)[doc] - np.arange(len(word))
    for k in range(size):
        live = np.flatnonzero(left > k)
        total[live] = mix(total[live] * _U(_BASE) + word[live + k])
    keep = (left >= size) | ((np.arange(len(word)) == first[doc]) & (words[doc] < size))
    doc, total = doc[keep], total[keep]
    order = np.lexsort((total, doc))
    doc, total = doc[order], total[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (total[1:] != total[:-1])
    return doc[new], total[new], words


# ------------------------------------------------------------- DartMinHash

def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, k: int, seed: int = 1) -> np.ndarray:
    """Signatures (docs x k, uint32; all ones for an empty set) of weighted
    sets given as sorted (document, element, weight > 0) triples."""
    out = np.full((docs, k), np.iinfo(np.uint64).max, np.uint64)
    mass = np.bincount(doc, weight, minlength=docs)
    aim = np.full(docs, k * (math.log(k) + 3))
    todo = mass > 0
    cells = np.ceil(weight).astype(np.int64)
    row = np.repeat(np.arange(len(doc)), cells)
    cell = np.arange(len(row)) - np.repeat(np.cumsum(cells) - cells, cells)
    owner = mix(element[row] + mix(cell.astype(_U) + _U(seed * _BASE & _MASK)))
    reach = (weight[row] - cell)          # width of the strip inside the cell
    strip_doc = doc[row]
    narrow = len(reach) > 0 and reach.min() < 1
    while todo.any():
        live = np.flatnonzero(todo[strip_doc])
        limit = aim / np.maximum(mass, 1e-300)
        out[todo] = np.iinfo(np.uint64).max
        rank, step = np.zeros(len(live)), 0
        while len(live):
            draw = mix(owner[live] + _U((step + 1) * 0xD6E8FEB86659FD93 & _MASK))
            rank = rank - np.log((draw >> _U(11)).astype(np.float64) * 2.0 ** -53 + 2.0 ** -54)
            inside = rank < limit[strip_doc[live]]
            live, rank, draw = live[inside], rank[inside], draw[inside]
            name = mix(draw ^ _U(0xA0761D6478BD642F))
            place = (name >> _U(40)).astype(np.float64) * 2.0 ** -24
            hit = place < reach[live] if narrow else slice(None)
            name, at = name[hit], live[hit]
            low = name & _U(0xFFFFFFFF)
            slot = strip_doc[at] * k + ((low * _U(k)) >> _U(32)).astype(np.int64)
            earliest = rank[hit].astype(np.float32).view(np.uint32).astype(_U) << _U(32) | (mix(name) & _U(0xFFFFFFFF))
            np.minimum.at(out.reshape(-1), slot, earliest)
            step += 1
        empty = (out == np.iinfo(np.uint64).max).any(axis=1)
        todo &= empty
        aim[todo] *= 2
    return (out & _U(0xFFFFFFFF)).astype(np.uint32)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band (docs x bands)."""
    parts = signatures.reshape(len(signatures), bands, rows).astype(_U)
    key = np.broadcast_to(mix(np.arange(1, bands + 1).astype(_U)), parts.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * _U(_BASE) + parts[:, :, r])
    return key.view(np.int64)


def _batches(size: int, bands: int, rows: int):
    def run(batches):
        for b in batches:
            texts = [t or b"" for t in b.column("text").cast(pa.large_binary()).to_pylist()]
            i = 0
            while i < len(texts):
                j, held = i, 0
                while j < len(texts) and (j == i or held + len(texts[j]) <= BATCH_BYTES):
                    held += len(texts[j])
                    j += 1
                doc, element, words = shingle_sets(texts[i:j], size)
                keys = band_keys(dart_signatures(doc, element, np.ones(len(doc)), j - i, bands * rows), bands, rows)
                nodes = [hashlib.md5(b" ".join(t.lower().split())).digest() for t in texts[i:j]]
                counts = np.where(words > 0, bands, 0)
                flat = keys[words > 0].ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in (*RID, "doc_id")), pa.array(nodes, pa.binary()), lists],
                                                 names=[*RID, "doc_id", "node", "bands"])
                i = j
    return run


def signed(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Row id, doc_id, node (MD5 of the word sequence: copies share it) and
    band keys, in one narrow pass."""
    named = with_row_id(docs, ["doc_id", "text"]).select(*RID, F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(named, _batches(size, bands, rows), f"{RID[0]} bigint, {RID[1]} bigint, doc_id bigint, node binary, bands array<bigint>")


# -------------------------------------------------------- links and classes

def _sliced(batches):
    """Batches of a few rows: whole sets are held for these only."""
    for b in batches:
        for i in range(0, b.num_rows, SLICE_ROWS):
            yield b.slice(i, SLICE_ROWS)


def _set_batches(size: int):
    def run(batches):
        for b in _sliced(batches):
            sets = []
            for t in b.column("text").cast(pa.large_binary()).to_pylist():
                sets.append(shingle_sets([t or b""], size)[1].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])
    return run


def _link_batches(threshold: float):
    def run(batches):
        for b in _sliced(batches):
            keep = []
            for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist()):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                small, large = min(len(x), len(y)), max(len(x), len(y))
                if small < threshold * large:
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], names=["a", "b"])
    return run


def verified_links(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose shingle sets reach the threshold.  Both joins are
    sort-merge on plain exchanges, so a pivot with many partners is split."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")).hint("merge")
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")).hint("merge")
    return map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb"), _link_batches(threshold), "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edge table (a, b), root the smallest
    node of its component: alternating large and small stars, which end after
    a logarithmic number of rounds and keep hub rows apart (each step is a
    minimum with partial aggregation and a join with its written result)."""
    current = write_table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "stars")
    while not _is_forest(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = write_table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars-min")
        large = both.join(sized(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = write_table(large.filter("u != v").distinct(), "stars")
        least = write_table(large.groupBy("u").agg(F.min("v").alias("m")), "stars-min")
        linked = large.join(sized(least), "u")
        small = linked.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        current = write_table(small.distinct(), "stars")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _is_forest(stars: DataFrame) -> bool:
    """Every node has one parent and no parent has one: stars are done."""
    ends = stars.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(
        stars.select(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    return (ends.groupBy("x").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
            .filter("child > 1 or (child > 0 and parent > 0)").isEmpty())


def fertile(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Nodes that can have a partner, with their set size and ``found``:
    |x & y| >= threshold * |x | y| needs at least threshold * |x| shingles of
    x in some other candidate.  Counting, for each shingle, the candidates
    that have it settles that without any pair; only nodes without a link are
    dropped."""
    named = sets.withColumn("id", F.xxhash64("node"))
    rows = write_table(map_arrow(named.select("id", "shingles"), _shingle_rows, "id bigint, size int, shingle bigint"), "shingle-rows")
    common = rows.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1").select("shingle")
    counts = rows.join(common.hint("merge"), "shingle").groupBy("id", "size").agg(F.count("*").alias("found"))
    able = write_table(counts.filter(F.col("found") >= threshold * F.col("size") - 1e-9), "fertile")
    # two nodes with one id would only count too much, which drops neither
    size = (F.octet_length("shingles") / 8).cast("int")
    return write_table(named.select("node", "id", size.alias("size")).join(sized(able), ["id", "size"]).drop("id"), "fertile")


def _can_link(size, found, other_size, other_found, threshold: float):
    """A link needs |x & y| >= t / (1 + t) * (|x| + |y|), and |x & y| is at
    most ``found`` of either."""
    return F.least(found, other_found) * (1 + threshold) + 1e-6 >= threshold * (size + other_size)


def _shingle_rows(batches):
    for b in _sliced(batches):
        for i in range(0, b.num_rows, 64):
            part = b.slice(i, 64)
            sets = [np.frombuffer(x, np.int64) for x in part.column("shingles").to_pylist()]
            sizes = np.array([len(x) for x in sets], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("id").to_numpy(), sizes)), pa.array(np.repeat(sizes, sizes)),
                                              pa.array(np.concatenate(sets))], names=["id", "size", "shingle"])


def _rooted(frame: DataFrame, roots: DataFrame, column: str, out: str) -> DataFrame:
    named = roots.select(F.col("node").alias(column), F.col("root").alias("__root"))
    return frame.join(sized(named), column, "left").withColumn(out, F.coalesce("__root", column)).drop("__root")


def _with_pivots(members: DataFrame) -> DataFrame:
    """Members (key, node, ...) of buckets with two or more members, each with
    the bucket's smallest row as ``pivot``.  Buckets are counted with partial
    aggregation and join back by sort-merge, which splits a hot bucket."""
    members = write_table(members, "members")
    row = F.struct(*[c for c in members.columns if c != "key"])
    shared = members.groupBy("key").agg(F.count("*").alias("n"), F.min(row).alias("pivot")).filter("n > 1").select("key", "pivot")
    return members.join(write_table(shared, "buckets").hint("merge"), "key")


def link_nodes(nodes: DataFrame, texts_of, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(links, roots) among nodes (node, bands).  ``texts_of(candidates)``
    returns (node, shingles) for a table of nodes."""
    nodes = write_table(nodes, "nodes")
    banded = nodes.select(F.explode("bands").alias("key"), "node")
    common = write_table(banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "buckets")
    shared = write_table(banded.join(common.hint("merge"), "key"), "members")
    sets = write_table(texts_of(shared.select("node").distinct()), "shingle-sets")
    members = write_table(_with_pivots(shared.join(sized(fertile(sets, threshold)), "node")), "members")
    both = [F.col(c) for c in ("size", "found", "pivot.size", "pivot.found")]
    stars = members.filter((F.col("node") != F.col("pivot.node")) & _can_link(*both, threshold))
    stars = write_table(stars.select(F.col("node").alias("a"), F.col("pivot.node").alias("b")).distinct(), "pairs")
    links = write_table(verified_links(stars, sets, threshold), "links")
    roots = write_table(components(links), "roots")
    members = members.filter(F.col("node") != F.col("pivot.node")).select("key", "node", "size", "found", F.col("node").alias("seen"))
    first = True
    while True:
        members = write_table(_rooted(members, roots, "node", "root"), "members")
        # a bucket is open while members of two components were not compared in one earlier bucket (``seen``)
        per_root = members.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("held"), F.min("size").alias("low"), F.min("seen").alias("lo"), F.max("seen").alias("hi"))
        open_ = (per_root.groupBy("key").agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("held").alias("held"), F.min("low").alias("low"),
                                             F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max_by("root", "n").alias("major"))
                 .filter("roots > 1 and lo != hi").drop("roots", "lo", "hi"))
        open_ = write_table(open_, "open-buckets")
        if open_.isEmpty():
            return links, roots
        # no partner of x is larger than found * (1 + t) / t - |x|: x goes when even the smallest member is
        largest = F.col("found") * ((1 + threshold) / threshold) - F.col("size") + 1e-6
        able = write_table(members.join(open_.hint("merge"), "key").filter(F.col("low") <= largest), "members")
        if first:  # each member's largest bucket; most others hold no new pair after it
            largest = able.groupBy("node").agg(F.max(F.struct("n", "key")).alias("b")).select(F.col("b.key").alias("key")).distinct()
            chosen = write_table(largest, "buckets")
            work = write_table(able.join(sized(chosen), "key"), "members")
        else:
            chosen, work = open_.select("key"), able
        first = False
        new = write_table(_blocks(work, sets, threshold), "links")
        seen = write_table(work.groupBy("node").agg(F.max(F.hash("key").cast("string").cast("binary")).alias("now")), "seen")
        if not new.isEmpty():
            links = write_table(links.unionByName(new).distinct(), "links")
            roots = write_table(components(links), "roots")
        members = (able.join(sized(chosen), "key", "left_anti").join(sized(seen), "node", "left")
                   .select("key", "node", "size", "found", F.coalesce("now", "seen").alias("seen")))


def _blocks(work: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links inside whole buckets between members outside the commonest
    component and all members.  Both sides are cut into blocks of about
    :data:`BLOCK_NODES` nodes or :data:`BLOCK_SHINGLES` shingles, and a task
    compares one block with one other, so no pair becomes a row and no task
    holds more than two blocks.  A task returns only links that join
    components which it has not joined yet: fewer than it has components."""
    heavy = F.ceil(F.col("held") / F.lit(BLOCK_SHINGLES))
    wide = F.greatest(F.ceil(F.col("n") / F.lit(BLOCK_NODES)), heavy, F.lit(1)).cast("int")
    tall = F.greatest(F.ceil((F.col("n") - F.col("most")) / F.lit(BLOCK_NODES)), F.ceil(heavy * (F.col("n") - F.col("most")) / F.col("n")), F.lit(1)).cast("int")
    spot = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    minor = (work.filter("root != major").select("key", "node", "root", spot(1, tall).alias("i"), F.explode(F.sequence(F.lit(0), wide - 1)).alias("j"))
             .withColumn("minor", F.lit(True)))
    every = work.select("key", "node", "root", F.explode(F.sequence(F.lit(0), tall - 1)).alias("i"), spot(2, wide).alias("j")).withColumn("minor", F.lit(False))
    rows = minor.unionByName(every).join(sets.hint("merge"), "node")
    ship_package(work.sparkSession)
    return rows.groupBy("key", "i", "j").applyInArrow(_compare_blocks(threshold), "a binary, b binary").distinct()


def _compare_blocks(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        flags = np.array(table["minor"].to_pylist(), bool)
        nodes, roots = table["node"].to_pylist(), table["root"].to_pylist()
        sets = [np.frombuffer(x, _U) for x in table["shingles"].to_pylist()]
        left, right = np.flatnonzero(flags), np.flatnonzero(~flags)
        found = ([], [])
        parent = {r: r for r in roots}

        def top(r):
            while parent[r] != r:
                parent[r] = r = parent[parent[r]]
            return r

        if len(left) and len(right):
            flat = np.concatenate([sets[k] for k in right])
            kinds, ids = np.unique(flat, return_inverse=True)
            sizes = np.array([len(sets[k]) for k in right])
            starts = np.cumsum(sizes) - sizes
            for k in left:
                at = np.searchsorted(kinds, sets[k])
                at = at[at < len(kinds)] if len(kinds) else at
                mark = np.zeros(len(kinds), np.int64)
                mark[at[np.isin(kinds[at], sets[k])]] = 1
                both = np.add.reduceat(mark[ids], starts)
                for r in right[both >= threshold * (len(sets[k]) + sizes - both) - 1e-9]:
                    a, b = top(roots[r]), top(roots[k])
                    if a != b:
                        parent[a] = b
                        found[0].append(max(nodes[k], nodes[r]))
                        found[1].append(min(nodes[k], nodes[r]))
        return pa.table({"a": pa.array(found[0], pa.binary()), "b": pa.array(found[1], pa.binary())})
    return run


def near_duplicates(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: row id, doc_id, class_id (largest doc_id of the
    class), class_size, n_join_links (the links of its text to different texts
    that were found while joining the class: texts already in one component
    are not compared, so this is no count of all links at the threshold),
    kept (that row stays).

    Defined cases: words are cut at blanks and A-Z lowered; null counts as
    empty; texts with equal word sequences, also without any word, are copies
    of one class; texts with fewer than five words have one shingle; among
    repeated rows with the kept doc_id the last by position stays; a null
    doc_id sorts lowest; texts of any length are read whole; other columns are
    ignored; an empty table gives an empty result."""
    table = write_table(signed(docs, size, bands, rows), "signatures")
    reps = table.groupBy("node").agg(F.min(F.struct(*RID)).alias("rep")).select("node", *[F.col(f"rep.{c}") for c in RID])
    reps = write_table(reps, "representatives")
    nodes = table.join(reps.select(*RID).hint("merge"), RID).select("node", "bands")

    def texts_of(candidates: DataFrame) -> DataFrame:
        wanted = write_table(reps.join(candidates.hint("merge"), "node"), "candidates")
        texts = with_row_id(docs, ["text"]).withColumn("text", F.col("text").cast("string")).join(sized(wanted), RID).select("node", "text")
        return map_arrow(texts, _set_batches(size), "node binary, shingles binary")

    links, roots = link_nodes(nodes, texts_of, threshold)
    degree = (links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
              .groupBy("node").agg(F.count("*").alias("n_join_links")))
    degree = write_table(degree, "degrees")
    rooted = _rooted(table.select(*RID, "doc_id", "node"), roots, "node", "root")
    rooted = write_table(rooted.join(sized(degree), "node", "left").drop("node"), "classed")
    groups = rooted.groupBy("root").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", *RID)).alias("top")).filter("n > 1")
    groups = write_table(groups, "classes")
    joined = rooted.join(sized(groups), "root", "left")
    single, top = F.col("n").isNull(), F.struct(*[F.col(f"top.{c}") for c in RID])
    return joined.select(*RID, "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("class_id"),
                         F.coalesce("n", F.lit(1)).cast("bigint").alias("class_size"), F.coalesce("n_join_links", F.lit(0)).cast("bigint").alias("n_join_links"),
                         (single | (top == F.struct(*RID))).alias("kept"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class stays."""
    return drop_rows(docs, near_duplicates(docs).filter(~F.col("kept")))
