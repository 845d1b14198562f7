"""Exact deduplication against an immutable snapshot.

* Texts are compared after lower-casing A-Z; null counts as empty.
* The snapshot is reduced to one row per distinct text (exact buckets, keyed
  by SHA-256) and to static binary-fuse filters, one per digest shard of about
  :data:`SHARD_KEYS` keys, so a filter is built and probed in bounded memory.
* The incoming batch is grouped by digest on its own (new-batch duplicates);
  its distinct digests are screened by the filter of their shard.  Only
  positives join the exact buckets, and a positive counts as equal after the
  two texts have been compared byte for byte.

Copies collapse in the map-side aggregate, so a group holding a third of all
rows is shuffled as one row per input partition."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from healthwatch.llm.common import BROADCAST_ROWS, RID, map_arrow, ship_package, sized, text_of, with_row_id, write_table

#: Keys a filter shard is sized for.
SHARD_KEYS = 50_000
#: Groups up to which the class table is broadcast (about 100 bytes a row).
BROADCAST_GROUPS = BROADCAST_ROWS // 4

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_ONE = np.uint64(1)


# ---------------------------------------------------------------- the filter

def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finalizer of key plus seed."""
    x = keys + np.uint64(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def _places(hashes: np.ndarray, seg_len: int, seg_count: int) -> np.ndarray:
    """Three slots per key in three consecutive segments: shape (3, n)."""
    mask = np.uint64(seg_len - 1)
    first = ((hashes >> np.uint64(32)) * np.uint64(seg_len * seg_count)) >> np.uint64(32)
    second = (first + np.uint64(seg_len)) ^ ((hashes >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * seg_len)) ^ (hashes & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _prints(hashes: np.ndarray) -> np.ndarray:
    return ((hashes ^ (hashes >> np.uint64(32))) & np.uint64(0xFFFF)).astype(np.uint16)


def fuse_build(keys: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """Binary-fuse filter with three 16-bit slots a key: (seed, segment length,
    segment count, slots).  Slots touched by one remaining key are peeled in
    rounds; fingerprints are assigned in reverse order of the rounds."""
    keys = np.unique(keys.astype(np.uint64))
    n = max(len(keys), 1)
    seg_len = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    seg_count = max(1, math.ceil(n * factor / seg_len) - 2)
    size = (seg_count + 2) * seg_len
    for seed in range(1, 200):
        hashes = _mix(keys, seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        at = _places(hashes, seg_len, seg_count)
        index = np.arange(len(keys))
        degree = np.bincount(at.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        for row in at:
            np.bitwise_xor.at(owner, row, index)
        rounds, ready = [], np.flatnonzero(degree == 1)
        while len(ready):
            peeled, where = np.unique(owner[ready], return_index=True)
            rounds.append((peeled, ready[where]))
            touched = at[:, peeled]
            for row in touched:
                np.subtract.at(degree, row, 1)
                np.bitwise_xor.at(owner, row, peeled)
            touched = np.unique(touched)
            ready = touched[degree[touched] == 1]
        if sum(len(p) for p, _ in rounds) == len(keys):
            slots, prints = np.zeros(size, np.uint16), _prints(hashes)
            for peeled, slot in reversed(rounds):
                slots[slot] = 0
                rows = at[:, peeled]
                slots[slot] = prints[peeled] ^ slots[rows[0]] ^ slots[rows[1]] ^ slots[rows[2]]
            return seed, seg_len, seg_count, slots
    raise RuntimeError("no peelable seed found for the filter")


def fuse_contains(keys: np.ndarray, seed: int, seg_len: int, seg_count: int, slots: np.ndarray) -> np.ndarray:
    hashes = _mix(keys.astype(np.uint64), seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    at = _places(hashes, seg_len, seg_count)
    return (slots[at[0]] ^ slots[at[1]] ^ slots[at[2]]) == _prints(hashes)


# ------------------------------------------------------------ Spark operators

def _digest_batches(batches):
    for b in batches:
        texts = b.column("text").cast(pa.large_binary())
        digests = [hashlib.sha256((t.as_py() or b"").lower()).digest() for t in texts]
        cols = [b.column(c) for c in RID] + [b.column("doc_id"), pa.array(digests, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=[*RID, "doc_id", "digest"])


def digest_rows(docs: DataFrame) -> DataFrame:
    """Row id, doc_id and SHA-256 of the normalised text, one narrow pass."""
    rows = with_row_id(docs, ["doc_id", "text"]).withColumn("doc_id", F.col("doc_id").cast("bigint")).withColumn("text", F.col("text").cast("string"))
    return map_arrow(rows, _digest_batches, f"{RID[0]} bigint, {RID[1]} bigint, doc_id bigint, digest binary")


def grouped(rows: DataFrame) -> DataFrame:
    """Distinct digests with their count and top row (largest doc_id, then
    row id; a null doc_id sorts lowest)."""
    return rows.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", *RID)).alias("top"))


def _shard(digest: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


def _keys(digests: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests.to_pylist()), dtype="<u8")


def _build_shard(table: pa.Table) -> pa.Table:
    seed, seg_len, seg_count, slots = fuse_build(_keys(table["digest"]))
    return pa.table({"shard": table["shard"].slice(0, 1).cast(pa.int32()), "seed": pa.array([seed], pa.int64()),
                     "seg_len": pa.array([seg_len], pa.int64()), "seg_count": pa.array([seg_count], pa.int64()),
                     "slots": pa.array([slots.tobytes()], pa.binary())})


def build_filters(groups: DataFrame, shards: int) -> DataFrame:
    """One binary-fuse filter row per shard of the snapshot's digests."""
    ship_package(groups.sparkSession)
    return (groups.select(_shard(F.col("digest"), shards).alias("shard"), "digest").groupBy("shard")
            .applyInArrow(_build_shard, "shard int, seed bigint, seg_len bigint, seg_count bigint, slots binary"))


def _screen_shard(digests: pa.Table, filters: pa.Table) -> pa.Table:
    if digests.num_rows == 0 or filters.num_rows == 0:
        return pa.table({"digest": pa.array([], pa.binary())})
    f = {c: filters[c][0].as_py() for c in filters.column_names}
    hit = fuse_contains(_keys(digests["digest"]), f["seed"], f["seg_len"], f["seg_count"], np.frombuffer(f["slots"], np.uint16))
    return pa.table({"digest": digests["digest"].filter(pa.array(hit))})


def screen(digests: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """Digests whose shard filter answers 'maybe'."""
    ship_package(digests.sparkSession)
    left = digests.select(_shard(F.col("digest"), shards).alias("shard"), "digest")
    return left.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(_screen_shard, "digest binary")


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Digests of ``pairs`` (digest, mine, theirs: top rows) whose two texts
    are equal byte for byte.  Only two texts per digest are fetched."""
    pairs = write_table(pairs, "positives")
    reps = pairs.select("digest", F.explode(F.array("mine", "theirs")).alias("t")).select("digest", *[F.col(f"t.{c}") for c in RID])
    reps = write_table(reps, "representatives")
    texts = with_row_id(docs, ["text"]).join(sized(reps), RID)
    norm = F.encode(F.translate(text_of(), UPPER, LOWER), "UTF-8")
    return (texts.select("digest", norm.alias("b")).groupBy("digest")
            .agg(F.min("b").alias("lo"), F.max("b").alias("hi"), F.count("*").alias("n"))
            .filter((F.col("lo") == F.col("hi")) & (F.col("n") == 2)).select("digest"))


def classes(docs: DataFrame, rows: DataFrame, is_snapshot: Column) -> DataFrame:
    """Groups of two or more equal texts: digest, ``part`` (null when both
    batches share the class, else the batch), size and top row."""
    snap = write_table(grouped(rows.filter(is_snapshot)), "snapshot-buckets")
    batch = write_table(grouped(rows.filter(~is_snapshot)), "batch-groups")
    shards = max(1, math.ceil(max(snap.count(), batch.count()) / SHARD_KEYS))  # bounds the keys built and those screened
    filters = write_table(build_filters(snap, shards), "fuse-filters")
    maybe = screen(batch.select("digest"), filters, shards)
    hits = (maybe.join(batch, "digest").select("digest", F.col("top").alias("mine"))
            .join(snap.select("digest", F.col("top").alias("theirs")), "digest"))
    same = verified(docs, hits).withColumn("same", F.lit(True))
    both = snap.withColumn("part", F.lit(True)).unionByName(batch.withColumn("part", F.lit(False)))
    part = F.when(F.col("same"), F.lit(None).cast("boolean")).otherwise(F.col("part"))
    return (both.join(same, "digest", "left").select("digest", part.alias("part"), "n", "top")
            .groupBy("digest", "part").agg(F.sum("n").alias("n"), F.max("top").alias("top")).filter(F.col("n") > 1))


def midpoint(rows: DataFrame) -> Column:
    """Default batch split: ids up to the middle of the id range are the
    published snapshot, later and null ids the incoming batch."""
    lo, hi = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    return F.lit(False) if lo is None else F.coalesce(F.col("doc_id") <= F.lit(lo + (hi - lo) // 2), F.lit(False))


def exact_duplicates(docs: DataFrame, is_snapshot: Column | None = None) -> DataFrame:
    """One row per input row: row id, doc_id, keep_id, group_size, kept,
    text_sha256.

    Defined cases: null text equals the empty text; of equal texts the row
    with the largest doc_id stays; among repeated rows with that same doc_id
    exactly one (the last by position) stays; a null doc_id sorts lowest and
    keep_id is null only when the whole group has null ids; an empty table
    gives an empty result; other columns are ignored."""
    rows = write_table(digest_rows(docs), "digests")
    split = midpoint(rows) if is_snapshot is None else is_snapshot
    found = write_table(classes(docs, rows, split), "classes").select(
        F.col("digest").alias("__d"), "part", "n", "top")
    joined = rows.join(sized(found, BROADCAST_GROUPS), (F.col("digest") == F.col("__d")) & (F.col("part").isNull() | (F.col("part") == split)), "left")
    single = F.col("n").isNull()
    top = F.struct(*[F.col(f"top.{c}") for c in RID])
    return joined.select(
        *RID, "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        (single | (top == F.struct(*RID))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose row id is in ``dropped``; the columns
    of ``docs`` are unchanged."""
    cols = docs.columns
    gone = write_table(dropped.select(*RID), "dropped")
    return with_row_id(docs, cols).join(sized(gone), RID, "left_anti").select(*[F.col(f"`{c}`") for c in cols])


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts one row stays."""
    return drop_rows(docs, exact_duplicates(docs).filter(~F.col("kept")))
