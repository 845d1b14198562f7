"""Exact k-means over integer vectors with a LAESA pivot table.

The distances of every vector to a few fixed pivots are computed once and
stored beside it.  By the triangle inequality |d(x, p) - d(c, p)| is at most
d(x, c), so in each round the stored row and the pivots' distances to the new
centroids bound every centroid from below; only centroids whose bound does not
exceed the best distance found so far get an exact integer distance.

Centroids and pivots are at most ``k`` vectors and travel with the tasks; a
task returns sums per cluster and component, which Spark adds up, so nothing
that grows with the table reaches the driver."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from healthwatch.llm.common import map_arrow, write_table

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
#: Largest absolute component: squared distances and sums over 2^35 vectors then fit into 64 bits.
LARGEST = 1 << 27


def quantised(vectors: DataFrame, vec: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and ``q`` = floor(scale * x) of the vectors that have exactly
    ``dims`` components, none null or non-finite (built-in functions only)."""
    finite = F.forall("x", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    kept = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(vec).cast("array<double>").alias("x"))
    kept = kept.filter(F.col("x").isNotNull() & (F.size("x") == dims) & finite)
    return kept.select("vec_id", F.transform("x", lambda v: F.floor(v * F.lit(float(scale))).cast("bigint")).alias("q"))


def _checked(q: np.ndarray) -> np.ndarray:
    if q.max(initial=0) > LARGEST or q.min(initial=0) < -LARGEST:
        raise ValueError(f"components beyond {LARGEST} have no exact 64-bit distances")
    return q


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return _checked(np.asarray(column.flatten(), np.int64)).reshape(-1, dims)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def _pivot_batches(pivots: np.ndarray):
    def run(batches):
        for b in batches:
            x = _matrix(b.column("q"), pivots.shape[1])
            table = np.stack([np.sqrt(squared(x, p).astype(np.float64)) for p in pivots], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(pivots), pa.int32()), pa.array(table.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("q"), lists], names=["vec_id", "q", "to_pivots"])
    return run


def nearest(x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of every row, ties to the smaller number,
    and how many exact distances were computed.  Centroids are tried by rising
    bound; a bound is lowered by far more than its rounding error."""
    between = np.sqrt(((centroids[:, None, :] - pivots[None, :, :]) ** 2).sum(-1).astype(np.float64))
    bound = np.zeros((len(x), len(centroids)))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(to_pivots[:, p, None] - between[None, :, p]), out=bound)
    bound = np.maximum(bound - 1e-9 * (to_pivots.max(axis=1, initial=0)[:, None] + between.max(axis=1)[None, :]) - 1e-9, 0) ** 2
    order = np.argsort(bound, axis=1, kind="stable")
    best = np.full(len(x), np.iinfo(np.int64).max)
    cluster = np.full(len(x), len(centroids), np.int64)
    exact = 0
    for r in range(len(centroids)):
        live = np.flatnonzero(bound[np.arange(len(x)), order[:, r]] <= best)
        if not len(live):
            break
        c = order[live, r]
        d = squared(x[live], centroids[c])
        exact += len(live)
        better = (d < best[live]) | ((d == best[live]) & (c < cluster[live]))
        best[live[better]], cluster[live[better]] = d[better], c[better]
    return cluster, best, exact


def _assigned(centroids: np.ndarray, pivots: np.ndarray, batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    x = _matrix(batch.column("q"), centroids.shape[1])
    table = np.asarray(batch.column("to_pivots").flatten(), np.float64).reshape(len(x), len(pivots))
    return x, *nearest(x, table, centroids, pivots)


def _sum_batches(centroids: np.ndarray, pivots: np.ndarray):
    def run(batches):
        k, dims = centroids.shape
        total, count, exact = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), 0
        for b in batches:
            x, cluster, _, n = _assigned(centroids, pivots, b)
            np.add.at(total, cluster, x)
            count += np.bincount(cluster, minlength=k)
            exact += n
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, dims).astype(np.int32)), pa.array(np.tile(np.arange(dims), len(used)).astype(np.int32)),
             pa.array(total[used].ravel()), pa.array(np.repeat(count[used], dims))], names=["cluster", "dim", "total", "n"])
    return run


def _final_batches(centroids: np.ndarray, pivots: np.ndarray):
    def run(batches):
        for b in batches:
            _, cluster, best, _ = _assigned(centroids, pivots, b)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(best)], names=["vec_id", "cluster", "distance"])
    return run


def pivot_table(kept: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vec_id, q and the stored distances to the pivots."""
    return write_table(map_arrow(kept, _pivot_batches(pivots), "vec_id bigint, q array<bigint>, to_pivots array<double>"), "pivot-table")


def moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Centroids after one round: the componentwise floor of the mean of the
    vectors of each cluster; empty clusters keep theirs."""
    sums = map_arrow(table, _sum_batches(centroids, pivots), "cluster int, dim int, total bigint, n bigint")
    out = centroids.copy()
    for r in sums.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # k x dims rows
        out[r["cluster"], r["dim"]] = r["total"] // r["n"]
    return out


def clusters(vectors: DataFrame, vec: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS,
             scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector, and the centroids.

    Defined cases: vectors that are null, of another length, or hold a null or
    non-finite component are left out; with fewer than ``k`` kept vectors each
    is a centroid of its own; repeated vec_ids are rows of their own, ordered
    by their components where they tie as start; a null vec_id hashes as an
    empty one; an empty table gives an empty result; other columns are
    ignored; components beyond 2^27 raise, as their distances would not fit."""
    kept = write_table(quantised(vectors, vec, dims, scale), "vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = kept.select(name.alias("h"), "q").orderBy("h", "q").limit(k).collect()  # k rows
    if not start:
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), np.zeros((0, dims), np.int64)
    pivots = _checked(np.array([r["q"] for r in start], np.int64)).reshape(len(start), dims)
    table, centroids = pivot_table(kept, pivots), pivots
    for _ in range(rounds):
        centroids = moved(table, centroids, pivots)
    done = map_arrow(table, _final_batches(centroids, pivots), "vec_id bigint, cluster int, distance bigint")
    return write_table(done, "clusters"), centroids


def clustered(vectors: DataFrame, **options) -> DataFrame:
    """:func:`clusters` with cluster_inertia, inertia and centroid_sha256."""
    rows, centroids = clusters(vectors, **options)
    inertia = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    prints = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]

    def of(values, kind):
        return F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("cluster")) if values else F.lit(None).cast(kind)

    sums = [inertia.get(c, 0) for c in range(len(centroids))]
    return rows.select("vec_id", "cluster", "distance", of(sums, "bigint").alias("cluster_inertia"),
                       F.lit(sum(sums)).cast("bigint").alias("inertia"), of(prints, "string").alias("centroid_sha256"))
