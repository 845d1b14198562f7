"""Exact k nearest documents of every query vector, at any number of either.

*Index.*  Documents are divided among cells by their nearest centroid (the
centroids are documents of a bounded sample).  A cell knows the largest distance
of its documents to its centroid, and is cut into blocks of a bounded size.

*Search.*  A query visits its nearest cell first, which gives it k candidates
and so a bound.  By the triangle inequality a cell whose centroid is further
away than the bound plus the cell's radius holds nothing nearer; the query then
visits all other cells, and the result is exact.  A visit is a product of a
block of queries with a block of documents that keeps the k best per query, so
no pair becomes a row.  Busy cells are given to several tasks.

Only the centroid table (at most :data:`CELLS` rows) is sent to all tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from healthwatch.session import ship_package, write_table

#: Documents sampled for centroids, centroids at most, documents aimed at per cell.
SAMPLE, CELLS, CELL_DOCS = 65_536, 1024, 1024
#: Documents of a block and queries of a slice: one task holds one of each.
BLOCK_DOCS, SLICE_QUERIES = 8192, 8192


def _matrix(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.array(rows, dtype=np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 0))


def exact_distances(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Squared distances row by row, summed component by component."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        total += (q[:, j] - d[:, j]) ** 2
    return total


def best_of_block(queries: np.ndarray, docs: np.ndarray, ids: np.ndarray, k: int):
    """(query, document, distance) of the k nearest of a block, ties to the
    smaller id.  One matrix product gives all distances up to rounding; those
    that may be among the k best are computed exactly."""
    norms = (docs ** 2).sum(axis=1)
    size = (queries ** 2).sum(axis=1)
    rough = size[:, None] + norms[None, :] - 2 * queries @ docs.T
    slack = 1e-9 * (size + norms.max(initial=0)) + 1e-12
    kth = np.partition(rough, min(k, rough.shape[1]) - 1, axis=1)[:, min(k, rough.shape[1]) - 1]
    q, d = np.nonzero(rough <= (kth + 2 * slack)[:, None])
    exact = exact_distances(queries[q], docs[d])
    order = np.lexsort((ids[d], exact, q))
    q, d, exact = q[order], d[order], exact[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], d[place < k], exact[place < k]


def _assign(centroids: np.ndarray):
    """Cell of every vector and its distance to the centroid."""
    def run(batches):
        for b in batches:
            x = _matrix(b.column("vec"))
            cell, far = np.zeros(len(x), np.int32), np.zeros(len(x))
            for i in range(0, len(x), 4096):
                part = x[i:i + 4096]
                rough = (centroids ** 2).sum(axis=1)[None, :] - 2 * part @ centroids.T
                cell[i:i + 4096] = rough.argmin(axis=1)
                far[i:i + 4096] = np.sqrt(exact_distances(part, centroids[cell[i:i + 4096]]))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array(cell), pa.array(far)], names=["id", "vec", "cell", "far"])
    return run


def _visits(centroids: np.ndarray, radius: np.ndarray, first: bool):
    """Cells a query visits: the nearest one, or all others that its bound
    (null: fewer than k found) does not exclude."""
    def run(batches):
        used = np.flatnonzero(radius >= 0)
        for b in batches:
            x = _matrix(b.column("vec"))
            row, cell = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for i in range(0, len(x), 1024):
                part = x[i:i + 1024]
                away = np.sqrt(np.stack([exact_distances(part, np.broadcast_to(centroids[c], part.shape)) for c in used], axis=1))
                if first:
                    row.append(i + np.arange(len(part)))
                    cell.append(used[away.argmin(axis=1)].astype(np.int32))
                else:
                    bound = np.array([np.inf if v is None else np.sqrt(v) for v in b.column("bound").to_pylist()[i:i + 1024]])
                    done = b.column("cell").to_numpy()[i:i + 1024]
                    margin = 1e-9 * (away + radius[used][None, :]) + 1e-12
                    r, c = np.nonzero((away - radius[used][None, :] - margin <= bound[:, None]) & (used[None, :] != done[:, None]))
                    row.append(i + r)
                    cell.append(used[c].astype(np.int32))
            row, cell = np.concatenate(row), np.concatenate(cell)
            yield pa.RecordBatch.from_arrays([b.column("qid").take(pa.array(row)), b.column("vec").take(pa.array(row)), pa.array(cell, pa.int32())],
                                             names=["qid", "vec", "cell"])
    return run


def _search(k: int):
    def run(docs: pa.Table, queries: pa.Table) -> pa.Table:
        if not docs.num_rows or not queries.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], docs["id"].type), "distance": pa.array([], pa.float64())})
        ids = docs["id"].to_pylist()
        rank = np.empty(len(ids), np.int64)
        rank[sorted(range(len(ids)), key=lambda i: ids[i])] = np.arange(len(ids))
        d, x, found = _matrix(docs["vec"]), _matrix(queries["vec"]), []
        for i in range(0, len(x), 1024):
            q, at, dist = best_of_block(x[i:i + 1024], d, rank, k)
            found.append((q + i, at, dist))
        q, at, dist = (np.concatenate(c) for c in zip(*found))
        return pa.table({"qid": queries["qid"].take(pa.array(q)), "id": docs["id"].take(pa.array(at)), "distance": pa.array(dist)})
    return run


def _searched(visits: DataFrame, blocks: DataFrame, k: int, id_type: str) -> DataFrame:
    """The k best of every (query, block) of the visited cells."""
    slices = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(SLICE_QUERIES)).cast("int").alias("slices"))   # at most CELLS rows
    parts = blocks.groupBy("cell").agg((F.max("block") + 1).alias("blocks"))                                            # at most CELLS rows
    sides = write_table(slices.join(parts, "cell"), "cell-sides")
    asked = visits.join(F.broadcast(sides), "cell").select(
        "cell", F.pmod(F.xxhash64("qid"), F.col("slices")).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "qid", "vec")
    held = blocks.join(F.broadcast(sides), "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "block", "id", "vec")
    keys = ["cell", "slice", "block"]
    ship_package(visits.sparkSession)
    return held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_search(k), f"qid bigint, id {id_type}, distance double")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of every query with their rank (a window per query
    holds k rows per block visited)."""
    w = Window.partitionBy("qid").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest_docs(queries: DataFrame, docs: DataFrame, k: int = 3, vec: str = "embedding", doc_id: str = "doc_id",
                 cell_docs: int = CELL_DOCS, cells: int = CELLS) -> DataFrame:
    """The k nearest documents (squared L2, ties to the smaller id) of every
    query row: its other columns, ``rank`` from 1, the document's id and
    ``distance``.  Rows without a vector, with null components or of another
    length than most documents' are left out; fewer than k documents give
    fewer rows."""
    spark = queries.sparkSession
    clean = lambda df: df.filter(F.col("vec").isNotNull() & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v)))
    items = write_table(clean(docs.select(F.col(doc_id).alias("id"), F.col(vec).cast("array<double>").alias("vec"))), "nearest-docs")
    lengths = items.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    id_type = items.schema["id"].dataType.simpleString()
    other = [c for c in queries.columns if c != vec]
    dims = lengths["dims"] if lengths else 0
    items = items.filter(F.size("vec") == dims)
    asked = queries.withColumn("qid", F.monotonically_increasing_id()).withColumn("vec", F.col(vec).cast("array<double>"))
    asked = write_table(clean(asked.drop(vec) if vec != "vec" else asked).filter(F.size("vec") == dims), "nearest-queries")   # qid is fixed here
    n = items.count()
    if not n:
        return asked.filter("false").select(*other, F.lit(0).alias("rank"), F.lit(None).cast(id_type).alias(doc_id), F.lit(0.0).alias("distance"))
    wanted = max(1, min(cells, -(-n // cell_docs), n))
    sample = items.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(min(SAMPLE, wanted)).select("vec").collect()   # at most CELLS rows
    centroids = np.array([r["vec"] for r in sample], np.float64).reshape(len(sample), dims)
    ship_package(spark)
    placed = write_table(items.mapInArrow(_assign(centroids), f"id {id_type}, vec array<double>, cell int, far double"), "nearest-cells")
    found = placed.groupBy("cell").agg(F.max("far").alias("r"), F.count(F.lit(1)).alias("n")).collect()                       # at most CELLS rows
    radius = np.full(len(centroids), -1.0)
    for r in found:
        radius[r["cell"]] = r["r"]
    most = F.create_map(*[F.lit(x) for r in found for x in (r["cell"], -(-r["n"] // BLOCK_DOCS))])
    blocks = placed.select("cell", F.pmod(F.xxhash64(F.col("id").cast("string"), "vec"), F.element_at(most, F.col("cell"))).cast("int").alias("block"), "id", "vec")
    named = "qid bigint, vec array<double>, cell int"
    first = write_table(asked.select("qid", "vec").mapInArrow(_visits(centroids, radius, True), named), "nearest-visits")
    near = write_table(_best(_searched(first, blocks, k, id_type), k), "nearest-found")
    bound = near.filter(F.col("rank") == k).select("qid", F.col("distance").alias("bound"))
    rest = first.join(bound, "qid", "left").mapInArrow(_visits(centroids, radius, False), named)
    rest = write_table(rest, "nearest-visits")
    hits = near.drop("rank").unionByName(_searched(rest, blocks, k, id_type)) if not rest.isEmpty() else near.drop("rank")
    best = _best(hits, k).select("qid", F.col("rank").alias("__rank"), F.col("id").alias("__id"), F.col("distance").alias("__distance"))
    return asked.drop("vec").join(best, "qid").select(*other, F.col("__rank").alias("rank"), F.col("__id").alias(doc_id), F.col("__distance").alias("distance"))
