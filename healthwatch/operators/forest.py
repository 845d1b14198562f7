"""Isolation forest (Liu, Ting & Zhou 2008) on Spark.

MLlib has no isolation forest, so it is built from DataFrame pieces:

1. **Sample.**  Every row is hashed once; the :data:`KEEP` rows with the
   smallest hash are kept (a top-k: tasks keep their own smallest, one merge).
   A tree draws ``psi`` of the kept rows by a hash of (seed, tree, row), so no
   row of the table is paired with the trees.
2. **Trees** -- ``groupBy(tree).applyInPandas``: one group per tree, each at
   most ``psi`` (256) rows.  Feature and threshold of a node come from a hash
   of (seed, tree, node), nodes are numbered as in a heap.
3. **Scores** -- the node table has at most ``trees x (2 psi - 1)`` rows
   whatever the data size; it is collected once, sent to the tasks, and every
   partition is scored vectorised with ``mapInPandas``.  Path lengths are
   whole millionths, so their sums do not depend on any order.
4. **Threshold** -- the exact ``contamination`` quantile of the scores: ranges
   are counted and refined around the wanted rank until few values are left.

All draws are MD5 of plain text, so any engine can rebuild the same forest (the
SQL of the registered queries does), and a recomputed task repeats them.  Rows
with a missing or NaN feature are not sampled and get no score.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from healthwatch.session import ship_package, write_table

EULER = 0.5772156649015329
#: Rows kept for the trees to draw from.
KEEP = 4096
#: Path lengths are counted in this fraction of a step.
UNIT = 1_000_000
#: Ranges counted at once, and rows few enough to be looked at one by one.
RANGES, FEW = 1024, 10_000
NODE_SCHEMA = "tree int, node int, feature int, threshold double, size int, path long"


def c_factor(n: float) -> float:
    """Average unsuccessful-search path length in a BST of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def c_units(n: int) -> int:
    return round(c_factor(n) * UNIT)


def max_depth(psi: int) -> int:
    return math.ceil(math.log2(max(psi, 2)))


def node_draw(seed: int, tree: int, node: int) -> tuple[int, float]:
    """(feature draw, threshold draw in [0, 1)) of a node."""
    h = hashlib.md5(f"{seed}|{tree}|{node}".encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16) / 2.0 ** 32


def _build_tree(pdf: pd.DataFrame, features: list[str], seed: int, depth_limit: int) -> pd.DataFrame:
    tree = int(pdf["tree"].iloc[0])
    x = pdf[features].to_numpy(dtype="float64")
    rows, todo = [], [(1, 0, np.arange(len(x)))]
    while todo:
        node, depth, idx = todo.pop()
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        movable = np.flatnonzero(hi > lo)
        if depth >= depth_limit or len(idx) <= 1 or not len(movable):
            rows.append((tree, node, -1, 0.0, len(idx), depth * UNIT + c_units(len(idx))))
            continue
        pick, u = node_draw(seed, tree, node)
        f = int(movable[pick % len(movable)])
        t = float(lo[f] + u * (hi[f] - lo[f]))
        rows.append((tree, node, f, t, len(idx), -1))
        right = sub[:, f] >= t
        todo += [(2 * node, depth + 1, idx[~right]), (2 * node + 1, depth + 1, idx[right])]
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "size", "path"])


def _complete(features: list[str]) -> Column:
    ok = F.lit(True)
    for f in features:
        v = F.col(f).cast("double")
        ok = ok & v.isNotNull() & ~F.isnan(v)
    return ok


def fit(df: DataFrame, features: list[str], trees: int = 100, psi: int = 256, seed: int = 42,
        row_id: str | None = None, n: int | None = None, keep: int = KEEP) -> tuple[DataFrame, int]:
    """Build the forest; returns (node table, effective psi)."""
    rows = df.filter(_complete(features))
    n = rows.count() if n is None else n
    psi = min(psi, n)
    name = F.col(row_id).cast("string") if row_id else F.md5(F.concat_ws("|", *[F.col(f).cast("string") for f in features]))
    kept = (rows.select(*[F.col(f).cast("double").alias(f) for f in features], name.alias("_id"))
                .withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), "_id"))).orderBy("_h", "_id").limit(max(keep, psi)).drop("_h"))
    drawn = (kept.withColumn("tree", F.explode(F.array(*[F.lit(t) for t in range(trees)])))      # at most keep x trees rows
                 .withColumn("_u", F.md5(F.concat(F.lit(f"{seed}|"), F.col("tree").cast("string"), F.lit("|"), "_id"))))
    w = Window.partitionBy("tree").orderBy("_u", "_id")
    sample = drawn.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= psi).select("tree", *features)
    ship_package(df.sparkSession)
    depth = max_depth(psi)
    return sample.groupBy("tree").applyInPandas(lambda pdf: _build_tree(pdf, features, seed, depth), NODE_SCHEMA), psi


def _model(nodes: DataFrame, trees: int, psi: int) -> dict:
    """The node table as arrays (trees x heap)."""
    limit = trees * (2 * psi - 1)
    pdf = nodes.limit(limit + 1).toPandas()
    if len(pdf) > limit:
        raise ValueError("node table larger than trees x (2 psi - 1)")
    heap = 2 << max_depth(psi)
    feature, threshold = np.zeros((trees, heap), np.int32), np.zeros((trees, heap))
    path = np.full((trees, heap), -1, np.int64)
    at = (pdf["tree"].to_numpy(), pdf["node"].to_numpy())
    feature[at], threshold[at], path[at] = pdf["feature"], pdf["threshold"], pdf["path"]
    return {"feature": feature, "threshold": threshold, "path": path, "scale": trees * c_units(psi), "depth": max_depth(psi)}


def _path_sums(x: np.ndarray, model: dict) -> np.ndarray:
    """Path lengths of every row, summed over the trees, in whole units."""
    total, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for feature, threshold, path in zip(model["feature"], model["threshold"], model["path"]):
        node = np.ones(len(x), np.int64)
        for _ in range(model["depth"]):
            inner = path[node] < 0
            child = 2 * node + (x[rows, feature[node]] >= threshold[node])
            node = np.where(inner, child, node)
        total += path[node]
    return total


def score(df: DataFrame, nodes: DataFrame, features: list[str], trees: int, psi: int) -> DataFrame:
    """Add ``anomaly_score`` = 2^(-E[h(x)] / c(psi)) (higher = more isolated),
    null for rows with a missing feature."""
    spark = df.sparkSession
    ship_package(spark)
    bmodel = spark.sparkContext.broadcast(_model(nodes, trees, psi))
    out_schema = T.StructType(list(df.schema.fields) + [T.StructField("anomaly_score", T.DoubleType())])

    def fn(it):
        m = bmodel.value
        for pdf in it:
            x = pdf[features].to_numpy(dtype="float64")
            known = ~np.isnan(x).any(axis=1)
            s = np.full(len(x), 0.5) if m["scale"] == 0 else np.power(2.0, -(_path_sums(np.nan_to_num(x), m) / m["scale"]))
            yield pdf.assign(anomaly_score=pd.Series(s, index=pdf.index).where(known, None))

    return df.mapInPandas(fn, out_schema)


def value_at_rank(df: DataFrame, col: str, rank: int) -> float:
    """The value with ``rank`` smaller-or-equal predecessors (0 is the least):
    counts of ranges, refined around the rank, one small aggregate a step."""
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    rows = df
    while lo < hi:
        width = (hi - lo) / RANGES
        bucket = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(RANGES - 1)) if width > 0 else F.lit(0)
        found = sorted(rows.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect())
        for b, n, lo_b, hi_b in found:                       # at most RANGES rows
            if rank < n:
                break
            rank -= n
        rows, lo, hi = rows.filter(F.col(col).between(lo_b, hi_b)), lo_b, hi_b
        if n <= FEW:
            return sorted(r[0] for r in rows.select(col).collect())[rank]
    return lo


def quantile_cut(df: DataFrame, col: str, q: float) -> float:
    """Exact quantile with linear interpolation at position (n - 1) q."""
    at = (df.count() - 1) * q
    low = value_at_rank(df, col, math.floor(at))
    high = low if at == math.floor(at) else value_at_rank(df, col, math.ceil(at))
    return low + (at - math.floor(at)) * (high - low)


def isolation_forest(df: DataFrame, features: list[str], trees: int = 100, psi: int = 256,
                     contamination: float = 0.05, seed: int = 42, min_rows: int = 20,
                     approx: bool = False, row_id: str | None = None, keep: int = KEEP) -> DataFrame:
    """Score every row: ``score`` = decision value (round 4, negative =
    anomaly) and ``is_anomaly``.  With fewer than ``min_rows`` complete rows no
    model is fitted: every row gets a NULL score and ``is_anomaly`` false."""
    n = df.filter(_complete(features)).count()
    if n < min_rows:
        return df.withColumns({"score": F.lit(None).cast("double"), "is_anomaly": F.lit(False),
                               "details": F.lit("Insufficient data")})
    nodes, psi = fit(df, features, trees, psi, seed, row_id, n, keep)
    # Scores feed both the contamination cut and the output: write them once
    # (Python scoring is the expensive step) instead of scoring twice.
    scored = write_table(score(df, nodes, features, trees, psi), "forest-scores").withColumn("neg", -F.col("anomaly_score"))
    known = scored.filter("neg is not null").select("neg")
    cut = known.agg(F.percentile_approx("neg", contamination, 100000)).first()[0] if approx else quantile_cut(known, "neg", contamination)
    dec = F.col("neg") - F.lit(cut)
    rounded = F.round(dec, 4)
    return (scored.withColumns({"score": F.when(rounded == 0, F.lit(0.0)).otherwise(rounded), "is_anomaly": F.coalesce(dec < 0, F.lit(False)),
                                "details": F.lit(None).cast("string")})
                  .drop("neg", "anomaly_score"))


def analyze_latest(df: DataFrame, features: list[str], ts: str = "ts", **kw) -> DataFrame:
    """Fit on all history and report the newest row's verdict (of equal times
    the one with the largest features, in their order)."""
    scored = isolation_forest(df, features, **kw)
    newest = [F.col(ts).desc(), *[F.col(f).desc() for f in features]]
    return scored.orderBy(*newest).limit(1).select(ts, *features, "score", "is_anomaly", "details")
