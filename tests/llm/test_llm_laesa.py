import hashlib
import math

import numpy as np
import pytest
from cases import SF, key
from healthwatch.llm import laesa

SCHEMA = "vec_id bigint, embedding array<float>, label int, q string, cluster string, distance string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "q", "c", "d") for i, v in rows], SCHEMA)


def brute(rows, k=16, rounds=3, dims=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(64 * x) for x in v]))
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centroids = [q for _, _, q in sorted((name(i), tuple(q), q) for i, q in kept)[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [min((dist(q, c), j) for j, c in enumerate(centroids)) for _, q in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            own = [q for (_, q), (_, c) in zip(kept, found) if c == j]
            if own:
                centroids[j] = [sum(col) // len(own) for col in zip(*own)]
    found = assign()
    per = [sum(d for d, c in found if c == j) for j in range(len(centroids))]
    prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return key([(i, c, d, per[c], sum(per), prints[c]) for (i, _), (d, c) in zip(kept, found)])


def got(df, **options):
    names = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return key([tuple(r[c] for c in names) for r in laesa.clustered(df, **options).collect()])


def test_sample_matches_brute_force(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert got(df) == brute([(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_left_out_rows_ties_and_repeats(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.normal(size=64).astype(np.float32)]) for k in range(30)]
    bad = [(100, None), (101, []), (102, [0.5] * 63), (103, [0.5] * 65), (104, [float("nan")] + [0.0] * 63), (105, [None] + [0.0] * 63),
           (106, [float("inf")] + [0.0] * 63), (107, [float("-inf")] + [0.0] * 63)]
    rows += [rows[0]] * 4 + [(None, rows[1][1]), (None, rows[2][1]), (7, rows[3][1]), (200, [0.0] * 64), (201, [-0.0] * 64), (202, [1e6] * 64)]
    assert got(frame(spark, rows + bad)) == brute(rows)
    assert got(frame(spark, rows[:5])) == brute(rows[:5])
    same = [(k, [0.25] * 64) for k in range(40)]
    assert got(frame(spark, same)) == brute(same)
    assert got(frame(spark, bad)) == [] and got(frame(spark, [])) == []
    with pytest.raises(Exception, match="exact 64-bit"):
        got(frame(spark, [(1, [1e30] * 64)]))


def test_pivot_bounds_spare_exact_distances():
    rng = np.random.default_rng(1)
    centres = rng.integers(-3000, 3000, (16, 64))
    x = centres[rng.integers(0, 16, 2000)] + rng.integers(-40, 40, (2000, 64))
    to = np.stack([np.sqrt(laesa.squared(x, p).astype(float)) for p in centres], axis=1)
    moved = centres + rng.integers(-10, 10, centres.shape)
    cluster, best, exact = laesa.nearest(x, to, moved, centres)
    full = ((x[:, None, :] - moved[None]) ** 2).sum(-1)
    assert (cluster == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
    assert exact < 2 * len(x)
