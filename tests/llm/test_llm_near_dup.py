import random

import numpy as np
from cases import frame, near_classes, rows_of, sample
from healthwatch.llm import near_dup as nd


def test_signature_agreement_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    e = rng.integers(0, 2 ** 63, 400).astype(np.uint64)
    a = rng.random(400) * 3 + 0.05
    b = np.where(rng.random(400) < 0.7, a, rng.random(400) * 3)
    s = nd.dart_signatures(np.repeat([0, 1], 400), np.concatenate([e, e]), np.concatenate([a, b]), 2, 4096)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03
    ones = nd.dart_signatures(np.repeat([0, 1], 400), np.concatenate([e, e + (np.arange(400) >= 300).astype(np.uint64)]), np.ones(800), 2, 4096)
    assert abs((ones[0] == ones[1]).mean() - 300 / 500) < 0.03


def test_signature_does_not_depend_on_its_batch():
    e = np.arange(1, 50).astype(np.uint64)
    alone = nd.dart_signatures(np.zeros(49, int), e, np.ones(49), 1, 160)
    beside = nd.dart_signatures(np.repeat([0, 1], 49), np.concatenate([e + np.uint64(99), e]), np.ones(98), 2, 160)
    assert (alone[0] == beside[1]).all()
    assert (nd.dart_signatures(np.zeros(0, int), e[:0], np.ones(0), 1, 8) == 2 ** 32 - 1).all()


def check(spark, df):
    got = nd.near_duplicates(df).collect()
    rows = rows_of(df)
    classes = near_classes(rows)
    members = {}
    for (i, _), c in zip(rows, classes):
        members.setdefault(c, []).append(i)
    known = lambda ids: max([i for i in ids if i is not None], default=None)
    want = sorted((str(i), str(known(members[c])), len(members[c])) for (i, _), c in zip(rows, classes))
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["class_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(members)


def test_classes_match_all_pairs(spark):
    check(spark, frame(spark))
    check(spark, sample(spark))


def test_families_of_variants(spark):
    """Variants of one text on both sides of the threshold: chains, hubs and
    unlinked members that share buckets."""
    rnd = random.Random(7)
    base = [f"w{rnd.randrange(10 ** 6)}" for _ in range(120)]
    rows = []
    for n in range(90):
        w = list(base)
        for _ in range(rnd.choice([1, 2, 3, 4, 5, 6, 8])):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10 ** 6)}"
        rows.append((n, " ".join(w), "en", "a", 0))
    check(spark, frame(spark, rows))


def test_join_links_are_not_named_as_all_links(spark):
    """Every two of these texts are linked; joining needs fewer links."""
    base = [f"w{i}" for i in range(200)]
    df = frame(spark, [(n, " ".join([*base, f"x{n}"]), "en", "a", 0) for n in range(6)])
    got = nd.near_duplicates(df)
    assert "n_links" not in got.columns and "n_join_links" in got.columns
    links = [r["n_join_links"] for r in got.collect()]
    assert max(links) <= 5 and 2 * 5 <= sum(links) < 6 * 5


def test_components(spark):
    edges = [(bytes([i]), bytes([i + 1])) for i in range(40)] + [(b"\xf0", bytes([200 + i])) for i in range(20)]
    got = {bytes(r["node"]): bytes(r["root"]) for r in nd.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert got == {**{bytes([i]): b"\x00" for i in range(41)}, **{bytes([200 + i]): bytes([200]) for i in range(20)}, b"\xf0": bytes([200])}


def test_stage_and_empty(spark):
    df = frame(spark)
    out = nd.stage(spark, df, "")
    assert out.columns == df.columns and out.count() == len(set(near_classes(rows_of(df))))
    assert nd.near_duplicates(frame(spark, [])).count() == 0


def test_rows_of_a_block_are_fewer_than_its_components(spark):
    """All members of one bucket are alike: a task returns a spanning tree."""
    import numpy as np
    import pyarrow as pa
    n = 300
    sets = [np.arange(100, dtype=np.uint64).tobytes() for _ in range(n)]
    nodes = [k.to_bytes(4, "big") for k in range(n)]
    both = pa.table({"minor": [True] * n + [False] * n, "node": nodes * 2, "root": nodes * 2, "shingles": sets * 2})
    out = nd._compare_blocks(0.8)(both)
    assert out.num_rows == n - 1
    seen = {nodes[0]}
    for _ in range(n):
        seen |= {x for e in zip(out["a"].to_pylist(), out["b"].to_pylist()) for x in e if set(e) & seen}
    assert len(seen) == n
