import numpy as np
from cases import frame, rows_of, sample, words
from hypothesis import given, settings
from hypothesis import strategies as st
from healthwatch.llm import mixing
from pyspark.sql import functions as F


def brute_targets(sizes):
    """sizes: source -> words; excess is reshared until no target is above its cap."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] >= 2 * sizes[s]]
        if not over:
            return {**capped, **{s: level * weight[s] for s in free}}
        capped |= {s: 2.0 * sizes[s] for s in over}


def check(spark, df):
    got = mixing.mix(df).collect()
    source = {}
    for r in df.select("doc_id", "text", "source").collect():
        source[r["source"]] = source.get(r["source"], 0) + len(words(r["text"]))
    want = brute_targets(source)
    assert len(got) == df.count()
    taken, largest = {}, {}
    for r in got:
        assert r["source_size"] == source[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    for s in source:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6
    return sorted((str(r["doc_id"]), r["size"], r["copies"]) for r in got)


def test_targets_and_totals(spark):
    check(spark, frame(spark))
    first = check(spark, sample(spark))
    assert first == check(spark, sample(spark).repartition(3))      # reruns agree, whatever the layout
    assert sorted(r["size"] for r in mixing.mix(sample(spark)).collect()) == sorted(len(words(t)) for _, t in rows_of(sample(spark)))


def test_many_leaves_keep_the_total(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF_ROWS", 4)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    check(spark, sample(spark))


def test_repeated_rows_are_spread_over_leaves(spark, monkeypatch):
    """Fully repeated rows and copies with null doc_id in one source."""
    tables, write = [], mixing.write_table

    def watched(df, name):
        tables.append((name, write(df, name)))
        return tables[-1][1]

    monkeypatch.setattr(mixing, "LEAF_ROWS", 16)
    monkeypatch.setattr(mixing, "write_table", watched)
    rows = [(1, "one two three", "en", "a", 1)] * 500 + [(None, "four five", "en", "a", 1)] * 500 + [(i, "six " * (i % 9 + 1), "en", "b", 1) for i in range(200)]
    df = frame(spark, rows)
    first = check(spark, df)
    level = next(t for name, t in tables if name == "mix-level")
    sizes = [r["count"] for r in level.groupBy("source", "leaf").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 64
    assert first == check(spark, df.repartition(3)) == check(spark, df.orderBy(F.rand(3)).coalesce(1))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 1000), st.floats(0.01, 0.99)), min_size=1, max_size=60), st.booleans())
def test_pivotal_keeps_mass(units, last):
    sizes = np.array([u[0] for u in units])
    p = np.array([u[1] for u in units])
    after, done = mixing.pivotal(sizes, p, np.arange(len(p)), last)
    assert (~done).sum() <= (0 if last else 1)
    assert set(after[done]) <= {0.0, 1.0}
    slack = sizes.max() if last else 1e-6 * sizes.sum()
    assert abs((sizes * after).sum() - (sizes * p).sum()) <= slack


def test_draws_are_unbiased():
    p = np.array([0.2, 0.5, 0.7, 0.9])
    runs = [mixing.pivotal(np.array([5, 3, 9, 4]), p, np.arange(4) + 1000 * k, True)[0] for k in range(4000)]
    assert np.abs(np.mean(runs, axis=0) - p).max() < 0.04


def test_stage_repeats_and_empty(spark):
    df = frame(spark)
    out = mixing.stage(spark, df, "")
    assert out.columns == df.columns
    want = {}
    for r in mixing.mix(df).collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["copies"]
    got = {}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: v for k, v in want.items() if v}
    assert mixing.mix(frame(spark, [])).count() == 0


def test_one_document_of_half_a_source_and_many_small_ones():
    """The total ends within one small document of what was asked for."""
    rng = np.random.default_rng(4)
    for trial in range(40):
        sizes = np.concatenate([[4000], rng.integers(20, 90, 75)])
        share = rng.uniform(0.2, 0.8)
        hashes = rng.integers(-2 ** 62, 2 ** 62, 76)
        p, done = mixing.pivotal(sizes, np.full(76, share), hashes, True)
        p = mixing.made_up(sizes, np.full(76, share), p, hashes)
        assert done.all() and set(p.tolist()) <= {0.0, 1.0}
        want, rest = share * sizes.sum(), sizes[1:].sum()
        feasible = min(max(want, 0 if p[0] == 0 else 4000), rest if p[0] == 0 else 4000 + rest)
        assert abs((sizes * p).sum() - feasible) <= 90
