import collections
import hashlib

import numpy as np
import pytest
from cases import ROWS, frame, key, lower, rows_of, sample
from hypothesis import given, settings
from hypothesis import strategies as st
from healthwatch.llm import exact_dedup as ed
from pyspark.sql import functions as F


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2 ** 64 - 1), max_size=400))
def test_fuse_filter_has_no_false_negatives(values):
    keys = np.array(sorted(values), np.uint64)
    built = ed.fuse_build(keys)
    assert ed.fuse_contains(keys, *built).all()


def test_fuse_filter_size_and_false_positives():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2 ** 63, 50_000).astype(np.uint64)
    built = ed.fuse_build(keys)
    assert len(built[3]) < 1.3 * len(keys)
    assert ed.fuse_contains(rng.integers(0, 2 ** 63, 200_000).astype(np.uint64), *built).mean() < 1e-3


def brute(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return out, len(groups)


@pytest.mark.parametrize("split", [None, "true", "false", "doc_id % 2 = 0"])
def test_classes_match_brute_force(spark, split):
    for df in (frame(spark), sample(spark)):
        part = split if split is None else F.coalesce(F.expr(split), F.lit(False))
        got = ed.exact_duplicates(df, part).collect()
        want, groups = brute(rows_of(df))
        assert key([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got]) == key(want)
        assert sum(r["kept"] for r in got) == groups
        assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


@pytest.mark.parametrize("split", ["false", "true", "doc_id = 1"])
def test_screening_tasks_are_bounded_by_both_sides(spark, monkeypatch, split):
    """An empty or tiny snapshot must not put the whole batch in one shard."""
    most, screen = [], ed.screen

    def watched(digests, filters, shards):
        most.append(digests.groupBy(ed._shard(F.col("digest"), shards)).count().agg(F.max("count")).first()[0] or 0)
        return screen(digests, filters, shards)

    monkeypatch.setattr(ed, "SHARD_KEYS", 8)
    monkeypatch.setattr(ed, "screen", watched)
    df = sample(spark).limit(400)
    got = ed.exact_duplicates(df, F.coalesce(F.expr(split), F.lit(False))).collect()
    want, groups = brute([(r["doc_id"], r["text"]) for r in df._stored_rows.collect()] if hasattr(df, "_stored_rows") else rows_of(df))
    assert key([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got]) == key(want)
    assert sum(r["kept"] for r in got) == groups and max(most) <= 30


def test_stage_leaves_one_row_of_each_text(spark):
    df = frame(spark)
    out = ed.stage(spark, df, "")
    assert out.columns == df.columns
    assert sorted(lower(r["text"]) for r in out.collect()) == sorted({lower(r[1]) for r in ROWS})
    assert ed.exact_duplicates(frame(spark, [])).count() == 0


def test_multiplied_joined_and_unioned_rows_keep_one_row_a_group(spark):
    """Rows that share a scanned row are still rows of their own."""
    docs = sample(spark)
    texts = len({lower(r["text"]) for r in docs.collect()})
    n = docs.count()
    inputs = [docs.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))), docs.unionByName(docs),
              docs.join(spark.createDataFrame([("en",), ("en",), ("de",)], "lang string"), "lang", "left")]
    for df in inputs:
        got = ed.exact_duplicates(df).collect()
        assert len(got) == df.count() and len({(r["__row_file"], r["__row_pos"]) for r in got}) == len(got)
        assert sum(r["kept"] for r in got) == len({lower(r["text"]) for r in df.collect()}) <= texts
        assert ed.stage(spark, df, "").count() == sum(r["kept"] for r in got)
    assert inputs[0].count() == 2 * n
