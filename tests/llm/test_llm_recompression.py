import collections
import hashlib

import numpy as np
import pytest
from cases import frame, key, rows_of, sample, words
from hypothesis import given, settings
from hypothesis import strategies as st
from healthwatch.llm import recompression as rc


def brute(rows, window=35):
    seen = collections.Counter()
    texts = [words(t) for _, t in rows]
    for w in texts:
        seen.update(tuple(w[k:k + window]) for k in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, texts):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k:k + window])] > 1:
                gone[k:k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return key(out)


def got(df, **options):
    rows = rc.without_repeats(df, **options).collect()
    for r in rows:
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"]
        assert r["n_words"] - r["n_removed"] == len(words(r["kept_text"]))
    return key([(r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in rows])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), min_size=1, max_size=5), st.integers(3, 12))
def test_equal_windows_hold_equal_symbols(docs, window):
    """The context of a symbol fixes it: where its words occur, it occurs."""
    word, counts = rc.flat_words([" ".join(f"w{x}" for x in d).encode() for d in docs])
    assert counts.tolist() == [len(d) for d in docs]
    text = word.tolist()
    for _, name, first, last, _, _ in rc.symbols(word, (1, 2, 3, 4), window):
        name, first, last = name[first <= last], first[first <= last], last[first <= last]
        held = collections.defaultdict(set)
        for n, a, z in zip(name.tolist(), first.tolist(), last.tolist()):
            assert z - a >= 0
            for s in range(max(a, 0), z + 1):
                if 0 not in text[s:s + window] and len(text[s:s + window]) == window:
                    held[tuple(text[s:s + window])].add((s, z - s, n))
        for found in held.values():
            per_start = collections.defaultdict(set)
            for s, offset, n in found:
                per_start[s].add((offset, n))
            starts = [s for s in range(len(text) - window + 1) if tuple(text[s:s + window]) == tuple(text[next(iter(per_start)):][:window])]
            assert all(per_start[s] == per_start[starts[0]] for s in starts)


@pytest.mark.parametrize("levels,long", [((), ()), ((1,), rc.LONG), ((3, 5), ()), ((6,), (1, 2, 3, 7, 8, 12, 30))])
def test_matches_brute_force_on_cases(spark, levels, long):
    df = frame(spark)
    assert got(df, levels=levels, long=long) == brute(rows_of(df))


def test_periodic_short_and_repeated_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = ["a " * 36, "a " * 35, "a " * 34, "b a b " * 40, passage, "x " + passage + " y", passage.replace("p30", "q30"), None, "",
             " ".join(f"v{x}" for x in rng.integers(0, 3, 400)), " ".join(f"v{x}" for x in rng.integers(0, 3, 400)),
             "é ü " * 20 + passage, "one two one two " * 9, " ".join(f"u{k}" for k in range(35)), " ".join(f"u{k}" for k in range(35))]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)] + [(4, passage, "en", "s", 1), (None, "a " * 36, "en", "s", 1)]
    df = frame(spark, rows)
    want = brute(rows_of(df))
    assert got(df) == want
    assert got(df, levels=(2, 4, 8)) == want
    for window in (3, 8):
        assert got(df, window=window, levels=(1, 2), long=(3, 4, 6, 9), long_words=4, slice_bytes=900) == brute(rows_of(df), window)
    monkeypatch.setattr(rc, "BROADCAST_DOCS", -1)  # the sort-merge way gives the same
    assert got(df) == want


@pytest.mark.parametrize("slice_bytes", [rc.BATCH_BYTES, 3_000])
def test_whole_sample_and_empty_table(spark, slice_bytes):
    """Small slices spread copies over many tasks' slices, so their high
    symbols meet in the round, not in one slice."""
    df = sample(spark)
    assert got(df, slice_bytes=slice_bytes) == brute(rows_of(df))
    assert rc.without_repeats(frame(spark, [])).count() == 0
