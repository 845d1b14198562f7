import collections
import re
import zlib

import numpy as np
import pytest
from cases import frame, rows_of, sample
from hypothesis import given, settings
from hypothesis import strategies as st
from healthwatch.llm import spelling as sp


def edit_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_words(rows):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def brute(rows):
    n = brute_words(rows)
    masks = collections.defaultdict(set)  # words that agree but for one place
    for w in n:
        for k in range(len(w)):
            masks[w[:k] + "\0" + w[k + 1:]].add(w)
            masks[w[:k] + w[k + 1:]].add(w)
        masks[w].add(w)
    near = {w: set() for w in n}
    for group in masks.values():
        for a in group:
            near[a] |= {b for b in group if edit_one(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def got(df, **options):
    rows = sp.spelling_variants(df, **options).collect()
    out = {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abÿ", min_size=4, max_size=4), min_size=1, max_size=60, unique=True), st.integers(1, 2), st.integers(1, 8))
def test_tree_finds_all_points_in_the_ball(words, radius, leaf):
    points = sp.letter_counts(sp.letter_codes(words))
    tree = sp.KdTree(points, leaf)
    found = [(int(s), int(p)) for a, b in tree.within(points, radius) for s, p in zip(a, b)]
    want = {(i, j) for i in range(len(words)) for j in range(len(words)) if np.abs(points[i] - points[j]).sum() <= radius}
    assert len(found) == len(set(found)) and set(found) == want


def test_letter_order_is_verified():
    code = sp.letter_codes
    assert sp.one_edit(code(["abcde", "abcde", "abcde"]), code(["abxde", "abcde", "bacde"])).tolist() == [True, False, False]
    assert sp.one_edit(code(["abcde", "abcde", "abcde", "aaaaa"]), code(["abcdee", "xabcde", "bacdee", "aaaaaa"])).tolist() == [True, True, False, True]


@pytest.mark.parametrize("cell_words", [1, 40, 5000])
def test_sample_matches_brute_force(spark, cell_words):
    df = sample(spark)
    rows = rows_of(df)
    if cell_words == 1:  # many rounds of splits: a smaller vocabulary is enough
        rows = rows[:60]
        df = df.sparkSession.createDataFrame(rows, "doc_id bigint, text string")
    assert got(df, cell_words=cell_words) == brute(rows)


def test_cases_long_words_hot_cells_and_empty_table(spark, monkeypatch):
    df = frame(spark)
    assert got(df) == brute(rows_of(df))
    monkeypatch.setattr(sp, "CELL_SEARCHES", 3)
    long = "ab" * 4000
    texts = [f"{long} {long}c {long[:-1]}x "] * 3 + ["abcde abcdf abcdg xbcde abcdefg " * 4, "abcde Àbcde àbcde ABCDE abcd× " * 3, "bcdea cdeab deabc eabcd " * 3]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)]
    rows += [(0, texts[0], "en", "s", 1), (None, None, "en", "s", 1)]
    df = frame(spark, rows)
    assert got(df, cell_words=2) == brute(rows_of(df))
    assert got(frame(spark, [])) == set()


def test_chains_end_at_one_root(spark):
    steps = ["aaaaaaaa", "aaaaaaab", "aaaaaabb", "aaaaabbb", "aaaabbbb", "aaabbbbb"]
    text = " ".join(" ".join([w] * (3 << k)) for k, w in enumerate(steps))
    df = frame(spark, [(None, text, "en", "s", 1)])
    out = {r[0]: r[2] for r in got(df)}
    assert got(df) == brute(rows_of(df)) and out["aaaaaaaa"] == "aaabbbbb"
