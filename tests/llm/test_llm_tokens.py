import random

import numpy as np
from cases import frame, sample
from healthwatch.llm import token_counts as tc

ENCODE, WIDTH = tc.encoder(tc.load_ranks())


def brute(fields):
    text, bounds, _ = tc.line_bounds(fields)
    section = [max(i for i in range(len(bounds) - 1) if bounds[i] <= c) for c in range(len(text))]
    owner = [c for c, ch in enumerate(text) for _ in ch.encode()]
    counts, crossing, at = [0] * (len(bounds) - 1), 0, 0
    ids = ENCODE(text)
    for i in ids:
        hit = [section[c] for c in sorted(set(owner[at:at + WIDTH[i]]))]
        at += WIDTH[i]
        crossing += len(set(hit)) > 1
        counts[max(sorted(set(hit)), key=hit.count)] += 1
    return len(ids), crossing, counts


def test_sections_match_brute_force():
    rnd = random.Random(1)
    bits = ["the ", "of", "\n", "\n\n", "\n\n\n", " ", "é", "漢字", "🙂", "word", "\t", "  \n", "a b"]
    for _ in range(800):
        fields = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 12))) for _ in range(rnd.randrange(1, 4))]
        if "\n".join(fields):
            n, crossing, counts, _ = tc.count_sections(fields, ENCODE, WIDTH, "most")
            assert (n, crossing, counts.tolist()) == brute(fields)
            for rule in ("first", "last", "split"):
                assert abs(tc.count_sections(fields, ENCODE, WIDTH, rule)[2].sum() - n) < 1e-6


def test_allocation_rules():
    first, end, bounds = np.array([0]), np.array([4]), np.array([0, 1, 4])
    assert tc.allocate(first, end, bounds, "first")[0].tolist() == [1, 0]
    assert tc.allocate(first, end, bounds, "last")[0].tolist() == [0, 1]
    assert tc.allocate(first, end, bounds, "most")[0].tolist() == [0, 1]
    assert tc.allocate(first, end, bounds, "split")[0].tolist() == [0.25, 0.75]
    assert tc.allocate(first, np.array([2]), bounds, "most")[0].tolist() == [1, 0]      # a tie goes to the earlier one


def test_query(spark):
    for df in (frame(spark), sample(spark)):
        got = {}
        for r in tc.token_counts(df, ("source", "text")).collect():
            assert abs(sum(r["section_tokens"]) - r["n_tokens"]) < 1e-6 and abs(sum(r["field_tokens"]) - r["n_tokens"]) < 1e-6
            got.setdefault(r["doc_id"], []).append(r["n_tokens"])
        want = {}
        for r in df.collect():
            text = f"{r['source'] or ''}\n{r['text'] or ''}"
            want.setdefault(r["doc_id"], []).append(len(ENCODE(text)))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert tc.token_counts(frame(spark, [])).count() == 0


def test_long_blank_runs():
    assert tc.count_sections([" " * 100_000], ENCODE, WIDTH, "most")[0] > 0
