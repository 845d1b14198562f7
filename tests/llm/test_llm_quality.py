import collections
import re

from cases import ROWS, frame, key, rows_of, sample, words
from healthwatch.llm import quality


def brute(text):
    t, w = text or "", words(text)
    lines = [x for x in t.split("\n") if words(x)]
    seen = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def figures(df):
    return [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in df.collect()]


def expected(rows):
    out = []
    for i, t in rows:
        f = brute(t)
        out.append((i, *f, f[0] < 20 or 100 * f[4] > 30 * f[0]))
    return out


def test_measures_match_brute_force(spark):
    for df in (frame(spark), sample(spark)):
        assert key(figures(quality.quality(df))) == key(expected(rows_of(df)))


def test_verdict_keeps_prose_and_rejects_junk(spark):
    got = {r["doc_id"]: (r["kept"], r["failed_rules"]) for r in quality.quality(frame(spark)).collect() if r["doc_id"]}
    assert got[1][0] and got[3][0]
    assert not got[13][0] and "symbols" in got[13][1]
    assert not got[4][0] and not got[5][0] and not got[11][0]


def test_plan_is_native_and_narrow(spark):
    plan = quality.quality(sample(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_stage_keeps_columns_and_empty_table(spark):
    df = frame(spark)
    out = quality.stage(spark, df, "")
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert {r["doc_id"] for r in out.collect()} >= {1, 2, 3}
    assert quality.quality(frame(spark, [])).count() == 0
    assert len(ROWS) > out.count()
