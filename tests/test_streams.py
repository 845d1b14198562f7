"""Offset log, stall timers, once-only intake, panes, running baseline."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from healthwatch.operators import alerts as al
from healthwatch.operators import baseline as bl
from healthwatch.operators import telemetry as tm
from healthwatch.sources import fixtures as fx
from healthwatch.sources import offset_log as ol
from healthwatch.streaming import late as lt
from healthwatch.streaming import pipeline as sp
from healthwatch.streaming import running as rn
from healthwatch.streaming import silence as si

from conftest import SF_SMOKE

T0 = dt.datetime(2024, 1, 1)
SCHEMA = (T.StructType().add("id", "string").add("k", "string").add("ts", T.TimestampNTZType()).add("v", "double")
          .add("tags", T.ArrayType(T.StringType())).add("day", "date").add("at", "timestamp"))


def _rows(spark, items):
    """Events (id, key, second)."""
    return spark.createDataFrame([(i, k, T0 + dt.timedelta(seconds=s), float(s), [k], T0.date(), T0) for i, k, s in items], SCHEMA)


@pytest.fixture
def log(spark, tmp_path):
    path = str(tmp_path / "log")
    ol.create(spark, path, SCHEMA, partitions=3)
    return path


def _append(spark, path, items):
    return ol.append(_rows(spark, items), path, "k", ["ts", "id"])


def test_log_offsets_are_consecutive_and_typed(spark, log):
    items = [(f"e{n}", f"k{n % 7}", n * 10) for n in range(50)]
    _append(spark, log, items[:20])
    high = _append(spark, log, items[20:])
    assert sum(high.values()) == 50
    df = ol.read_log(spark, log)
    assert [f.dataType for f in df.schema.fields[:7]] == [f.dataType for f in SCHEMA.fields]
    got = df.collect()
    assert sorted(r["id"] for r in got) == sorted(i for i, _, _ in items) and got[0]["tags"] == [got[0]["k"]]
    for p, h in high.items():
        mine = sorted((r for r in got if r["partition"] == p), key=lambda r: r["offset"])
        assert [r["offset"] for r in mine] == list(range(h))
        assert [r["ts"] for r in mine] == sorted(r["ts"] for r in mine)
    assert len({(r["k"], r["partition"]) for r in got}) == len({r["k"] for r in got})


def test_log_newest_rows_open_only_the_segments_they_need(spark, log):
    for k in range(5):
        high = _append(spark, log, [(f"e{n}", f"k{n % 7}", n * 10) for n in range(k * 40, k * 40 + 40)])
    begin = {p: max(0, h - 4) for p, h in high.items()}
    used = {os.path.join(log, s["file"]) for s in ol.segments(log)}
    needed = {p.file for p in ol.plan(log, begin, high)}
    assert needed < used and len(needed) <= 2 * len(high)
    newest = ol.read_log(spark, log, n=4).collect()
    assert len(newest) == sum(h - begin[p] for p, h in high.items()) and all(r["offset"] >= begin[r["partition"]] for r in newest)
    assert ol.read_log(spark, log, n=10 ** 6).count() == 200 and ol.read_log(spark, log, n=0).count() == 0


def test_log_groups_resume_and_lag(spark, log):
    high = _append(spark, log, [(f"e{n}", f"k{n % 7}", n) for n in range(60)])
    seen = []
    for _ in range(20):
        rows, offsets = ol.consume(spark, log, "g", limit=5)
        got = [r["id"] for r in rows.collect()]
        if not got:
            break
        seen += got
        lag = tm.consumer_lag(ol.group_offsets(spark, log, "g", "t")).first()["consumer_lag"]
        ol.commit(log, "g", offsets)
        after = tm.consumer_lag(ol.group_offsets(spark, log, "g", "t")).first()["consumer_lag"]
        assert after == 60 - len(seen) and lag >= after
    assert sorted(seen) == sorted(f"e{n}" for n in range(60))
    assert ol.committed(log, "g") == high and ol.committed(log, "other") == {}


def test_log_stream_resumes_from_checkpoint_and_commits(spark, log, tmp_path):
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ck")

    def run():
        return sp.run_to_table(ol.stream_log(spark, log, group="s"), "t", "append", out=out, checkpoint=ckpt).count()

    _append(spark, log, [(f"a{n}", "x", n) for n in range(10)])
    assert run() == 10
    _append(spark, log, [(f"b{n}", f"k{n}", n) for n in range(7)])
    assert run() == 17 and run() == 17
    _append(spark, log, [("c", "x", 1)])
    assert run() == 18
    assert sum(ol.committed(log, "s").values()) in (17, 18)   # the last batch is committed when the next begins
    assert sp.run_to_table(ol.stream_log(spark, log, starting="latest"), "u", "append").count() == 0


def test_log_follow_and_second_writer(spark, log, tmp_path, monkeypatch):
    _append(spark, log, [("a", "x", 1)])
    _append(spark, log, [("b", "x", 2)])
    copy = str(tmp_path / "copy")
    assert sum(ol.follow(log, copy).values()) == 1 and sum(ol.follow(log, copy).values()) == 2
    assert sorted(r["id"] for r in ol.read_log(spark, copy).collect()) == ["a", "b"]
    children = ol._children
    monkeypatch.setattr(ol, "_children", lambda path: [] if path.endswith("manifests") else children(path))
    with pytest.raises(RuntimeError, match="another writer"):
        _append(spark, log, [("c", "x", 3)])
    with pytest.raises(FileNotFoundError):
        ol.high_watermarks(str(tmp_path / "nothing"))


def _stalls(spark, log, out, ckpt, feed, **kw):
    with si.rocksdb_state(spark):
        return sp.run_to_table(si.stalls(ol.stream_log(spark, log), **kw), "stall", "append", out=out, checkpoint=ckpt, feed=feed)


def _wait(query, seconds):
    until = time.monotonic() + seconds
    while time.monotonic() < until:
        assert query.exception() is None
        time.sleep(0.1)


def test_silence_is_reported_once_and_survives_a_restart(spark, log, tmp_path):
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ck")
    kw = dict(gap_seconds=30, silence_seconds=6)

    def first(query):
        for items in ([("a", "x", 0), ("b", "y", 10), ("late", "y", 5)], [("c", "x", 100)], [("d", "z", 110)]):
            sp.caught_up(query, _append(spark, log, items))

    got = _stalls(spark, log, out, ckpt, first, **kw)
    assert [(r["kind"], r["gap_seconds"]) for r in got.filter("kind = 'gap'").collect()] == [("gap", 90.0)]
    time.sleep(6)                                                    # the timer is due while nothing runs

    def until_silent(query):
        for _ in range(60):
            _wait(query, 1)
            written = spark.read.parquet(out)
            if written.filter("kind = 'silent' and gap_start = '2024-01-01 00:01:50'").count():
                return

    got = _stalls(spark, log, out, ckpt, until_silent, **kw)
    assert [r["gap_start"] for r in si.open_stalls(got).filter("kind = 'silent'").collect()] == [T0 + dt.timedelta(seconds=110)]
    assert got.filter("kind = 'silent' and gap_start = '2024-01-01 00:01:50'").count() == 1
    again = _stalls(spark, log, out, ckpt, lambda q: _wait(q, 8), **kw)
    assert again.count() == got.count()                              # neither repeated nor lost


def test_stalls_per_key_and_empty_times(spark, log, tmp_path):
    _append(spark, log, [("a", "x", 0), ("b", "x", 40), ("c", "y", 0), ("d", "y", 29), ("e", "y", 60)])

    def feed(query):
        sp.caught_up(query, ol.high_watermarks(log))

    got = _stalls(spark, log, str(tmp_path / "o"), str(tmp_path / "c"), feed, key="k", silence_seconds=3600, ttl_seconds=3600)
    assert sorted((r["key"], r["gap_seconds"]) for r in got.collect()) == [("x", 40.0), ("y", 31.0)]


def test_repeats_replays_and_late_events(spark, log, tmp_path):
    hour = 3600
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ck")
    first = [(f"e{n}", f"k{n % 3}", n * 60) for n in range(120)]
    second = [(f"e{n}", f"k{n % 3}", n * 60) for n in range(100, 240)]           # 20 repeats within the delay
    third = [("late1", "k1", 10), ("late2", "k2", 20), ("late2", "k2", 20), ("e3", "k0", 180), ("f", "k0", 5 * hour)]

    def feed(query):
        for items in (first, second, third):
            sp.caught_up(query, _append(spark, log, items))
            query.processAllAvailable()

    accepted = sp.run_to_table(lt.accept_once(ol.stream_log(spark, log), ["id"]), "a", "append", out=out, checkpoint=ckpt, feed=feed)
    ids = sorted(r["id"] for r in accepted.collect())
    assert ids == sorted({i for i, _, _ in first + second} | {"f"})
    late = lt.late_rows(ol.read_log(spark, log), accepted, ["id"])
    assert sorted(r["id"] for r in late.collect()) == ["late1", "late2"]


def test_panes_leave_the_state_and_the_burst_is_flagged(spark, log):
    quiet = [(f"q{n}", f"k{n % 5}", 20 * n) for n in range(300)]
    burst = [(f"b{n}", "flood", 3000 + n % 3) for n in range(60)]
    held = []

    def feed(query):
        for items in (quiet[:100], quiet[100:200] + burst, quiet[200:], [("z", "beat", 10 ** 6)]):
            _append(spark, log, items)
            query.processAllAvailable()
            held.append(max(sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in query.recentProgress[-1:]))

    stream = sp.event_time(ol.stream_log(spark, log), delay="10 seconds")
    out = sp.run_to_table(sp.burst_windows(stream, key="k"), "b", "append", feed=feed)
    rows = out.select("k", F.col("w.start").alias("s"), "events", "is_burst").collect()
    want = {}
    for _, k, s in quiet + burst:
        for w in (s - 2, s - 1, s):
            want[k, w] = want.get((k, w), 0) + 1
    got = {(r["k"], int((r["s"] - T0).total_seconds())): r["events"] for r in rows}
    assert got == want and {r["k"] for r in rows if r["is_burst"]} == {"flood"}
    assert max(held) <= 40 and held[-1] <= 4                          # open panes and windows only


def test_running_baseline_equals_the_batch_one(spark):
    source, path = fx.event_log(spark, SF_SMOKE), None
    from healthwatch.session import scratch_path
    path = scratch_path(spark, f"running-{time.time_ns()}")
    ol.follow(source, path, 0)

    def feed(query):
        for _ in range(3):
            sp.caught_up(query, ol.follow(source, path))

    state = sp.run_to_table(rn.running_baseline(ol.stream_log(spark, path)), "r", "complete", feed=feed)
    stats, hist = bl.from_sketch(state)
    v = fx.vitals(spark, SF_SMOKE)
    exact = {r["field"]: r for r in bl.fit_baseline(v).collect()}
    got = {r["field"]: r for r in stats.collect()}
    for f, r in exact.items():
        for c in ("n_samples", "mean", "std", "min_value", "max_value"):
            assert got[f][c] == pytest.approx(r[c], abs=1e-4)
    counts = {r["field"]: r["n"] for r in hist.groupBy("field").agg(F.sum("n").alias("n")).collect()}
    assert counts == {f: r["n_samples"] for f, r in exact.items()}
    one_pass = {r["field"]: r["mean"] for r in bl.fit_sketch(v).collect()}
    assert all(one_pass[f] == pytest.approx(exact[f]["mean"], abs=1e-4) for f in exact)
    _, inc = fx.split_base_inc(v)
    fired = {r["detector"] for r in al.detect_all(inc, stats, hist).collect()}
    assert {"zscore", "schema_entropy"} <= fired


def test_latest_n_resumes_and_keeps_two_states(spark, log, tmp_path):
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ck")
    items = [(f"e{n:03d}", f"k{n % 4}", (n * 37) % 500) for n in range(90)]
    for k in range(0, 90, 15):
        _append(spark, log, items[k:k + 15])
        got = sp.stream_latest_n(ol.stream_log(spark, log).drop("partition", "offset"), ["ts", "id"], 10, out=out, checkpoint=ckpt)
        want = sorted(items[:k + 15], key=lambda x: (x[2], x[0]))[-10:]
        assert sorted(r["id"] for r in got.collect()) == sorted(i for i, _, _ in want)
    assert len([f for f in os.listdir(out) if f.startswith("bid=")]) == 2
