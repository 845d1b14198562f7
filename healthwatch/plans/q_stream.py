"""Registered streaming queries (J1-J7, A1, E11, E14): the vitals table as an
offset log that grows while the query runs, one append per micro-batch."""

from __future__ import annotations

import os
import time

from pyspark.sql import functions as F

from healthwatch.functions import fields as fd
from healthwatch.operators import baseline as bl
from healthwatch.operators import telemetry as tm
from healthwatch.plans import sqlgen as sg
from healthwatch.plans.registry import register
from healthwatch.session import scratch_path
from healthwatch.sources import fixtures as fx
from healthwatch.sources import offset_log as ol
from healthwatch.streaming import pipeline as sp

SLICES = len(fx.LOG_CUTS) + 1


class _Replay:
    """A fresh log that receives the appends of a stored one while a query
    reads it; with ``beat`` the closing heartbeat comes last."""

    def __init__(self, spark, sf_dir, name="vitals", beat=False):
        import uuid
        self.source = fx.event_log(spark, sf_dir, name)
        self.path = scratch_path(spark, f"replay-{uuid.uuid4().hex[:12]}")
        self.beat = beat
        ol.follow(self.source, self.path, 0)
        self.stream = ol.stream_log(spark, self.path).drop("partition", "offset")

    def feed(self, query):
        for _ in range(SLICES):
            sp.caught_up(query, ol.follow(self.source, self.path))
        if self.beat:
            ol.follow(self.source, self.path)
            query.processAllAvailable()


def _ntz(c):
    return F.col(c).cast("timestamp_ntz")


# ---------------------------------------------------------------- J3
@register("stream_window_stats", sql="""
SELECT date_trunc('hour', ts) AS window_start, COUNT(*) AS events, ROUND(AVG(heart_rate), 4) AS avg_heart_rate,
       COUNT(*) FILTER (WHERE COALESCE(heart_rate > 200 OR bp_systolic > 180 OR spo2 < 70, false)) AS impossible_events
FROM vitals GROUP BY 1""", views=("vitals",))
def q_stream_window_stats(spark, sf_dir):
    r = _Replay(spark, sf_dir, beat=True)
    out = sp.run_to_table(sp.window_stats(sp.event_time(r.stream), "1 hour"), "window_stats", "append", feed=r.feed)
    return out.select(_ntz("w.start").alias("window_start"), "events",
                      F.round("avg_heart_rate", 4).alias("avg_heart_rate"), "impossible_events")


# ---------------------------------------------------------------- J4
@register("stream_burst", sql="""
WITH w AS (SELECT patient_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) - t.k AS ws
           FROM rush, range(0, 3) t(k))
SELECT patient_id, make_timestamp(ws * 1000000) AS window_start, make_timestamp((ws + 3) * 1000000) AS window_end,
       COUNT(*) AS events, COUNT(*) >= 50 AS is_burst FROM w GROUP BY patient_id, ws""", views=("rush",))
def q_stream_burst(spark, sf_dir):
    r = _Replay(spark, sf_dir, "rush", beat=True)
    out = sp.run_to_table(sp.burst_windows(sp.event_time(r.stream)), "burst", "append", feed=r.feed)
    return out.select("patient_id", _ntz("w.start").alias("window_start"), _ntz("w.end").alias("window_end"),
                      "events", "is_burst")


# ---------------------------------------------------------------- J5
@register("stream_sessions", sql="""
WITH o AS (SELECT ward, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY ward ORDER BY ts)) < 30000000
                                 THEN 0 ELSE 1 END AS brk FROM vitals),
s AS (SELECT ward, ts, SUM(brk) OVER (PARTITION BY ward ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM o)
SELECT ward, MIN(ts) AS session_start, MAX(ts) + INTERVAL 30 SECOND AS session_end, COUNT(*) AS events
FROM s GROUP BY ward, sid""", views=("vitals",))
def q_stream_sessions(spark, sf_dir):
    r = _Replay(spark, sf_dir, beat=True)
    with sp.local_sessions(spark):
        out = sp.run_to_table(sp.idle_sessions(sp.event_time(r.stream)), "sessions", "append", feed=r.feed)
    return out.select("ward", _ntz("s.start").alias("session_start"), _ntz("s.end").alias("session_end"), "events")


# ---------------------------------------------------------------- J1
# One append is one micro-batch.  The first holds no event of the incoming half: a stall.
def _stream_detect_sql():
    from healthwatch.plans.q_triage import alert_ctes
    edges = ["2024-01-16 00:00:00", *[c for c in fx.LOG_CUTS if c > fx.INC_START], "9999-01-01 00:00:00"]
    spans = [("9998-01-01 00:00:00", "9999-01-01 00:00:00")] * sum(c <= fx.INC_START for c in fx.LOG_CUTS) + list(zip(edges, edges[1:]))
    parts = [f"""SELECT * FROM (WITH slice AS (SELECT * FROM inc WHERE ts >= CAST('{lo}' AS TIMESTAMP) AND ts < CAST('{hi}' AS TIMESTAMP)),
{alert_ctes('slice')} SELECT *, CAST({k} AS BIGINT) AS batch_id FROM alerts) s{k}""" for k, (lo, hi) in enumerate(spans)]
    return "\nUNION ALL ".join(parts)


@register("stream_detect", sql=_stream_detect_sql(), views=("base", "inc"))
def q_stream_detect(spark, sf_dir):
    base, _ = fx.split_base_inc(fx.vitals(spark, sf_dir))
    cut = F.lit(fx.INC_START).cast("timestamp_ntz")
    r = _Replay(spark, sf_dir)
    return sp.stream_detect(r.stream.filter(F.col("ts") >= cut), *bl.fit(base, quantiles=False), feed=r.feed)


# ---------------------------------------------------------------- E11 (stream form)
@register("stream_stall_gaps", sql="""
SELECT ward, prev AS gap_start, ts AS gap_end, CAST(epoch_us(ts) - epoch_us(prev) AS DOUBLE) / 1000000 AS gap_seconds
FROM (SELECT ward, ts, lag(ts) OVER (PARTITION BY ward ORDER BY ts) AS prev FROM vitals) q
WHERE epoch_us(ts) - epoch_us(prev) > 30000000""", views=("vitals",))
def q_stream_stall_gaps(spark, sf_dir):
    out = _stalls(spark, sf_dir, "ward", 3600)
    return out.filter("kind = 'gap'").select(F.col("key").alias("ward"), _ntz("gap_start").alias("gap_start"),
                                             _ntz("gap_end").alias("gap_end"), "gap_seconds")


def _stalls(spark, sf_dir, key, silence_seconds, until_silent=False):
    from healthwatch.streaming import silence as si
    r = _Replay(spark, sf_dir)
    path = scratch_path(spark, f"{os.path.basename(r.path)}-stalls")

    def feed(query):
        r.feed(query)
        high = query.lastProgress["batchId"]
        while until_silent and not sp.folder_after(spark, path, high):
            if query.exception() is not None:
                raise query.exception()
            time.sleep(0.2)

    with si.rocksdb_state(spark):
        return sp.run_to_table(si.stalls(r.stream, silence_seconds=silence_seconds, key=key), "stalls", "append", out=path, feed=feed)


@register("stream_stall", sql="""
SELECT 'gap' AS kind, prev AS gap_start, ts AS gap_end, CAST(epoch_us(ts) - epoch_us(prev) AS DOUBLE) / 1000000 AS gap_seconds
FROM (SELECT ts, lag(ts) OVER (ORDER BY ts) AS prev FROM vitals) q WHERE epoch_us(ts) - epoch_us(prev) > 30000000
UNION ALL SELECT 'silent', MAX(ts), NULL, NULL FROM vitals""", views=("vitals",))
def q_stream_stall(spark, sf_dir):
    """The whole stream: its gaps, and the silence after its last event, which
    a timer reports without any further input."""
    from healthwatch.streaming import silence as si
    out = si.open_stalls(_stalls(spark, sf_dir, None, 2, until_silent=True))
    return out.select("kind", _ntz("gap_start").alias("gap_start"), _ntz("gap_end").alias("gap_end"), "gap_seconds")


# ---------------------------------------------------------------- J2
@register("stream_latest_n", sql="SELECT * FROM vitals ORDER BY ts DESC, event_id DESC LIMIT 50", views=("vitals",))
def q_stream_latest_n(spark, sf_dir):
    r = _Replay(spark, sf_dir)
    return sp.stream_latest_n(r.stream, ["ts", "event_id"], 50, feed=r.feed)


# ---------------------------------------------------------------- J7
_LATE = "\nUNION ALL ".join(f"""SELECT ts FROM vitals
WHERE ts < CAST('{c}' AS TIMESTAMP) - INTERVAL 3 DAY AND CAST(substr(event_id, 4) AS BIGINT) % 50 = 7""" for c in fx.LOG_CUTS)


@register("stream_late", sql=f"""
SELECT date_trunc('day', ts) AS day, COUNT(*) FILTER (WHERE NOT late) AS events, COUNT(*) FILTER (WHERE late) AS late_events
FROM (SELECT ts, false AS late FROM vitals UNION ALL SELECT ts, true AS late FROM ({_LATE}) l) q GROUP BY 1""", views=("vitals",))
def q_stream_late(spark, sf_dir):
    """Events per day, each once, and the late ones: every slice of the log
    repeats a day of the slice before and brings old events under new ids."""
    from healthwatch.streaming import late as lt
    r = _Replay(spark, sf_dir, "late")
    accepted = sp.run_to_table(lt.accept_once(r.stream, ["event_id"]), "accepted", "append", feed=r.feed)
    read = ol.read_log(spark, r.path).drop("partition", "offset")
    late = lt.late_rows(read, accepted, ["event_id"])
    both = accepted.select(_ntz("ts").alias("ts"), F.lit(False).alias("late")).unionByName(late.select(_ntz("ts").alias("ts"), F.lit(True).alias("late")))
    return both.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(
        F.count_if(~F.col("late")).alias("events"), F.count_if("late").alias("late_events"))


# ---------------------------------------------------------------- J6, D1
@register("stream_baseline", sql=f"""
WITH bs AS ({sg.melt('vitals')})
SELECT field, COUNT(*) AS n_samples, ROUND(AVG(v), 4) AS mean, ROUND(STDDEV_POP(v), 4) AS std, ROUND(MIN(v), 4) AS min_value,
       ROUND(MAX(v), 4) AS max_value, true AS p25_within, true AS p75_within FROM bs GROUP BY field""", views=("vitals",))
def q_stream_baseline(spark, sf_dir):
    """The baseline after all micro-batches: exact moments; whether the ranks
    of the sketched quartiles lie within the stated error of the true ones."""
    from healthwatch.streaming import running as rn
    r = _Replay(spark, sf_dir)
    state = sp.run_to_table(rn.running_baseline(r.stream), "running-baseline", "complete", feed=r.feed)
    stats, _ = bl.from_sketch(state)
    ranks = bl.melt(fx.vitals(spark, sf_dir)).join(F.broadcast(stats.select("field", "p25", "p75")), "field")   # one row a field
    e = bl.SKETCH_ERROR
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))

    def within(c, q):
        return ((share(F.col("value") < F.col(c)) <= q + e) & (share(F.col("value") <= F.col(c)) >= q - e)).alias(f"{c}_within")

    near = ranks.groupBy("field").agg(within("p25", 0.25), within("p75", 0.75))
    return stats.drop("p25", "p75").join(F.broadcast(near), "field")


# ---------------------------------------------------------------- E14 from commits
@register("log_lag", sql="""
SELECT 'vitals' AS topic, COUNT(*) - 300 AS consumer_lag FROM vitals""", views=("vitals",))
def q_log_lag(spark, sf_dir):
    """Lag of a group that has committed 300 rows in two reads, 50 and then 25
    of each of the four partitions."""
    r = _Replay(spark, sf_dir)
    ol.follow(r.source, r.path, SLICES)
    for limit in (50, 25):
        _, offsets = ol.consume(spark, r.path, "reporter", limit)
        ol.commit(r.path, "reporter", offsets)
    return tm.consumer_lag(ol.group_offsets(spark, r.path, "reporter", "vitals"))
