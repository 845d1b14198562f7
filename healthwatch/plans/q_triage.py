"""Registered security, telemetry, fan-in and triage queries (E8-E15, C4, F1-F6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from healthwatch.functions import fields as fd
from healthwatch.operators import alerts as al
from healthwatch.operators import baseline as bl
from healthwatch.operators import security as sec
from healthwatch.operators import telemetry as tm
from healthwatch.operators import triage as tr
from healthwatch.operators import zscore as zs
from healthwatch.plans import sqlgen as sg
from healthwatch.plans.q_detect import SCHEMA_ROWS, ks_ctes
from healthwatch.plans.registry import register
from healthwatch.sources import fixtures as fx
from healthwatch.sources.tables import table


def _halves(spark, sf_dir):
    return fx.split_base_inc(fx.vitals(spark, sf_dir))


# ---------------------------------------------------------------- E9
@register("security_denylist", sql="""
SELECT patient_id, COUNT(*) AS event_count, COUNT(*) > 5 AS is_flood
FROM vitals WHERE patient_id IN ('PT-ATTACKER-0000') GROUP BY patient_id""", views=("vitals",))
def q_security_denylist(spark, sf_dir):
    return sec.denylist_flood(fx.vitals(spark, sf_dir))


# ---------------------------------------------------------------- E10
@register("hot_key_share", sql="""
SELECT patient_id, COUNT(*) AS event_count,
       ROUND(CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM vitals), 4) AS share,
       COUNT(*) > CAST(0.2 AS DOUBLE) * (SELECT COUNT(*) FROM vitals) AS is_hot
FROM vitals GROUP BY patient_id""", views=("vitals",))
def q_hot_key_share(spark, sf_dir):
    return sec.hot_keys(fx.vitals(spark, sf_dir))


@register("heavy_hitters", sql="""
SELECT patient_id, COUNT(*) AS event_count, ROUND(CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM crowded), 4) AS share,
       COUNT(*) > CAST(0.2 AS DOUBLE) * (SELECT COUNT(*) FROM crowded) AS is_hot
FROM crowded GROUP BY patient_id HAVING COUNT(*) > CAST(0.05 AS DOUBLE) * (SELECT COUNT(*) FROM crowded)""", views=("crowded",))
def q_heavy_hitters(spark, sf_dir):
    return sec.heavy_hitters(fx.crowded(spark, sf_dir), floor=0.05)


@register("burst_rate", sql="""
WITH w AS (SELECT patient_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) - t.k AS ws
           FROM rush, range(0, 3) t(k)),
c AS (SELECT patient_id, ws, COUNT(*) AS n FROM w GROUP BY patient_id, ws)
SELECT patient_id, MAX(n) AS max_events, MAX(n) >= 50 AS is_burst FROM c GROUP BY patient_id""",
          views=("rush",))
def q_burst_rate(spark, sf_dir):
    return sec.burst_rate(fx.rush(spark, sf_dir))


# ---------------------------------------------------------------- E11
@register("stall_gaps", sql="""
SELECT prev AS gap_start, ts AS gap_end, CAST(epoch_us(ts) - epoch_us(prev) AS DOUBLE) / 1000000 AS gap_seconds
FROM (SELECT ts, lag(ts) OVER (ORDER BY ts) AS prev FROM events) q
WHERE epoch_us(ts) - epoch_us(prev) > 30000000""")
def q_stall_gaps(spark, sf_dir):
    g = tm.stall_gaps(table(spark, sf_dir, "events"))
    return g.select(F.col("gap_start").cast("timestamp_ntz").alias("gap_start"),
                    F.col("gap_end").cast("timestamp_ntz").alias("gap_end"), "gap_seconds")


# ---------------------------------------------------------------- E12
@register("latency_breaches", sql="SELECT ts, db_latency_sec FROM telemetry WHERE db_latency_sec > 3",
          views=("telemetry",))
def q_latency_breaches(spark, sf_dir):
    return tm.latency_breaches(fx.telemetry(spark, sf_dir)).select("ts", "db_latency_sec")


# ---------------------------------------------------------------- E13
_TF = tm.TELEMETRY_FIELDS


@register("telemetry_zscore", sql=f"""
WITH tb AS (SELECT * FROM telemetry WHERE ts < CAST('2024-01-16 00:00:00' AS TIMESTAMP)),
ti AS (SELECT * FROM telemetry WHERE ts >= CAST('2024-01-16 00:00:00' AS TIMESTAMP)),
{sg.stats_cte('tb', _TF)}, {sg.z_cte('ti', ('ts',), _TF)}
SELECT ti.ts, COALESCE(e.n_anomalous, 0) AS n_anomalous, e.anomalous_fields, e.max_zscore
FROM ti LEFT JOIN (SELECT ts, COUNT(*) AS n_anomalous, string_agg(field, ',' ORDER BY field) AS anomalous_fields,
                          MAX(ROUND(z, 2)) AS max_zscore FROM zl WHERE z > 3 GROUP BY ts) e ON ti.ts = e.ts""",
          views=("telemetry",))
def q_telemetry_zscore(spark, sf_dir):
    tel = fx.telemetry(spark, sf_dir)
    cut = F.lit(fx.INC_START).cast("timestamp_ntz")
    tb, ti = tel.filter(F.col("ts") < cut), tel.filter(F.col("ts") >= cut)
    flags = zs.zscore_flags(ti, bl.baseline_moments(tb, _TF), fields=_TF)
    return flags.select("ts", F.col("n_anomalous").cast("long").alias("n_anomalous"),
                        F.when(F.col("n_anomalous") > 0, F.array_join("anomalous_fields", ","))
                         .alias("anomalous_fields"), "max_zscore")


# ---------------------------------------------------------------- E14
@register("consumer_lag", sql="""
SELECT topic, CAST(SUM(CASE WHEN committed >= 0 THEN high - committed WHEN high > 0 THEN high ELSE 0 END) AS BIGINT)
       AS consumer_lag FROM offsets GROUP BY topic""", views=("offsets",))
def q_consumer_lag(spark, sf_dir):
    return tm.consumer_lag(fx.offsets(spark, sf_dir))


# ---------------------------------------------------------------- E8
def _forest_ctes(trees: int = 100, psi: int = 256, seed: int = 42, contamination: float = 0.05) -> str:
    """The same forest in SQL: md5 draws, one pair of CTEs per level of the
    trees, then every row walks down all trees."""
    from healthwatch.operators import forest as fo
    f, levels = _TF, fo.max_depth(psi)
    xs = ", ".join(f"CAST({c} AS DOUBLE) AS x{j}" for j, c in enumerate(f, 1))
    names = ", ".join(f"x{j}" for j in range(1, len(f) + 1))
    ranges = ", ".join(f"min(x{j}) AS lo{j}, max(x{j}) AS hi{j}" for j in range(1, len(f) + 1))
    lo, hi, moves = (", ".join(p.format(j=j) for j in range(1, len(f) + 1)) for p in ("lo{j}", "hi{j}", "hi{j} > lo{j}"))
    paths = "[" + ", ".join(str(fo.c_units(n)) for n in range(1, psi + 1)) + "]"
    hexa = "CAST(('0x' || substr(md5('{seed}|' || tree || '|' || node), {at}, 8)) AS BIGINT)"
    out = [f"tel AS MATERIALIZED (SELECT ts, {', '.join(f)}, {xs}, CAST(ts AS VARCHAR) AS id FROM telemetry)",
           f"size AS MATERIALIZED (SELECT least({psi}, count(*)) AS psi, CAST(ceil(log2(greatest(least({psi}, count(*)), 2))) AS INTEGER) AS depth FROM tel)",
           f"kept AS MATERIALIZED (SELECT id, {names} FROM tel ORDER BY md5('{seed}|' || id), id LIMIT {fo.KEEP})",
           f"drawn AS (SELECT t.t AS tree, k.*, row_number() OVER (PARTITION BY t.t ORDER BY md5('{seed}|' || t.t || '|' || id), id) AS rn FROM kept k, range({trees}) t(t))",
           f"a0 AS MATERIALIZED (SELECT tree, id, {names}, 1 AS node FROM drawn WHERE rn <= (SELECT psi FROM size))"]
    for d in range(levels + 1):
        out += [f"g{d} AS (SELECT tree, node, count(*) AS n, {ranges} FROM a{d} GROUP BY tree, node)",
                f"""m{d} AS (SELECT *, list_filter(range(1, {len(f) + 1}), lambda j: [{moves}][j]) AS mv, {hexa.format(seed=seed, at=1)} AS pick,
  {hexa.format(seed=seed, at=9)} / CAST(4294967296 AS DOUBLE) AS u FROM g{d})""",
                f"""s{d} AS MATERIALIZED (SELECT tree, node, leaf, f, CASE WHEN NOT leaf THEN [{lo}][f] + u * ([{hi}][f] - [{lo}][f]) END AS thr,
  CASE WHEN leaf THEN {d} * {fo.UNIT} + {paths}[n] END AS path
  FROM (SELECT *, {d} >= (SELECT depth FROM size) OR n <= 1 OR len(mv) = 0 AS leaf, mv[1 + pick % greatest(len(mv), 1)] AS f FROM m{d}) q)"""]
        if d < levels:
            out += [f"""a{d + 1} AS MATERIALIZED (SELECT a.tree, a.id, {', '.join('a.' + x for x in names.split(', '))},
  2 * a.node + CASE WHEN [{names}][s.f] >= s.thr THEN 1 ELSE 0 END AS node FROM a{d} a JOIN s{d} s USING (tree, node) WHERE NOT s.leaf)"""]
    out += ["nodes AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM s{d}" for d in range(levels + 1)) + ")",
            f"w0 AS (SELECT id, {names}, t.t AS tree, 1 AS node FROM tel, range({trees}) t(t))"]
    for d in range(levels):
        out += [f"""w{d + 1} AS MATERIALIZED (SELECT w.id, {', '.join('w.' + x for x in names.split(', '))}, w.tree,
  CASE WHEN o.leaf THEN w.node ELSE 2 * w.node + CASE WHEN [{names}][o.f] >= o.thr THEN 1 ELSE 0 END END AS node FROM w{d} w JOIN nodes o USING (tree, node))"""]
    out += [f"h AS (SELECT w.id, CAST(sum(o.path) AS BIGINT) AS total FROM w{levels} w JOIN nodes o USING (tree, node) GROUP BY w.id)",
            f"e AS (SELECT id, -pow(2, -(CAST(total AS DOUBLE) / ({trees} * {paths}[(SELECT psi FROM size)]))) AS neg FROM h)",
            f"cut AS (SELECT quantile_cont(neg, {contamination}) AS c FROM e)",
            f"verdict AS (SELECT ts, {', '.join(f)}, CASE WHEN round(neg - c, 4) = 0 THEN CAST(0 AS DOUBLE) ELSE round(neg - c, 4) END AS score, neg - c < 0 AS is_anomaly FROM e JOIN tel USING (id), cut)"]
    return ",\n".join(out)


@register("isolation_forest", sql=f"WITH {_forest_ctes()}\nSELECT ts, score, is_anomaly FROM verdict", views=("telemetry",))
def q_isolation_forest(spark, sf_dir):
    from healthwatch.operators import forest as fo
    tel = fx.telemetry(spark, sf_dir)
    return fo.isolation_forest(tel, tm.TELEMETRY_FIELDS, row_id="ts").select("ts", "score", "is_anomaly")


@register("forest_latest", sql=f"""WITH {_forest_ctes()}
SELECT ts, {', '.join(_TF)}, score, is_anomaly FROM verdict ORDER BY ts DESC LIMIT 1""", views=("telemetry",))
def q_forest_latest(spark, sf_dir):
    from healthwatch.operators import forest as fo
    return fo.analyze_latest(fx.telemetry(spark, sf_dir), tm.TELEMETRY_FIELDS, row_id="ts").drop("details")


# ---------------------------------------------------------------- E15
def alert_ctes(inc: str = "inc", security: bool = True, stall: bool = True) -> str:
    sec_part = "\n  UNION ALL SELECT 'security', 4, CAST(n AS BIGINT), patient_id FROM sec" if security else ""
    stall_part = ("SELECT 'stall' AS detector, 0 AS priority, CAST(n AS BIGINT) AS signal_count, "
                  "'No events received' AS detail\n  FROM tot WHERE n = 0\n  UNION ALL " if stall else "")
    return f"""{ks_ctes(inc)}, {sg.z_cte(inc)},
zf AS (SELECT COUNT(DISTINCT event_id) AS flagged, string_agg(DISTINCT field, ',' ORDER BY field) AS d
       FROM zl WHERE z > 3),
kd AS (SELECT COUNT(*) AS n, string_agg(field, ',' ORDER BY field) AS d FROM p WHERE p < CAST(0.0001 AS DOUBLE)),
{SCHEMA_ROWS.format(view=inc).strip()},
sf AS (SELECT COUNT(*) FILTER (WHERE anomaly_detected) AS flagged FROM sb),
sfc AS (SELECT kind || ':' || field AS kf FROM (
          SELECT 'missing' AS kind, unnest(missing_fields) AS field FROM sb WHERE anomaly_detected
          UNION ALL SELECT 'extra' AS kind, unnest(extra_fields) AS field FROM sb WHERE anomaly_detected) q
        GROUP BY kind, field),
sdd AS (SELECT COALESCE(string_agg(kf, ',' ORDER BY kf), '') AS d FROM sfc),
sec AS (SELECT patient_id, COUNT(*) AS n FROM {inc} WHERE patient_id IN ('PT-ATTACKER-0000')
        GROUP BY patient_id HAVING COUNT(*) > 5),
tot AS (SELECT COUNT(*) AS n FROM {inc}),
alerts AS (
  {stall_part}SELECT 'zscore' AS detector, 1 AS priority, CAST(flagged AS BIGINT) AS signal_count, d AS detail
  FROM zf WHERE flagged > 0
  UNION ALL SELECT 'ks_test', 2, CAST(n AS BIGINT), d FROM kd WHERE n > 0
  UNION ALL SELECT 'schema_entropy', 3, CAST(flagged AS BIGINT), (SELECT d FROM sdd) FROM sf WHERE flagged > 0{sec_part})"""


ALERT_CTES = alert_ctes()


def _alerts(spark, sf_dir):
    base, inc = _halves(spark, sf_dir)
    return al.detect_all(inc, *bl.fit(base, quantiles=False))


@register("alerts", sql=f"WITH {ALERT_CTES}\nSELECT * FROM alerts", views=("base", "inc"))
def q_alerts(spark, sf_dir):
    return _alerts(spark, sf_dir)


# ---------------------------------------------------------------- E15 on the topic path (key presence in JSON)
_TOPIC_KEYS = "list_sort(json_keys(raw))"
_TINC = f"""tinc AS (SELECT json_extract_string(raw, '$.event_id') AS event_id, json_extract_string(raw, '$.patient_id') AS patient_id,
  {', '.join(f"CAST(json_extract(raw, '$.{c}') AS DOUBLE) AS {c}" for c in fd.NUMERIC_FIELDS)}, raw, ts
  FROM topic WHERE json_valid(raw) AND ts >= CAST('{fx.INC_START}' AS TIMESTAMP))"""


@register("alerts_topic", sql=f"WITH {_TINC}, {alert_ctes('tinc').replace(sg.present_list(), _TOPIC_KEYS)}\nSELECT * FROM alerts", views=("base", "topic"))
def q_alerts_topic(spark, sf_dir):
    """The fan-in on raw messages: a key with a JSON null is present."""
    from healthwatch.sources import events as ev
    base, _ = _halves(spark, sf_dir)
    raw = fx.topic(spark, sf_dir)
    batch = ev.decode_variant(raw.filter(F.col("ts") >= F.lit(fx.INC_START).cast("timestamp_ntz")))
    return al.detect_all(batch, *bl.fit(base, quantiles=False), presence="json")


# ---------------------------------------------------------------- E15 on telemetry
@register("alerts_telemetry", sql=f"""
WITH {_forest_ctes()},
tb AS (SELECT * FROM telemetry WHERE ts < CAST('{fx.INC_START}' AS TIMESTAMP)),
ti AS (SELECT * FROM telemetry WHERE ts >= CAST('{fx.INC_START}' AS TIMESTAMP)),
{sg.stats_cte('tb', _TF)}, {sg.z_cte('ti', ('ts',), _TF)},
late AS (SELECT count(*) AS n FROM ti WHERE db_latency_sec > 3),
spikes AS (SELECT count(DISTINCT ts) AS n, string_agg(DISTINCT field, ',' ORDER BY field) AS d FROM zl WHERE z > 3),
odd AS (SELECT count(*) AS n FROM verdict WHERE is_anomaly AND ts >= CAST('{fx.INC_START}' AS TIMESTAMP))
SELECT 'telemetry_zscore' AS detector, 5 AS priority, n AS signal_count, d AS detail FROM spikes WHERE n > 0
UNION ALL SELECT 'isolation_forest', 6, n, '{",".join(_TF)}' FROM odd WHERE n > 0
UNION ALL SELECT 'latency_monitor', 7, n, 'db_latency_sec' FROM late WHERE n > 0""", views=("telemetry",))
def q_alerts_telemetry(spark, sf_dir):
    tel = fx.telemetry(spark, sf_dir)
    cut = F.lit(fx.INC_START).cast("timestamp_ntz")
    return al.telemetry_alerts(tel.filter(F.col("ts") >= cut), tel.filter(F.col("ts") < cut), row_id="ts")


def _components_sql(det):
    expr = f"['{fd.UNKNOWN_COMPONENT}']"
    for names, comps in reversed(fd.DETECTOR_COMPONENTS):
        expr = f"CASE WHEN {det} IN ({', '.join(repr(n) for n in names)}) THEN {sg.sql_list(comps)} ELSE {expr} END"
    return expr


# ---------------------------------------------------------------- F1-F3
PACKET_SELECT = f"""
SELECT COALESCE(string_agg(detector, ',' ORDER BY priority, detector), '') AS fault_signals,
       COALESCE(array_to_string(list_sort(list_distinct(flatten(list(comp)))), ','), '') AS affected_components,
       COUNT(*) AS n_signals,
       CASE WHEN COUNT(*) = 0 THEN 'UNKNOWN'
            WHEN COALESCE(bool_or(detector = 'security'), false) OR COUNT(*) > 1 THEN 'CRITICAL' ELSE 'HIGH' END AS severity
FROM (SELECT detector, priority, {_components_sql('detector')} AS comp FROM alerts) a"""


_PACKET = f"""WITH {ALERT_CTES},
pk AS ({PACKET_SELECT}),
sg AS (SELECT string_agg(detector || '/' || signal_count || '/' || detail, ';' ORDER BY priority, detector) AS signals,
              max(CASE WHEN detector = 'security' THEN detail END) AS attacker_id FROM alerts)
SELECT 'CRISIS-' || (SELECT CAST(floor(epoch_us(MAX(ts)) / 1000000) AS BIGINT) FROM inc) AS crisis_id, pk.*, COALESCE(sg.signals, '') AS signals, sg.attacker_id FROM pk, sg"""


@register("crisis_packet", sql=_PACKET, views=("base", "inc"))
def q_crisis_packet(spark, sf_dir):
    """The packet built at the time of the last event."""
    from healthwatch.functions.columns import epoch_micros
    _, inc = _halves(spark, sf_dir)
    now = inc.agg(F.floor(F.max(epoch_micros("ts", inc.schema["ts"].dataType)) / 1_000_000)).scalar()
    packet = tr.crisis_packet(_alerts(spark, sf_dir), crisis_id=tr.crisis_id(now))
    text = F.transform("signals", lambda s: F.concat_ws("/", s["detector"], s["signal_count"].cast("string"), s["detail"]))
    return packet.withColumn("signals", F.array_join(text, ";"))


# ---------------------------------------------------------------- F4
def _goal_sql(det):
    expr = "CAST(NULL AS VARCHAR)"
    for pats, text in reversed(fd.GOAL_RULES):
        cond = " OR ".join(f"contains(lower({det}), '{p}')" if p == "latency" else f"contains({det}, '{p}')"
                           for p in pats)
        expr = f"CASE WHEN {cond} THEN '{text}' ELSE {expr} END"
    return expr


@register("completion_goals", sql=f"""WITH {ALERT_CTES}
SELECT COALESCE(string_agg(goal, ' AND ' ORDER BY priority, detector), '{fd.GOAL_FALLBACK}') AS stop_condition
FROM (SELECT detector, priority, {_goal_sql('detector')} AS goal FROM alerts) a WHERE goal IS NOT NULL""",
          views=("base", "inc"))
def q_completion_goals(spark, sf_dir):
    return tr.completion_goals(_alerts(spark, sf_dir))


# ---------------------------------------------------------------- F6
def _action_sql():
    code, rank, text = "CAST(NULL AS VARCHAR)", "CAST(NULL AS INTEGER)", "CAST(NULL AS VARCHAR)"
    for det, (c, r, t) in tr.ACTIONS.items():
        code = f"CASE WHEN detector = '{det}' THEN '{c}' ELSE {code} END"
        rank = f"CASE WHEN detector = '{det}' THEN {r} ELSE {rank} END"
        text = f"CASE WHEN detector = '{det}' THEN '{t}' ELSE {text} END"
    return f"{code} AS action_code, {rank} AS rk, {text} AS action"


PLAN_SELECT = f"""
SELECT action_code, action, row_number() OVER (ORDER BY rk, action_code) AS step
FROM (SELECT DISTINCT action_code, rk, action FROM (SELECT {_action_sql()} FROM alerts) a
      WHERE action_code IS NOT NULL) q"""


@register("action_plan", sql=f"WITH {ALERT_CTES}{PLAN_SELECT}", views=("base", "inc"))
def q_action_plan(spark, sf_dir):
    return tr.action_plan(_alerts(spark, sf_dir)).withColumn("step", F.col("step").cast("long"))


# ---------------------------------------------------------------- F5
@register("runbook_topk", sql="""
WITH u AS (SELECT label, i, AVG(CAST(x AS DOUBLE)) AS m
           FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) q
           GROUP BY label, i),
c AS (SELECT label, list(m ORDER BY i) AS cv FROM u GROUP BY label),
d AS (SELECT e.vec_id, c.label, list_sum(list_transform(range(1, len(c.cv) + 1),
        lambda i: (CAST(e.embedding[i] AS DOUBLE) - c.cv[i]) * (CAST(e.embedding[i] AS DOUBLE) - c.cv[i]))) AS distance
      FROM embeddings e, c),
r AS (SELECT vec_id, label, distance, row_number() OVER (PARTITION BY vec_id ORDER BY distance, label) AS rank FROM d)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, label, ROUND(distance, 6) AS distance FROM r WHERE rank <= 3""")
def q_runbook_topk(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    docs = tr.centroids(emb, "label")
    hits = tr.nearest_docs(emb.select("vec_id", "embedding"), docs, k=3, doc_id="label")
    return hits.select("vec_id", "rank", "label", F.round("distance", 6).alias("distance"))


# ---------------------------------------------------------------- C4
def _truth_sql(col):
    expr = "CAST(NULL AS VARCHAR)"
    for k, v in reversed(list(fd.GROUND_TRUTH.items())):
        expr = f"CASE WHEN {col} = '{k}' THEN '{v}' ELSE {expr} END"
    return expr


@register("detection_correct", sql=f"""
SELECT run, fault_type, {_truth_sql('fault_type')} AS expected_detector,
       COALESCE(list_contains(string_split(detectors_fired, ','), {_truth_sql('fault_type')}), false) AS detection_correct
FROM evaluation""", views=("evaluation",))
def q_detection_correct(spark, sf_dir):
    from healthwatch.operators import metrics as mt
    return mt.detection_correct(fx.evaluation(spark, sf_dir)).select(
        "run", "fault_type", "expected_detector", "detection_correct")


# ---------------------------------------------------------------- E15 per batch (one batch per day)
def _alerts_by_day_sql():
    from healthwatch.plans.q_detect import SCHEMA_ROWS as SR
    return f"""
WITH {sg.stats_cte()},
ib AS (SELECT *, date_trunc('day', ts) AS batch_start FROM inc),
{sg.z_cte('ib', ('batch_start', 'event_id'))},
zf AS (SELECT batch_start, COUNT(DISTINCT event_id) AS flagged, string_agg(DISTINCT field, ',' ORDER BY field) AS d
       FROM zl WHERE z > 3 GROUP BY batch_start),
kb AS ({sg.melt('base')}),
ki AS ({sg.melt('ib', ids=('batch_start',))}),
bt AS (SELECT DISTINCT batch_start FROM ib),
s2 AS (SELECT bt.batch_start, kb.field, kb.v, 1 AS a FROM bt, kb
       UNION ALL SELECT batch_start, field, v, 0 AS a FROM ki),
g2 AS (SELECT batch_start, field, v, CAST(SUM(a) AS DOUBLE) AS na, CAST(SUM(1 - a) AS DOUBLE) AS nb
       FROM s2 GROUP BY batch_start, field, v),
c2 AS (SELECT batch_start, field,
              SUM(na) OVER (PARTITION BY batch_start, field ORDER BY v) / SUM(na) OVER (PARTITION BY batch_start, field) AS fa,
              SUM(nb) OVER (PARTITION BY batch_start, field ORDER BY v) / NULLIF(SUM(nb) OVER (PARTITION BY batch_start, field), 0) AS fb,
              SUM(na) OVER (PARTITION BY batch_start, field) AS n, SUM(nb) OVER (PARTITION BY batch_start, field) AS m FROM g2),
d2 AS (SELECT batch_start, field, MAX(ABS(fa - fb)) AS ks, MAX(n) AS n, MAX(m) AS m FROM c2
       GROUP BY batch_start, field HAVING MAX(m) >= 10 AND MAX(n) > 0),
l2 AS (SELECT batch_start, field, ks * SQRT(n * m / (n + m)) AS lam FROM d2),
p2 AS (SELECT batch_start, field, {sg.ks_p('lam')} AS p FROM l2),
kd AS (SELECT batch_start, COUNT(*) AS n, string_agg(field, ',' ORDER BY field) AS d FROM p2
       WHERE p < CAST(0.0001 AS DOUBLE) GROUP BY batch_start),
{SR.format(view='ib').strip()},
sbb AS (SELECT ib.batch_start, sb.* FROM sb JOIN ib ON sb.event_id = ib.event_id),
sf AS (SELECT batch_start, COUNT(*) FILTER (WHERE anomaly_detected) AS flagged FROM sbb GROUP BY batch_start),
sfc AS (SELECT batch_start, kind || ':' || field AS kf FROM (
          SELECT batch_start, 'missing' AS kind, unnest(missing_fields) AS field FROM sbb WHERE anomaly_detected
          UNION ALL SELECT batch_start, 'extra' AS kind, unnest(extra_fields) AS field FROM sbb WHERE anomaly_detected) q
        GROUP BY batch_start, kind, field),
sdd AS (SELECT batch_start, string_agg(kf, ',' ORDER BY kf) AS d FROM sfc GROUP BY batch_start),
sec AS (SELECT batch_start, patient_id, COUNT(*) AS n FROM ib WHERE patient_id IN ('PT-ATTACKER-0000')
        GROUP BY batch_start, patient_id HAVING COUNT(*) > 5),
cal AS (SELECT unnest(generate_series(MIN(batch_start), MAX(batch_start), INTERVAL 1 DAY)) AS batch_start FROM ib)
SELECT batch_start, 'stall' AS detector, 0 AS priority, CAST(0 AS BIGINT) AS signal_count, 'No events received' AS detail
FROM cal WHERE batch_start NOT IN (SELECT batch_start FROM bt)
UNION ALL SELECT batch_start, 'zscore', 1, CAST(flagged AS BIGINT), d FROM zf WHERE flagged > 0
UNION ALL SELECT batch_start, 'ks_test', 2, CAST(n AS BIGINT), d FROM kd WHERE n > 0
UNION ALL SELECT sf.batch_start, 'schema_entropy', 3, CAST(flagged AS BIGINT), COALESCE(sdd.d, '')
          FROM sf LEFT JOIN sdd ON sf.batch_start = sdd.batch_start WHERE flagged > 0
UNION ALL SELECT batch_start, 'security', 4, CAST(n AS BIGINT), patient_id FROM sec"""


@register("alerts_by_day", sql=_alerts_by_day_sql(), views=("base", "inc"))
def q_alerts_by_day(spark, sf_dir):
    base, inc = _halves(spark, sf_dir)
    batched = al.with_batch(inc, 86400)
    return al.detect_all(batched, *bl.fit(base, quantiles=False),
                         keys=["batch_start"], batch_seconds=86400)


# ---------------------------------------------------------------- end-to-end detection per daily batch
def _batch_detection_sql():
    from healthwatch.operators.metrics import FAULT_DETECTORS, FAULT_ROWS
    spec = " UNION ALL ".join(f"SELECT '{k}' AS fault_type, {sg.sql_list(v)} AS expected"
                              for k, v in FAULT_DETECTORS.items())
    planted = " ".join(f"WHEN '{k}' THEN COUNT(*) FILTER (WHERE {c}) > 0" for k, c in FAULT_ROWS.items())
    return f"""
WITH ab AS ({_alerts_by_day_sql()}),
fired AS (SELECT batch_start, list(DISTINCT detector) AS fired FROM ab GROUP BY batch_start),
b AS (SELECT date_trunc('day', ts) AS batch_start, * FROM inc),
f AS ({spec}),
p AS (SELECT b.batch_start, f.fault_type, f.expected, CASE f.fault_type {planted} END AS planted
      FROM b CROSS JOIN f GROUP BY b.batch_start, f.fault_type, f.expected)
SELECT p.batch_start, p.fault_type, p.planted,
       COALESCE(len(list_filter(p.expected, lambda x: list_contains(fired.fired, x))) > 0, false) AS detected
FROM p LEFT JOIN fired ON p.batch_start = fired.batch_start"""


@register("batch_detection", sql=_batch_detection_sql(), views=("base", "inc"))
def q_batch_detection(spark, sf_dir):
    from healthwatch.operators import metrics as mt
    base, inc = _halves(spark, sf_dir)
    batched = al.with_batch(inc, 86400)
    alerts = al.detect_all(batched, *bl.fit(base, quantiles=False), keys=["batch_start"], batch_seconds=86400)
    return mt.batch_detection(batched, alerts)
