"""Detector fan-in: run every detector on a batch (or on many batches at
once, keyed) and emit one alert row per firing detector, in the fixed order
stall, zscore, ks_test, schema_entropy, security.

``detect_all`` reads the batch twice: one partially aggregated pass yields
the z-score, schema, security and stall figures (all narrow columns of the
same rows), and the KS collapse is the other.  The per-detector functions
(``zscore_alert`` ...) remain available on their own.  Call
``batch.persist()`` first when the batch comes from an expensive plan
(``streaming.pipeline.stream_detect`` does so per micro-batch).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from healthwatch.functions import fields as fd
from healthwatch.operators import ks as ksm
from healthwatch.operators import schema_drift as sd
from healthwatch.operators import security as sec
from healthwatch.operators import zscore as zs
from healthwatch.operators.baseline import stats_map

ALERT_COLUMNS = ["detector", "priority", "signal_count", "detail"]
DETECTOR_ORDER = {"stall": 0, "zscore": 1, "ks_test": 2, "schema_entropy": 3, "security": 4, "telemetry_zscore": 5, "isolation_forest": 6,
                  "latency_monitor": 7}


def _alert(df: DataFrame, name: str, count_col: str, detail, keys: list[str] | None = None) -> DataFrame:
    return df.select(*(keys or []), F.lit(name).alias("detector"),
                     F.lit(DETECTOR_ORDER.get(name, 9)).alias("priority"),
                     F.col(count_col).cast("long").alias("signal_count"), detail.alias("detail"))


def _group(df: DataFrame, keys: list[str] | None):
    return df.groupBy(*keys) if keys else df


def zscore_alert(batch: DataFrame, stats, threshold: float = fd.ZSCORE_THRESHOLD,
                 keys: list[str] | None = None) -> DataFrame:
    sm = stats if isinstance(stats, dict) else stats_map(stats)
    flags = zs.zscore_flags(batch, sm, threshold)
    fields = [f for f in sm if f in batch.columns]
    agg = _group(flags, keys).agg(F.count_if("is_anomalous").alias("flagged"),
                                  *[F.count_if(F.col(f"z_{f}") > threshold).alias(f"{f}__c") for f in fields])
    detail = F.array_join(F.array_sort(F.array_compact(F.array(*[
        F.when(F.col(f"{f}__c") > 0, F.lit(f)) for f in fields]))), ",")
    return _alert(agg.filter(F.col("flagged") > 0), "zscore", "flagged", detail, keys)


def ks_alert(batch: DataFrame, base_hist: DataFrame, base_stats: DataFrame | None = None,
             alpha: float = fd.KS_ALPHA, keys: list[str] | None = None) -> DataFrame:
    if keys:
        drift = ksm.ks_drift_by(batch, base_hist, keys, alpha=alpha)
    else:
        drift = ksm.ks_drift(batch, base_hist, alpha=alpha)          # alerts need no baseline means
    agg = _group(drift.filter("drifted"), keys).agg(      # <= one row per field per batch
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("field")), ",").alias("d"))
    return _alert(agg.filter(F.col("n") > 0), "ks_test", "n", F.col("d"), keys)


def schema_alert(batch: DataFrame, contracts=None, threshold: float = fd.SCHEMA_THRESHOLD,
                 keys: list[str] | None = None, present: Column | None = None) -> DataFrame:
    checked = sd.schema_check(batch, contracts, threshold, present=present,
                              columns=[c for c in batch.columns if c not in (keys or [])])
    flagged = _group(checked, keys).agg(F.count_if("anomaly_detected").alias("flagged"))
    counts = sd.schema_field_counts(checked, keys)        # one row per distinct field name (per batch)
    detail = _group(counts, keys).agg(F.array_join(F.array_sort(F.collect_list(
        F.concat("kind", F.lit(":"), "field"))), ",").alias("detail"))
    if keys:
        joined = flagged.filter(F.col("flagged") > 0).join(detail, keys, "left")   # one row per batch
        return _alert(joined, "schema_entropy", "flagged", F.coalesce("detail", F.lit("")), keys)
    return _alert(flagged.filter(F.col("flagged") > 0), "schema_entropy", "flagged",
                  F.coalesce(detail.scalar(), F.lit("")))


def security_alert(batch: DataFrame, ids: list[str] | None = None,
                   min_events: int = fd.DENYLIST_MIN_EVENTS, keys: list[str] | None = None) -> DataFrame:
    flood = sec.denylist_flood(batch, ids, min_events, keys=keys).filter("is_flood")
    return _alert(flood, "security", "event_count", F.col("patient_id"), keys)


def stall_alert(batch: DataFrame, keys: list[str] | None = None, batch_seconds: int | None = None,
                ts: str = "ts") -> DataFrame:
    """Whole-frame mode: one alert when the batch is empty.  Keyed time
    batches (``with_batch``): one alert per empty batch window between the
    first and the last event."""
    if keys and batch_seconds:
        from healthwatch.operators.telemetry import empty_batches
        empty = empty_batches(batch, batch_seconds, ts).select(
            F.col("batch_start").alias(keys[0]), F.lit(0).alias("n"))
        return _alert(empty, "stall", "n", F.lit("No events received"), keys)
    n = batch.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 0)
    return _alert(n, "stall", "n", F.lit("No events received"))


def with_batch(df: DataFrame, batch_seconds: int, ts: str = "ts", name: str = "batch_start") -> DataFrame:
    """Tag each row with the start of its fixed time batch (same type as ``ts``)."""
    from healthwatch.functions.columns import epoch_micros, from_epoch_micros
    width = batch_seconds * 1_000_000
    dtype = df.schema[ts].dataType
    us = epoch_micros(ts, dtype)                       # zone-independent for TIMESTAMP_NTZ
    return df.withColumn(name, from_epoch_micros(F.floor(us / width) * width, dtype))


def _one_pass_alerts(batch: DataFrame, sm: dict, contracts, keys: list[str] | None,
                     include_security: bool, include_stall: bool, ids: list[str] | None, include_schema: bool = True) -> DataFrame:
    """z-score, schema, security and (whole-frame) stall alerts from ONE
    aggregation over the batch: z flags, schema masks and denylist matches
    are narrow columns of the same rows, so every figure is a ``count_if``
    of that single (partially aggregated) pass."""
    keys = keys or []
    contracts = contracts or fd.CONTRACTS
    cols = [c for c in batch.columns if c not in keys]
    checked = zs.zscore_flags(sd.schema_check(batch, contracts, columns=cols) if include_schema else batch, sm)
    zfields = [f for f in sm if f in cols]
    rename = sd.DEFAULT_RENAME
    names = sorted({rename.get(c, c) for c in cols} | {f for _, fl in contracts for f in fl}) if include_schema else []
    ids = ids or [fd.ATTACKER_ID]
    thr = fd.ZSCORE_THRESHOLD
    q, lit = sd._q, sd._s
    aggs = ["count(1) AS _n", "count_if(is_anomalous) AS _zf", f"{'count_if(anomaly_detected)' if include_schema else 'CAST(0 AS BIGINT)'} AS _sf"]
    aggs += [f"count_if({q('z_' + f)} > {thr}) AS _z_{i}" for i, f in enumerate(zfields)]
    aggs += [f"count_if(anomaly_detected AND array_contains(missing_fields, {lit(n)})) AS _m_{i}"
             for i, n in enumerate(names)]
    aggs += [f"count_if(anomaly_detected AND array_contains(extra_fields, {lit(n)})) AS _e_{i}"
             for i, n in enumerate(names)]
    if include_security:
        aggs += [f"count_if(coalesce(patient_id = {lit(x)}, false)) AS _s_{i}" for i, x in enumerate(ids)]
    aggs = [F.expr(a) for a in aggs]
    wide = _group(checked, keys).agg(*aggs)

    def alert(name, count, detail, fire):
        return F.struct(F.lit(name).alias("detector"), F.lit(DETECTOR_ORDER[name]).alias("priority"),
                        count.cast("long").alias("signal_count"), detail.alias("detail"), fire.alias("fire"))

    zdetail = F.array_join(F.array_compact(F.array(*[
        F.when(F.col(f"_z_{i}") > 0, F.lit(f)) for i, f in sorted(enumerate(zfields), key=lambda t: t[1])]
        or [F.lit(None).cast("string")])), ",")
    sparts = sorted([(f"extra:{n}", f"_e_{i}") for i, n in enumerate(names)]
                    + [(f"missing:{n}", f"_m_{i}") for i, n in enumerate(names)])
    sdetail = F.array_join(F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(t)) for t, c in sparts])), ",") if sparts else F.lit("")
    cands = [alert("zscore", F.col("_zf"), zdetail, F.col("_zf") > 0),
             alert("schema_entropy", F.col("_sf"), sdetail, F.col("_sf") > 0)]
    if include_security:
        cands += [alert("security", F.col(f"_s_{i}"), F.lit(x), F.col(f"_s_{i}") > fd.DENYLIST_MIN_EVENTS)
                  for i, x in enumerate(ids)]
    if include_stall and not keys:
        cands.append(alert("stall", F.col("_n"), F.lit("No events received"), F.col("_n") == 0))
    return (wide.select(*keys, F.explode(F.array(*cands)).alias("a"))
                .filter("a.fire").select(*keys, "a.detector", "a.priority", "a.signal_count", "a.detail"))


def detect_all(batch: DataFrame, stats: DataFrame, base_hist: DataFrame, contracts=None,
               include_security: bool = True, include_stall: bool = True,
               keys: list[str] | None = None, batch_seconds: int | None = None,
               ids: list[str] | None = None, presence: str = "non_null", json_keys: str = "keys") -> DataFrame:
    """Alert rows ``([keys...,] detector, priority, signal_count, detail)``:
    for the whole frame, or per batch when ``keys`` are given (e.g. the
    ``batch_start`` of ``with_batch`` — then ``batch_seconds`` enables stall
    alerts for empty batch windows).

    Two passes over the batch in total: one aggregation yields the z-score,
    schema, security and stall figures, and the KS collapse is the other.

    ``presence="json"`` is the topic path: the fields an event has are the keys
    listed in the array column ``json_keys`` (``events.decode_variant``), so a
    key with a JSON null is present and any other key counts as extra."""
    sm = stats_map(stats)
    if presence not in ("non_null", "json"):
        raise ValueError(f"unknown presence {presence!r}")
    by_keys = presence == "json"
    parts = [_one_pass_alerts(batch, sm, contracts, keys, include_security, include_stall, ids, not by_keys),
             ks_alert(batch, base_hist, stats, keys=keys)]
    if by_keys:
        parts.append(schema_alert(batch, contracts, keys=keys, present=F.col(json_keys)))
    if include_stall and keys and batch_seconds:
        parts.append(stall_alert(batch, keys, batch_seconds))
    return reduce(DataFrame.unionByName, parts)


def telemetry_alerts(tel: DataFrame, base: DataFrame, fields: list[str] | None = None, row_id: str | None = None,
                     latency: str = "db_latency_sec", threshold_sec: float = fd.LATENCY_SECONDS) -> DataFrame:
    """Alert rows of a telemetry series: ``telemetry_zscore`` (rows with a
    latency, lag or load spike against the moments of ``base``),
    ``isolation_forest`` (rows that a forest over both series finds anomalous)
    and ``latency_monitor`` (rows above the latency threshold)."""
    from healthwatch.operators import forest as fo
    from healthwatch.operators.baseline import baseline_moments
    from healthwatch.operators.telemetry import TELEMETRY_FIELDS
    fields = fields or TELEMETRY_FIELDS
    spikes = zscore_alert(tel, baseline_moments(base, fields)).withColumns(
        {"detector": F.lit("telemetry_zscore"), "priority": F.lit(DETECTOR_ORDER["telemetry_zscore"])})
    both = base.withColumn("_new", F.lit(False)).unionByName(tel.withColumn("_new", F.lit(True)))
    odd = fo.isolation_forest(both, fields, row_id=row_id).agg(F.count_if(F.col("_new") & F.col("is_anomaly")).alias("n"))
    late = tel.agg(F.count_if(F.col(latency) > threshold_sec).alias("n"))
    return (spikes.unionByName(_alert(odd.filter("n > 0"), "isolation_forest", "n", F.lit(",".join(fields))))
                  .unionByName(_alert(late.filter("n > 0"), "latency_monitor", "n", F.lit(latency))))


def validate(batch: DataFrame, stats: DataFrame, base_hist: DataFrame, contracts=None,
             include_security: bool = False) -> DataFrame:
    """Steady-state check after a repair: re-run z-score, KS and schema (and
    optionally security) on the batch.  ``STEADY_STATE`` iff none fires; an
    empty batch is ``STILL_ANOMALOUS``.  One row: events_checked,
    n_failures, failures (detectors in order), status."""
    alerts = detect_all(batch, stats, base_hist, contracts, include_security=include_security,
                        include_stall=True)
    fails = alerts.agg(F.array_sort(F.collect_list(F.struct("priority", "detector"))).alias("_f"))
    n = batch.agg(F.count(F.lit(1)).alias("events_checked"))
    from healthwatch.functions.columns import combine_rows
    out = combine_rows(n, fails)
    return out.select("events_checked", F.size("_f").alias("n_failures"),
                      F.array_join(F.transform("_f", lambda s: s["detector"]), ",").alias("failures"),
                      F.when((F.size("_f") == 0) & (F.col("events_checked") > 0), "STEADY_STATE")
                       .otherwise("STILL_ANOMALOUS").alias("status"))
