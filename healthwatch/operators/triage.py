"""Triage: alerts -> crisis packet (components, severity), completion goals,
ordered action plan, and nearest-runbook retrieval.

Per packet the alert list is bounded by the number of detectors, so the
``collect_list`` calls below aggregate at most a handful of rows per group.
Components, goals and actions come from a rule table (``operators.rules``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from healthwatch.functions import fields as fd
from healthwatch.operators import rules as rl
from healthwatch.operators.nearest import nearest_docs  # noqa: F401  (part of the triage surface)

#: Repair step (code, rank, text) per signal pattern, as in the default rule table.
ACTIONS = {pattern: tuple(step) for pattern, *step in rl.ACTIONS}
#: A signal without a rule keeps a step of its own in the plan.
NO_RULE = ("Z", 9, "no repair rule: inspect ")


def _ruled(alerts: DataFrame, rules: DataFrame | None, kind: str) -> DataFrame:
    return rl.with_rule(alerts, rl.default_rules(alerts.sparkSession) if rules is None else rules, kind, "detector")


def crisis_packet(alerts: DataFrame, keys: list[str] | None = None, rules: DataFrame | None = None, crisis_id: Column | None = None) -> DataFrame:
    """One packet per ``keys`` group: signals (in detector order), sorted
    distinct components, severity (UNKNOWN without signals; CRITICAL for a
    security signal or two or more signals; else HIGH), ``signals`` (detector,
    count and detail of each), the attacker's id (the default one when a
    security signal names none) and, when given, the ``crisis_id``."""
    keys = keys or []
    a = _ruled(alerts, rules, "component").withColumn("_parts", F.split(F.coalesce("rule.text", F.lit(fd.UNKNOWN_COMPONENT)), ","))
    g = a.groupBy(*keys) if keys else a
    sig = F.array_sort(F.collect_list(F.struct("priority", "detector", "signal_count", "detail")))
    p = g.agg(sig.alias("_sig"),
              F.array_sort(F.array_distinct(F.flatten(F.collect_list("_parts")))).alias("_comp"),
              F.count(F.lit(1)).alias("n_signals"),
              F.bool_or(F.col("detector") == "security").alias("_sec"))
    severity = (F.when(F.col("n_signals") == 0, "UNKNOWN")
                 .when(F.col("_sec") | (F.col("n_signals") > 1), "CRITICAL").otherwise("HIGH"))
    guilty = F.get(F.filter("_sig", lambda s: s["detector"] == "security"), F.lit(0))["detail"]
    return p.select(*keys, *([crisis_id.alias("crisis_id")] if crisis_id is not None else []),
                    F.array_join(F.transform("_sig", lambda s: s["detector"]), ",").alias("fault_signals"),
                    F.array_join("_comp", ",").alias("affected_components"),
                    "n_signals", severity.alias("severity"),
                    F.transform("_sig", lambda s: s.dropFields("priority")).alias("signals"),
                    F.when(F.col("_sec"), F.coalesce(guilty, F.lit(fd.ATTACKER_ID))).alias("attacker_id"))


def completion_goals(alerts: DataFrame, keys: list[str] | None = None, rules: DataFrame | None = None) -> DataFrame:
    """Stop condition per packet: the goals of its signals in signal order,
    joined by `` AND `` (duplicates kept); the fallback when none match."""
    keys = keys or []
    a = _ruled(alerts, rules, "goal").withColumn("goal", F.col("rule.text"))
    g = a.groupBy(*keys) if keys else a
    goals = F.array_sort(F.collect_list(F.when(F.col("goal").isNotNull(),
                                               F.struct("priority", "detector", "goal"))))
    out = g.agg(goals.alias("_g"))
    txt = F.array_join(F.transform("_g", lambda s: s["goal"]), " AND ")
    return out.select(*keys, F.when(F.size("_g") > 0, txt).otherwise(F.lit(fd.GOAL_FALLBACK))
                      .alias("stop_condition"))


def action_plan(alerts: DataFrame, keys: list[str] | None = None, rules: DataFrame | None = None) -> DataFrame:
    """Ordered repair steps: quarantine first, one vitals imputation even when
    both zscore and ks_test fired, then spo2 imputation, alerting, connector
    check.  A signal without a rule gets an explicit step that names it, so no
    alert is dropped.  ``step`` numbers the plan within each group."""
    keys = keys or []
    ruled = _ruled(alerts, rules, "action")
    code, rank = F.coalesce("rule.code", F.lit(NO_RULE[0])), F.coalesce("rule.rank", F.lit(NO_RULE[1]))
    text = F.coalesce("rule.text", F.concat(F.lit(NO_RULE[2]), F.col("detector")))
    acts = (ruled.select(*keys, code.alias("action_code"), rank.alias("rank"), text.alias("action"))
                  .dropDuplicates([*keys, "action_code", "action"]))
    w = Window.partitionBy(*keys).orderBy("rank", "action_code", "action") if keys else \
        Window.orderBy("rank", "action_code", "action")       # one packet: a few rows
    return acts.withColumn("step", F.row_number().over(w)).drop("rank")


def plan_codes(plan: DataFrame) -> list[str]:
    """Action codes of one packet's plan in order (one row per action)."""
    return [r["action_code"] for r in plan.orderBy("step").select("action_code").collect()]


# ---------------------------------------------------------------- F5 (search: operators.nearest)
def centroids(df: DataFrame, key: str, vec: str = "embedding", dims: int | None = None) -> DataFrame:
    """Mean vector per key (one partially aggregated pass over the rows)."""
    if dims is None:
        dims = len(df.select(vec).first()[0])
    return df.groupBy(key).agg(F.array(*[F.avg(F.col(vec)[i].cast("double")) for i in range(dims)]).alias(vec))


def crisis_id(now_epoch_s: int | Column | None = None) -> Column:
    """``CRISIS-<epoch seconds>`` of the build time (or a given clock)."""
    ts = F.unix_timestamp(F.current_timestamp()) if now_epoch_s is None else now_epoch_s if isinstance(now_epoch_s, Column) else F.lit(now_epoch_s)
    return F.concat(F.lit("CRISIS-"), ts.cast("string"))


def incident_record(packet: DataFrame, plan: DataFrame, validation: DataFrame,
                    diagnosis: str | None = None, now_epoch_s: int | None = None) -> DataFrame:
    """One incident row from a packet, its action plan and the validation of
    the repaired table.  The log id hashes the crisis id with the signals,
    components and validation outcome (stable if the task is recomputed, and
    distinct for different incidents raised in the same second); MTTR is left NULL for
    ``metrics.backfill_mttr``.  The three one-row inputs are combined by a
    union and a global aggregate, not a join."""
    from healthwatch.functions.columns import combine_rows
    acts = plan.agg(F.array_sort(F.collect_list(F.struct("step", "action"))).alias("_a"))  # <= 6 rows
    cid = crisis_id(now_epoch_s)
    p = packet.select(cid.alias("crisis_id"), "severity", "fault_signals", "affected_components")
    v = validation.select(F.col("status").alias("validation_status"),
                          F.col("failures").alias("validation_failures"))
    row = combine_rows(p, acts, v)
    return row.select(
        F.concat(F.lit("INC-"), F.xxhash64("crisis_id", "fault_signals", "affected_components",
                                                  "validation_status").cast("string")).alias("log_id"),
        F.current_timestamp().alias("timestamp"), "crisis_id", "severity", "affected_components",
        "fault_signals", F.lit(diagnosis).cast("string").alias("agent_diagnosis"),
        F.array_join(F.transform("_a", lambda s: s["action"]), " | ").alias("actions_taken"),
        "validation_status", "validation_failures", F.lit(None).cast("double").alias("mttr_seconds"))
