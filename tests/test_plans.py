"""Structural plan properties the scale design relies on."""

import re

import pytest

import __spark_entry__ as se

from conftest import SF_SMOKE


def _plan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")     # no "..." in scan metadata
    return se.queries()[name](spark, SF_SMOKE)._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_or_nested_loop_join_anywhere(spark):
    """Streams are left out: what they return is a scan of their result."""
    from healthwatch.plans.catalog import QUERIES
    names = [n for n in QUERIES if not n.startswith("stream_")]
    bad = [n for n in names if re.search(r"CartesianProduct|BroadcastNestedLoopJoin", _plan(spark, n))]
    assert bad == []


@pytest.mark.parametrize("name", ["zscore_events", "schema_best_match", "impute_vitals", "impute_spo2",
                                  "quarantine", "display_rows", "audit_sql", "decode_events", "align_to_sink"])
def test_narrow_operators_do_not_shuffle(spark, name):
    assert "Exchange" not in _plan(spark, name)


@pytest.mark.parametrize("name,needle", [("security_denylist", "EqualTo(patient_id"),
                                         ("impossible_vitals", "PushedFilters: [Or"),
                                         ("zscore_events", "GreaterThanOrEqual(ts")])
def test_predicates_reach_the_scan(spark, name, needle):
    assert needle in _plan(spark, name)


def test_column_pruning_on_detector_scan(spark):
    plan = _plan(spark, "security_denylist")
    assert "ReadSchema: struct<patient_id:string>" in plan
