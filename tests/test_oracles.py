"""Registered queries against their SQL on the smallest tables; the full set runs through tests.check."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
NAMES = [
    "top_shorts", "derived_rpm", "revenue_attribution", "parse_result_table", "typed_metric_cast", "part_manifest_check",
    "motion_peaks", "silence_runs", "event_clusters", "candidates_end_to_end", "adaptive_samples", "horizon_outcomes",
    "segment_lift", "predict_performance", "pairwise_similarity", "history_anti_join", "persistent_dedup",
    "interval_subtract", "subtitle_groups", "campaign_progress", "slot_instant", "stale_watchdog", "stream_gap_sessions",
    "stream_stale_jobs", "learning_run", "insight_apply", "clustering_rule_rows", "detector_rule_rows", "cache_lookup_join", "report_sink", "editorial_compare",
    "plan_days", "transcript_chunks", "transcript_assemble",
]
if os.environ.get("ALL_QUERIES"):
    NAMES = sorted(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    assert compare(spark, entry.queries(), entry.oracle_sql(), name, SF) == ""


def test_every_query_has_sql_or_is_known():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 206


def test_entry_returns_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
