"""Registered queries against their SQL on the smallest tables."""

import pytest

import checks
from checks.run import compare, connect

KNOWN, SQL = checks.load()
# Slow ones and streams are compared by the full run (python -m checks.run).
FAST = ["ndvi", "qa_decode_bits", "percentile_stretch", "histogram_match", "change_report", "suppress_pipeline", "change_event",
        "earliest_supported_date", "morphology_rule", "coregister", "query_parse", "text_embed", "vector_topk", "hybrid_rank", "stac_parse",
        "stac_ingest_route", "feedback_alert_match", "spatial_clusters", "class_weights", "split_holdout", "stream_earliest_date"]


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0


def test_every_query_but_known_ones_has_sql():
    assert sorted(set(KNOWN) - set(SQL)) == sorted([
        "change_event_export", "change_event_registered", "change_report_registered", "coregister_sub", "fit_change_threshold", "semantic_search",
        "vector_topk_ann"])


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, small, name):
    ok, note = compare(KNOWN[name](spark, small), connect(small), SQL[name])
    assert ok, note
