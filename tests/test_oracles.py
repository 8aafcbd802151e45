"""Every registered query runs over the whole of its tables and, where it has one, equals its oracle."""

import os

import pytest

import __spark_entry__ as entry
from workload.registry import ORACLES, QUERIES
from workload.check import compare, duck

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

# at the smallest scale nothing qualifies for these
MAY_BE_EMPTY = {
    "commit_bursts", "graduate", "topic_coverage", "near_duplicate_vectors", "dedup_three_layers", "thread_detail", "thread_members",
    "action_items", "unalerted_items", "daily_digest_top", "daily_digest_new_sources", "text_search_fallback", "routed_search",
    "hybrid_search", "eval_overlap", "page_url_dedup", "briefing_by_vector", "report_erroring_sources", "report_stale_sources",
    "threads", "thread_top_items", "thread_narratives", "coverage_gaps", "spend_first_breach", "library_entry_related", "briefing_by_group",
}


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    status, rows, _, note = compare(name, spark, con, SF_DIR, QUERIES, ORACLES)
    assert status in ("ok", "rows-only") or (status == "ok-EMPTY" and name in MAY_BE_EMPTY), f"{status}: {note}"


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "url", "primary_type", "significance", "rank", "cluster_count", "pos"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
