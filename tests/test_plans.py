"""Physical plans: no cross joins anywhere, no Python in native operators, pruned and filtered scans."""

import re

import pytest

import workload.suite  # noqa: F401
from feedloom.plans import feed as fd
from feedloom.plans import insight as ins
from feedloom.sources.tables import read_items, write_items
from workload.adapter import as_of
from workload.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"
EAGER = {
    "alert_stream", "breaking_notices", "repo_event_stream", "stream_url_dedup", "stream_history_dedup", "replay_guard", "cluster_items",
    "alert_stream_many_keywords", "items_round_trip", "log_append", "text_search_indexed_batches", "text_search_fallback_indexed", "text_search_total_indexed",
    "routed_search_indexed", "stream_history_bucketed", "stream_history_items", "repo_event_stream_shuffled", "silence_stream", "event_sessions_stream",
    "alert_stream_after_failures", "signal_merge", "library_merge",
}
PYTHON = {
    "unicode_nfc", "gate_scores", "gate_stage", "gate_scores_by_join", "watchlist_matches", "nearest_neighbours", "near_duplicate_vectors",
    "related_entries", "dedup_three_layers", "alert_matches_many_keywords", "fired_alerts", "alert_deliveries", "unalerted_items",
    "alert_status", "poll_cooldown", "alert_matches", "fired_alerts_zero_cooldown",
    "watchlist_matches_indexed", "nearest_neighbours_indexed", "alert_matches_distributed", "fired_alerts_after_failures",
    "watchlist_matches_with_pivots", "nearest_neighbours_with_pivots", "related_entries_with_pivots",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in EAGER])
def test_no_cross_join_and_no_stray_python(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in PYTHON:
        assert "EvalPython" not in text and "InPandas" not in text and "MapInArrow" not in text


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    from workload.adapter import Tables

    path = str(tmp_path_factory.mktemp("t") / "items")
    t = Tables(spark, SF_DIR)
    write_items(t.items(vectors=True), path)
    t.sources().write.parquet(path + "-sources")
    return path


def formatted(spark, df):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def scan(text):
    return re.findall(r"ReadSchema: (\S+)", text)


def test_feed_reads_neither_text_nor_vectors(spark, table):
    df = fd.feed(read_items(spark, table), spark.read.parquet(table + "-sources"), as_of=as_of())
    text = formatted(spark, df)
    items = [s for s in scan(text) if "relevance_score" in s]
    assert items and all("content" not in s and "embedding" not in s for s in items)
    assert "TakeOrderedAndProject" in text
    assert re.search(r"PushedFilters: \[.*EqualTo\(status,processed\)", text)


def test_day_partitions_are_pruned(spark, table):
    df = ins.digest(read_items(spark, table, "2024-01-24"), as_of=as_of())
    text = formatted(spark, df)
    assert re.search(r"PartitionFilters: \[.*day", text)
    assert "WindowGroupLimit" in text


def test_trends_aggregate_before_the_shuffle(spark, table):
    text = plan(ins.tag_trends(read_items(spark, table), as_of=as_of()))
    assert text.count("HashAggregate") >= 3
