"""Jobs and reports on tiny frames: the cases the derived tables do not reach."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from feedloom.operators import filters as fl
from feedloom.plans import alerts as al
from feedloom.plans import briefing as br
from feedloom.plans import dedup as dd
from feedloom.plans import insight as ins
from feedloom.plans import reports as rp
from feedloom.plans import signals as sg
from feedloom.plans import source_jobs as sj
from feedloom.plans import stages as st

NOW = dt.datetime(2024, 1, 31)
AS_OF = "2024-01-31 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def signals(spark, counts):
    """counts: item -> {action: n}"""
    rows, key = [], 0
    for item, actions in counts.items():
        for action, n in actions.items():
            for _ in range(n):
                key += 1
                rows.append((item, key, action, NOW - dt.timedelta(days=2)))
    return spark.createDataFrame(rows, "item_id string, api_key_id int, action string, created_at timestamp")


@pytest.mark.parametrize("tier,actions,want", [
    ("tier2", {"upvote": 8, "dismiss": 2}, "tier1"), ("tier1", {"upvote": 8, "read": 2}, "tier1"), ("tier2", {"dismiss": 6, "upvote": 4}, "tier3"),
    ("tier3", {"dismiss": 9, "read": 1}, "tier3"), ("tier2", {"dismiss": 5, "upvote": 5}, "tier2"), ("tier2", {"upvote": 7, "read": 3}, "tier2"),
])
def test_tier_adjustment(spark, tier, actions, want):
    sources = spark.createDataFrame([("s", tier, True)], "id string, tier string, is_active boolean")
    items = spark.createDataFrame([("i", "s")], "id string, source_id string")
    out = sg.source_tier_adjustment(sources, items, signals(spark, {"i": actions}), as_of=as_of()).collect()
    assert [r.new_tier for r in out] == [want]


def test_contrarian_labels(spark):
    items = spark.createDataFrame(
        [("a", ["x"], "minor"), ("b", ["security"], "major"), ("c", ["x"], "minor"), ("d", ["x"], None)], "id string, tags array<string>, significance string"
    )
    s = signals(spark, {"a": {"dismiss": 7, "read": 3}, "b": {"dismiss": 5, "read": 5}, "c": {"upvote": 11, "dismiss": 11, "read": 60}, "d": {"dismiss": 9}})
    got = {r.id: r.contrarian_signals for r in sg.contrarian_signals(items, s).collect()}
    assert got == {"a": ["adoption_risk"], "b": ["regression", "security_concern"], "c": ["hype_gap"]}


def test_upsert_keeps_last_action_once(spark):
    t = NOW
    log = spark.createDataFrame([(1, "i", 1, "upvote", t), (2, "i", 1, "dismiss", t), (3, "i", 2, "read", t)], "event_id int, item_id string, api_key_id int, action string, created_at timestamp")
    got = {(r.api_key_id, r.action) for r in sg.upsert_signals(log).collect()}
    assert got == {(1, "dismiss"), (2, "read")}


def test_dedup_reasons_and_idempotence(spark):
    rows = [
        ("n1", "https://a.org/1#x", "Hello, world", 1), ("n2", "https://a.org/2", "hello WORLD!", 2), ("n3", "https://a.org/1", "other", 3),
        ("n4", "https://k.org/", "fresh", 4), ("n5", "https://a.org/5", "known text", 5),
    ]
    cols = "id string, url string, content string, n int"
    batch = spark.createDataFrame(rows, cols).withColumn("published_at", F.timestamp_seconds("n")).withColumn("created_at", as_of())
    known = spark.createDataFrame([("k1", "https://k.org", "Known, text", 0)], cols).withColumn("published_at", F.timestamp_seconds("n")).withColumn("created_at", as_of())
    got = {r.id: r.reason for r in dd.dedup_items(batch, known, as_of=as_of(), vectors=False).collect()}
    assert got == {"n1": None, "n2": "content_fingerprint", "n3": "url_hash", "n4": "url_hash", "n5": "content_fingerprint"}
    kept = dd.keep_new(batch, known, as_of=as_of(), vectors=False)
    again = dd.keep_new(kept, known, as_of=as_of(), vectors=False)
    assert sorted(r.id for r in again.collect()) == sorted(r.id for r in kept.collect()) == ["n1"]


def test_source_error_streaks(spark):
    def log(source, flags):
        return [(source, NOW + dt.timedelta(days=i), i, ok, attempt) for i, (ok, attempt) in enumerate(flags)]

    e, ok, retry = (False, 1), (True, 1), (False, 2)
    rows = log("dead", [e] * 5 + [ok]) + log("fine", [e, e, ok, e, retry, retry]) + log("never", [e] * 3)
    polls = spark.createDataFrame(rows, "source_id string, ts timestamp, poll_id int, ok boolean, attempt int")
    got = {r.source_id: (r.consecutive_errors, r.is_active, r.last_successful_poll is not None) for r in sj.source_errors(polls).collect()}
    assert got == {"dead": (0, False, True), "fine": (1, True, True), "never": (3, True, False)}


def test_gate_without_references_lets_everything_pass(spark):
    items = spark.createDataFrame([("i", "s", [1.0], "embedded", NOW)], "id string, source_id string, embedding array<float>, status string, created_at timestamp").withColumn("relevance_score", F.lit(None).cast("double"))
    sources = spark.createDataFrame([("s", "tier1", "{}")], "id string, tier string, config string")
    refs = spark.createDataFrame([], "id string, embedding array<float>, is_positive boolean")
    r = st.gate_stage(items, sources, refs, as_of=as_of()).first()
    assert r.status == "queued" and r.relevance_score == pytest.approx(0.35)


def test_embed_stage_with_a_callers_udf(spark):
    import pandas as pd
    from pyspark.sql.types import ArrayType, FloatType

    def lengths(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [float(len(t))])

    items = spark.createDataFrame([("a", "T", "body", "raw"), ("b", "T", "x", "queued")], "id string, title string, content string, status string")
    got = {r.id: (r.status, r.embedding) for r in st.embed_stage(items, embedder=F.pandas_udf(lengths, ArrayType(FloatType()))).collect()}
    assert got == {"a": ("embedded", [7.0]), "b": ("queued", None)}


def test_transitions(spark):
    items = spark.createDataFrame([("a", "queued"), ("b", "raw")], "id string, status string")
    assert {r.id: r.status for r in fl.transition(items, "queued", "processing").collect()} == {"a": "processing", "b": "raw"}
    with pytest.raises(ValueError):
        fl.transition(items, "processed", "raw")


def test_trends_need_history(spark):
    rows = [("s1", ["new"], "processed", NOW - dt.timedelta(days=1))] * 3
    items = spark.createDataFrame(rows, "source_id string, tags array<string>, status string, created_at timestamp").withColumn("published_at", F.lit(None).cast("timestamp"))
    assert ins.tag_trends(items, as_of=as_of()).first().velocity_ratio == 99.0
    assert ins.trends(items, as_of=as_of()).count() == 0


def test_coverage_gap_notes(spark):
    notes = ['{"query": " MCP "}', '{"query": "mcp"}', "mcp", '{"other": 1}', None, "[1]", "", "{broken"]
    rows = [("auto_miss", n, NOW - dt.timedelta(days=1)) for n in notes] + [("auto_miss", "mcp", NOW - dt.timedelta(days=9)), ("bug", "mcp", NOW)]
    fb = spark.createDataFrame(rows, "report_type string, notes string, created_at timestamp")
    assert [(r.keyword, r.n) for r in rp.coverage_gaps(fb, as_of=as_of()).collect()] == [("mcp", 3)]
    assert {r.keyword for r in rp.coverage_gaps(fb, as_of=as_of(), min_count=1).collect()} == {"mcp", "[1]", "{broken"}


def test_empty_pages(spark):
    page = spark.createDataFrame([], "pos int, title string, summary string, excerpt string, significance string, tags array<string>, relevance_score double")
    assert ins.result_quality(page).first().result_quality == "LOW"
    assert ins.tldr(page, "q").first()[0] == 'No results found for "q".'
    assert ins.query_relevance(page, "docker").first()[0] is True
    assert br.bottom_line(page, "mcp").first()[0] == "No items found for mcp."
    assert br.compress_briefing(page).count() == 0


def test_summary_line_keeps_the_word_before_a_last_line_break(spark):
    text = "word " * 23 + "tail\n"  # 120 characters
    page = spark.createDataFrame([(1, "T", text + "more", "minor")], "pos int, title string, summary string, significance string")
    assert ins.tldr(page, "q").first()[0] == "Found 1 result. Top: " + text[:-1] + "..."


def test_bullets_by_tag_when_there_is_one_tier(spark):
    rows = [(1, "A", "minor", ["x"]), (2, "B", "minor", ["y"]), (3, "C", "minor", ["y"]), (4, "D", "minor", [])]
    page = spark.createDataFrame(rows, "pos int, title string, significance string, tags array<string>").withColumn("summary", F.lit(None).cast("string")).withColumn("excerpt", F.lit(None).cast("string"))
    got = [r.bullet for r in br.compress_briefing(page).orderBy("bullet_no").collect()]
    assert got == ["2 on y: B; C", "1 on x: A", "1 on general: D"]


def test_alert_rules_without_keywords_or_cooldown(spark):
    items = spark.createDataFrame([("i", "T", "text", ["t"], "breaking", NOW)], "id string, title string, content string, tags array<string>, significance string, created_at timestamp")
    rules = spark.createDataFrame([("r", [], ["breaking"], None, True), ("off", ["text"], None, 5, False)], "id string, keywords array<string>, significance_trigger array<string>, cooldown_minutes int, is_active boolean")
    assert [(r.rule_id, r.item_id) for r in al.fired_alerts(items, rules).collect()] == [("r", "i")]
    m = al.match_rules(items, rules).collect()
    assert [(r.rule_id, r.keyword, r.by_significance) for r in m] == [("r", None, True)]


def test_zero_cooldown_ends():
    import numpy as np

    from feedloom.operators.cooldown import fire_seconds

    assert fire_seconds(np.array([1, 2, 5]), 0, 0) == ([1, 2, 5], 6)


def test_one_per_key(spark):
    from feedloom.operators.joins import one_per_key

    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "x"), (None, 1, "z")], "k string, n int, v string")
    got = {(r.k, r.n, r.v) for r in one_per_key(rows, "k", F.desc("n"), F.col("v")).collect()}
    assert got == {("a", 2, "x"), (None, 1, "z")}


def test_newest_discussion_of_several_of_one_time(spark):
    from feedloom.sources import payloads as pl

    nodes = [("D100", "2024-01-05T00:00:00Z"), ("D99", "2024-01-05T00:00:00Z"), ("D101", "2024-01-05T00:00:00Z"), ("D1", "2024-01-01T00:00:00Z")]
    for order in (nodes, nodes[::-1]):
        rows = [("s", "S", "o/r", '{"nodes":[{"id":"%s","createdAt":"%s"}]}' % n) for n in order]
        got = pl.last_discussions(spark.createDataFrame(rows, "source_id string, source_name string, repo string, payload string").coalesce(1)).first()
        assert got.last_id == "D99" and got.last_at == dt.datetime(2024, 1, 5)


def test_calls_are_not_dealt_by_model(spark):
    from feedloom.plans import spend as sp

    calls = spark.createDataFrame([(1, NOW, 1, "haiku", 100, 10), (2, NOW, 1, "unknown", 1, 1)], "call_id long, ts timestamp, user_id long, model string, in_tokens long, out_tokens long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = sp.ledger(calls, sp.price_table(spark))
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert [r.call_id for r in out.collect()] == [1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
