"""Streams over several files equal their batch twins."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from feedloom.plans import alerts as al
from feedloom.plans import repo_events as re_
from feedloom.sources import tables as tb
from feedloom.streaming import jobs as st
from workload.adapter import Tables

SF = "/root/testdata/sf0.001"


def files_in_time_order(spark, df, ts, path, n=4):
    """n files whose rows follow each other in time."""
    cuts = [r[0] for r in df.select(F.expr(f"explode(percentile(unix_seconds({ts}), array({','.join(str(i / n) for i in range(1, n))})))")).collect()]
    edges = [float("-inf"), *cuts, float("inf")]
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        part = df.where((F.unix_seconds(ts) > a) & (F.unix_seconds(ts) <= b))
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture()
def items(spark):
    return Tables(spark, SF).items()


def test_alert_stream_equals_batch(spark, items, tmp_path):
    rules = Tables(spark, SF).alert_rules().withColumn("cooldown_minutes", F.col("cooldown_minutes") * 40)
    stream = files_in_time_order(spark, items, "created_at", str(tmp_path / "in"))
    out = st.drain(st.alert_stream(stream, rules), path=str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"))
    batch = al.fired_alerts(items, rules)
    want = {(r.rule_id, r.item_id) for r in batch.collect()}
    assert {(r.rule_id, r.item_id) for r in out.collect()} == want and len(want) > 20


def test_repo_events_equal_batch(spark, tmp_path):
    snaps = Tables(spark, SF).repo_snapshots()
    stream = files_in_time_order(spark, snaps, "ts", str(tmp_path / "in"))
    out = st.drain(st.repo_event_stream(stream), path=str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"))
    got = {(r.repo, r.ts, r.event, r.detail) for r in out.collect()}
    want = {(r.repo, r.ts, "star_milestone", str(r.milestone)) for r in re_.star_milestones(snaps).collect()}
    want |= {(r.repo, r.ts, "commit_burst", str(r.commits)) for r in re_.commit_bursts(snaps).collect()}
    want |= {(r.repo, r.ts, "description_changed", r.hash) for r in re_.description_changes(snaps).collect()}
    files = snaps.withColumn("path", F.lit("C"))
    want |= {(r.repo, r.ts, "file_changed", r.external_id.split(":")[-1]) for r in re_.file_changes(files).collect()}
    assert got == want


def test_dedup_within_watermark(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0), ("b", t0 + dt.timedelta(minutes=1)), ("a", t0 + dt.timedelta(minutes=2))]
    later = [("a", t0 + dt.timedelta(minutes=3)), ("c", t0 + dt.timedelta(minutes=30))]
    after, last = [("d", t0 + dt.timedelta(minutes=31))], [("a", t0 + dt.timedelta(minutes=45))]
    path = str(tmp_path / "in")
    for part in (rows, later, after, last):
        spark.createDataFrame(part, "token string, received_at timestamp").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("token string, received_at timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    out = st.drain(st.replay_guard(stream), path=str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"))
    # the same token counts as new once the watermark has left it behind
    assert sorted(r.token for r in out.collect()) == ["a", "a", "b", "c", "d"]


def test_append_unseen_survives_a_repeated_batch(spark, items, tmp_path):
    path = str(tmp_path / "hist")
    handle = st.append_unseen(path)
    rows = items.select("id", "url", "created_at")
    first, second = rows.where("id <= 'd2'"), rows
    handle(first, 0)
    handle(second, 1)
    once = sorted(r.id for r in spark.read.parquet(path).collect())
    handle(second, 1)  # the batch is run again after a failure
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == once
    keys = [r.url_key for r in spark.read.parquet(path).collect()]
    assert len(keys) == len(set(keys)) == rows.select(F.substring_index("url", "#", 1)).distinct().count()


def test_late_rows_are_split(spark):
    rows = spark.createDataFrame([("s", 1, dt.datetime(2024, 1, 1, 0, 0, 5)), ("s", 2, dt.datetime(2024, 1, 1, 0, 0, 9)), ("n", 3, dt.datetime(2020, 1, 1))], "source_id string, id int, ts timestamp")
    sec = int(dt.datetime(2024, 1, 1, 0, 0, 5, tzinfo=dt.timezone.utc).timestamp())
    marks = spark.createDataFrame([("s", sec)], "source_id string, last_poll_ts long")
    fresh, late = st.split_late(rows, marks, "ts")
    assert {r.id for r in fresh.collect()} == {2, 3} and {r.id for r in late.collect()} == {1}
    moved = {r.source_id: r.last_poll_ts for r in st.advance_watermarks(marks, rows, "ts").collect()}
    assert moved["s"] == sec + 4 and "n" in moved


def test_silence_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    path = str(tmp_path / "in")
    beats = [[("a", t0), ("b", t0)], [("b", t0 + dt.timedelta(hours=6))], [("b", t0 + dt.timedelta(hours=7))]]
    for part in beats:
        spark.createDataFrame(part, "source_id string, ts timestamp").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("source_id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    out = st.drain(st.silence_stream(stream, hours=4), path=str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"))
    assert "a" in {r.source_id for r in out.collect()}
    gaps = re_.silence_gaps(spark.read.parquet(path), hours=4).collect()
    assert [(g.silent_from, g.silent_to) for g in gaps] == [(t0, t0 + dt.timedelta(hours=6))]


def test_append_log_and_stream_sink(spark, items, tmp_path):
    path = str(tmp_path / "log")
    rows = items.select("id", "created_at")
    tb.append_log(rows, path)
    tb.append_log(rows, path)
    assert spark.read.parquet(path).count() == 2 * rows.count()
    stream = files_in_time_order(spark, rows, "created_at", str(tmp_path / "in"), 2)
    tb.append_stream(stream, str(tmp_path / "s"), str(tmp_path / "s-cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "s")).count() == rows.count()


def tried_one_by_one(events):
    """(key, item) of the deliveries that are tried: a success starts the cooldown, a failure does not."""
    out, ready = [], {}
    for ts, item, key, wait, good in sorted(events):
        if ts >= ready.get(key, -1):
            out.append((key, item))
            if good:
                ready[key] = ts + max(wait, 1)
    return sorted(out)


def test_cooldown_starts_after_a_delivery(spark):
    import random

    from feedloom.operators.cooldown import cooldown_after_delivery

    rng = random.Random(8)
    events = [(rng.randint(0, 90_000), f"i{k:04d}", rng.choice("ab"), 600, rng.random() < 0.3) for k in range(900)]
    events += [(50_000, f"s{k}", "c", 0, k % 3 == 2) for k in range(7)] + [(50_001, "t", "c", 0, True)] + [(k, f"n{k:05d}", "none", 60, False) for k in range(300)]
    rows = spark.createDataFrame([(k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), i, w, g) for s, i, k, w, g in events], "key string, ts timestamp, id string, cooldown_seconds long, delivered boolean")
    got = sorted((r["key"], r["id"]) for r in cooldown_after_delivery(rows).collect())
    want = tried_one_by_one(events)
    assert got == want and 350 < len(want) < len(events)


def delivery_inputs(spark, path, matches, results):
    """Streams of items (all of one rule) and of results, one file for each list."""
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    item = "id string, title string, content string, tags array<string>, significance string, created_at timestamp"
    for part in matches:
        spark.createDataFrame([(i, "alpha", "", [], "minor", at(s)) for i, s in part], item).coalesce(1).write.mode("append").parquet(f"{path}/items")
    result = "rule_id string, item_id string, delivered boolean, ts timestamp"
    for part in results:
        spark.createDataFrame([("r", i, g, at(s)) for i, g, s in part], result).coalesce(1).write.mode("append").parquet(f"{path}/results")
    rules = spark.createDataFrame([("r", True, ["alpha"], [], 1)], "id string, is_active boolean, keywords array<string>, significance_trigger array<string>, cooldown_minutes int")
    read = spark.readStream.option("maxFilesPerTrigger", 1)
    return read.schema(item).parquet(f"{path}/items"), rules, read.schema(result).parquet(f"{path}/results")


def test_deliveries_wait_for_results_that_come_later(spark, tmp_path):
    # a fails, b is tried at once and succeeds, c is inside the cooldown, d is behind it
    matches = [[("a", 0), ("b", 10)], [("c", 30), ("d", 80)], [("e", 85)]]
    results = [[("x", True, 0)], [("a", False, 5)], [("b", True, 12), ("d", True, 81)]]
    out = st.drain(st.delivery_stream(*delivery_inputs(spark, tmp_path, matches, results), patience=1e6), path=str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"))
    assert sorted(r["item_id"] for r in out.collect()) == ["a", "b", "d"]


def test_an_alert_without_a_result_is_given_up(spark, tmp_path):
    matches = [[("a", 0), ("b", 10)], [("far", 5000)], [("further", 9000)], [("end", 20000)]]
    results = [[("x", True, k * 4000)] for k in range(4)]
    out = st.drain(st.delivery_stream(*delivery_inputs(spark, tmp_path, matches, results), patience=60), path=str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"))
    assert {"a", "b", "far"} <= {r["item_id"] for r in out.collect()}


def states_of(stream, tmp_path):
    """Rows of state after everything available was processed."""
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return q.lastProgress["stateOperators"][0]["numRowsTotal"]


@pytest.mark.parametrize("delay", [None, "1 hour"])
def test_repositories_share_states(spark, tmp_path, delay):
    snaps = Tables(spark, SF).repo_snapshots()
    repos = snaps.select("repo").distinct().count()
    end = snaps.limit(1).select(F.lit("~end").alias("repo"), (F.col("ts") + F.expr("INTERVAL 9000 DAYS")).alias("ts"), F.lit(0).cast("long").alias("stars"), F.lit(0).cast("long").alias("commits"), "description", "file_text")
    stream = files_in_time_order(spark, snaps.unionByName(end), "ts", str(tmp_path / "in"))
    assert states_of(st.repo_event_stream(stream, delay=delay, buckets=4), tmp_path) <= 4 < repos
    got = {(r.repo, r.event, r.detail) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.repo, "star_milestone", str(r.milestone)) for r in re_.star_milestones(snaps).collect()}
    want |= {(r.repo, "commit_burst", str(r.commits)) for r in re_.commit_bursts(snaps).collect()}
    want |= {(r.repo, "description_changed", r.hash) for r in re_.description_changes(snaps).collect()}
    assert {g for g in got if g[1] != "file_changed" and g[0] != "~end"} == want


def test_sources_share_states(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda ms: t0 + dt.timedelta(milliseconds=ms)
    hour = 3_600_000
    # s0 .. s39 fall silent and speak again, "edge" is silent for one millisecond more than the limit at the end
    first = [(f"s{k}", at(k)) for k in range(40)]
    later = [(f"s{k}", at(5 * hour + k)) for k in range(40)] + [("edge", at(5 * hour))]
    last = [("end", at(9 * hour + 1))]
    for rows in (first, later, last):
        spark.createDataFrame(rows, "source_id string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source_id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert states_of(st.silence_stream(stream, hours=4, buckets=4), tmp_path) <= 4
    got = sorted((r.source_id, r.last_seen) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted([*first, ("edge", at(5 * hour)), ("s0", at(5 * hour))])
