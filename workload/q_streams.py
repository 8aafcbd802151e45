"""Alerts, repository events and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from feedloom.functions import text as tx
from feedloom.operators import joins as jn
from feedloom.plans import alerts as al
from feedloom.plans import repo_events as re_
from feedloom.plans import reports as rp
from feedloom.plans import source_jobs as sj
from feedloom.sources.history import KeyedHistory
from feedloom.streaming import jobs as st
from workload.adapter import Tables, as_of
from workload.oracle import AS_OF, EVENT_TS, sql, ts_text
from workload.q_functions import BREAK_SQL
from workload.q_insight import ts
from workload.registry import query

c = F.col
LOW = "lower(title || ' ' || content || ' ' || array_to_string(tags, ' '))"

def drain_into(stream, path: str, checkpoint: str) -> None:
    st.drain(stream, path=path, checkpoint=checkpoint)


def in_time_order(t: Tables, name: str, n: int, inputs: list, plan, last=None, run=drain_into) -> str:
    """The folder with what ``plan`` makes of ``inputs``, (rows, at) pairs, which it gets as streams that follow each other
    by ``at``: each of ``n`` stretches of time is one micro-batch of all inputs, of however many files. Rows of a column
    ``_at`` lose it; ``last`` are rows of the first input that come at the end.

    One job writes the stretches of an input, with as many files as it has tasks. They are moved into the streams' folders
    one after the other, and the query goes on from its checkpoint each time.
    """
    spark = t.spark
    times = reduce(DataFrame.unionByName, [rows.select(at.cast("double").alias("at")) for rows, at in inputs])
    first, end = times.agg(F.coalesce(F.min("at"), F.lit(0.0)), F.coalesce(F.max("at"), F.lit(0.0))).first()
    path = spark._jvm.org.apache.hadoop.fs.Path
    streams, folders = [], []
    for rows, at in inputs:
        held, seen = st.scratch(spark, f"{name}-held"), st.scratch(spark, f"{name}-in")
        fs = path(seen).getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path(seen))
        part = F.least(F.floor((at.cast("double") - first) / ((end - first) / n or 1.0)), F.lit(n - 1)).alias("_part")
        shown = rows.drop("_at")
        rows.select(*shown.columns, part).write.partitionBy("_part").parquet(held)
        streams.append(spark.readStream.schema(shown.schema).option("recursiveFileLookup", True).parquet(seen))
        folders.append((held, seen))
    if last is not None:
        last.write.parquet(f"{folders[0][0]}/_part={n}")
    out, checkpoint = st.scratch(spark, name), st.scratch(spark, f"{name}-cp")
    result = plan(*streams)
    for k in range(n + 1):
        moves = [(path(f"{held}/_part={k}"), path(f"{seen}/{k}")) for held, seen in folders]
        if any([fs.exists(a) and fs.rename(a, b) for a, b in moves]):
            run(result, out, checkpoint)
    return out


def in_files(t: Tables, rows, n: int = 4):
    """The rows as a stream of ``n`` micro-batches, each of as many files as the rows have tasks: no task gets a whole batch."""
    path = st.scratch(t.spark, "input")
    part = (F.monotonically_increasing_id() % n).alias("_part")
    rows.select(*rows.columns, part).write.partitionBy("_part").parquet(path)
    files = len(t.spark.read.schema(rows.schema).parquet(path).inputFiles())
    if not files:
        rows.write.mode("append").parquet(path)  # a file without rows, so that an empty table makes a batch too
    reader = t.spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", max(1, -(-files // n)))
    return reader.parquet(path)


MATCH = f"""low AS MATERIALIZED (SELECT id, created_at, significance, {LOW} AS low FROM items),
m AS MATERIALIZED (SELECT r.id AS rule_id, i.id AS item_id, i.created_at, r.cooldown_minutes, list_filter(r.keywords, lambda k: contains(i.low, k))[1] AS keyword,
  coalesce(list_contains(r.significance_trigger, i.significance), false) AS by_significance FROM (SELECT * FROM alert_rules WHERE is_active) r CROSS JOIN low i),
hit AS (SELECT * FROM m WHERE keyword IS NOT NULL OR by_significance)"""


@query("alert_matches", "J17 F30", sql("items alert_rules", "SELECT rule_id, item_id, keyword, by_significance FROM hit", MATCH))
def _(t: Tables):
    return al.match_rules(t.items(), t.alert_rules())


def many_keywords(t: Tables):
    """Every rule with 400 further keywords, none of which occurs."""
    more = F.transform(F.sequence(F.lit(1), F.lit(400)), lambda k: F.concat(F.lit("zq#"), "id", F.lit("#"), k))
    return t.alert_rules().withColumn("keywords", F.concat("keywords", more))


@query("alert_matches_many_keywords", "J17 F30", sql("items alert_rules", "SELECT rule_id, item_id, keyword, by_significance FROM hit", MATCH))
def _(t: Tables):
    return al.match_rules(t.items(), many_keywords(t))


FIRE = """, ev AS MATERIALIZED (SELECT rule_id, CAST(epoch(created_at) AS BIGINT) AS s, min({'t': created_at, 'i': item_id}) AS f, max(cooldown_minutes) * 60 AS cd FROM hit GROUP BY 1, 2),
fire(rule_id, s) AS (SELECT rule_id, min(s) FROM ev GROUP BY 1 UNION ALL SELECT f.rule_id, min(e.s) FROM fire f JOIN ev e ON e.rule_id = f.rule_id AND e.s >= f.s + e.cd GROUP BY f.rule_id)"""
FIRED = "SELECT ev.rule_id, ev.f.i AS item_id, " + ts_text("ev.f.t") + " AS ts FROM ev JOIN fire USING (rule_id, s)"


@query("fired_alerts", "T04 J17", sql("items alert_rules", FIRED, MATCH + FIRE))
def _(t: Tables):
    return al.fired_alerts(t.items(), t.alert_rules()).select("rule_id", "item_id", ts("ts"))


ALERT_COLUMNS = ("id", "title", "content", "tags", "significance", "created_at")


def streamed_alerts(t: Tables, rules):
    """A cooldown is right only where items come in order of time, which the files of a table do not."""
    items = t.items().select(*ALERT_COLUMNS)
    out = in_time_order(t, "alerts", 4, [(items, c("created_at"))], lambda s: st.alert_stream(s, rules))
    return t.spark.read.schema("rule_id string, item_id string, ts timestamp").parquet(out).select("rule_id", "item_id", ts("ts"))


@query("alert_stream", "T04", sql("items alert_rules", FIRED, MATCH + FIRE))
def _(t: Tables):
    return streamed_alerts(t, t.alert_rules())


@query("alert_stream_many_keywords", "T04", sql("items alert_rules", FIRED, MATCH + FIRE))
def _(t: Tables):
    return streamed_alerts(t, many_keywords(t))


@query("fired_alerts_zero_cooldown", "T04", sql("items alert_rules", FIRED, MATCH + FIRE.replace("max(cooldown_minutes) * 60", "3600")))
def _(t: Tables):
    """A cooldown of zero is none given: the default of one hour."""
    return al.fired_alerts(t.items(), t.alert_rules().withColumn("cooldown_minutes", F.lit(0))).select("rule_id", "item_id", ts("ts"))


@query("alert_matches_distributed", "J17 F30", sql("items alert_rules", "SELECT rule_id, item_id, keyword, by_significance FROM hit", MATCH))
def _(t: Tables):
    """More than 100,000 keywords, joined; those of the rules occur, the others do not."""
    rules = t.alert_rules()
    each = rules.agg((F.floor(F.lit(100_000) / F.count(F.lit(1))) + 1).cast("int")).scalar()
    more = F.transform(F.sequence(F.lit(1), "each"), lambda k: F.concat(F.lit("zq#"), "id", F.lit("#"), k))
    return al.match_rules(t.items(), rules.withColumn("each", each).withColumn("keywords", F.concat("keywords", more)).drop("each"), most_keywords=0)


AFTER = """, ev AS MATERIALIZED (SELECT rule_id, item_id, created_at AS t, CAST(epoch(created_at) AS BIGINT) AS s, CAST(substr(item_id, 2) AS INT) % 3 = 0 AS ok,
  CASE WHEN coalesce(cooldown_minutes, 0) = 0 THEN 60 ELSE cooldown_minutes END * 60 AS cd FROM hit),
good AS MATERIALIZED (SELECT rule_id, s, min({'t': t, 'i': item_id}) AS f, max(cd) AS cd FROM ev WHERE ok GROUP BY 1, 2),
sent(rule_id, s) AS (SELECT rule_id, min(s) FROM good GROUP BY 1 UNION ALL SELECT f.rule_id, min(g.s) FROM sent f JOIN good o ON o.rule_id = f.rule_id AND o.s = f.s JOIN good g ON g.rule_id = f.rule_id AND g.s >= f.s + o.cd GROUP BY f.rule_id),
done AS MATERIALIZED (SELECT g.* FROM sent JOIN good g USING (rule_id, s))"""
TRIED = "SELECT rule_id, item_id, " + ts_text("ev.t") + """ AS ts, ok AS delivered FROM ev WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.rule_id = ev.rule_id AND d.s <= ev.s AND ev.s < d.s + d.cd
  AND (ev.s > d.s OR {'t': ev.t, 'i': ev.item_id} > d.f))"""


def outcomes(t: Tables):
    """Deliveries of every third item succeed, the others fail."""
    hits = al.match_rules(t.items(), t.alert_rules()).select("rule_id", "item_id")
    return hits.withColumn("delivered", F.expr("int(substr(item_id, 2)) % 3 = 0"))


@query("fired_alerts_after_failures", "T04 J17", sql("items alert_rules", TRIED, MATCH + AFTER))
def _(t: Tables):
    return al.tried_alerts(t.items(), t.alert_rules(), outcomes(t)).select("rule_id", "item_id", ts("ts"), "delivered")


@query("alert_stream_after_failures", "T04", sql("items alert_rules", TRIED.replace(", ok AS delivered", ""), MATCH + AFTER))
def _(t: Tables):
    """The items come as a stream, and so do the results, in micro-batches of their own."""
    times = t.items().select(c("id").alias("item_id"), c("created_at").alias("ts"))
    results = outcomes(t).join(times, "item_id")
    inputs = [(t.items().select(*ALERT_COLUMNS), c("created_at")), (results, c("ts"))]
    out = in_time_order(t, "tried", 2, inputs, lambda items, found: st.delivery_stream(items, t.alert_rules(), found, patience=1e9))
    return t.spark.read.schema("rule_id string, item_id string, ts timestamp").parquet(out).select("rule_id", "item_id", ts("ts"))


@query(
    "alert_deliveries", "F29 F31 S28",
    sql("items alert_rules", f"""SELECT rule_id AS alert_rule_id, item_id AS intel_item_id, CASE WHEN primary_type = 'update' AND ({BREAK_SQL}) THEN 'critical' WHEN primary_type = 'update' AND confidence_score >= 0.8 THEN 'important'
      ELSE 'interesting' END AS urgency, 'pending' AS status FROM (SELECT x.*, i.primary_type, i.confidence_score, {LOW} AS low FROM (SELECT ev.rule_id, ev.f.i AS item_id FROM ev JOIN fire USING (rule_id, s)) x JOIN items i ON i.id = x.item_id)""", MATCH + FIRE),
)
def _(t: Tables):
    items = t.items()
    return al.delivery_rows(al.fired_alerts(items, t.alert_rules()), items).select("alert_rule_id", "intel_item_id", "urgency", "status")


@query(
    "unalerted_items", "J11",
    sql("items alert_rules", f"""SELECT id, {ts_text('created_at')} AS created_at FROM items WHERE status = 'processed' AND created_at >= {AS_OF} - INTERVAL 72 HOUR
      AND id NOT IN (SELECT ev.f.i FROM ev JOIN fire USING (rule_id, s)) ORDER BY items.created_at, id LIMIT 100""", MATCH + FIRE),
)
def _(t: Tables):
    items = t.items()
    d = al.delivery_rows(al.fired_alerts(items, t.alert_rules()), items)
    return al.unalerted_items(items, d, as_of=as_of(), hours=72).select("id", ts("created_at"))


@query(
    "alert_status", "A23",
    sql("items alert_rules", f"""SELECT r.id, {ts_text('l.last')} AS last_fired_at, coalesce({AS_OF} < l.last + to_minutes(CAST(r.cooldown_minutes AS BIGINT)), false) AS on_cooldown
      FROM alert_rules r LEFT JOIN (SELECT ev.rule_id, max(ev.f.t) AS last FROM ev JOIN fire USING (rule_id, s) GROUP BY 1) l ON l.rule_id = r.id WHERE r.is_active""", MATCH + FIRE),
)
def _(t: Tables):
    fired = al.fired_alerts(t.items(), t.alert_rules()).select(c("rule_id").alias("alert_rule_id"), c("ts").alias("delivered_at"))
    return rp.alert_status(t.alert_rules(), fired, as_of=as_of()).select("id", ts("last_fired_at"), "on_cooldown")


@query("breaking_notices", "T05", sql("items", "SELECT id, title, url, 'critical' AS urgency FROM items WHERE status = 'processed' AND significance = 'breaking'"))
def _(t: Tables):
    s = al.breaking_notices(t.items(docs=t.stream("documents")))
    out = st.drain(s, path=st.scratch(t.spark, "notices"), checkpoint=st.scratch(t.spark, "notices-cp"))
    return out.select("id", "title", "url", "urgency")


@query(
    "poll_cooldown", "T08",
    """WITH RECURSIVE ev AS MATERIALIZED (SELECT user_id AS k, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s, min({'t': ts, 'i': event_id}) AS f FROM events GROUP BY 1, 2),
    fire(k, s) AS (SELECT k, min(s) FROM ev GROUP BY 1 UNION ALL SELECT f.k, min(e.s) FROM fire f JOIN ev e ON e.k = f.k AND e.s >= f.s + 36000 GROUP BY f.k)
    SELECT CAST(k AS VARCHAR) AS source_id, ev.f.i AS poll_id FROM ev JOIN fire USING (k, s)""",
)
def _(t: Tables):
    p = t.raw("events").selectExpr("user_id AS source_id", "ts", "event_id AS poll_id", "36000 AS poll_interval_seconds")
    return re_.polls_allowed(p).select("source_id", "poll_id")


LAG = "lag({0}) OVER (PARTITION BY repo ORDER BY ts)"


@query(
    "star_milestones", "E01",
    sql("repo_snapshots", f"""SELECT repo, {ts_text('ts')} AS ts, m AS milestone, repo || ':star_milestone:' || m AS external_id, repo || ' reached ' || CASE m WHEN 1000 THEN '1,000' WHEN 5000 THEN '5,000' ELSE CAST(m AS VARCHAR) END || ' stars' AS title FROM
      (SELECT repo, ts, stars, coalesce({LAG.format('stars')}, 0) AS prev FROM repo_snapshots), (SELECT unnest([100,500,1000,5000]) AS m) WHERE prev < m AND m <= stars"""),
)
def _(t: Tables):
    return re_.star_milestones(t.repo_snapshots()).select("repo", ts("ts"), "milestone", "external_id", "title")


@query(
    "commit_bursts", "E02 F39",
    sql("repo_snapshots", f"""SELECT repo, {ts_text('ts')} AS ts, commits, prev AS previous, repo || ':commit_burst:' || strftime(ts, '%G-W%V') AS external_id FROM
      (SELECT repo, ts, commits, coalesce({LAG.format('commits')}, 0) AS prev FROM repo_snapshots) WHERE commits > 20 AND commits > 2 * prev"""),
)
def _(t: Tables):
    return re_.commit_bursts(t.repo_snapshots()).select("repo", ts("ts"), "commits", "previous", "external_id")


@query(
    "description_changes", "E03 F38",
    sql("repo_snapshots", f"""SELECT repo, {ts_text('ts')} AS ts, h AS hash FROM (SELECT repo, ts, h, lag(h) OVER (PARTITION BY repo ORDER BY ts) AS prev FROM
      (SELECT *, substr(sha256(trim(description)), 1, 16) AS h FROM repo_snapshots)) WHERE prev IS NOT NULL AND h <> prev"""),
)
def _(t: Tables):
    return re_.description_changes(t.repo_snapshots()).select("repo", ts("ts"), "hash")


@query(
    "file_changes", "E04",
    sql("repo_snapshots", f"""SELECT repo, {ts_text('ts')} AS ts, 'changelog,update' || CASE WHEN file_text = 'P' THEN ',breaking-changes' ELSE '' END AS tags, repo || ':file_changed:CHANGES.md:' || substr(sha256(ft), 1, 8) AS external_id FROM
      (SELECT *, lag(ft) OVER (PARTITION BY repo ORDER BY ts) AS prev FROM (SELECT *, CASE WHEN file_text = 'P' THEN 'breaking: P' ELSE file_text END AS ft FROM repo_snapshots)) WHERE prev IS NOT NULL AND prev <> ft"""),
)
def _(t: Tables):
    f = t.repo_snapshots().withColumn("path", F.lit("CHANGES.md")).withColumn(
        "file_text", F.when(c("file_text") == "P", F.lit("breaking: P")).otherwise(c("file_text"))
    )
    return re_.file_changes(f).select("repo", ts("ts"), F.array_join("tags", ",").alias("tags"), "external_id")


@query(
    "repo_event_stream", "E01 E02 E03 E04",
    sql("repo_snapshots", f"""SELECT repo, event, count(*) AS n FROM (
      SELECT repo, 'star_milestone' AS event FROM (SELECT repo, stars, coalesce({LAG.format('stars')}, 0) AS prev FROM repo_snapshots), (SELECT unnest([100,500,1000,5000,10000]) AS m) WHERE prev < m AND m <= stars
      UNION ALL SELECT repo, 'commit_burst' FROM (SELECT repo, commits, coalesce({LAG.format('commits')}, 0) AS prev FROM repo_snapshots) WHERE commits > 20 AND commits > 2 * prev
      UNION ALL SELECT repo, 'description_changed' FROM (SELECT repo, description AS d, {LAG.format('description')} AS prev FROM repo_snapshots) WHERE prev IS NOT NULL AND d <> prev
      UNION ALL SELECT repo, 'file_changed' FROM (SELECT repo, file_text AS d, {LAG.format('file_text')} AS prev FROM repo_snapshots) WHERE prev IS NOT NULL AND d <> prev) GROUP BY 1, 2"""),
)
def _(t: Tables):
    src = st.scratch(t.spark, "snapshots")
    snaps = t.repo_snapshots()
    snaps.write.parquet(src)
    s = st.repo_event_stream(t.spark.readStream.schema(snaps.schema).parquet(src))
    out = st.drain(s, path=st.scratch(t.spark, "repo"), checkpoint=st.scratch(t.spark, "repo-cp"))
    return out.groupBy("repo", "event").agg(F.count(F.lit(1)).alias("n"))


@query(
    "repo_event_stream_shuffled", "E01 E02 E03 E04 T09",
    sql("repo_snapshots", f"""SELECT repo, event, count(*) AS n FROM (
      SELECT repo, 'star_milestone' AS event FROM (SELECT repo, stars, coalesce({LAG.format('stars')}, 0) AS prev FROM repo_snapshots), (SELECT unnest([100,500,1000,5000,10000]) AS m) WHERE prev < m AND m <= stars
      UNION ALL SELECT repo, 'commit_burst' FROM (SELECT repo, commits, coalesce({LAG.format('commits')}, 0) AS prev FROM repo_snapshots) WHERE commits > 20 AND commits > 2 * prev
      UNION ALL SELECT repo, 'description_changed' FROM (SELECT repo, description AS d, {LAG.format('description')} AS prev FROM repo_snapshots) WHERE prev IS NOT NULL AND d <> prev
      UNION ALL SELECT repo, 'file_changed' FROM (SELECT repo, file_text AS d, {LAG.format('file_text')} AS prev FROM repo_snapshots) WHERE prev IS NOT NULL AND d <> prev) GROUP BY 1, 2"""),
)
def _(t: Tables):
    """Snapshots arrive up to three days out of order, over several micro-batches; a last poll far ahead closes the stream."""
    snaps = t.repo_snapshots()
    late = snaps.withColumn("_at", F.unix_seconds("ts") + F.pmod(F.xxhash64("repo", "ts"), F.lit(3 * 86400)))
    end = snaps.limit(1).withColumn("repo", F.lit("~end")).withColumn("ts", c("ts") + F.expr("INTERVAL 9000 DAYS")).withColumns({"stars": F.lit(0).cast("long"), "commits": F.lit(0).cast("long")})
    out = in_time_order(t, "repo", 3, [(late, c("_at"))], lambda s: st.repo_event_stream(s, delay="4 days"), end.select(*snaps.columns))
    return t.spark.read.schema("repo string, ts timestamp, event string, detail string").parquet(out).groupBy("repo", "event").agg(F.count(F.lit(1)).alias("n"))


@query(
    "silence_gaps", "T06",
    f"""SELECT {ts_text('prev')} AS silent_from, {ts_text('s')} AS silent_to, round(epoch(s - prev) / 3600, 4) AS hours FROM
    (SELECT s, lag(s) OVER (ORDER BY s) AS prev FROM (SELECT DISTINCT date_trunc('second', ts) AS s FROM events)) WHERE epoch(s - prev) / 3600 > 0.4""",
)
def _(t: Tables):
    return re_.silence_gaps(t.raw("events"), hours=0.4).select(ts("silent_from"), ts("silent_to"), "hours")


@query(
    "silence_stream", "T06",
    f"""SELECT CAST(user_id AS VARCHAR) AS source_id, {ts_text('prev')} AS last_seen FROM (SELECT user_id, s AS prev, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS nxt, max(s) OVER () AS top
      FROM (SELECT DISTINCT user_id, date_trunc('milliseconds', ts) AS s FROM events)) WHERE epoch_ms(coalesce(nxt, top)) - epoch_ms(prev) > 86400000""",
)
def _(t: Tables):
    """Silences of more than a day, source by source, over micro-batches that follow each other in time."""
    beats = t.raw("events").select(c("user_id").cast("string").alias("source_id"), "ts")
    out = in_time_order(t, "silence", 4, [(beats, F.unix_millis("ts"))], lambda s: st.silence_stream(s, hours=24))
    return t.spark.read.schema("source_id string, last_seen timestamp").parquet(out).select("source_id", ts("last_seen"))


SESSIONS = f"""SELECT user_id, {ts_text('min(ts)')} AS session_start, {ts_text("max(ts) + INTERVAL 6 HOUR")} AS session_end, count(*) AS events FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM (
    SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, n"""


@query("event_sessions", "T09", SESSIONS)
def _(t: Tables):
    out = st.sessions(t.raw("events"), keys=["user_id"], gap="6 hours")
    return out.select("user_id", ts("session_start"), ts("session_end"), "events")


@query("event_sessions_stream", "T09", SESSIONS)
def _(t: Tables):
    """The same sessions from micro-batches whose rows come up to two hours out of order; an event far ahead closes the last ones."""
    e = t.raw("events").select("user_id", "ts")
    late = e.withColumn("_at", F.unix_seconds("ts") + F.pmod(F.xxhash64("user_id", "ts"), F.lit(7200)))
    end = e.limit(1).select(F.lit(-1).cast(e.schema["user_id"].dataType).alias("user_id"), (c("ts") + F.expr("INTERVAL 9000 DAYS")).alias("ts"))
    out = in_time_order(t, "sessions", 4, [(late, c("_at"))], lambda s: st.sessions(s, keys=["user_id"], gap="6 hours", delay="3 hours"), end)
    return t.spark.read.parquet(out).where("user_id >= 0").select("user_id", ts("session_start"), ts("session_end"), "events")


@query(
    "silence_by_source", "T06",
    f"""SELECT user_id, {ts_text('prev')} AS silent_from, round(epoch(s - prev) / 3600, 4) AS hours FROM
    (SELECT user_id, s, lag(s) OVER (PARTITION BY user_id ORDER BY s) AS prev FROM (SELECT DISTINCT user_id, date_trunc('second', ts) AS s FROM events)) WHERE epoch(s - prev) / 3600 > 24""",
)
def _(t: Tables):
    return re_.silence_gaps(t.raw("events"), hours=24, keys=["user_id"]).select("user_id", ts("silent_from"), "hours")


@query(
    "source_silence", "T06",
    f"SELECT {ts_text('max(ts)')} AS last_heartbeat, round((epoch_us({AS_OF}) - epoch_us(max(ts)))::DOUBLE / 3600000000, 4) AS silent_hours, (epoch_us({AS_OF}) - epoch_us(max(ts)))::DOUBLE / 3600000000 > 4 AS alarm FROM events",
)
def _(t: Tables):
    return sj.source_silence(t.raw("events"), as_of=as_of()).select(ts("last_heartbeat"), "silent_hours", "alarm")


@query(
    "stream_url_dedup", "T01 T02",
    sql("items", "SELECT DISTINCT sha256(regexp_replace(split_part(url, '#', 1), '/+$', '')) AS url_hash FROM items"),
)
def _(t: Tables):
    s = st.dedup_landed(t.items(docs=t.stream("documents")).select("id", "url", "created_at"), delay="400 days").select("url_hash")
    return st.drain(s, path=st.scratch(t.spark, "dedup"), checkpoint=st.scratch(t.spark, "dedup-cp"))


@query(
    "stream_history_dedup", "T02 J09",
    sql("items", "SELECT id FROM items QUALIFY row_number() OVER (PARTITION BY regexp_replace(split_part(url, '#', 1), '/+$', '') ORDER BY created_at, id) = 1"),
)
def _(t: Tables):
    rows = t.items().select("id", "url", "created_at")

    def run(stream, path, checkpoint):
        st.drain_batches(stream, st.append_unseen(path), checkpoint=checkpoint)

    # of rows with the same url the oldest is kept, so they come in order of time
    return t.spark.read.parquet(in_time_order(t, "history", 4, [(rows, c("created_at"))], lambda s: s, run=run)).select("id")


@query(
    "stream_history_bucketed", "T02 J09",
    sql("items", "SELECT DISTINCT sha256(regexp_replace(split_part(url, '#', 1), '/+$', '')) AS key FROM items"),
)
def _(t: Tables):
    path = st.scratch(t.spark, "rows")
    history = KeyedHistory(t.spark, st.scratch(t.spark, "keys"), buckets=8)
    handle = st.append_unseen_keys(history, path)

    def compacting(batch, batch_id):
        if batch_id == 2:
            history.compact(most_files=1)
        handle(batch, batch_id)

    st.drain_batches(in_files(t, t.items().select("id", "url", "created_at")), compacting, checkpoint=st.scratch(t.spark, "keys-cp"))
    return t.spark.read.parquet(path).select("key")


@query(
    "stream_history_items", "T02 J09 J10 B01",
    sql("items", """SELECT count(*) AS n, count(*) AS urls, count(DISTINCT f) AS texts FROM (
      SELECT regexp_replace(lower(content), '[^\\p{L}\\p{N}_]+', '', 'g') AS f FROM items
      QUALIFY row_number() OVER (PARTITION BY f ORDER BY id) = 1)"""),
)
def _(t: Tables):
    """Items whose url is their text's: each text stays once, whichever micro-batch brings it."""
    path = st.scratch(t.spark, "rows")
    history = KeyedHistory(t.spark, st.scratch(t.spark, "keys"), buckets=8)
    items = t.items().select("id", "content", "created_at", "published_at").withColumn("url", F.concat(F.lit("https://e.org/"), F.sha2(c("content"), 256)))
    st.drain_batches(in_files(t, items, 3), st.append_new_items(history, path, as_of=as_of()), checkpoint=st.scratch(t.spark, "keys-cp"))
    kept = t.spark.read.parquet(path)
    return kept.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("url").alias("urls"), F.countDistinct(tx.content_fingerprint(c("content"))).alias("texts"))


@query(
    "replay_guard", "T03",
    "SELECT DISTINCT user_id || '-' || event_type AS token FROM events",
)
def _(t: Tables):
    s = t.stream("events").select(F.concat("user_id", F.lit("-"), "event_type").alias("token"), c("ts").alias("received_at"))
    out = st.replay_guard(s, ttl="40 days").select("token")
    return st.drain(out, path=st.scratch(t.spark, "tokens"), checkpoint=st.scratch(t.spark, "tokens-cp"))


@query(
    "late_rows", "T09 T01",
    f"""WITH m AS (SELECT user_id, max(ts) FILTER (event_id % 2 = 0) AS mark FROM events GROUP BY 1)
    SELECT e.event_id, coalesce(floor(epoch(e.ts)) <= floor(epoch(m.mark)), false) AS late FROM events e JOIN m USING (user_id)""",
)
def _(t: Tables):
    e = t.raw("events").withColumn("source_id", c("user_id"))
    none = e.select("source_id", F.lit(0).cast("long").alias("last_poll_ts")).where(F.lit(False))
    marks = st.advance_watermarks(none, e.where("event_id % 2 = 0"), "ts")
    fresh, late = st.split_late(e, marks, "ts")
    return fresh.select("event_id", F.lit(False).alias("late")).unionByName(late.select("event_id", F.lit(True).alias("late")))


@query(
    "unread_pairs", "J12",
    sql("signals", "SELECT count(*) AS n, count(DISTINCT item_id) AS items FROM signals WHERE action IN ('read','acted_on','dismiss')"),
)
def _(t: Tables):
    p = jn.seen_pairs(t.signals())
    return p.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("items"))
