"""Trends, landscapes, digests, deltas, threads, signals."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from feedloom.plans import feed as fd
from feedloom.plans import insight as ins
from feedloom.plans import signals as sg
from feedloom.plans import threads as th
from feedloom.session import ensure_checkpoint_dir
from feedloom.sources.snapshots import KeyedTable
from workload.adapter import Tables, as_of
from workload.oracle import AS_OF, EVENT_TS, SIG, half_up, sql, ts_text
from workload.q_feed import CAND, INTEREST, PROFILE
from workload.registry import query

c = F.col


def ts(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


VELOCITY = "CASE WHEN velocity_ratio IS NULL THEN 'emerging' WHEN velocity_ratio > 1.5 THEN 'accelerating' WHEN velocity_ratio < 0.67 THEN 'declining' ELSE 'plateauing' END"


def trends_sql(days: int, min_count: int, limit: int) -> str:
    return sql(
        "items",
        f"SELECT *, {VELOCITY} AS velocity_label FROM page WHERE (SELECT max(window_2_count) FROM page) > 0",
        f"""g AS (SELECT tag, count(*) FILTER (ets >= {AS_OF} - INTERVAL {days * 12} HOUR) AS window_1_count,
          count(*) FILTER (ets < {AS_OF} - INTERVAL {days * 12} HOUR) AS window_2_count, count(*) AS total_count,
          count(DISTINCT source_id) AS source_count
          FROM (SELECT source_id, unnest(tags) AS tag, {EVENT_TS} AS ets FROM items WHERE status = 'processed'
            AND {EVENT_TS} >= {AS_OF} - INTERVAL {days} DAY) GROUP BY tag HAVING count(*) >= {min_count}),
        page AS (SELECT *, CASE WHEN window_2_count = 0 THEN CASE WHEN window_1_count > 0 THEN 99 END
            ELSE {half_up('window_1_count::DOUBLE / window_2_count', 2)} END::DOUBLE AS velocity_ratio,
          round(CASE WHEN window_2_count = 0 THEN CASE WHEN window_1_count > 0 THEN 99 ELSE -1 END
            ELSE window_1_count::DOUBLE / window_2_count END * least(source_count, 5)::DOUBLE / 5, 6) AS weight
          FROM g ORDER BY weight DESC, tag LIMIT {limit})""",
    )


@query("trends", "Q11 A01 A02 F27 J15", trends_sql(14, 3, 20))
def _(t: Tables):
    return ins.trends(t.items(), as_of=as_of())


@query("trends_90_days", "Q11 A01 A02", trends_sql(90, 1, 100))
def _(t: Tables):
    return ins.trends(t.items(), as_of=as_of(), days=90, min_count=1, limit=100)


@query(
    "tag_page", "A03 L03",
    sql("items", "SELECT tag, n FROM (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM items WHERE status = 'processed') GROUP BY tag) WHERE n >= 2 ORDER BY n DESC, tag LIMIT 5 OFFSET 2"),
)
def _(t: Tables):
    return ins.tag_page(t.items(), min_count=2, limit=5, offset=2)


@query(
    "tag_total", "A03",
    sql("items", "SELECT count(*) AS total FROM (SELECT tag FROM (SELECT unnest(tags) AS tag FROM items WHERE status = 'processed') GROUP BY tag HAVING count(*) >= 2)"),
)
def _(t: Tables):
    return ins.tag_counts(t.items(), 2).agg(F.count(F.lit(1)).alias("total"))


@query("type_counts", "A04", sql("items", "SELECT primary_type, count(*) AS n FROM items WHERE status = 'processed' GROUP BY 1"))
def _(t: Tables):
    return ins.type_counts(t.items())


@query(
    "topic_index", "A05",
    sql("items", f"""SELECT tag, item_count, avg_quality, {ts_text('last_updated')} AS last_updated,
      CASE tag WHEN 'mcp' THEN 'Model Context Protocol' WHEN 'claude-code' THEN 'Claude Code' WHEN 'security' THEN 'Security' WHEN 'testing' THEN 'Testing'
        ELSE upper(tag[1]) || tag[2:] END AS label,
      CASE tag WHEN 'docker' THEN 'deployment,monitoring,ci-cd,infra' WHEN 'sql' THEN 'postgres,supabase,neon,database,prisma'
        WHEN 'agents' THEN 'multi-agent,ai-agents,orchestration,agentic-design,workflow-automation'
        WHEN 'rag' THEN 'embeddings,embedding,vector-database,vector-store,pinecone,weaviate,chroma,qdrant,llamaindex,retrieval-augmented-generation' END AS subtopics
      FROM (SELECT tag, count(*) AS item_count, round(avg(q * r), 4) AS avg_quality, max(created_at) AS last_updated FROM
        (SELECT unnest(tags) AS tag, quality_score AS q, relevance_score AS r, created_at FROM items WHERE status = 'processed')
        GROUP BY tag HAVING count(*) >= 3 ORDER BY avg_quality DESC, item_count DESC, tag LIMIT 50)"""),
)
def _(t: Tables):
    out = ins.topic_index(t.items())
    return out.select("tag", "item_count", "avg_quality", ts("last_updated"), "label", F.array_join("subtopics", ",").alias("subtopics"))


@query(
    "topic_frequency", "A26",
    sql("items", """SELECT tag, count(*) AS tag_count, count(DISTINCT source_id) AS source_count FROM
      (SELECT source_id, unnest(tags) AS tag FROM items WHERE status = 'processed')
      WHERE tag NOT IN ('tool','update','docs','practice','skill') GROUP BY tag ORDER BY tag_count DESC, tag LIMIT 8"""),
)
def _(t: Tables):
    return ins.topic_frequency(t.items(), limit=8)


DOMAIN = f"status = 'processed' AND created_at >= {AS_OF} - INTERVAL 30 DAY AND list_contains(tags, 'mcp')"


@query(
    "landscape_leaders", "Q12 A06",
    sql("items", f"""SELECT title, url, primary_type, source_name, max(relevance_score) AS relevance_score,
      ['breaking','major','minor','informational'][min({SIG}) + 1] AS significance, count(*) AS item_count,
      CAST(sum(CASE WHEN created_at >= {AS_OF} - INTERVAL 7 DAY THEN 2 ELSE 1 END * CASE significance WHEN 'breaking' THEN 8 WHEN 'major' THEN 4 ELSE 1 END) AS BIGINT) AS momentum_weight
      FROM items WHERE {DOMAIN} GROUP BY 1, 2, 3, 4 ORDER BY momentum_weight DESC, relevance_score DESC, url, title LIMIT 20"""),
)
def _(t: Tables):
    return ins.landscape_leaders(t.items(), domain="mcp", as_of=as_of())


@query("landscape_positioning", "Q12 A07", sql("items", f"SELECT primary_type, count(*) AS n FROM items WHERE {DOMAIN} GROUP BY 1"))
def _(t: Tables):
    return ins.landscape_positioning(t.items(), domain="mcp", as_of=as_of())


@query(
    "landscape_gaps", "Q12 A07 U04",
    sql("items", f"""SELECT p AS primary_type FROM (SELECT unnest(['skill','tool','update','practice','docs']) AS p) WHERE p NOT IN
      (SELECT primary_type FROM items WHERE status = 'processed' AND created_at >= {AS_OF} - INTERVAL 1 DAY AND list_contains(tags, 'de'))"""),
)
def _(t: Tables):
    return ins.landscape_gaps(t.items(), domain="de", as_of=as_of(), days=1)


@query(
    "digest", "Q08 W01",
    sql("items", f"""SELECT id, primary_type, relevance_score, rn FROM (SELECT *, row_number() OVER (PARTITION BY primary_type ORDER BY relevance_score DESC, id) AS rn
      FROM items WHERE status = 'processed' AND created_at >= {AS_OF} - INTERVAL 7 DAY) WHERE rn <= 10"""),
)
def _(t: Tables):
    return ins.digest(t.items(), as_of=as_of()).select("id", "primary_type", "relevance_score", "rn")


IMPACT = """CASE significance WHEN 'breaking' THEN 'Breaking change: immediate action required' WHEN 'major' THEN 'Major update: adoption recommended'
 WHEN 'minor' THEN 'Minor change: low priority' ELSE 'Informational update' END"""


@query(
    "diff", "Q09 F28 L01 P05 P06",
    sql("items", f"""SELECT id, significance, relevance_score, {IMPACT} AS impact FROM items WHERE status = 'processed'
      AND {EVENT_TS} >= {AS_OF} - INTERVAL 7 DAY AND list_has_any(tags, {INTEREST}) ORDER BY {SIG}, relevance_score DESC, id LIMIT 20"""),
)
def _(t: Tables):
    return ins.diff(t.items(), profile=PROFILE, as_of=as_of()).select("id", "significance", "relevance_score", "impact")


@query(
    "diff_since_cursor", "Q09 T07 F46",
    sql("items", f"""SELECT id, significance FROM items WHERE status = 'processed' AND {EVENT_TS} >= TIMESTAMP '2023-12-20 10:00:00'
      AND list_has_any(tags, ['docker','mcp','llama','meta']) AND list_has_any(tags, ['docker','deployment','monitoring','ci-cd','infra'])
      AND significance IN ('breaking','major') ORDER BY {SIG}, relevance_score DESC, id LIMIT 20"""),
)
def _(t: Tables):
    out = ins.diff(
        t.items(), profile={"tech_stack": ["docker", "mcp"], "providers": ["meta"]}, as_of=as_of(),
        cursor=F.lit("2023-12-20 10:00:00").cast("timestamp"), group="devops", significance="breaking,major",
    )
    return out.select("id", "significance")


@query(
    "diff_for_all_profiles", "Q09 F45 L01",
    sql("items profile_tags", f"""SELECT user_id, id, pos FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY {SIG}, relevance_score DESC, id) AS pos
      FROM profile_tags p JOIN (SELECT id, tags AS item_tags, significance, relevance_score FROM items WHERE status = 'processed'
        AND {EVENT_TS} >= {AS_OF} - INTERVAL 7 DAY) i ON list_has_any(p.tags, i.item_tags)) WHERE pos <= 20"""),
)
def _(t: Tables):
    return ins.diff_all(t.items(), t.profiles(), as_of=as_of()).select("user_id", "id", "pos")


@query(
    "action_items", "Q10 J12 W04 L01",
    sql("items signals", f"""SELECT id, significance, relevance_score, pos FROM page QUALIFY row_number() OVER (
        PARTITION BY coalesce('c:' || cluster_id, 'i:' || id) ORDER BY relevance_score DESC, pos) = 1""",
        f"""page AS (SELECT *, row_number() OVER (ORDER BY {SIG}, relevance_score DESC, id) AS pos FROM
          (SELECT * FROM items i WHERE status = 'processed' AND {EVENT_TS} >= {AS_OF} - INTERVAL 7 DAY AND significance IN ('breaking','major')
            AND NOT EXISTS (SELECT 1 FROM signals s WHERE s.item_id = i.id AND s.api_key_id = 3 AND s.action IN ('read','acted_on','dismiss'))
          ORDER BY {SIG}, relevance_score DESC, id LIMIT 5))"""),
)
def _(t: Tables):
    out = ins.action_items(t.items(), t.signals(), t.sources(), key_id=3, as_of=as_of())
    return out.select("id", "significance", "relevance_score", "pos")


THREAD = f"""up AS (SELECT item_id, upvotes FROM signal_counts),
stats AS (SELECT cluster_id, count(*) AS item_count, min(created_at) AS first_seen, max(created_at) AS last_seen, avg(relevance_score) AS avg_rel,
  CASE WHEN max(created_at) >= {AS_OF} - INTERVAL 7 DAY THEN 2 ELSE 1 END AS recency, CAST(coalesce(sum(upvotes), 0) AS BIGINT) AS total_upvotes
  FROM items i LEFT JOIN up ON up.item_id = i.id WHERE status = 'processed' AND cluster_id IS NOT NULL AND created_at >= {AS_OF} - INTERVAL 30 DAY
  GROUP BY cluster_id HAVING count(*) >= 2),
modes AS (SELECT cluster_id, significance AS dominant_significance FROM items WHERE status = 'processed' AND created_at >= {AS_OF} - INTERVAL 30 DAY
  GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, significance) = 1),
page AS (SELECT *, row_number() OVER (ORDER BY last_seen DESC, cluster_id) AS pos FROM
  (SELECT *, avg_rel * ln(1 + item_count) * recency AS raw FROM stats JOIN modes USING (cluster_id) ORDER BY last_seen DESC, cluster_id LIMIT 20))"""


@query(
    "threads", "Q13 A08 W09",
    sql("items signal_counts", f"""SELECT cluster_id, item_count, {ts_text('first_seen')} AS first_seen, {ts_text('last_seen')} AS last_seen,
      total_upvotes, dominant_significance, {half_up('raw / (SELECT max(raw) FROM page)', 4)} AS momentum_score, pos FROM page""", THREAD),
)
def _(t: Tables):
    out = th.threads(t.items(), t.signals(), as_of=as_of())
    return out.select("cluster_id", "item_count", ts("first_seen"), ts("last_seen"), "total_upvotes", "dominant_significance", "momentum_score", "pos")


@query(
    "thread_total", "A09",
    sql("items", f"SELECT count(*) AS total FROM (SELECT cluster_id FROM items WHERE status = 'processed' AND cluster_id IS NOT NULL AND created_at >= {AS_OF} - INTERVAL 30 DAY GROUP BY 1 HAVING count(*) >= 2)"),
)
def _(t: Tables):
    return th.thread_total(t.items(), as_of=as_of())


TOP3 = """top AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY relevance_score DESC, id) AS rn FROM items
  WHERE status = 'processed' AND cluster_id IN (SELECT cluster_id FROM page) QUALIFY rn <= 3)"""


@query(
    "thread_top_items", "Q13 W02",
    sql("items signal_counts", "SELECT cluster_id, id, rn FROM top", THREAD + ", " + TOP3),
)
def _(t: Tables):
    items = t.items()
    return th.thread_top_items(items, th.threads(items, t.signals(), as_of=as_of())).select("cluster_id", "id", "rn")


@query(
    "thread_narratives", "Q13 A27",
    sql("items signal_counts", f"""SELECT cluster_id, lead || chr(10) || chr(10) || item_count || ' items about ' || tag_names || ' (' || strftime(first_seen, '%b %d') || ' – '
      || strftime(last_seen, '%b %d') || '). Breakdown: ' || sigs || '.' AS narrative
      FROM page JOIN leads USING (cluster_id) JOIN tagged USING (cluster_id) JOIN sigd USING (cluster_id)""",
      THREAD + ", " + TOP3 + """,
      leads AS (SELECT cluster_id, CASE WHEN length(s) > 150 THEN substr(s, 1, 150) || '...' ELSE s END AS lead FROM
        (SELECT cluster_id, coalesce(nullif(summary, ''), title) AS s FROM top WHERE rn = 1)),
      tagged AS (SELECT cluster_id, string_agg(tag, ', ' ORDER BY n DESC, first_at) AS tag_names FROM (SELECT cluster_id, tag, count(*) AS n, min(rn * 10 + p) AS first_at
        FROM (SELECT cluster_id, rn, unnest(tags) AS tag, generate_subscripts(tags, 1) AS p FROM top) GROUP BY 1, 2
        QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, first_at) <= 3) GROUP BY cluster_id),
      sigd AS (SELECT cluster_id, string_agg(n || ' ' || significance, ', ' ORDER BY o) AS sigs FROM (SELECT cluster_id, significance, count(*) AS n,
        min(CASE significance WHEN 'breaking' THEN 0 WHEN 'major' THEN 1 WHEN 'minor' THEN 2 ELSE 3 END) AS o FROM top GROUP BY 1, 2) GROUP BY 1)"""),
)
def _(t: Tables):
    items = t.items()
    page = th.threads(items, t.signals(), as_of=as_of())
    return th.thread_narratives(items, page).select("cluster_id", "narrative")


@query(
    "thread_detail", "Q13 W09",
    sql("items signal_counts", f"""SELECT cluster_id, count(*) AS item_count, {ts_text('min(created_at)')} AS first_seen, {ts_text('max(created_at)')} AS last_seen,
      CAST(coalesce(sum(upvotes), 0) AS BIGINT) AS total_upvotes, ['breaking','major','minor','informational'][min({SIG}) + 1] AS dominant_significance,
      {half_up(f"least(1, avg(relevance_score) * ln(1 + count(*)) * CASE WHEN max(created_at) >= {AS_OF} - INTERVAL 7 DAY THEN 2 ELSE 1 END / 10)", 4)} AS momentum_score
      FROM items i LEFT JOIN signal_counts u ON u.item_id = i.id WHERE status = 'processed' AND cluster_id = 'c3' GROUP BY cluster_id HAVING count(*) >= 2"""),
)
def _(t: Tables):
    d = th.thread_detail(t.items(), t.signals(), cluster_id="c3", as_of=as_of())
    return d.select("cluster_id", "item_count", ts("first_seen"), ts("last_seen"), "total_upvotes", "dominant_significance", "momentum_score")


@query("thread_members", "Q13", sql("items", f"SELECT id, {ts_text('created_at')} AS created_at FROM items WHERE status = 'processed' AND cluster_id = 'c3'"))
def _(t: Tables):
    return th.thread_members(t.items(), cluster_id="c3").select("id", ts("created_at"))


@query("latest_signals", "W10 B21", sql("signals", f"SELECT item_id, api_key_id, action, {ts_text('created_at')} AS created_at FROM signals"))
def _(t: Tables):
    return t.signals().select("item_id", "api_key_id", "action", ts("created_at"))


@query("signal_merge", "W10 B21 S27", sql("signals", f"SELECT item_id, api_key_id, action, {ts_text('created_at')} AS created_at FROM signals"))
def _(t: Tables):
    """The signals as a stored table, merged in three parts of the log."""
    table = KeyedTable(t.spark, f"{ensure_checkpoint_dir(t.spark)}/signals-{uuid.uuid4().hex}", ("item_id", "api_key_id"), buckets=8)
    log = t.signal_log()
    edges = log.agg(F.min(F.unix_micros("created_at")).alias("a"), F.max(F.unix_micros("created_at")).alias("b")).first()
    span = (edges["b"] - edges["a"]) // 3 + 1
    rows = log.withColumn("part", F.floor((F.unix_micros("created_at") - edges["a"]) / span))
    for k in range(3):
        table.merge(sg.upsert_signals(rows.where(c("part") == k)), k)
    schema = sg.upsert_signals(log).schema
    return table.read(schema).select("item_id", "api_key_id", "action", ts("created_at"))


@query("signal_counts", "A10", sql("signal_counts", "SELECT * FROM signal_counts"))
def _(t: Tables):
    return sg.signal_counts(t.signals())


@query(
    "contrarian_signals", "A11",
    sql("items signal_counts", """SELECT id, upvotes, bookmarks, dismissals, total, nullif(array_to_string(list_filter([
      CASE WHEN dismissals::DOUBLE / total > 0.6 THEN 'adoption_risk' END, CASE WHEN upvotes > 10 AND dismissals >= upvotes THEN 'hype_gap' END,
      CASE WHEN significance IN ('breaking','major') AND dismissals::DOUBLE / total > 0.4 THEN 'regression' END,
      CASE WHEN list_contains(tags, 'security') AND dismissals::DOUBLE / total > 0.3 THEN 'security_concern' END], lambda x: x IS NOT NULL), ','), '') AS labels
      FROM items i JOIN signal_counts s ON s.item_id = i.id WHERE total >= 10"""),
)
def _(t: Tables):
    out = sg.contrarian_signals(t.items(), t.signals())
    return out.select("id", "upvotes", "bookmarks", "dismissals", "total", F.array_join("contrarian_signals", ",").alias("labels"))


@query(
    "source_tier_adjustment", "A12 J19",
    sql("items sources signals", f"""SELECT source_id, tier, positive, negative, total, ['tier3','tier2','tier1'][greatest(1, least(3, list_position(['tier3','tier2','tier1'], tier)
      + CASE WHEN negative::DOUBLE / total > 0.5 THEN -1 WHEN positive::DOUBLE / total > 0.7 THEN 1 ELSE 0 END))] AS new_tier FROM
      (SELECT i.source_id, s.tier, count(*) FILTER (g.action = 'upvote') AS positive, count(*) FILTER (g.action = 'dismiss') AS negative, count(*) AS total
       FROM (SELECT id AS sid, tier FROM sources WHERE is_active) s JOIN items i ON i.source_id = s.sid JOIN signals g ON g.item_id = i.id
       WHERE g.created_at > {AS_OF} - INTERVAL 30 DAY GROUP BY 1, 2 HAVING count(*) >= 10)"""),
)
def _(t: Tables):
    return sg.source_tier_adjustment(t.sources(), t.items(), t.signals(), as_of=as_of())


@query(
    "library_counters", "B21",
    """SELECT 'entry-' || (event_id % 50) AS slug, count(*) FILTER (event_type <> 'error') AS helpful_count,
    strftime(max(ts) FILTER (event_type <> 'error'), '%Y-%m-%d %H:%M:%S') AS last_confirmed_at,
    bool_or(event_type = 'error') AS flagged_outdated FROM events GROUP BY 1""",
)
def _(t: Tables):
    log = t.raw("events").selectExpr(
        "concat('entry-', event_id % 50) AS slug", "if(event_type = 'error', 'outdated', 'helpful') AS action", "ts AS created_at"
    )
    out = sg.library_counters(log)
    return out.select("slug", "helpful_count", ts("last_confirmed_at"), "flagged_outdated")


@query("feed_total", "Q01 L03 P01 P02 P03", sql("items", f"SELECT count(*) AS total FROM items WHERE {CAND}"))
def _(t: Tables):
    return fd.feed_total(t.items(), as_of=as_of())


@query(
    "feed_cursor", "T07",
    sql("items", f"""SELECT api_key_id, strftime(max(last_seen_at), '%Y-%m-%d %H:%M:%S.%f') AS last_seen_at FROM (
      SELECT user_id AS api_key_id, min(ts) AS last_seen_at FROM events GROUP BY 1
      UNION ALL SELECT 7, max(created_at) + INTERVAL 1 MICROSECOND FROM (SELECT created_at FROM items WHERE status = 'processed'
        AND {EVENT_TS} >= {AS_OF} - INTERVAL 7 DAY ORDER BY relevance_score DESC, id LIMIT 20)) GROUP BY 1"""),
)
def _(t: Tables):
    cursors = t.raw("events").groupBy(c("user_id").alias("api_key_id")).agg(F.min("ts").alias("last_seen_at"))
    page = t.items().where(ins.fl.processed() & ins.fl.recent(as_of(), 7)).orderBy(F.desc("relevance_score"), "id").limit(20)
    out = fd.advance_cursor(cursors, 7, page)
    return out.select("api_key_id", F.date_format("last_seen_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_seen_at"))


@query(
    "feed_health", "A25",
    sql("sources", f"""SELECT {ts_text('max(last_successful_poll)')} AS last_ingestion, count(*) FILTER (is_active) AS sources_active,
      coalesce(epoch_us({AS_OF}) - epoch_us(max(last_successful_poll)) < 3600000000, false) AS healthy FROM sources"""),
)
def _(t: Tables):
    return fd.feed_health(t.sources(), as_of=as_of()).select(ts("last_ingestion"), "sources_active", "healthy")


@query(
    "topic_coverage", "A24",
    sql("sources", "SELECT count(*) FILTER (contains(lower(name), 'src1') OR contains(lower(url), 'src1') OR contains(lower(config), 'src1')) AS topic_sources FROM sources WHERE is_active"),
)
def _(t: Tables):
    return fd.topic_coverage(t.sources(), "SRC1")


@query(
    "page_quality", "A30",
    sql("items", f"""SELECT count(*) AS n, round(avg(relevance_score), 6) AS mean, CASE WHEN count(*) = 0 THEN 'LOW' WHEN avg(relevance_score) >= 0.7 AND count(*) >= 3 THEN 'HIGH'
      WHEN avg(relevance_score) >= 0.4 OR count(*) >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS result_quality
      FROM (SELECT * FROM items WHERE {CAND} ORDER BY relevance_score DESC, id LIMIT 20)"""),
)
def _(t: Tables):
    page = fd.feed_candidates(t.items(), as_of=as_of()).orderBy(F.desc("relevance_score"), "id").limit(20)
    return ins.result_quality(page)


@query(
    "page_summary_line", "A29 P17",
    sql("items", f"""SELECT 'Found ' || n || ' results (' || b || ' breaking, ' || m || ' major). Top: ' || regexp_replace(substr(s, 1, 120), '\\s+\\S*$', '') || '...' AS tldr,
      (SELECT bool_or(contains(lower(title || ' ' || coalesce(summary, '') || ' ' || array_to_string(tags, ' ')), 'docker')) FROM page WHERE pos <= 3) AS relevant
      FROM (SELECT count(*) AS n, count(*) FILTER (significance = 'breaking') AS b, count(*) FILTER (significance = 'major') AS m,
        first(summary ORDER BY pos) AS s FROM page)""",
      f"""page AS (SELECT *, row_number() OVER (ORDER BY {SIG}, relevance_score DESC, id) AS pos FROM items WHERE status = 'processed' AND summary IS NOT NULL
        ORDER BY {SIG}, relevance_score DESC, id LIMIT 60)"""),
)
def _(t: Tables):
    rows = t.items().where(ins.fl.processed() & c("summary").isNotNull()).withColumn("severity", ins.sc.significance_rank(c("significance")))
    page = ins.rk.top_positions(rows, ins.severity_order(), 60)
    return ins.tldr(page, "docker").withColumn("relevant", ins.query_relevance(page, "the Docker api").scalar())
