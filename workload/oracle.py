"""The adapter's derivations as DuckDB CTEs, and a helper that prefixes the ones a query needs."""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
AS_OF_US = f"epoch_us({AS_OF})"
TAGS = "['mcp','testing','security','claude-code','docker','sql','agents','rag']"

_ITEM_COLS = f"""
    'd' || doc_id AS id, source AS source_id, 'Source ' || substr(source, 4) AS source_name,
    CAST(doc_id AS VARCHAR) AS external_id,
    'https://example.org/p/' || CASE WHEN doc_id % 20 = 1 THEN (doc_id - 1) || '#dup' ELSE CAST(doc_id AS VARCHAR) END AS url,
    translate(substr(text, 1, 80), chr(10), ' ') AS title, text AS content, substr(text, 1, 500) AS excerpt,
    CASE WHEN doc_id % 9 = 0 THEN NULL ELSE substr(text, 1, 160) END AS summary,
    ['skill','tool','update','practice','docs'][doc_id % 5 + 1] AS primary_type,
    CASE WHEN doc_id % 20 = 0 THEN 'breaking' WHEN doc_id % 20 <= 3 THEN 'major'
         WHEN doc_id % 20 <= 11 THEN 'minor' ELSE 'informational' END AS significance,
    [lang, {TAGS}[doc_id % 8 + 1]] AS tags,
    CASE label_quality WHEN 1 THEN 0.8::DOUBLE WHEN 0 THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END + (doc_id % 10)::DOUBLE / 100 AS quality_score,
    0.5::DOUBLE + (doc_id % 50)::DOUBLE / 100 AS confidence_score,
    round(0.4::DOUBLE + 0.6::DOUBLE * ((doc_id * 37) % 101)::DOUBLE / 101, 4) AS relevance_score,
    created_at,
    CASE WHEN doc_id % 4 = 0 THEN NULL ELSE created_at - to_hours(CAST(doc_id % 48 AS BIGINT)) END AS published_at,
    created_at + to_minutes(CAST(doc_id % 30 AS BIGINT)) AS updated_at,
    CASE doc_id % 25 WHEN 0 THEN 'raw' WHEN 1 THEN 'queued' WHEN 2 THEN 'filtered' WHEN 3 THEN 'failed' ELSE 'processed' END AS status,
    CASE WHEN doc_id % 7 = 0 THEN 'c' || ((doc_id // 7) % 20) END AS cluster_id"""

_DOCS = f"""SELECT d.*, l.quality AS label_quality,
    {AS_OF} - to_minutes(CAST((d.doc_id * 7919) % 129600 AS BIGINT)) AS created_at
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""

CTES: dict[str, tuple[list[str], str]] = {
    "items": ([], f"SELECT {_ITEM_COLS} FROM ({_DOCS})"),
    "vitems": (
        [],
        f"SELECT {_ITEM_COLS}, CAST(embedding AS DOUBLE[]) AS embedding FROM ({_DOCS}) q LEFT JOIN embeddings e "
        "ON e.vec_id = q.doc_id % (SELECT count(*) FROM embeddings)",
    ),
    "landed": (
        ["items"],
        "SELECT * REPLACE ('raw' AS status, NULL::DOUBLE AS relevance_score, NULL::DOUBLE AS quality_score) FROM items",
    ),
    "vlanded": (
        ["vitems"],
        "SELECT * REPLACE ('raw' AS status, NULL::DOUBLE AS relevance_score, NULL::DOUBLE AS quality_score) FROM vitems",
    ),
    "sources": (
        [],
        f"""SELECT source AS id, 'Source ' || k AS name, ['rss','github','hn','reddit','npm'][k % 5 + 1] AS type,
        'https://src' || k || '.example.org/feed' AS url, k % 10 <> 9 AS is_active, 'tier' || (1 + k % 3) AS tier,
        k % 6 AS consecutive_errors, k % 4 AS recovery_attempts,
        CASE WHEN k % 7 = 3 THEN NULL ELSE {AS_OF} - to_hours(CAST(k * 10 AS BIGINT)) END AS last_successful_poll,
        {AS_OF} - to_hours(CAST(k * 5 AS BIGINT)) AS last_fetched_at, {AS_OF} - to_hours(CAST(k * 2 AS BIGINT)) AS created_at,
        CASE WHEN k % 5 = 0 THEN '{{"relevance_threshold": 0.3}}' ELSE '{{}}' END AS config
        FROM (SELECT DISTINCT source, CAST(substr(source, 4) AS INTEGER) AS k FROM documents)""",
    ),
    "signal_log": (
        [],
        """SELECT event_id, 'd' || ((event_id * 13) % (SELECT greatest(count(*) // 10, 1) FROM documents)) AS item_id,
        user_id AS api_key_id, CASE event_type WHEN 'purchase' THEN 'upvote' WHEN 'click' THEN 'bookmark'
        WHEN 'error' THEN 'dismiss' WHEN 'view' THEN 'read' ELSE 'acted_on' END AS action, ts AS created_at FROM events""",
    ),
    "signals": (
        ["signal_log"],
        """SELECT item_id, api_key_id, action, created_at FROM signal_log
        QUALIFY row_number() OVER (PARTITION BY item_id, api_key_id ORDER BY created_at DESC, event_id DESC) = 1""",
    ),
    "signal_counts": (
        ["signals"],
        """SELECT item_id, count(*) FILTER (action = 'upvote') AS upvotes, count(*) FILTER (action = 'bookmark') AS bookmarks,
        count(*) FILTER (action = 'dismiss') AS dismissals, count(*) AS total FROM signals GROUP BY item_id""",
    ),
    "profiles": (
        [],
        f"""SELECT c_custkey AS user_id, [{TAGS}[c_custkey % 8 + 1]] AS tech_stack,
        CASE WHEN c_custkey % 3 = 0 THEN ['devops','unlisted'] ELSE []::VARCHAR[] END AS skills,
        CASE WHEN c_custkey % 4 = 1 THEN ['cursor'] ELSE []::VARCHAR[] END AS tools,
        CASE WHEN c_custkey % 5 = 2 THEN ['meta'] ELSE []::VARCHAR[] END AS providers FROM customer""",
    ),
    "profile_tags": (
        ["profiles"],
        """SELECT user_id, list_sort(list_distinct(tech_stack
        || CASE WHEN len(skills) > 0 THEN ['docker','deployment','monitoring','ci-cd','unlisted'] ELSE [] END
        || CASE WHEN len(tools) > 0 THEN ['cursor','cursor-rules','copilot','ai-ide'] ELSE [] END
        || CASE WHEN len(providers) > 0 THEN ['meta','llama'] ELSE [] END)) AS tags FROM profiles""",
    ),
    "users": (
        [],
        f"""SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'user' || c_custkey || '@example.org' END AS email,
        c_custkey % 6 <> 0 AS is_active, {AS_OF} - to_hours(CAST((c_custkey % 40) * 6 AS BIGINT)) AS created_at FROM customer""",
    ),
    "api_keys": (
        [],
        f"""SELECT o_orderkey AS id, o_custkey AS user_id, o_orderstatus <> 'F' AS is_active,
        CAST(trunc(o_totalprice) AS BIGINT) AS usage_count,
        {AS_OF} - to_hours(CAST(o_orderkey % 72 AS BIGINT)) AS last_used_at FROM orders""",
    ),
    "query_logs": (
        [],
        f"""SELECT conv_id * 1000 + turn AS id, conv_id % 50 AS api_key_id,
        ['feed','search','similar','library'][turn % 4 + 1] AS query_type, text AS query_text,
        length(text) % 25 AS result_count, {AS_OF} - to_hours(CAST(conv_id * 24 + turn AS BIGINT)) AS created_at
        FROM conversations WHERE role = 'user'""",
    ),
    "feedback": (
        [],
        """SELECT event_id AS id, 'auto_miss' AS report_type, user_id AS api_key_id, ts AS created_at,
        CASE WHEN event_id % 3 = 0 THEN ' K' || json_extract_string(props, '$.k') || ' '
        ELSE '{"query": "k' || json_extract_string(props, '$.k') || '"}' END AS notes FROM events WHERE event_type = 'error'""",
    ),
    "watchlists": (
        [],
        """SELECT 'w' || label AS id, label % 3 AS user_id, list(m ORDER BY pos) AS concept_embedding,
        0.25::DOUBLE + (label % 3)::DOUBLE / 20 AS similarity_threshold, label % 5 <> 4 AS is_active
        FROM (SELECT label, pos, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x,
        generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label""",
    ),
    "reference_items": (
        [],
        """SELECT 'r' || label || '-' || part AS id, list(m ORDER BY pos) AS embedding, label % 2 = 0 AS is_positive
        FROM (SELECT label, part, pos, avg(x::DOUBLE) AS m FROM (SELECT label, vec_id % 5 AS part, unnest(embedding) AS x,
        generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, part, pos) GROUP BY label, part""",
    ),
    "alert_rules": (
        [],
        """SELECT 'a' || n_nationkey AS id, n_nationkey % 4 AS user_id,
        [lower(n_name), ['mcp','security','deprecated','eol','rag'][n_nationkey % 5 + 1]] AS keywords,
        CASE WHEN n_nationkey % 6 = 0 THEN ['breaking'] WHEN n_nationkey % 6 = 1 THEN ['breaking','major'] END AS significance_trigger,
        60 * (1 + n_nationkey % 12) AS cooldown_minutes, n_nationkey % 8 <> 7 AS is_active FROM nation""",
    ),
    "library": (
        [],
        f"""SELECT 'l' || p_partkey || '-' || version AS id, 'entry-' || p_partkey AS slug, p_name AS title,
        CASE WHEN p_partkey % 10 = 3 THEN NULL ELSE 'Use ' || p_name || ' from ' || p_brand END AS tldr,
        p_name || ' is made as ' || p_type || ' by ' || p_brand || ', version ' || version AS body,
        [p_brand, p_type] AS key_points,
        CASE WHEN p_partkey % 3 = 0 THEN [{{'title': p_brand, 'detail': p_type}}] END AS gotchas,
        lower(p_type) AS topic_path, [lower(p_brand), {TAGS}[p_partkey % 8 + 1]] AS tags,
        ['guide','reference','pattern'][p_partkey % 3 + 1] AS entry_type,
        CASE p_partkey % 12 WHEN 0 THEN 'candidate' WHEN 1 THEN 'review_needed' ELSE 'active' END AS status,
        (p_partkey % 37)::DOUBLE AS graduation_score,
        CASE WHEN p_partkey % 2 = 0 THEN 'synthesis' ELSE 'signal' END AS graduation_method,
        {AS_OF} - to_days(CAST(p_partkey % 300 AS INTEGER)) AS graduated_at,
        CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE {AS_OF} - to_days(CAST(p_partkey % 260 AS INTEGER)) END AS last_confirmed_at,
        {AS_OF} - to_days(CAST(p_partkey % 60 AS INTEGER)) AS updated_at,
        {AS_OF} - to_days(CAST(400 - version AS INTEGER)) AS created_at,
        ['d' || ((p_partkey * 3) % greatest(nd // 3, 1)), 'd' || ((p_partkey * 5 + 1) % greatest(nd // 3, 1))] AS source_item_ids,
        p_size AS source_item_count, p_size % 5 AS source_count, p_size AS helpful_count, version,
        version = CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 1 END AS is_current, CAST(embedding AS DOUBLE[]) AS embedding
        FROM (SELECT *, 1 AS version FROM part UNION ALL SELECT *, 2 FROM part WHERE p_partkey % 4 = 0) p
        CROSS JOIN (SELECT count(*) AS nd FROM documents) n
        LEFT JOIN embeddings e ON e.vec_id = p.p_partkey % (SELECT count(*) FROM embeddings)""",
    ),
    "repo_snapshots": (
        [],
        """SELECT 'owner' || (o_custkey % 7) || '/repo' || o_custkey AS repo, CAST(day AS TIMESTAMP) AS ts,
        CAST(sum(n) OVER (PARTITION BY o_custkey ORDER BY day) * 40 AS BIGINT) AS stars, n * 15 AS commits, description, file_text
        FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, count(*) AS n, min(o_orderpriority) AS description,
        max(o_orderstatus) AS file_text FROM orders GROUP BY 1, 2)""",
    ),
    "spend": (
        [],
        """SELECT l_orderkey * 10 + l_linenumber AS call_id, l_shipdate AS ts, l_suppkey AS user_id,
        CASE WHEN l_linenumber % 2 = 0 THEN 'haiku' ELSE 'gpt-4o-mini' END AS model,
        CAST(trunc(l_quantity) AS BIGINT) * 100 AS in_tokens, CAST(trunc(l_quantity) AS BIGINT) * 10 AS out_tokens FROM lineitem""",
    ),
}


def sql(names: str, body: str, extra: str = "") -> str:
    """``WITH <needed tables> <extra ctes> body``; ``names`` is a blank-separated list."""
    order: list[str] = []

    def need(n: str) -> None:
        for dep in CTES[n][0]:
            need(dep)
        if n not in order:
            order.append(n)

    for n in names.split():
        need(n)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order]
    if extra:
        parts.append(extra)
    # one recursive keyword serves plain and recursive tables alike
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body


def age_days(ts: str) -> str:
    return f"(({AS_OF_US} - epoch_us({ts}))::DOUBLE / 86400000000)"


def decay(ts: str, days: float = 7.0) -> str:
    return f"exp(ln(0.5::DOUBLE) / {days} * {age_days(ts)})"


def half_up(x: str, digits: int) -> str:
    """Decimal half-up, the twin of scores.half_up."""
    return f"CAST(round(CAST({x} AS DECIMAL(18,9)), {digits}) AS DOUBLE)"


def ts_text(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


SIG = "CASE significance WHEN 'breaking' THEN 0 WHEN 'major' THEN 1 WHEN 'minor' THEN 2 ELSE 3 END"
EVENT_TS = "coalesce(published_at, created_at)"
