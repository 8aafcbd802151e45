"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom import vocab
from feedloom.functions import labels as lb
from feedloom.functions import profile as pf
from feedloom.functions import render as rd
from feedloom.functions import scores as sc
from feedloom.functions import text as tx
from feedloom.functions import urls as ux
from feedloom.functions import vectors as vx
from feedloom.operators.joins import with_source
from workload.adapter import Tables, as_of
from workload.oracle import EVENT_TS, SIG, age_days, decay, half_up, sql
from workload.registry import query

c = F.col
NOISE = vocab.NOISE_PATTERN.replace("'", "''")


def text_case(expr: str, mapping: dict, default: str) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items()) + f" ELSE {default} END"


@query(
    "url_functions", "F01 F02 F04 F05",
    """WITH n AS (SELECT page_id, url, regexp_replace(regexp_replace(split_part(url,'#',1), '/+$', ''),
       'smithery\\.ai/servers/', 'smithery.ai/server/') AS normalized FROM pages)
       SELECT page_id, normalized, sha256(normalized) AS url_hash, split_part(url,'#',1) AS base_fragment,
       regexp_extract(url, '^[^?#]*') AS base_path FROM n""",
)
def _(t: Tables):
    u = c("url")
    return t.raw("pages").select(
        "page_id", ux.normalize_url(u).alias("normalized"), ux.url_hash(u).alias("url_hash"),
        ux.base_url_fragment(u).alias("base_fragment"), ux.base_url_path(u).alias("base_path"),
    )


REPO_FORMS = {
    0: "https://github.com/own{k}/repo-{k}", 1: "https://github.com/own{k}/repo-{k}.git",
    2: "http://github.com/own{k}/repo-{k}/tree/main", 3: "https://gitlab.com/own{k}/repo-{k}",
    4: "https://github.com/own{k}/topics", 5: "https://github.com/own{k}",
}


def repo_url_expr() -> str:
    """The same CASE text serves both engines."""
    whens = " ".join(
        f"WHEN {n} THEN concat('" + form.replace("{k}", "', c_custkey, '") + "')" for n, form in REPO_FORMS.items()
    )
    return f"CASE c_custkey % 6 {whens} END"


@query(
    "repo_url_parts", "F06 F07",
    f"""WITH u AS (SELECT c_custkey, {repo_url_expr()} AS url FROM customer),
    p AS (SELECT *, nullif(regexp_extract(url, '^https?://github\\.com/([^/]+)/([^/]+?)(?:\\.git)?(?:/.*)?$', 1), '') AS owner,
      nullif(regexp_extract(url, '^https?://github\\.com/([^/]+)/([^/]+?)(?:\\.git)?(?:/.*)?$', 2), '') AS repo,
      string_split(regexp_extract(url, '^[a-z]+://[^/]*github\\.com/(.*)', 1), '/') AS parts FROM u)
    SELECT c_custkey, owner, repo, CASE WHEN len(parts) >= 2 AND parts[2] NOT IN ('topics','explore','settings','marketplace')
      THEN parts[1] || '/' || parts[2] END AS strict_slug FROM p""",
)
def _(t: Tables):
    u = t.raw("customer").select("c_custkey", F.expr(repo_url_expr()).alias("url"))
    return u.select(
        "c_custkey", ux.repo_owner(c("url")).alias("owner"), ux.repo_name(c("url")).alias("repo"),
        ux.repo_slug_strict(c("url")).alias("strict_slug"),
    )


@query(
    "text_fingerprints", "F03 F32 F38",
    """SELECT doc_id, sha256(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', '', 'g')) AS fingerprint,
    substr(sha256(trim(text)), 1, 16) AS short_hash,
    md5(source || chr(10) || chr(10) || substr(text, 1, 4000)) AS embed_md5 FROM documents""",
)
def _(t: Tables):
    return t.raw("documents").select(
        "doc_id", tx.content_fingerprint(c("text")).alias("fingerprint"), tx.short_hash(c("text")).alias("short_hash"),
        F.md5(tx.embed_input(c("source"), c("text"))).alias("embed_md5"),
    )


UNSAFE_SQL = "list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(text, '{p}') THEN '{label}' END" for p, label in vocab.UNSAFE_PATTERNS
) + "], lambda x: x IS NOT NULL)"


@query(
    "text_screens", "F08 F09",
    f"""SELECT doc_id, regexp_matches(source || ' ' || substr(text, 1, 500), '{NOISE}') AS noise,
    array_to_string({UNSAFE_SQL}, '; ') AS findings,
    round(greatest(0, 1 - len({UNSAFE_SQL}) * 0.2::DOUBLE), 3) AS security FROM documents""",
)
def _(t: Tables):
    found = tx.unsafe_findings(c("text"))
    return t.raw("documents").select(
        "doc_id", tx.is_noise(c("source"), c("text")).alias("noise"), F.array_join(found, "; ").alias("findings"),
        F.round(sc.security_score(found), 3).alias("security"),
    )


@query(
    "page_plain_text", "S24",
    r"""WITH f AS (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS flat FROM pages)
    SELECT page_id, CASE WHEN length(flat) > 50 THEN substr(flat, 1, 5000) END AS plain FROM f""",
)
def _(t: Tables):
    return t.raw("pages").select("page_id", tx.strip_html(c("html")).alias("plain"))


SIGNALS = """named_struct('stars', (c_custkey * 37) % 5000, 'forks', c_custkey % 300, 'open_issues', c_custkey % 9,
 'subscribers_count', c_custkey % 50,
 'pushed_at', CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE timestamp_micros(unix_micros(timestamp'2024-01-31 00:00:00') - (c_custkey % 400) * 86400000000) END,
 'archived', c_custkey % 17 = 0, 'has_license', c_custkey % 3 <> 0)"""

REPO_SQL = f"""WITH s AS (SELECT c_custkey, (c_custkey * 37) % 5000 AS stars, c_custkey % 300 AS forks, c_custkey % 50 AS subs,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey % 400 END AS age, c_custkey % 17 = 0 AS archived, c_custkey % 3 <> 0 AS lic,
  CASE WHEN c_custkey % 4 = 0 THEN 'eval(x); os.system(y)' ELSE c_name END AS content FROM customer),
q AS (SELECT c_custkey,
  {half_up('CASE WHEN archived THEN 0 WHEN age IS NULL THEN 0.5 ELSE greatest(0, least(1, 1 - age::DOUBLE / 365)) END', 3)} AS maintenance,
  CASE WHEN c_custkey % 4 = 0 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS security,
  round(CASE WHEN archived THEN greatest(0, CASE WHEN lic THEN 1 ELSE 0.5 END::DOUBLE - 0.2) ELSE CASE WHEN lic THEN 1 ELSE 0.5 END END::DOUBLE, 3) AS compatibility,
  CASE WHEN stars = 0 AND forks = 0 THEN 0::DOUBLE ELSE {half_up('least(1, least(1, log10(greatest(1, stars)) / 5) + least(0.1, log10(greatest(1, forks)) / 50) + least(0.05, log10(greatest(1, subs)) / 100))', 3)} END AS community,
  coalesce(age > 180, false) AS is_stale FROM s)
SELECT *, {half_up('greatest(0, least(1, maintenance * 0.25::DOUBLE + community * 0.30::DOUBLE + security * 0.25::DOUBLE + compatibility * 0.20::DOUBLE))', 3)} AS quality FROM q"""


@query("repo_quality", "F10 F11 F12 F13", REPO_SQL)
def _(t: Tables):
    s = t.raw("customer").select(
        "c_custkey", F.expr(SIGNALS).alias("signals"),
        F.expr("CASE WHEN c_custkey % 4 = 0 THEN 'eval(x); os.system(y)' ELSE c_name END").alias("content"),
    )
    s = s.select("c_custkey", sc.quality_subscores(c("signals"), c("content"), as_of()).alias("sub"))
    return s.select(
        "c_custkey", "sub.maintenance", "sub.security", "sub.compatibility", "sub.community", "sub.is_stale",
        sc.aggregate_quality(c("sub")).alias("quality"),
    )


TITLE_PEN = f"""CASE WHEN title IS NULL OR trim(title) IN ('', 'Untitled') THEN -0.25::DOUBLE
 WHEN regexp_matches(trim(title), '^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$') THEN -0.25::DOUBLE
 WHEN regexp_matches(title, '{vocab.DEMO_TITLE_PATTERN}') THEN -0.15::DOUBLE ELSE 0::DOUBLE END"""
GOOD_SUMMARY = f"coalesce(length(trim(summary)) >= 20 AND NOT regexp_matches(summary, '{vocab.BAD_SUMMARY_PATTERN}'), false)"
SUBSTANCE = """CASE WHEN content IS NULL THEN -0.20::DOUBLE WHEN length(content) < 100 THEN -0.15::DOUBLE
 WHEN length(content) < 500 THEN 0.05::DOUBLE WHEN length(content) < 2000 THEN 0.15::DOUBLE ELSE 0.20::DOUBLE END"""
HEURISTIC = half_up(f"""greatest(0.05::DOUBLE, least(1::DOUBLE, CASE tier WHEN 'tier1' THEN 0.40::DOUBLE WHEN 'tier2' THEN 0.25::DOUBLE
 WHEN 'tier3' THEN 0.10::DOUBLE ELSE 0.15::DOUBLE END + {SUBSTANCE} + CASE WHEN {GOOD_SUMMARY} THEN 0.15::DOUBLE ELSE 0::DOUBLE END
 + CASE WHEN len(tags) > 0 THEN 0.10::DOUBLE ELSE 0::DOUBLE END + CASE WHEN title IS NULL THEN 0::DOUBLE ELSE {TITLE_PEN} END
 + CASE WHEN {GOOD_SUMMARY} THEN 0::DOUBLE ELSE -0.15::DOUBLE END))""", 3)


@query(
    "heuristic_quality", "F14 F15 F16 F17",
    sql("items sources", f"""SELECT i.id, {TITLE_PEN} AS title_penalty, CASE WHEN {GOOD_SUMMARY} THEN 0::DOUBLE ELSE -0.15::DOUBLE END AS summary_penalty,
      {SUBSTANCE} AS substance, {HEURISTIC} AS quality
      FROM items i LEFT JOIN (SELECT id AS sid, tier FROM sources) s ON s.sid = i.source_id"""),
)
def _(t: Tables):
    j = with_source(t.items(), t.sources(), "tier2", ("tier",))
    h = sc.heuristic_quality(c("source_tier"), c("content"), c("summary"), c("tags"), c("title"))
    return j.select("id", h.alias("h")).select(
        "id", "h.title_penalty", "h.summary_penalty", c("h.content_substance").alias("substance"),
        c("h.final_score").alias("quality"),
    )


FRESH = f"""CASE WHEN published_at IS NULL THEN 0.5::DOUBLE ELSE exp(-greatest(floor({age_days('published_at')}), 0) / 30) END"""
AUTH = "CASE tier WHEN 'tier1' THEN 1::DOUBLE WHEN 'tier2' THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END"


@query(
    "item_scores", "F18 F19 F20 F21 F24 F28 J01",
    sql("items sources", f"""SELECT i.id, {AUTH} AS authority, round({FRESH}, 6) AS freshness,
      round(greatest(0, least(1, quality_score * 0.65::DOUBLE + {AUTH} * 0.15::DOUBLE + {FRESH} * 0.20::DOUBLE)), 6) AS relevance,
      round({decay(EVENT_TS)}, 6) AS decay, {SIG} AS significance_rank,
      CASE significance WHEN 'breaking' THEN '{vocab.IMPACT_LABELS['breaking']}' WHEN 'major' THEN '{vocab.IMPACT_LABELS['major']}'
        WHEN 'minor' THEN '{vocab.IMPACT_LABELS['minor']}' ELSE 'Informational update' END AS impact
      FROM items i LEFT JOIN (SELECT id AS sid, tier FROM sources) s ON s.sid = i.source_id"""),
)
def _(t: Tables):
    j = with_source(t.items(), t.sources(), "tier3", ("tier",))
    tier, pub = c("source_tier"), c("published_at")
    return j.select(
        "id", sc.authority(tier).alias("authority"), F.round(sc.freshness(pub, as_of()), 6).alias("freshness"),
        F.round(sc.relevance(c("quality_score"), tier, pub, as_of()), 6).alias("relevance"),
        F.round(sc.half_life_decay(sc.event_ts(), as_of()), 6).alias("decay"),
        sc.significance_rank(c("significance")).alias("significance_rank"),
        sc.impact_label(c("significance")).alias("impact"),
    )


@query(
    "label_functions", "F26 F27 F31 F40 F57",
    sql("items", f"""SELECT id, CASE WHEN n >= 10 AND m >= 3 THEN 'high' WHEN n >= 5 OR m >= 2 THEN 'medium' ELSE 'low' END AS confidence,
      CASE WHEN m = 0 THEN 'emerging' WHEN n::DOUBLE / m > 1.5 THEN 'accelerating' WHEN n::DOUBLE / m < 0.67 THEN 'declining' ELSE 'plateauing' END AS velocity,
      CASE WHEN brk THEN 'critical' WHEN primary_type = 'update' AND confidence_score >= 0.8 THEN 'important' ELSE 'interesting' END AS urgency,
      CASE WHEN list_has_any(tags, ['mcp','mcp-server','mcp-client','model-context-protocol','claude-code','claude-skills','claude-hooks','claude-workflow','claude-code-hooks','claude-code-skills'])
        OR contains(lower(url), 'mcp') THEN 0 WHEN list_has_any(tags, ['agent','agentic','multi-agent']) THEN 2 ELSE 10 END AS star_cutoff,
      CASE WHEN quality_score >= 0.8 THEN 'established' WHEN quality_score >= 0.5 THEN 'emerging' ELSE 'new/unverified' END AS quality_label,
      CASE WHEN k >= 1000 THEN regexp_replace(printf('%.1f', {half_up('k::DOUBLE / 1000', 1)}), '\\.0$', '') || 'k' WHEN k > 0 THEN CAST(k AS VARCHAR) END AS star_text
      FROM (SELECT *, CAST(external_id AS BIGINT) % 15 AS n, CAST(external_id AS BIGINT) % 6 AS m,
        primary_type = 'update' AND significance = 'breaking' AS brk, CAST(external_id AS BIGINT) * 7 AS k FROM items)"""),
)
def _(t: Tables):
    i = t.items().withColumn("d", c("external_id").cast("long"))
    n, m = c("d") % 15, c("d") % 6
    return i.select(
        "id", sc.confidence_label(n, m).alias("confidence"),
        sc.velocity_label(F.when(m != 0, n / m)).alias("velocity"),
        sc.urgency(c("primary_type"), (c("primary_type") == "update") & (c("significance") == "breaking"),
                   c("confidence_score")).alias("urgency"),
        sc.star_cutoff(c("tags"), c("url")).alias("star_cutoff"), sc.quality_label(c("quality_score")).alias("quality_label"),
        sc.star_text(c("d") * 7).alias("star_text"),
    )


BREAK_SQL = " OR ".join(f"contains(low, '{k}')" for k in vocab.BREAKING_KEYWORDS)


@query(
    "alert_text_matches", "F29 F30",
    sql("items", f"""SELECT id, {BREAK_SQL} AS breaking, contains(low, 'the') OR contains(low, 'docker') AS any_keyword,
      CASE WHEN contains(low, 'docker') THEN 'Docker' WHEN contains(low, 'the') THEN 'THE' END AS first_keyword
      FROM (SELECT id, lower(title || ' ' || content || ' ' || array_to_string(tags, ' ')) AS low FROM items)"""),
)
def _(t: Tables):
    hay = tx.alert_text(c("title"), c("content"), c("tags"))
    first = tx.matching_keyword(F.array(F.lit("Docker"), F.lit("THE")), hay)
    return t.items().select(
        "id", tx.is_breaking_text(c("title"), c("content"), c("tags")).alias("breaking"),
        first.isNotNull().alias("any_keyword"), first.alias("first_keyword"),
    )


RAW_TYPES = "'Tutorial','release','SDK','tool','nonsense','practice','Workflow'"
RAW_LABEL = f"get(array({RAW_TYPES}), cast(doc_id % 7 AS int))"


def label_payload(t: Tables):
    """Classifier answers derived from the documents: fenced, trailing text, broken and plain ones."""
    body = F.to_json(
        F.struct(
            F.expr(RAW_LABEL).alias("primary_type"), F.array(c("lang"), F.lit("x")).alias("tags"),
            ((c("doc_id") % 10) / 10.0).alias("confidence"),
            F.expr("CASE WHEN doc_id % 6 = 0 THEN ' ' ELSE substr(source, 1, 40) END").alias("summary"),
            F.expr("CASE WHEN doc_id % 4 = 0 THEN 'breaking-change' ELSE 'minor' END").alias("significance"),
        )
    )
    raw = (
        F.when(c("doc_id") % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(c("doc_id") % 5 == 1, F.concat(body, F.lit(" and that is all")))
        .when(c("doc_id") % 5 == 2, F.lit("cannot say"))
        .otherwise(body)
    )
    return t.raw("documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), raw.alias("raw_text"))


TYPE_SQL = text_case("lower(pt)", {**{k: f"'{v}'" for k, v in vocab.TYPE_FALLBACK.items()}}, "'docs'")


@query(
    "classifier_answers", "F33 F34",
    f"""WITH p AS (SELECT doc_id, doc_id % 5 = 2 AS bad, [{RAW_TYPES}][doc_id % 7 + 1] AS raw_type, lang,
      (doc_id % 10)::DOUBLE / 10 AS conf, CASE WHEN doc_id % 6 = 0 THEN ' ' ELSE substr(source, 1, 40) END AS summary,
      CASE WHEN doc_id % 4 = 0 THEN 'breaking-change' ELSE 'minor' END AS sig FROM documents),
    q AS (SELECT *, CASE WHEN bad THEN 'unknown' ELSE raw_type END AS pt FROM p)
    SELECT 'd' || doc_id AS id, CASE WHEN pt IN ('skill','tool','update','practice','docs') THEN pt ELSE {TYPE_SQL} END AS primary_type,
      CASE WHEN bad THEN '' ELSE lang || ',x' END AS tags, CASE WHEN bad THEN 0 ELSE conf END AS confidence,
      CASE WHEN bad OR trim(summary) = '' THEN '{vocab.BLANK_SUMMARY}' ELSE summary END AS summary,
      CASE WHEN bad THEN 'informational' WHEN sig = 'breaking-change' THEN 'breaking' ELSE sig END AS significance FROM q""",
)
def _(t: Tables):
    p = label_payload(t).select("id", lb.parse_label_json(c("raw_text")).alias("l"))
    return p.select(
        "id", lb.normalize_type(c("l.primary_type")).alias("primary_type"), F.array_join("l.tags", ",").alias("tags"),
        "l.confidence", lb.normalize_summary(c("l.summary")).alias("summary"),
        lb.normalize_significance(c("l.significance")).alias("significance"),
    )


ACRO = text_case("lower(w)", {k: f"'{v}'" for k, v in vocab.ACRONYMS.items()}, "upper(substr(w,1,1)) || lower(substr(w,2))")


@query(
    "slugs_and_titles", "F35 F36",
    f"""WITH s AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(raw), '[/\\\\]', '-', 'g'),
       '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug
       FROM (SELECT p_partkey, p_brand || '/' || p_name || ' (ai-mcp) ' || p_type AS raw FROM part))
    SELECT p_partkey, slug, array_to_string(list_transform(string_split(replace(slug, '/', ' -- '), '-'), lambda w: {ACRO}), ' ') AS title FROM s""",
)
def _(t: Tables):
    s = t.raw("part").select(
        "p_partkey", tx.slugify(F.concat("p_brand", F.lit("/"), "p_name", F.lit(" (ai-mcp) "), "p_type")).alias("slug")
    )
    return s.select("p_partkey", "slug", tx.smart_title(c("slug")).alias("title"))


@query(
    "iso_weeks", "F39",
    "SELECT strftime(o_orderdate, '%G-W%V') AS week, count(*) AS n FROM orders GROUP BY 1",
)
def _(t: Tables):
    return t.raw("orders").groupBy(tx.iso_week(c("o_orderdate")).alias("week")).agg(F.count(F.lit(1)).alias("n"))


SUFFIX = "' latest','',' mcp server',' migrate to 2',' compare a vs b',' how to',' status','  50%_off'"
LOW = "(lower(q))"
WORDS = r"regexp_split_to_array(lower(q), '\s+')"


def route_sql() -> str:
    parts = []
    for name, whole, phrases in tx.QUERY_ROUTES:
        tests = [f"list_has_any({WORDS}, {whole})"] if whole else []
        tests += ["contains(lower(q), '" + p.replace("'", "''") + "')" for p in phrases]
        parts.append(f"WHEN {' OR '.join(tests)} THEN '{name}'")
    return "CASE " + " ".join(parts) + " ELSE 'search' END"


@query(
    "query_understanding", "F41 F42 F43 F44",
    sql("query_logs", f"""SELECT id, array_to_string(terms, ',') AS terms, CASE WHEN len(terms) > 0 THEN array_to_string(terms, ' | ') ELSE q END AS or_form,
      replace(replace(replace(q, '\\', '\\\\'), '%', '\\%'), '_', '\\_') AS escaped,
      CASE WHEN regexp_matches(q, '{vocab.INTENT_TYPE_PATTERN}') THEN 'tool' END AS intent_type,
      CASE WHEN regexp_matches(q, '{vocab.INTENT_BREAKING_PATTERN}') THEN 'breaking' END AS intent_significance, {route_sql()} AS route
      FROM (SELECT id, q, regexp_extract_all(lower(q), '[a-zA-Z0-9]+') AS terms FROM
        (SELECT id, query_text || [{SUFFIX}][id % 8 + 1] AS q FROM query_logs))"""),
)
def _(t: Tables):
    q = t.query_logs().select("id", F.expr(f"concat(query_text, get(array({SUFFIX}), cast(id % 8 AS int)))").alias("q"))
    return q.select(
        "id", F.array_join(tx.query_terms_col(c("q")), ",").alias("terms"), tx.or_form(c("q")).alias("or_form"),
        tx.escape_like(c("q")).alias("escaped"), tx.intent_type(c("q")).alias("intent_type"),
        tx.intent_significance(c("q")).alias("intent_significance"), tx.query_route(c("q")).alias("route"),
    )


GROUP_LIST = "CASE t " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in vocab.TAG_GROUPS.items()) + " ELSE [t] END"


@query(
    "profile_interests", "F45 F46",
    sql("profile_tags profiles", f"""SELECT p.user_id, array_to_string(p.tags, ',') AS interest,
      array_to_string({GROUP_LIST}, ',') AS group_tags FROM profile_tags p
      JOIN (SELECT user_id, tech_stack[1] AS t FROM profiles) f USING (user_id)"""),
)
def _(t: Tables):
    return t.profiles().select(
        "user_id", F.array_join(pf.profile_tags(c("profile")), ",").alias("interest"),
        F.array_join(pf.group_tags(c("profile.tech_stack")[0]), ",").alias("group_tags"),
    )


@query(
    "vector_to_label_mean", "F47",
    sql("watchlists", """SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), concept_embedding), 6) AS similarity,
     round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), concept_embedding), 6) AS distance
     FROM embeddings e JOIN watchlists w ON w.id = 'w' || e.label"""),
)
def _(t: Tables):
    e = t.raw("embeddings").withColumn("id", F.concat(F.lit("w"), "label"))
    j = e.join(t.watchlists().select("id", "concept_embedding"), "id")
    return j.select(
        "vec_id", F.round(vx.cosine_similarity(c("embedding"), c("concept_embedding")), 6).alias("similarity"),
        F.round(vx.cosine_distance(c("embedding"), c("concept_embedding")), 6).alias("distance"),
    )


@query(
    "masked_emails", "F48",
    sql("users", "SELECT id, CASE WHEN length(email) > 3 THEN substr(email, 1, 3) || '***' ELSE '***' END AS masked FROM users"),
)
def _(t: Tables):
    return t.users().select("id", tx.mask_email(c("email")).alias("masked"))


@query("unicode_nfc", "F49", "SELECT conv_id, turn, md5(nfc_normalize(text)) AS nfc_md5 FROM conversations")
def _(t: Tables):
    return t.raw("conversations").select("conv_id", "turn", F.md5(tx.nfc_col(c("text"))).alias("nfc_md5"))


@query(
    "call_costs", "F50 F51",
    sql("spend", """SELECT call_id, round(cost, 8) AS cost, CASE WHEN c0 = 0 AND cost > 0 THEN 1 ELSE c0 END AS cents FROM
     (SELECT *, CAST(round_even(cost * 100, 0) AS BIGINT) AS c0 FROM (SELECT call_id,
       (in_tokens * CASE model WHEN 'haiku' THEN 1.00::DOUBLE ELSE 0.15::DOUBLE END * 10
        + out_tokens * CASE model WHEN 'haiku' THEN 5.00::DOUBLE ELSE 0.60::DOUBLE END * 10) / 1000000 AS cost FROM spend))"""),
)
def _(t: Tables):
    from feedloom.plans.spend import price_table, priced

    s = priced(t.spend(), price_table(t.spark))
    cost = sc.token_cost(c("in_tokens") * 10, c("out_tokens") * 10, c("in_price"), c("out_price"))
    return s.select("call_id", F.round(cost, 8).alias("cost"), sc.to_cents(cost).alias("cents"))


@query(
    "json_fields", "F52",
    "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
)
def _(t: Tables):
    return t.raw("events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query(
    "clean_items", "F53 L05",
    sql("items", f"""SELECT id, url, title, CASE WHEN coalesce(summary, '') = '' THEN excerpt END AS excerpt,
      {half_up('quality_score', 2)} AS quality_score, {half_up('relevance_score', 2)} AS relevance_score,
      strftime(created_at, '%Y-%m-%d') AS created_at, strftime(published_at, '%Y-%m-%d') AS published_at,
      CAST(external_id AS BIGINT) AS github_stars FROM (SELECT * FROM items WHERE external_id <> '0')
      UNION ALL SELECT id, url, title, CASE WHEN coalesce(summary, '') = '' THEN excerpt END,
      {half_up('quality_score', 2)}, {half_up('relevance_score', 2)}, strftime(created_at, '%Y-%m-%d'), strftime(published_at, '%Y-%m-%d'), NULL
      FROM items WHERE external_id = '0'"""),
)
def _(t: Tables):
    d = t.items().withColumn(
        "quality_score_details", F.concat(F.lit('{"signals": {"stars": '), "external_id", F.lit("}}"))
    )
    return rd.project_fields(
        rd.clean_item(d),
        ["url", "title", "excerpt", "quality_score", "relevance_score", "created_at", "published_at", "github_stars"],
    )


ITEM_TEXT_SQL = """'## ' || title || chr(10) || coalesce(nullif(summary, ''), nullif(excerpt, ''), '') || chr(10) || 'URL: ' || url || chr(10)
 || 'Type: ' || primary_type || ' | Sig: ' || significance || ' | Score: ' || printf('%.2f', """ + half_up("relevance_score", 2) + """) || chr(10)
 || 'Tags: ' || array_to_string(tags, ', ') || chr(10) || chr(10)"""


@query(
    "rendered_items", "F54 F56",
    sql("items", f"""SELECT id, md5({ITEM_TEXT_SQL}) AS plain_md5, md5('## [' || title || '](' || url || ')' || chr(10) || chr(10) || '**' || significance
      || '** · ' || primary_type || ' · ' || source_name || chr(10) || chr(10) || coalesce(nullif(summary, ''), nullif(excerpt, ''), '')
      || chr(10) || chr(10) || '*Tags: ' || array_to_string(tags, ', ') || '* · *' || strftime({EVENT_TS}, '%Y-%m-%d') || '*') AS markdown_md5,
      chr(27) || '[1m' || title || chr(27) || '[0m' || chr(10) || chr(27) || '[2m' || url || chr(27) || '[0m' || chr(10)
      || coalesce(nullif(summary, ''), nullif(excerpt, ''), '') || chr(10) || chr(27) || '[2m'
      || array_to_string(list_transform(tags, lambda x: '[' || x || ']'), ' ') || chr(27) || '[0m' AS terminal FROM items"""),
)
def _(t: Tables):
    return t.items().select(
        "id", F.md5(rd.item_text()).alias("plain_md5"), F.md5(rd.render_markdown()).alias("markdown_md5"),
        rd.render_terminal().alias("terminal"),
    )


@query(
    "rendered_library", "F37 F55",
    sql("library", """SELECT id, '## Library: ' || title || chr(10) || CASE WHEN tldr IS NOT NULL THEN tldr || chr(10) ELSE '' END
      || 'Key points:' || chr(10) || '- ' || key_points[1] || chr(10) || '- ' || key_points[2] || chr(10)
      || CASE WHEN gotchas IS NOT NULL THEN 'Gotchas:' || chr(10) || '- ' || gotchas[1].title || ': ' || gotchas[1].detail || chr(10) ELSE '' END
      || chr(10) AS block, sha256(body || '["' || key_points[1] || '","' || key_points[2] || '"]') AS content_hash FROM library"""),
)
def _(t: Tables):
    # the block ends in one blank line: the last bullet's newline and an empty line
    return t.library().select(
        "id", rd.library_text().alias("block"), tx.library_content_hash(c("body"), c("key_points")).alias("content_hash")
    )


@query(
    "chat_blocks", "F56",
    sql("items", """SELECT id, CAST(json_extract_string(doc, '$.blocks[0].text.text') AS VARCHAR) AS section,
      json_extract_string(doc, '$.blocks[1].elements[0].text') AS context FROM (SELECT id, json_object('blocks', json_array(
        json_object('text', json_object('text', '*<' || url || '|' || t1 || '>*' || chr(10) || b1)),
        json_object('elements', json_array(json_object('text', significance || ' · ' || primary_type || ' · ' || source_name))))) AS doc
      FROM (SELECT *, replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t1,
        replace(replace(replace(coalesce(nullif(summary, ''), nullif(excerpt, ''), title), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS b1 FROM items))"""),
)
def _(t: Tables):
    d = t.items().select("id", rd.render_chat_blocks().alias("doc"))
    return d.select(
        "id", F.get_json_object("doc", "$.blocks[0].text.text").alias("section"),
        F.get_json_object("doc", "$.blocks[1].elements[0].text").alias("context"),
    )
