"""State jobs, de-duplication, briefings and the knowledge library."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from feedloom.functions import scores as sc
from feedloom.functions import text as tx
from feedloom.operators import filters as fl
from feedloom.operators import joins as jn
from feedloom.operators import skew as sk
from feedloom.plans import briefing as br
from feedloom.plans import dedup as dd
from feedloom.plans import overlap as ov
from feedloom.plans import graduation as gr
from feedloom.plans import library as li
from feedloom.plans import source_jobs as sj
from feedloom.plans import stages as st
from feedloom.session import ensure_checkpoint_dir
from feedloom.sources.snapshots import KeyedTable
from workload.adapter import Tables, as_of
from workload.oracle import AS_OF, AS_OF_US, EVENT_TS, SIG, age_days, decay, half_up, sql, ts_text
from workload.q_functions import AUTH, FRESH, HEURISTIC, NOISE, RAW_TYPES, SIGNALS, TYPE_SQL, label_payload
from workload.q_insight import ts
from workload.q_search import TOKENS, query_vector
from workload.registry import query

c = F.col
NEW = f"created_at >= {AS_OF} - INTERVAL 3 DAY"
FP = "sha256(regexp_replace(lower(content), '[^\\p{L}\\p{N}_]+', '', 'g'))"
UH = "regexp_replace(split_part(url, '#', 1), '/+$', '')"

# ---- de-duplication ----------------------------------------------------------------------


def split_batch(t: Tables, vectors: bool):
    i = t.items(vectors=vectors)
    new = fl.recent(as_of(), 3, c("created_at"))
    return i.where(new), i.where(~new)


LAYERS = f"""b AS (SELECT *, {UH} AS uh, {FP} AS fp FROM {{src}} WHERE {NEW}), k AS (SELECT *, {UH} AS uh, {FP} AS fp FROM {{src}} WHERE NOT {NEW}),
l1 AS (SELECT *, CASE WHEN uh IN (SELECT uh FROM k) OR row_number() OVER (PARTITION BY uh ORDER BY published_at NULLS FIRST, id) > 1 THEN 'url_hash' END AS r1 FROM b),
l2 AS (SELECT *, CASE WHEN r1 IS NULL AND (fp IN (SELECT fp FROM k) OR row_number() OVER (PARTITION BY r1 IS NULL, fp ORDER BY published_at NULLS FIRST, id) > 1)
  THEN 'content_fingerprint' END AS r2 FROM l1)"""


@query(
    "dedup_by_url_and_text", "J09 J10 B01 T02",
    sql("items", "SELECT id, coalesce(r1, r2) AS reason FROM l2", LAYERS.replace("{src}", "items")),
)
def _(t: Tables):
    batch, known = split_batch(t, False)
    return dd.dedup_items(batch, known, as_of=as_of(), vectors=False).select("id", "reason")


@query(
    "dedup_three_layers", "B01 J08 J09 J10",
    sql("vitems", f"""SELECT id, coalesce(r1, r2, CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.created_at >= {AS_OF} - INTERVAL 60 DAY
      AND round(1 - list_cosine_similarity(l2.embedding, k.embedding), 6) + 0 < 0.6) THEN 'embedding_similarity' END) AS reason FROM l2""", LAYERS.replace("{src}", "vitems")),
)
def _(t: Tables):
    batch, known = split_batch(t, True)
    return dd.dedup_items(batch, known, as_of=as_of(), threshold=0.6, days=60, inside_batch=False).select("id", "reason")


STORED = f"""o AS (SELECT *, row_number() OVER (ORDER BY published_at NULLS FIRST, id) AS n FROM l2 WHERE r1 IS NULL AND r2 IS NULL AND NOT EXISTS (SELECT 1 FROM k
    WHERE k.created_at >= {AS_OF} - INTERVAL 60 DAY AND round(1 - list_cosine_similarity(l2.embedding, k.embedding), 6) + 0 < 0.6)),
e AS (SELECT a.n, a.id, (SELECT coalesce(list(z.id), []) FROM o z WHERE z.n < a.n AND z.created_at >= {AS_OF} - INTERVAL 60 DAY
    AND round(1 - list_cosine_similarity(a.embedding, z.embedding), 6) + 0 < 0.6) AS near FROM o a)"""


def first_load(t: Tables):
    return t.items(vectors=True).where(fl.recent(as_of(), 14, c("created_at"))).withColumn("url", F.concat(F.lit("https://first.org/"), "id")).withColumn("content", c("id"))


CHAIN = f"""b AS (SELECT * FROM vitems WHERE created_at >= {AS_OF} - INTERVAL 14 DAY), o AS (SELECT *, row_number() OVER (ORDER BY published_at NULLS FIRST, id) AS n FROM b WHERE embedding IS NOT NULL),
e AS (SELECT a.n, a.id, (SELECT coalesce(list(z.id), []) FROM o z WHERE z.n < a.n AND round(1 - list_cosine_similarity(a.embedding, z.embedding), 6) + 0 < 0.55) AS near FROM o a)"""


@query(
    "dedup_inside_batch", "B01 J08",
    sql("vitems", f"""SELECT id, coalesce(r1, r2, CASE WHEN id NOT IN (SELECT unnest(stored) FROM (
      WITH RECURSIVE s AS (SELECT 0 AS n, []::VARCHAR[] AS stored UNION ALL SELECT e.n, CASE WHEN list_has_any(s.stored, e.near) THEN s.stored ELSE list_append(s.stored, e.id) END
        FROM s JOIN e ON e.n = s.n + 1) SELECT stored FROM s ORDER BY n DESC LIMIT 1)) THEN 'embedding_similarity' END) AS reason FROM l2""", LAYERS.replace("{src}", "vitems") + ",\n" + STORED),
)
def _(t: Tables):
    batch, known = split_batch(t, True)
    return dd.dedup_items(batch, known, as_of=as_of(), threshold=0.6, days=60).select("id", "reason")


@query(
    "dedup_inside_batch_chain", "B01 J08",
    sql("vitems", f"""SELECT id, CASE WHEN id NOT IN (SELECT unnest(stored) FROM (
      WITH RECURSIVE s AS (SELECT 0 AS n, []::VARCHAR[] AS stored UNION ALL SELECT e.n, CASE WHEN list_has_any(s.stored, e.near) THEN s.stored ELSE list_append(s.stored, e.id) END
        FROM s JOIN e ON e.n = s.n + 1) SELECT stored FROM s ORDER BY n DESC LIMIT 1)) THEN 'embedding_similarity' END AS reason FROM b""", CHAIN),
)
def _(t: Tables):
    """A first load: nothing is known, and each text and url is its own, so only near copies inside the batch are refused."""
    batch = first_load(t)
    return dd.dedup_items(batch, batch.where(F.lit(False)), as_of=as_of(), threshold=0.55, days=60).select("id", "reason")


@query(
    "fingerprint_groups", "J10 F03",
    """SELECT fp, count(*) AS copies, min(doc_id) AS first_doc FROM (SELECT doc_id, sha256(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', '', 'g')) AS fp FROM documents)
    GROUP BY fp HAVING count(*) > 1""",
)
def _(t: Tables):
    d = t.raw("documents").select("doc_id", tx.content_fingerprint(c("text")).alias("fp"))
    return d.groupBy("fp").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query(
    "page_url_dedup", "J09",
    """SELECT page_id FROM (SELECT page_id, regexp_replace(split_part(url, '#', 1), '/+$', '') AS u FROM pages)
    QUALIFY row_number() OVER (PARTITION BY u ORDER BY page_id) = 1""",
)
def _(t: Tables):
    p = t.raw("pages").select(F.lpad(c("page_id").cast("string"), 12, "0").alias("id"), "page_id", "url", F.lit(None).cast("timestamp").alias("published_at"))
    none = p.where(F.lit(False))
    return jn.unseen_by_url(p, none).select("page_id")


GRAMS = """b AS MATERIALIZED (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS t FROM benchmark),
d AS MATERIALIZED (SELECT min(doc_id) AS doc_id, regexp_extract_all(lower(coalesce(any_value(text), '')), '[\\p{L}\\p{N}]+') AS t FROM documents GROUP BY sha256(text)),
bg AS MATERIALIZED (SELECT item_id, i, array_to_string(list_slice(t, i + 1, i + 8), ' ') AS g FROM (SELECT item_id, t, unnest(range(len(t) - 7)) AS i FROM b WHERE len(t) >= 8)),
dg AS MATERIALIZED (SELECT doc_id, j, g FROM (SELECT doc_id, j, array_to_string(list_slice(t, j + 1, j + 8), ' ') AS g FROM (SELECT doc_id, t, unnest(range(len(t) - 7)) AS j FROM d WHERE len(t) >= 8)) WHERE g IN (SELECT g FROM bg))"""


@query(
    "eval_passage_overlap", "J23",
    f"""WITH {GRAMS}, h AS (SELECT item_id, i, least(8, coalesce(i - lag(i) OVER (PARTITION BY item_id ORDER BY i), 8)) AS new FROM bg WHERE g IN (SELECT g FROM dg))
    SELECT b.item_id, len(b.t) AS words, greatest(len(b.t) - 7, 0) AS grams, count(h.i) AS hits, coalesce(sum(new), 0)::BIGINT AS covered,
      CASE WHEN len(b.t) > 0 THEN round(coalesce(sum(new), 0)::DOUBLE / len(b.t), 6) ELSE 0 END AS coverage FROM b LEFT JOIN h ON h.item_id = b.item_id GROUP BY b.item_id, b.t""",
)
def _(t: Tables):
    return ov.passage_coverage(t.raw("benchmark"), t.raw("documents"))


@query(
    "eval_passage_runs", "J23",
    f"""WITH {GRAMS}, p AS (SELECT DISTINCT item_id, doc_id, i, j FROM bg JOIN dg USING (g)),
    r AS (SELECT *, i - row_number() OVER (PARTITION BY item_id, doc_id, j - i ORDER BY i) AS s FROM p)
    SELECT item_id, doc_id, min(i) AS item_from, min(j) AS doc_from, count(*) + 7 AS words FROM r GROUP BY item_id, doc_id, j - i, s HAVING count(*) + 7 >= 12""",
)
def _(t: Tables):
    return ov.passage_runs(t.raw("benchmark"), t.raw("documents"), least=12)


@query(
    "eval_overlap", "J23",
    sql("items", f"SELECT id FROM items WHERE external_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels) AND {UH} IN (SELECT {UH} FROM items WHERE external_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels))"),
)
def _(t: Tables):
    i = t.items().select("id", "external_id", "url")
    lab = t.raw("labels").select(c("doc_id").cast("string").alias("external_id"))
    return jn.url_overlap(i.join(lab, "external_id", "left_semi"), i.join(lab, "external_id", "left_anti")).select("id")


# ---- stages ------------------------------------------------------------------------------

NOISY = f"(regexp_matches(title || ' ' || substr(content, 1, 500), '{NOISE}') OR (trim(title) = '' AND trim(content) = ''))"


@query("noise_stage", "B02 F08", sql("landed", f"SELECT id, CASE WHEN {NOISY} THEN 'filtered' ELSE 'raw' END AS status FROM landed"))
def _(t: Tables):
    return st.noise_stage(t.landed()).select("id", "status")


def embedded(t: Tables):
    i = t.items(vectors=True)
    return st.embed_stage(st.noise_stage(t.landed()), vectors=i.select("id", "embedding"), model="table-64")


@query(
    "embed_stage", "B03 P15",
    sql("landed", f"SELECT id, CASE WHEN {NOISY} THEN 'filtered' ELSE 'embedded' END AS status, CASE WHEN NOT {NOISY} THEN 'table-64' END AS model FROM landed"),
)
def _(t: Tables):
    return embedded(t).select("id", "status", c("embedding_model_version").alias("model"))


GATE_CTE = """near AS (SELECT i.id, r.is_positive, 1 - (round(1 - list_cosine_similarity(i.embedding, r.embedding), 6) + 0) AS sim
    FROM vlanded i CROSS JOIN reference_items r QUALIFY row_number() OVER (PARTITION BY i.id ORDER BY round(1 - list_cosine_similarity(i.embedding, r.embedding), 6) + 0, r.id) <= 20),
  g AS (SELECT id, """ + half_up("greatest(0, least(1, coalesce(max(sim) FILTER (is_positive), 0) - 0.5 * coalesce(max(sim) FILTER (NOT is_positive), 0)))", 6) + """ AS gate FROM near GROUP BY id)"""


@query("gate_scores", "J03 W12", sql("vlanded reference_items", "SELECT id, gate FROM g", GATE_CTE))
def _(t: Tables):
    s = st.gate_scores(t.items(vectors=True).select("id", "embedding"), t.reference_items())
    return s.select("id", sc.half_up(c("gate_score"), 6).alias("gate"))


@query("gate_scores_by_join", "J03 W12", sql("vlanded reference_items", "SELECT id, gate FROM g", GATE_CTE))
def _(t: Tables):
    s = st.gate_scores(t.items(vectors=True).select("id", "embedding"), t.reference_items(), max_shipped=10)
    return s.select("id", sc.half_up(c("gate_score"), 6).alias("gate"))


@query(
    "gate_stage", "B04 F20 J01 J03 W12",
    sql("vlanded reference_items sources", f"""SELECT i.id, CASE WHEN {NOISY} THEN 'filtered' WHEN gate >= coalesce(TRY_CAST(json_extract_string(s.config, '$.relevance_threshold') AS DOUBLE), 0.25) THEN 'queued' ELSE 'filtered' END AS status,
      CASE WHEN NOT {NOISY} THEN {half_up("greatest(0, least(1, gate * 0.65::DOUBLE + " + AUTH + " * 0.15::DOUBLE + " + FRESH.replace('published_at', 'created_at') + " * 0.20::DOUBLE))", 6)} END AS relevance_score
      FROM vlanded i JOIN g ON g.id = i.id LEFT JOIN (SELECT id AS sid, tier, config FROM sources) s ON s.sid = i.source_id""", GATE_CTE),
)
def _(t: Tables):
    return st.gate_stage(embedded(t), t.sources(), t.reference_items(), as_of=as_of(), threshold=0.25).select("id", "status", "relevance_score")


def answers(t: Tables):
    """Every eleventh document got no answer."""
    d = t.raw("documents").where("doc_id % 11 <> 0").select(F.concat(F.lit("d"), "doc_id").alias("id"))
    return label_payload(t).join(d, "id", "left_semi")


LABELLED = f"""lab AS (SELECT *, 'd' || doc_id AS lid, doc_id % 5 = 2 AS bad, [{RAW_TYPES}][doc_id % 7 + 1] AS raw_type FROM documents WHERE doc_id % 11 <> 0),
lab2 AS (SELECT lid, CASE WHEN bad THEN '' ELSE lang || ',x' END AS ltags, CASE WHEN bad THEN 'unknown' ELSE raw_type END AS pt, CASE WHEN bad THEN 0 ELSE (doc_id % 10)::DOUBLE / 10 END AS conf,
  CASE WHEN bad OR doc_id % 6 = 0 THEN '[Summary unavailable — classification returned empty summary]' ELSE substr(source, 1, 40) END AS lsummary,
  CASE WHEN bad THEN 'informational' WHEN doc_id % 4 = 0 THEN 'breaking' ELSE 'minor' END AS lsig FROM lab)"""


@query(
    "apply_labels", "B05 F33",
    sql("items", f"""SELECT id, CASE WHEN lid IS NULL THEN primary_type WHEN pt IN ('skill','tool','update','practice','docs') THEN pt ELSE {TYPE_SQL} END AS primary_type,
      CASE WHEN lid IS NULL THEN array_to_string(tags, ',') ELSE ltags END AS tags, CASE WHEN lid IS NULL THEN confidence_score ELSE conf END AS confidence_score,
      CASE WHEN lid IS NULL THEN summary ELSE lsummary END AS summary, CASE WHEN lid IS NULL THEN significance ELSE lsig END AS significance,
      CASE WHEN lid IS NULL THEN 'failed' ELSE 'processed' END AS status FROM items LEFT JOIN lab2 ON lid = id""", LABELLED),
)
def _(t: Tables):
    out = st.apply_labels(t.items().withColumn("status", F.lit("processing")), answers(t))
    return out.select("id", "primary_type", F.array_join("tags", ",").alias("tags"), "confidence_score", "summary", "significance", "status")


@query(
    "apply_labels_twice", "B05 F33",
    sql("items", f"""SELECT id, CASE WHEN lid IS NULL THEN primary_type WHEN pt IN ('skill','tool','update','practice','docs') THEN pt ELSE {TYPE_SQL} END AS primary_type,
      CASE WHEN lid IS NULL THEN 'failed' ELSE 'processed' END AS status FROM items LEFT JOIN lab2 ON lid = id""", LABELLED),
)
def _(t: Tables):
    """An older, unusable answer to every item beside the newer one, and the newer one twice."""
    new = answers(t).withColumn("answered_at", as_of())
    old = new.withColumns({"raw_text": F.lit("{}"), "answered_at": F.lit("2020-01-01").cast("timestamp")})
    out = st.apply_labels(t.items().withColumn("status", F.lit("processing")), new.unionByName(old).unionByName(new))
    return out.select("id", "primary_type", "status")


REPO_URL = "CASE doc_id % 3 WHEN 0 THEN concat('https://github.com/own/repo', doc_id) WHEN 1 THEN 'https://github.com/own' ELSE url END"


def repo_items(t: Tables):
    i = t.items().withColumn("doc_id", c("external_id").cast("long"))
    return i.withColumn("url", F.expr(REPO_URL)).drop("doc_id")


def repo_signals(t: Tables):
    return t.raw("customer").select(F.concat(F.lit("own/repo"), "c_custkey").alias("repo"), F.expr(SIGNALS).alias("signals"))


@query(
    "quality_stage", "B06 F13 F17",
    sql("items sources", f"""SELECT i.id, CASE WHEN status <> 'processed' THEN quality_score WHEN n % 3 = 1 THEN 0.5 WHEN c_custkey IS NOT NULL THEN repo_quality ELSE {HEURISTIC} END AS quality_score
      FROM (SELECT *, CAST(external_id AS BIGINT) AS n FROM items) i LEFT JOIN (SELECT id AS sid, tier FROM sources) s ON s.sid = i.source_id
      LEFT JOIN rq ON i.n % 3 = 0 AND rq.c_custkey = i.n AND sec_of(i.content) IS NOT NULL""".replace(" AND sec_of(i.content) IS NOT NULL", ""),
        f"""rs AS (SELECT c_custkey, (c_custkey * 37) % 5000 AS stars, c_custkey % 300 AS forks, c_custkey % 50 AS subs,
          CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey % 400 END AS age, c_custkey % 17 = 0 AS archived, c_custkey % 3 <> 0 AS lic FROM customer),
        sec AS (SELECT CAST(external_id AS BIGINT) AS n, greatest(0, 1 - 0.2::DOUBLE * (CAST(regexp_matches(content, '\\beval\\s*\\(') AS INT) + CAST(regexp_matches(content, '\\bexec\\s*\\(') AS INT)
          + CAST(regexp_matches(content, 'os\\.system\\s*\\(') AS INT) + CAST(regexp_matches(content, 'subprocess\\.call\\(.*shell\\s*=\\s*True') AS INT)
          + CAST(regexp_matches(content, '(?:/home/|/Users/|~/.ssh/|~/.aws/)') AS INT) + CAST(regexp_matches(content, 'AKIA[A-Z0-9]{{16}}') AS INT)
          + CAST(regexp_matches(content, 'sk-[A-Za-z0-9]{{17,}}') AS INT) + CAST(regexp_matches(content, 'ghp_[A-Za-z0-9]{{36,}}') AS INT) + CAST(regexp_matches(content, 'gho_[A-Za-z0-9]{{36,}}') AS INT))) AS security FROM items),
        rq AS (SELECT c_custkey, {half_up("greatest(0, least(1, maintenance * 0.25::DOUBLE + community * 0.30::DOUBLE + " + half_up('security', 3) + " * 0.25::DOUBLE + compatibility * 0.20::DOUBLE))", 3)} AS repo_quality FROM
          (SELECT c_custkey, {half_up('CASE WHEN archived THEN 0 WHEN age IS NULL THEN 0.5 ELSE greatest(0, least(1, 1 - age::DOUBLE / 365)) END', 3)} AS maintenance, security,
            round(CASE WHEN archived THEN greatest(0, CASE WHEN lic THEN 1 ELSE 0.5 END::DOUBLE - 0.2) ELSE CASE WHEN lic THEN 1 ELSE 0.5 END END::DOUBLE, 3) AS compatibility,
            CASE WHEN stars = 0 AND forks = 0 THEN 0::DOUBLE ELSE {half_up('least(1, least(1, log10(greatest(1, stars)) / 5) + least(0.1, log10(greatest(1, forks)) / 50) + least(0.05, log10(greatest(1, subs)) / 100))', 3)} END AS community
           FROM rs JOIN sec ON sec.n = rs.c_custkey))"""),
)
def _(t: Tables):
    return st.quality_stage(repo_items(t), t.sources(), repo_signals(t), as_of=as_of()).select("id", "quality_score")


@query(
    "stalest_first", "L04 F52",
    sql("items", f"""SELECT id, strftime(tracked, '%Y-%m-%d %H:%M:%S') AS last_tracked_at FROM (SELECT id, status, CAST(external_id AS BIGINT) AS n,
      CASE WHEN CAST(external_id AS BIGINT) % 4 = 0 THEN TIMESTAMP '1970-01-01' ELSE updated_at END AS tracked FROM items) WHERE status = 'processed' AND n % 3 < 2 ORDER BY tracked, id LIMIT 100"""),
)
def _(t: Tables):
    i = repo_items(t).withColumn(
        "quality_score_details",
        F.when(c("external_id").cast("long") % 4 == 0, F.lit("{}")).otherwise(
            F.concat(F.lit('{"last_tracked_at":"'), F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"}'))
        ),
    )
    return st.stalest_first(i, limit=100).select("id", ts("last_tracked_at"))


@query(
    "refresh_quality", "B07 L04",
    sql("items", f"""SELECT id, {half_up("greatest(0, least(1, maintenance * 0.25::DOUBLE + community * 0.30::DOUBLE + 0.25::DOUBLE + compatibility * 0.20::DOUBLE))", 3)} AS quality_score, stars FROM
      (SELECT d.id, stars, {half_up('CASE WHEN archived THEN 0 WHEN age IS NULL THEN 0.5 ELSE greatest(0, least(1, 1 - age::DOUBLE / 365)) END', 3)} AS maintenance,
         round(CASE WHEN archived THEN greatest(0, CASE WHEN lic THEN 1 ELSE 0.5 END::DOUBLE - 0.2) ELSE CASE WHEN lic THEN 1 ELSE 0.5 END END::DOUBLE, 3) AS compatibility,
         CASE WHEN stars = 0 AND forks = 0 THEN 0::DOUBLE ELSE {half_up('least(1, least(1, log10(greatest(1, stars)) / 5) + least(0.1, log10(greatest(1, forks)) / 50) + least(0.05, log10(greatest(1, subs)) / 100))', 3)} END AS community
       FROM (SELECT id, CAST(external_id AS BIGINT) AS n FROM items WHERE status = 'processed' AND CAST(external_id AS BIGINT) % 3 < 2) d
       JOIN (SELECT c_custkey, (c_custkey * 37) % 5000 AS stars, c_custkey % 300 AS forks, c_custkey % 50 AS subs, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey % 400 END AS age,
         c_custkey % 17 = 0 AS archived, c_custkey % 3 <> 0 AS lic FROM customer) r ON d.n % 3 = 0 AND r.c_custkey = d.n)"""),
)
def _(t: Tables):
    i = repo_items(t).withColumn("quality_score_details", F.lit("{}"))
    out = st.refresh_quality(i, repo_signals(t), as_of=as_of())
    return out.select("id", "quality_score", F.get_json_object("quality_score_details", "$.stars").cast("long").alias("stars"))


@query(
    "stuck_recovery", "B08 P15",
    sql("items", f"""SELECT id, CASE WHEN status = 'queued' AND updated_at >= {AS_OF} - INTERVAL 10 MINUTE THEN 'processing' ELSE status END AS status FROM items"""),
)
def _(t: Tables):
    return st.stuck_recovery(fl.transition(t.items(), "queued", "processing"), as_of=as_of()).select("id", "status")


@query(
    "allowed_transitions", "P15",
    sql("items", """SELECT status, list_contains(CASE status WHEN 'raw' THEN ['embedded','failed'] WHEN 'queued' THEN ['processing'] WHEN 'failed' THEN ['raw'] ELSE [] END, 'embedded') AS to_embedded,
      list_contains(CASE status WHEN 'raw' THEN ['embedded','failed'] WHEN 'queued' THEN ['processing'] WHEN 'failed' THEN ['raw'] ELSE [] END, 'raw') AS to_raw, count(*) AS n FROM items GROUP BY 1, 2, 3"""),
)
def _(t: Tables):
    i = t.items().select("status", fl.transition_allowed(c("status"), F.lit("embedded")).alias("to_embedded"), fl.transition_allowed(c("status"), F.lit("raw")).alias("to_raw"))
    return i.groupBy("status", "to_embedded", "to_raw").agg(F.count(F.lit(1)).alias("n"))


@query(
    "clear_filtered_vectors", "B16",
    sql("vitems", f"SELECT id, embedding IS NOT NULL AND NOT (status = 'filtered' AND updated_at < {AS_OF} - INTERVAL 24 HOUR) AS has_vector FROM vitems"),
)
def _(t: Tables):
    return st.clear_filtered_vectors(t.items(vectors=True), as_of=as_of()).select("id", c("embedding").isNotNull().alias("has_vector"))


@query(
    "clearable_vectors", "B16",
    sql("vitems", f"SELECT count(*) AS vectors, {half_up('sum(len(embedding)) * 4 / 1048576', 2)} AS megabytes FROM vitems WHERE status = 'filtered' AND updated_at < {AS_OF} - INTERVAL 24 HOUR"),
)
def _(t: Tables):
    return st.clearable_estimate(t.items(vectors=True), as_of=as_of())


def readmes(t: Tables):
    return t.raw("customer").select(
        F.concat(F.lit("own/repo"), "c_custkey").alias("repo"), F.concat(F.lit("# "), "c_name", F.lit("\n"), "c_mktsegment").alias("readme"),
        (c("c_custkey") * 7 % 120).alias("stars"), F.when(c("c_custkey") % 2 == 0, c("c_mktsegment")).alias("description"),
    )


README_SQL = "('# ' || c_name || chr(10) || c_mktsegment)"


@query(
    "readme_backfill", "B17 F07 F38 F40",
    sql("items", f"""SELECT id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || chr(10) || chr(10) ELSE '' END || {README_SQL} AS content, substr(sha256({README_SQL}), 1, 16) AS content_hash, stars FROM
      (SELECT *, CAST(external_id AS BIGINT) AS n FROM items WHERE status = 'processed' AND CAST(external_id AS BIGINT) % 3 < 2 AND length(content) < 1000) i
      JOIN (SELECT *, c_custkey * 7 % 120 AS stars FROM customer) r ON i.n % 3 = 0 AND r.c_custkey = i.n
      WHERE stars >= CASE WHEN list_has_any(tags, ['mcp','claude-code']) THEN 0 ELSE 10 END"""),
)
def _(t: Tables):
    return st.readme_backfill(repo_items(t), readmes(t), short=1000).select("id", "content", "content_hash", "stars")


@query(
    "readme_refresh", "B18 F38",
    sql("items", f"""SELECT id, substr(sha256({README_SQL}), 1, 16) AS content_hash FROM
      (SELECT *, CAST(external_id AS BIGINT) AS n FROM items WHERE status = 'processed' AND CAST(external_id AS BIGINT) % 3 < 2 AND length(content) >= 200
        AND CAST(external_id AS BIGINT) % 90 >= 50) i JOIN customer r ON i.n % 3 = 0 AND r.c_custkey = i.n WHERE n % 4 <> 0"""),
)
def _(t: Tables):
    d = repo_items(t).withColumn("quality_score_details", F.concat(F.lit('{"stars": '), (c("external_id").cast("long") % 90).cast("string"), F.lit("}")))
    known = readmes(t).select(F.substring_index("repo", "repo", -1).alias("external_id"), tx.short_hash(c("readme")).alias("_h"))
    d = d.join(known, "external_id", "left").withColumn("content_hash", F.when(c("external_id").cast("long") % 4 == 0, c("_h")).otherwise(F.lit("old"))).drop("_h")
    return st.readme_refresh(d, readmes(t)).select("id", "content_hash")


@query(
    "rising_repos", "B19",
    sql("repo_snapshots", """SELECT repo, old_stars, new_stars FROM (SELECT repo, min(stars) AS old_stars, max(stars) AS new_stars FROM repo_snapshots GROUP BY repo)
      WHERE new_stars >= 3 * old_stars AND new_stars >= 50"""),
)
def _(t: Tables):
    s = t.repo_snapshots()
    return st.rising_repos(s.groupBy("repo").agg(F.min("stars").alias("stars")), s.groupBy("repo").agg(F.max("stars").alias("stars"))).select("repo", "old_stars", "new_stars")


# ---- sources -----------------------------------------------------------------------------

POLLS = "SELECT user_id AS source_id, ts, event_id AS poll_id, event_type NOT IN ('error','view') AS ok, 1 + event_id % 3 AS attempt FROM events"


@query(
    "source_errors", "B14",
    f"""WITH p AS ({POLLS}), s AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY source_id ORDER BY ts, poll_id) AS streak FROM p),
    g AS (SELECT source_id, streak, count(*) FILTER (NOT ok AND attempt = 1) AS errors, max(ts) AS lf, max(ts) FILTER (ok) AS ls FROM s GROUP BY 1, 2)
    SELECT source_id, arg_max(errors, streak) AS consecutive_errors, max(errors) < 3 AS is_active, {ts_text('max(lf)')} AS last_fetched_at, {ts_text('max(ls)')} AS last_successful_poll FROM g GROUP BY 1""",
)
def _(t: Tables):
    polls = t.raw("events").selectExpr(
        "user_id AS source_id", "ts", "event_id AS poll_id", "event_type NOT IN ('error','view') AS ok", "1 + event_id % 3 AS attempt"
    )
    return sj.source_errors(polls, max_errors=3).select("source_id", "consecutive_errors", "is_active", ts("last_fetched_at"), ts("last_successful_poll"))


@query(
    "source_recovery", "B15",
    sql("sources", f"""SELECT id, is_active OR again AS is_active, CASE WHEN again THEN 0 ELSE consecutive_errors END AS consecutive_errors, recovery_attempts + CAST(again AS INT) AS recovery_attempts,
      NOT is_active AND recovery_attempts >= 3 AS dead_for_good FROM (SELECT *, NOT is_active AND last_fetched_at < {AS_OF} - INTERVAL 36 HOUR AND recovery_attempts < 3 AS again FROM sources)"""),
)
def _(t: Tables):
    return sj.source_recovery(t.sources(), as_of=as_of(), hours=36).select("id", "is_active", "consecutive_errors", "recovery_attempts", "dead_for_good")


@query(
    "source_thresholds", "B20",
    sql("sources", """SELECT id, CASE WHEN type IN ('rss','npm') THEN 0.5 ELSE TRY_CAST(json_extract_string(config, '$.relevance_threshold') AS DOUBLE) END AS threshold,
      is_active OR (last_successful_poll IS NULL AND consecutive_errors < 3) AS is_active FROM sources"""),
)
def _(t: Tables):
    out = sj.source_thresholds(t.sources(), types=["rss", "npm"])
    return out.select("id", F.get_json_object("config", "$.relevance_threshold").cast("double").alias("threshold"), "is_active")


@query(
    "new_tracking_sources", "J21",
    sql("repo_snapshots sources", """SELECT 'github-deep:' || repo AS id, max(stars) AS promoted_at_stars FROM repo_snapshots WHERE stars > 50
      AND repo NOT IN (SELECT 'owner' || (c_custkey % 7) || '/repo' || c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY repo"""),
)
def _(t: Tables):
    tracked = t.raw("customer").where("c_acctbal < 0").selectExpr("concat('github-deep:owner', c_custkey % 7, '/repo', c_custkey) AS id")
    return jn.new_sources(t.repo_snapshots().select("repo", "stars"), tracked).select("id", "promoted_at_stars")


# ---- library -----------------------------------------------------------------------------

GRAD = f"""cand AS (SELECT *, round((u * 3 + b * 2 - d * 2)::DOUBLE * CASE tier WHEN 'tier1' THEN 1.5::DOUBLE WHEN 'tier3' THEN 0.7::DOUBLE ELSE 1::DOUBLE END
    * CASE primary_type WHEN 'practice' THEN 1.4::DOUBLE WHEN 'docs' THEN 1.3::DOUBLE WHEN 'update' THEN 0.6::DOUBLE ELSE 1.1::DOUBLE END, 6) AS score,
    tier = 'tier1' AND primary_type IN ('practice','docs') AND relevance_score >= 0.85 AS fast,
    relevance_score >= 0.70 AND quality_score >= 0.60 AND floor({age_days('created_at')}) >= 14 AND primary_type IN ('practice','docs','tool') AS steady
  FROM (SELECT i.*, s.tier, coalesce(upvotes, 0) AS u, coalesce(bookmarks, 0) AS b, coalesce(dismissals, 0) AS d FROM items i
    JOIN (SELECT id AS sid, tier FROM sources) s ON s.sid = i.source_id LEFT JOIN signal_counts g ON g.item_id = i.id
    WHERE status = 'processed' AND created_at <= {AS_OF} - INTERVAL 7 DAY)),
qual AS (SELECT * FROM cand WHERE score >= 15 OR fast OR steady)"""


@query("graduation_candidates", "A13 F25 W10", sql("items sources signal_counts", "SELECT id, score AS graduation_score, fast AS fast_track FROM qual", GRAD))
def _(t: Tables):
    return gr.graduation_candidates(t.items(), t.sources(), t.signals(), as_of=as_of()).select("id", "graduation_score", "fast_track")


@query(
    "graduate", "B10 J22 F35",
    sql("items sources signal_counts library", """SELECT id AS item_id, CASE WHEN row_number() OVER (PARTITION BY s ORDER BY id) > 1 THEN s || '-' || id ELSE s END AS slug,
      CASE WHEN fast THEN 'source_type' ELSE 'signal' END AS method, coalesce(nullif(summary, ''), title) AS body FROM
      (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(tags[1] || '-' || substr(title, 1, 40)), '[/\\\\]', '-', 'g'), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS s
       FROM qual WHERE id NOT IN (SELECT unnest(source_item_ids) FROM library WHERE is_current))""", GRAD),
)
def _(t: Tables):
    out = gr.graduate(t.items(), t.sources(), t.signals(), t.library(), as_of=as_of())
    return out.select(c("source_item_ids")[0].alias("item_id"), "slug", c("graduation_method").alias("method"), "body")


@query(
    "promote_candidates", "B10",
    sql("library", f"""SELECT id, CASE WHEN status = 'candidate' AND is_current AND graduation_score >= 8 AND graduated_at <= {AS_OF} - INTERVAL 3 DAY THEN 'active' ELSE status END AS status FROM library"""),
)
def _(t: Tables):
    return gr.promote_candidates(t.library(), as_of=as_of()).select("id", "status")


@query(
    "stale_entries", "B11 J16",
    sql("library signals", f"""SELECT id, CASE WHEN flag THEN 'review_needed' WHEN status = 'review_needed' AND is_current AND updated_at <= {AS_OF} - INTERVAL 30 DAY THEN 'archived' ELSE status END AS status,
      {ts_text('confirmed')} AS last_confirmed_at FROM (SELECT *, status = 'active' AND is_current AND coalesce(confirmed, graduated_at) <= {AS_OF} - INTERVAL 180 DAY AS flag FROM
       (SELECT l.*, CASE WHEN h.hid IS NOT NULL THEN {AS_OF} ELSE last_confirmed_at END AS confirmed FROM library l LEFT JOIN
        (SELECT DISTINCT l.id AS hid FROM (SELECT id, unnest(source_item_ids) AS item_id, coalesce(last_confirmed_at, graduated_at, created_at) AS since FROM library WHERE status = 'active' AND is_current) l
         JOIN signals s ON s.item_id = l.item_id AND s.action IN ('upvote','bookmark') AND s.created_at > l.since) h ON h.hid = l.id))"""),
)
def _(t: Tables):
    return gr.stale_entries(t.library(), t.signals(), as_of=as_of()).select("id", "status", ts("last_confirmed_at"))


@query(
    "topics_to_synthesise", "B12 A26",
    sql("items", """SELECT topic, item_count, source_count, array_to_string(list(id ORDER BY rn), ',') AS ids, md5(string_agg('[' || rn || '] ' || title || ': ' || coalesce(summary, '(no summary)'), chr(10) ORDER BY rn)) AS prompt_md5
      FROM best JOIN topics USING (topic) GROUP BY 1, 2, 3""",
        """topics AS (SELECT tag AS topic, count(*) AS item_count, count(DISTINCT source_id) AS source_count FROM (SELECT source_id, unnest(tags) AS tag FROM items WHERE status = 'processed')
          GROUP BY tag ORDER BY item_count DESC, tag LIMIT 6),
        best AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY mean DESC, id) AS rn FROM (SELECT id, title, summary, round(relevance_score * 0.5 + quality_score * 0.5, 6) AS mean,
          unnest(list_distinct(tags || [primary_type])) AS topic FROM items WHERE status = 'processed') QUALIFY rn <= 10)"""),
)
def _(t: Tables):
    out = gr.topics_to_synthesise(t.items(), t.library(), n_topics=6)
    return out.select("topic", "item_count", "source_count", F.array_join("source_item_ids", ",").alias("ids"), F.md5("prompt").alias("prompt_md5"))


@query(
    "load_synthesis", "B13 W11",
    sql("items", """SELECT topic AS slug, 1 AS version, '{T}' || topic AS body FROM (SELECT tag AS topic, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM items WHERE status = 'processed')
      GROUP BY tag ORDER BY n DESC, tag LIMIT 6) WHERE topic <> 'en'""".replace("{T}", "All about ")),
)
def _(t: Tables):
    req = gr.topics_to_synthesise(t.items(), t.library(), n_topics=6)
    body = F.when(c("topic") == "en", F.lit("")).otherwise(F.concat(F.lit("All about "), "topic"))
    ans = req.select("slug", F.concat(F.lit("```json\n"), F.to_json(F.struct(body.alias("body"), F.array(F.lit("k")).alias("key_points"))), F.lit("\n```")).alias("raw_text"))
    out = gr.load_synthesis(t.library(), req, ans, as_of=as_of())
    return out.where(c("id").startswith("syn-")).select("slug", "version", "body")


@query(
    "library_merge", "S27 W11",
    """WITH v AS (SELECT 'e' || user_id AS slug, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events)
    SELECT slug, event_id, version, back = 1 AS is_current FROM v WHERE version % 5 <> 0 OR back = 1""",
)
def _(t: Tables):
    """The versions of all entries as a stored table: a first load of the older half, a merge of the newer half with the
    older rows it changes, and a merge that takes every fifth version away unless it is current."""
    log = t.raw("events").select(F.concat(F.lit("e"), "user_id").alias("slug"), "event_id", "ts")
    mid = log.agg(F.expr("timestamp_micros(cast((min(unix_micros(ts)) + max(unix_micros(ts))) / 2 AS long))").alias("m")).first()["m"]
    table = KeyedTable(t.spark, f"{ensure_checkpoint_dir(t.spark)}/library-{uuid.uuid4().hex}", ("slug", "event_id"), buckets=8)
    cols = ["slug", "event_id", "version", "is_current"]
    old = gr.number_versions(log.where(c("ts") < F.lit(mid)), order=["ts", "event_id"]).select(*cols)
    table.merge(old, 0)
    new = gr.number_versions(log, order=["ts", "event_id"]).select(*cols)
    table.merge(new.join(table.read(old.schema), cols, "left_anti"), 1)
    table.merge(table.read(old.schema).where("version % 5 = 0 AND NOT is_current").withColumn("gone", F.lit(True)), 2, deleted="gone")
    return table.read(old.schema)


@query(
    "library_versions", "W11",
    """SELECT 'e' || user_id AS slug, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS is_current FROM events""",
)
def _(t: Tables):
    log = t.raw("events").select(F.concat(F.lit("e"), "user_id").alias("slug"), "event_id", "ts")
    return gr.number_versions(log, order=["ts", "event_id"]).select("slug", "event_id", "version", "is_current")


LIB_SCORE = " + ".join(
    f"CASE WHEN contains(lower(coalesce({f}, '')), '{w}') THEN {n} ELSE 0 END" for w in ("steel", "docker")
    for f, n in (("topic_path", 10), ("title", 5), ("array_to_string(tags, ', ')", 4), ("tldr", 3), ("body", 1))
)
LIB_HIT = " OR ".join(
    f"contains(lower(coalesce({f}, '')), '{w}')" for w in ("steel", "docker") for f in ("topic_path", "title", "array_to_string(tags, ', ')", "tldr")
)


@query(
    "library_search", "Q15 P14 P16",
    sql("library", f"SELECT slug, ({LIB_SCORE})::DOUBLE AS match_score FROM library WHERE status = 'active' AND is_current AND starts_with(topic_path, 's') AND ({LIB_HIT}) ORDER BY match_score DESC, slug LIMIT 5"),
)
def _(t: Tables):
    return li.library_search(t.library(), q="Steel docker!", topic="s").select("slug", "match_score")


VEC0 = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"


@query(
    "library_search_hybrid", "Q15 U03 F49",
    sql("library", f"""SELECT slug, match_score, row_number() OVER (ORDER BY branch, match_score DESC, slug) AS pos FROM (SELECT * FROM
      (SELECT slug, round(list_cosine_similarity(embedding, {VEC0}), 4) AS match_score, 0 AS branch FROM library WHERE status = 'active' AND is_current ORDER BY match_score DESC, slug LIMIT 12)
      UNION ALL (SELECT slug, ({LIB_SCORE})::DOUBLE AS match_score, 1 FROM library WHERE status = 'active' AND is_current AND ({LIB_HIT}) ORDER BY match_score DESC, slug LIMIT 12))
      QUALIFY row_number() OVER (PARTITION BY slug ORDER BY branch) = 1 ORDER BY pos LIMIT 12"""),
)
def _(t: Tables):
    return li.library_search(t.library(vectors=True), q="Steel docker!", query_vec=query_vector(t), limit=12).select("slug", "match_score", "pos")


@query(
    "library_recommend", "Q16 F45",
    sql("library", """SELECT slug, len(list_filter(tags, lambda x: list_contains(['docker','deployment','monitoring','ci-cd','sql'], x))) AS overlap FROM library WHERE status = 'active' AND is_current
      ORDER BY overlap DESC, graduation_score DESC, helpful_count DESC, slug LIMIT 5"""),
)
def _(t: Tables):
    return li.library_recommend(t.library(), profile={"tech_stack": ["sql"], "skills": ["devops"]}).select("slug", "overlap")


@query(
    "library_topic", "Q17 F23 P04 P05 A10",
    sql("items signal_counts", f"""SELECT id, round((quality_score * 0.35::DOUBLE + relevance_score * 0.35::DOUBLE + confidence_score * 0.10::DOUBLE + CASE significance WHEN 'breaking' THEN 0.20::DOUBLE WHEN 'major' THEN 0.15::DOUBLE WHEN 'minor' THEN 0.05::DOUBLE ELSE 0 END)
      * (1 + least(coalesce(upvotes, 0) + coalesce(bookmarks, 0), 10) * 0.05::DOUBLE) * exp(-0.693::DOUBLE * {age_days('created_at')} / 90), 6) AS evergreen_score FROM items i LEFT JOIN signal_counts g ON g.item_id = i.id
      WHERE status = 'processed' AND list_has_any(tags, ['docker','deployment','monitoring','ci-cd','infra']) ORDER BY evergreen_score DESC, id LIMIT 20"""),
)
def _(t: Tables):
    return li.library_topic(t.items(), t.signals(), topic="devops", as_of=as_of()).select("id", "evergreen_score")


@query(
    "library_entry_related", "Q18 J04",
    sql("library", """SELECT slug, round(list_cosine_similarity(embedding, (SELECT embedding FROM library WHERE slug = 'entry-7' AND is_current)), 6) AS relevance FROM library
      WHERE is_current AND slug <> 'entry-7' AND round(list_cosine_similarity(embedding, (SELECT embedding FROM library WHERE slug = 'entry-7' AND is_current)), 6) >= 0.3 ORDER BY relevance DESC, slug LIMIT 3"""),
)
def _(t: Tables):
    return li.entry_related(t.library(vectors=True), slug="entry-7", min_similarity=0.3).select("slug", "relevance")


@query(
    "library_entry_sources", "Q18 J20",
    sql("library items", """SELECT l.slug, l.pos - 1 AS position, i.id, i.url FROM (SELECT slug, unnest(source_item_ids) AS iid, generate_subscripts(source_item_ids, 1) AS pos FROM library WHERE is_current) l
      JOIN items i ON i.id = l.iid"""),
)
def _(t: Tables):
    return li.entry_sources(t.library(), t.items(), id_pattern="^d[0-9]+$").select("slug", "position", "id", "url")


@query("item_lookup", "Q19 P01", sql("items", "SELECT id, title, url FROM items WHERE status = 'processed' AND id = 'd29'"))
def _(t: Tables):
    return li.item_lookup(t.items(), item_id="d29").select("id", "title", "url")


# ---- briefing ----------------------------------------------------------------------------

ITEM_TEXT = """('## ' || title || chr(10) || coalesce(nullif(summary, ''), nullif(excerpt, ''), '') || chr(10) || 'URL: ' || url || chr(10) || 'Type: ' || primary_type || ' | Sig: '
 || significance || ' | Score: ' || printf('%.2f', """ + half_up("relevance_score", 2) + """) || chr(10) || 'Tags: ' || array_to_string(tags, ', ') || chr(10) || chr(10))"""
ADMIT = f"""status = 'processed' AND {EVENT_TS} >= {AS_OF} - INTERVAL 14 DAY AND relevance_score >= 0.5 AND (coalesce(quality_score, 0) >= 0.55 OR {EVENT_TS} >= {AS_OF} - INTERVAL 7 DAY
  OR significance IN ('breaking','major')) AND NOT contains(coalesce(summary, ''), 'unavailable')"""
BRANK = f"round(coalesce(relevance_score, 0.5) * {decay(EVENT_TS)} * (0.5 + 0.5 * coalesce(quality_score, 0.5)), 6)"


def briefing_sql(where: str, budget_chars: int, src: str = "items", order: str = f"{SIG}, rank DESC, id") -> str:
    return f"""fetched AS (SELECT *, row_number() OVER (ORDER BY {order}) AS pos FROM (SELECT *, {BRANK} AS rank FROM {src} WHERE {ADMIT} AND {where} ORDER BY {order} LIMIT 200)),
    win AS (SELECT * FROM fetched QUALIFY row_number() OVER (PARTITION BY coalesce('c:' || cluster_id, 'i:' || id) ORDER BY relevance_score DESC, pos) = 1),
    best AS (SELECT *, min(pos) OVER (PARTITION BY regexp_extract(url, '^[^?#]*')) AS p2 FROM win QUALIFY row_number() OVER (PARTITION BY regexp_extract(url, '^[^?#]*') ORDER BY relevance_score DESC, pos) = 1),
    run AS (SELECT * REPLACE (p2 AS pos), sum(length({ITEM_TEXT})) OVER (ORDER BY p2) AS running, row_number() OVER (ORDER BY p2) AS rn, {ITEM_TEXT} AS block FROM best),
    packed AS (SELECT * FROM run WHERE running <= {budget_chars} OR rn = 1)"""


@query(
    "briefing", "Q14 P13 F54 W07 W08",
    sql("items", "SELECT id, pos, CAST(running AS BIGINT) AS running_chars FROM packed", briefing_sql("true", 8000)),
)
def _(t: Tables):
    return br.briefing_items(t.items(), as_of=as_of()).select("id", "pos", "running_chars")


@query(
    "briefing_by_group", "Q14 F46 W08",
    sql("items", "SELECT id, pos FROM packed", briefing_sql("list_has_any(tags, ['mcp','mcp-server','model-context-protocol','tools','plugin'])", 2000, order="rank DESC, id")),
)
def _(t: Tables):
    return br.briefing_items(t.items(), as_of=as_of(), topic="mcp", budget=500, sort="score").select("id", "pos")


@query(
    "briefing_by_vector", "Q14 P08",
    sql("vitems", "SELECT id, pos FROM packed", f"w AS (SELECT *, round(1 - list_cosine_similarity(embedding, {VEC0}), 6) AS dist FROM vitems), " + briefing_sql("dist < 0.9", 8000, "w", f"dist, {SIG}, rank DESC, id")),
)
def _(t: Tables):
    return br.briefing_items(t.items(vectors=True), as_of=as_of(), topic="free text", topic_vec=query_vector(t), radius=0.9).select("id", "pos")


@query(
    "briefing_text_fallback", "Q14 P09",
    sql("items", "SELECT id, pos FROM packed", TOKENS.replace("{src}", "items") + ", " + briefing_sql("(list_contains(t_title, 'that') OR list_contains(t_excerpt, 'that') OR list_contains(t_content, 'that'))", 8000, "tok")),
)
def _(t: Tables):
    return br.briefing_items(t.items(), as_of=as_of(), topic="that").select("id", "pos")


LIB_TEXT = """('## Library: ' || title || chr(10) || CASE WHEN tldr IS NOT NULL THEN tldr || chr(10) ELSE '' END || 'Key points:' || chr(10) || '- ' || key_points[1] || chr(10) || '- ' || key_points[2] || chr(10)
 || CASE WHEN gotchas IS NOT NULL THEN 'Gotchas:' || chr(10) || '- ' || gotchas[1].title || ': ' || gotchas[1].detail || chr(10) ELSE '' END || chr(10))"""


@query(
    "briefing_with_library", "Q14 F55 W08",
    sql("items library", """SELECT 'item' AS part, pos, md5(block) AS block_md5 FROM packed UNION ALL SELECT 'library', pos, md5(t) FROM
      (SELECT *, sum(length(t)) OVER (ORDER BY pos) AS running FROM lib) WHERE running <= 2400 OR pos = 1""",
        briefing_sql("list_has_any(tags, ['docker','deployment','monitoring','ci-cd','infra'])", 5600) + f""",
        lib AS (SELECT *, row_number() OVER (ORDER BY graduation_score DESC, helpful_count DESC, slug) AS pos, {LIB_TEXT} AS t FROM library WHERE status = 'active' AND is_current
          AND list_has_any(tags, ['docker','deployment','monitoring','ci-cd','infra']) ORDER BY pos LIMIT 20)"""),
)
def _(t: Tables):
    out = br.context_pack(t.items(), t.library(), as_of=as_of(), topic="devops", include_library=True)
    return out.select("part", "pos", F.md5("block").alias("block_md5"))


@query(
    "briefing_bullets", "A28",
    sql("items", """SELECT row_number() OVER (ORDER BY s) AS bullet_no, CASE s WHEN 0 THEN 'BREAKING (' || n || '): ' || lead WHEN 1 THEN 'Major update (' || n || ' items): ' || lead
      ELSE n || ' ' || significance || ': ' || titles END AS bullet FROM (SELECT significance, """ + SIG + """ AS s, count(*) AS n, string_agg(title, '; ' ORDER BY pos) FILTER (k <= 3) AS titles,
        first(CASE WHEN length(l) > 150 THEN substr(l, 1, 150) || '...' ELSE l END ORDER BY pos) AS lead FROM (SELECT *, coalesce(nullif(summary, ''), nullif(excerpt, ''), title) AS l,
        row_number() OVER (PARTITION BY significance ORDER BY pos) AS k FROM packed) GROUP BY significance)""", briefing_sql("true", 40000)),
)
def _(t: Tables):
    return br.compress_briefing(br.briefing_items(t.items(), as_of=as_of(), budget=10000))


@query(
    "briefing_bottom_line", "A29",
    sql("items", """SELECT CASE WHEN length(l) > 200 THEN substr(l, 1, 197) || '...' ELSE l END || chr(10) || chr(10) || n || ' items' || CASE WHEN b > 0 THEN ' (' || b || ' breaking)' ELSE '' END || '.' AS bottom_line FROM
      (SELECT first(coalesce(nullif(summary, ''), nullif(excerpt, ''), title) ORDER BY pos) AS l, count(*) AS n, count(*) FILTER (significance = 'breaking') AS b FROM packed)""", briefing_sql("true", 8000)),
)
def _(t: Tables):
    return br.bottom_line(br.briefing_items(t.items(), as_of=as_of()))


@query(
    "conversation_packing", "W08 W13",
    """SELECT conv_id, turn, running_chars FROM (SELECT conv_id, turn, CAST(sum(greatest(length(text), 1)) OVER w AS BIGINT) AS running_chars, row_number() OVER w AS rn FROM conversations
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE running_chars <= 1500 OR rn = 1""",
)
def _(t: Tables):
    from feedloom.operators.rank import pack_budget

    d = t.raw("conversations").withColumn("pos", c("turn"))
    return pack_budget(d, F.length("text"), 1500, ["conv_id"]).select("conv_id", "turn", "running_chars")


# ---- ordered computations over hot keys, with buckets cut by range -----------------------

CUT = 200  # rows per bucket: every event type holds far more


@query("running_totals_cut", "A22", "SELECT event_id, sum(event_id) OVER (PARTITION BY event_type ORDER BY ts, event_id)::BIGINT AS total FROM events")
def _(t: Tables):
    e = t.raw("events").select("event_id", "event_type", "ts")
    out = sk.running_totals(e, ["event_type"], F.date_trunc("year", "ts"), [F.asc("ts"), F.asc("event_id")], {"total": c("event_id")}, max_rows=CUT)
    return out.select("event_id", "total")


@query("previous_values_cut", "E01 T06", "SELECT event_id, lag(event_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS previous FROM events")
def _(t: Tables):
    e = t.raw("events").select("event_id", "event_type", "ts")
    out = sk.previous_in_bucketed_order(e, ["event_type"], F.date_trunc("year", "ts"), ["ts", "event_id"], ["event_id"], max_rows=CUT)
    return out.select("event_id", c("prev_event_id").alias("previous"))


@query("row_numbers_cut", "W03", "SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS n FROM events")
def _(t: Tables):
    e = t.raw("events").select("event_id", "ts")
    out = sk.global_row_number(e, [F.desc("ts"), F.asc("event_id")], -F.unix_seconds(F.date_trunc("year", "ts")), "n", max_rows=CUT)
    return out.select("event_id", c("n").cast("long").alias("n"))
