"""Search and vector queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from feedloom.operators import filters as fl
from feedloom.operators import rank as rk
from feedloom.operators import text_match as tm
from feedloom.operators.text_index import TextIndex
from feedloom.operators.vector_index import VectorIndex
from feedloom.plans import search as se
from feedloom.plans import similar as sm
from feedloom.session import ensure_checkpoint_dir
from workload.adapter import Tables, as_of
from workload.oracle import AS_OF, EVENT_TS, age_days, decay, sql
from workload.registry import query

c = F.col
Q = "that with"
TERMS = Q.split()
WEIGHTS = {"title": 1.0, "excerpt": 0.4, "content": 0.2}


def toks(f: str) -> str:
    return f"regexp_extract_all(lower(coalesce({f}, '')), '[\\p{{L}}\\p{{N}}]+')"


TOKENS = "tok AS MATERIALIZED (SELECT *, " + ", ".join(f"{toks(f)} AS t_{f}" for f in WEIGHTS) + " FROM {src})"


def tf(f: str, term: str) -> str:
    return f"len(list_filter(t_{f}, lambda x: x = '{term}'))"


def phrase(f: str, terms: list[str]) -> str:
    return f"contains(' ' || array_to_string(t_{f}, ' ') || ' ', ' {' '.join(terms)} ')"


def has(term: str) -> str:
    return "(" + " OR ".join(f"list_contains(t_{f}, '{term}')" for f in WEIGHTS) + ")"


def rank_sql(terms=TERMS) -> str:
    parts = [
        f"CASE WHEN {tf(f, t)} > 0 THEN {w}::DOUBLE * (1 + ln({tf(f, t)})) ELSE 0 END" for f, w in WEIGHTS.items() for t in terms
    ]
    parts += [f"CASE WHEN {phrase(f, terms)} THEN {0.5 * w}::DOUBLE ELSE 0 END" for f, w in WEIGHTS.items()]
    return "(" + " + ".join(parts) + ")"


MATCH_ALL = " AND ".join(has(t) for t in TERMS)
MATCH_ANY = "(" + " OR ".join(has(t) for t in TERMS) + ")"
HYGIENE = "NOT contains(coalesce(summary, ''), 'unavailable') AND length(coalesce(content, '')) >= 100 AND coalesce(quality_score, 0) >= 0.40"


@query(
    "fulltext_match", "P09 P10 P11",
    sql("items", f"SELECT id, {MATCH_ALL} AS all_words, {MATCH_ANY} AS any_word, " + " OR ".join(phrase(f, TERMS) for f in WEIGHTS)
        + f" AS phrase, round({rank_sql()}, 6) AS rank FROM tok", TOKENS.replace("{src}", "items")),
)
def _(t: Tables):
    return t.items().select(
        "id", tm.match_all(Q).alias("all_words"), tm.match_any(Q).alias("any_word"), tm.has_phrase(TERMS).alias("phrase"),
        F.round(tm.text_rank(Q), 6).alias("rank"),
    )


@query(
    "fulltext_index", "P09 P10",
    sql("items", """SELECT id, count(*) AS n_terms, round(sum(score), 6) AS score FROM (SELECT id, term, sum(w * (1 + ln(tf))) AS score FROM
      (SELECT id, term, w, count(*) AS tf FROM (""" + " UNION ALL ".join(
        f"SELECT id, {w}::DOUBLE AS w, '{f}' AS f, unnest(t_{f}) AS term FROM tok" for f, w in WEIGHTS.items())
        + """) GROUP BY id, term, w, f) WHERE term IN ('that','with') GROUP BY id, term) GROUP BY id HAVING count(*) = 2""", TOKENS.replace("{src}", "items")),
)
def _(t: Tables):
    hit = tm.search_index(tm.build_index(t.items()), Q)
    return hit.select("id", "n_terms", F.round("score", 6).alias("score"))


@query(
    "fulltext_index_terms", "P09",
    """SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM
    (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents) GROUP BY term""",
)
def _(t: Tables):
    d = t.raw("documents").select(c("doc_id").alias("id"), F.explode(tm.tx.tokens(c("text"))).alias("term"))
    per_doc = d.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return per_doc.groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("occurrences"))


def text_index(t: Tables, batches: int = 1) -> TextIndex:
    """The index of the items, written in ``batches`` parts; with several, earlier ones hold old versions of later items."""
    index = TextIndex(t.spark, f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/text-index-{uuid.uuid4().hex}")
    items = t.items()
    part = F.pmod(F.xxhash64("id"), F.lit(batches))
    for k in range(batches):
        old = items.where(part > k).withColumns({f: F.reverse(c(f)) for f in ("title", "excerpt", "content")})
        index.append(items.where(part == k).unionByName(old), k)
    return index


@query(
    "fulltext_phrase_index", "P09 P10 P11",
    sql("items", "SELECT id, every, round(" + rank_sql() + ", 6) AS rank FROM (SELECT *, (" + " OR ".join(phrase(f, TERMS) for f in WEIGHTS)
        + f") AND NOT {has('nicht')} AS every FROM tok) WHERE {MATCH_ANY}", TOKENS.replace("{src}", "items")),
)
def _(t: Tables):
    """A phrase without an excluded word, from posting lists with positions; the rank is that of the phrase's words."""
    index = text_index(t)
    exact = index.hits(f'"{Q}" -nicht').select("id", "every")
    return index.hits(Q).select("id", F.round("score", 6).alias("rank")).join(exact, "id")


BLEND = f"{decay(EVENT_TS)} * (0.5 + 0.5 * coalesce(quality_score, 0.5))"


def text_page_sql(terms_all: str, terms_any: str, n: int, rank: str, extra: str = "true") -> str:
    return f"""strict AS (SELECT *, row_number() OVER (ORDER BY rank DESC, id) AS pos FROM (SELECT *, round({rank} * coalesce(relevance_score, 0.5) * {BLEND}, 6) AS rank
      FROM tok WHERE status = 'processed' AND {extra} AND relevance_score >= 0.60 AND {HYGIENE} AND {terms_all} ORDER BY rank DESC, id LIMIT {n})),
    wide AS (SELECT *, row_number() OVER (ORDER BY rank DESC, id) AS pos FROM (SELECT *, round({rank} * {BLEND}, 6) AS rank
      FROM tok WHERE status = 'processed' AND {extra} AND relevance_score >= 0.65 AND {HYGIENE} AND {terms_any} AND (SELECT count(*) FROM strict) < 3 ORDER BY rank DESC, id LIMIT {n})),
    merged AS (SELECT * REPLACE (row_number() OVER (ORDER BY branch, pos) AS pos) FROM (SELECT *, 0 AS branch FROM strict UNION ALL SELECT *, 1 FROM wide)
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY branch, pos) = 1),
    page AS (SELECT * FROM merged WHERE pos <= {n})"""


FINISH = """, collapsed AS (SELECT * FROM page QUALIFY row_number() OVER (PARTITION BY coalesce('c:' || cluster_id, 'i:' || id) ORDER BY rank DESC, pos) = 1),
 done AS (SELECT * FROM collapsed QUALIFY row_number() OVER (PARTITION BY split_part(url, '#', 1) ORDER BY pos) = 1)"""


@query(
    "text_search", "Q03 P09 P12 F21 L02 W04 W06",
    sql("items", "SELECT id, url, rank, pos FROM done ORDER BY pos LIMIT 20", TOKENS.replace("{src}", "items") + ", " + text_page_sql(MATCH_ALL, MATCH_ANY, 60, rank_sql()) + FINISH),
)
def _(t: Tables):
    return se.text_search(t.items(), q=Q, as_of=as_of()).select("id", "url", "rank", "pos")


RARE = ["erenst", "there"]


@query(
    "text_search_fallback", "Q03 P10 U02",
    sql("items", "SELECT id, rank, pos FROM done ORDER BY pos LIMIT 20",
        TOKENS.replace("{src}", "items") + ", " + text_page_sql(has("erenst") + " AND " + has("there"), f"({has('erenst')} OR {has('there')})", 60, rank_sql(RARE)) + FINISH),
)
def _(t: Tables):
    return se.text_search(t.items(), q="erenst there", as_of=as_of()).select("id", "rank", "pos")


TEXT_SEARCH = sql("items", "SELECT id, url, rank, pos FROM done ORDER BY pos LIMIT 20", TOKENS.replace("{src}", "items") + ", " + text_page_sql(MATCH_ALL, MATCH_ANY, 60, rank_sql()) + FINISH)


@query("text_search_indexed", "Q03 P09 P10 P12 L02 W04 W06", TEXT_SEARCH)
def _(t: Tables):
    return se.text_search(t.items(), q=Q, as_of=as_of(), index=text_index(t)).select("id", "url", "rank", "pos")


@query("text_search_indexed_batches", "Q03 P09 P10", TEXT_SEARCH)
def _(t: Tables):
    """The index was extended twice; the first two batches hold outdated texts of the items that follow."""
    return se.text_search(t.items(), q=Q, as_of=as_of(), index=text_index(t, 3)).select("id", "url", "rank", "pos")


@query(
    "text_search_fallback_indexed", "Q03 P10 U02",
    sql("items", "SELECT id, rank, pos FROM done ORDER BY pos LIMIT 20",
        TOKENS.replace("{src}", "items") + ", " + text_page_sql(has("erenst") + " AND " + has("there"), f"({has('erenst')} OR {has('there')})", 60, rank_sql(RARE)) + FINISH),
)
def _(t: Tables):
    return se.text_search(t.items(), q="erenst there", as_of=as_of(), index=text_index(t)).select("id", "rank", "pos")


@query(
    "text_search_low_confidence", "Q03 A31",
    sql("items", """SELECT q, count(DISTINCT id) AS rows, coalesce(bool_or(weak), false) AS weak FROM (SELECT 'now' AS q, id, mean < 0.3 AS weak FROM shown, (SELECT avg(coalesce(relevance_score, 0)) AS mean FROM shown)
        WHERE (SELECT max(rank) FROM shown WHERE pos = (SELECT min(pos) FROM shown)) >= 0.001
      UNION ALL SELECT 'later', id, false FROM shown WHERE (SELECT max(rank) FROM shown WHERE pos = (SELECT min(pos) FROM shown)) * pow(0.5, 100 / 7.0) >= 0.001) GROUP BY q""",
        TOKENS.replace("{src}", "items") + ", " + text_page_sql(MATCH_ALL, MATCH_ANY, 60, rank_sql()) + FINISH + ", shown AS (SELECT * FROM done ORDER BY pos LIMIT 20)"),
)
def _(t: Tables):
    """The page of today, and the empty one of a hundred days later, when even the first row ranks below the floor."""
    later = as_of() + F.expr("INTERVAL 100 DAYS")
    pages = [se.text_search(t.items(), q=Q, as_of=at).withColumn("q", F.lit(q)) for q, at in (("now", as_of()), ("later", later))]
    return pages[0].unionByName(pages[1]).groupBy("q").agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.bool_or("out_of_scope"), F.lit(False)).alias("weak"))


@query(
    "text_search_total", "Q03",
    sql("items", f"""SELECT CASE WHEN a < 3 THEN b ELSE a END AS total FROM (SELECT count(*) FILTER (relevance_score >= 0.60 AND {MATCH_ALL}) AS a,
      count(*) FILTER ((relevance_score >= 0.60 AND {MATCH_ALL}) OR (relevance_score >= 0.65 AND {MATCH_ANY})) AS b FROM tok WHERE status = 'processed' AND {HYGIENE})""", TOKENS.replace("{src}", "items")),
)
def _(t: Tables):
    return se.text_total(t.items(), q=Q, as_of=as_of())


@query(
    "text_search_total_indexed", "Q03 P09 P10",
    sql("items", f"""SELECT CASE WHEN a < 3 THEN b ELSE a END AS total FROM (SELECT count(*) FILTER (relevance_score >= 0.60 AND {MATCH_ALL}) AS a,
      count(*) FILTER ((relevance_score >= 0.60 AND {MATCH_ALL}) OR (relevance_score >= 0.65 AND {MATCH_ANY})) AS b FROM tok WHERE status = 'processed' AND {HYGIENE})""", TOKENS.replace("{src}", "items")),
)
def _(t: Tables):
    return se.text_total(t.items(), q=Q, as_of=as_of(), index=text_index(t))


ACCENTS = ["für", "être", "ció", "nicht"]


@query(
    "text_search_accents", "Q03 P09 F49",
    sql("items", " UNION ALL ".join(
        f"""SELECT '{w}' AS word, id FROM items WHERE list_contains(regexp_extract_all(lower(concat_ws(' ', title, excerpt, content)), '[\\p{{L}}\\p{{N}}]+'), '{w}')"""
        for w in ACCENTS)),
)
def _(t: Tables):
    """A German, a French and a Spanish word, each also typed in decomposed form and in capitals; whole words only."""
    import unicodedata

    from feedloom.operators import text_match as tm

    out = None
    for w in ACCENTS:
        typed = unicodedata.normalize("NFD", w.upper() if w == "für" else w)
        part = t.items().where(tm.match_all(typed)).select(F.lit(w).alias("word"), "id")
        out = part if out is None else out.unionByName(part)
    return out


VEC0 = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"
SIM0 = f"(round(1 - list_cosine_similarity(embedding, {VEC0}), 6) + 0)"


def query_vector(t: Tables):
    return t.raw("embeddings").where("vec_id = 0").select("embedding").first()[0]


def hybrid_sql(extra: str, rank_order: str, terms_all: str, limit: int = 60) -> str:
    return f"""ok AS MATERIALIZED (SELECT * FROM tok WHERE status = 'processed' AND {HYGIENE} AND {extra}),
    sem AS (SELECT *, row_number() OVER (ORDER BY k, id) AS rn FROM (SELECT *, {SIM0} AS k FROM ok WHERE embedding IS NOT NULL ORDER BY k, id LIMIT 50)),
    ft AS (SELECT *, row_number() OVER (ORDER BY k, id) AS rn FROM (SELECT *, -round({rank_order}, 6) AS k FROM ok WHERE {terms_all} ORDER BY k, id LIMIT 50)),
    cand AS (SELECT * FROM ok WHERE id IN (SELECT id FROM sem UNION SELECT id FROM ft)),
    qual AS (SELECT id, row_number() OVER (ORDER BY coalesce(quality_score, 0) DESC, id) AS rn FROM cand),
    fresh AS (SELECT id, row_number() OVER (ORDER BY {EVENT_TS} DESC, id) AS rn FROM cand),
    fused AS (SELECT b.*, round(0.25::DOUBLE * coalesce(1.0::DOUBLE / (60 + s.rn), 0) + 0.35::DOUBLE * coalesce(1.0::DOUBLE / (60 + f.rn), 0)
      + 0.35::DOUBLE * coalesce(1.0::DOUBLE / (60 + q.rn), 0) + 0.05::DOUBLE * coalesce(1.0::DOUBLE / (60 + r.rn), 0), 8) AS rank
      FROM cand b LEFT JOIN sem s ON s.id = b.id LEFT JOIN ft f ON f.id = b.id LEFT JOIN qual q ON q.id = b.id LEFT JOIN fresh r ON r.id = b.id),
    page AS (SELECT *, row_number() OVER (ORDER BY rank DESC, id) AS pos FROM fused ORDER BY rank DESC, id LIMIT {limit})"""


@query(
    "hybrid_search", "Q02 W03 J13 J14 P12 A31 W04 W06 U01",
    sql("vitems", f"""SELECT id, url, rank, pos FROM shown WHERE (SELECT count(*) FROM tok WHERE status = 'processed' AND {MATCH_ALL}) >= 3
      AND (SELECT avg(relevance_score) FROM (SELECT relevance_score FROM shown ORDER BY pos LIMIT 5)) >= 0.60""",
        TOKENS.replace("{src}", "vitems") + ", " + hybrid_sql("true", rank_sql(), MATCH_ALL) + FINISH + ", shown AS (SELECT * FROM done ORDER BY pos LIMIT 20)"),
)
def _(t: Tables):
    out = se.hybrid_search(t.items(vectors=True), q=Q, query_vec=query_vector(t), as_of=as_of())
    return out.select("id", "url", "rank", "pos")


@query(
    "hybrid_search_indexed", "Q02 P09 J13 J14 U01",
    sql("vitems", f"""SELECT id, url, rank, pos FROM shown WHERE (SELECT count(*) FROM tok WHERE status = 'processed' AND {MATCH_ALL}) >= 3
      AND (SELECT avg(relevance_score) FROM (SELECT relevance_score FROM shown ORDER BY pos LIMIT 5)) >= 0.60""",
        TOKENS.replace("{src}", "vitems") + ", " + hybrid_sql("true", rank_sql(), MATCH_ALL) + FINISH + ", shown AS (SELECT * FROM done ORDER BY pos LIMIT 20)"),
)
def _(t: Tables):
    out = se.hybrid_search(t.items(vectors=True), q=Q, query_vec=query_vector(t), as_of=as_of(), index=text_index(t))
    return out.select("id", "url", "rank", "pos")


@query(
    "hybrid_candidates", "Q02 U01",
    sql("vitems", "SELECT count(*) AS total FROM cand", TOKENS.replace("{src}", "vitems") + ", " + hybrid_sql("true", rank_sql(), MATCH_ALL)),
)
def _(t: Tables):
    return se.candidate_total(t.items(vectors=True), q=Q, query_vec=query_vector(t), as_of=as_of())


PLUGIN = ["plugin", "with"]


@query(
    "routed_search", "Q04 F43",
    sql("items", "SELECT id, rank, pos FROM done ORDER BY pos LIMIT 20",
        TOKENS.replace("{src}", "items") + f""", nofilter AS (SELECT *, round({rank_sql(['with', 'migrate'])} * coalesce(relevance_score, 0.5) * {BLEND}, 6) AS rank FROM tok
          WHERE status = 'processed' AND relevance_score >= 0.60 AND {HYGIENE} AND {has('with')} AND {has('migrate')}),
        narrow0 AS (SELECT * FROM nofilter WHERE significance = 'breaking'),
        wide0 AS (SELECT *, round({rank_sql(['with', 'migrate'])} * {BLEND}, 6) AS rank FROM tok WHERE status = 'processed' AND significance = 'breaking'
          AND relevance_score >= 0.65 AND {HYGIENE} AND ({has('with')} OR {has('migrate')}) AND (SELECT count(*) FROM narrow0) < 3),
        narrow AS (SELECT * FROM (SELECT *, 0 AS branch FROM narrow0 UNION ALL SELECT *, 1 FROM wide0 WHERE id NOT IN (SELECT id FROM narrow0)) ORDER BY branch, rank DESC, id LIMIT 60),
        page AS (SELECT *, row_number() OVER (ORDER BY branch, rank DESC, id) AS pos FROM (SELECT * FROM narrow WHERE (SELECT count(*) FROM narrow) >= 3
          UNION ALL SELECT *, 0 FROM nofilter WHERE (SELECT count(*) FROM narrow) < 3))""" + FINISH),
)
def _(t: Tables):
    return se.routed_search(t.items(), q="with migrate", as_of=as_of()).select("id", "rank", "pos")


@query(
    "routed_search_indexed", "Q04 F43 P09",
    sql("items", "SELECT id, rank, pos FROM done ORDER BY pos LIMIT 20",
        TOKENS.replace("{src}", "items") + f""", nofilter AS (SELECT *, round({rank_sql(['with', 'migrate'])} * coalesce(relevance_score, 0.5) * {BLEND}, 6) AS rank FROM tok
          WHERE status = 'processed' AND relevance_score >= 0.60 AND {HYGIENE} AND {has('with')} AND {has('migrate')}),
        narrow0 AS (SELECT * FROM nofilter WHERE significance = 'breaking'),
        wide0 AS (SELECT *, round({rank_sql(['with', 'migrate'])} * {BLEND}, 6) AS rank FROM tok WHERE status = 'processed' AND significance = 'breaking'
          AND relevance_score >= 0.65 AND {HYGIENE} AND ({has('with')} OR {has('migrate')}) AND (SELECT count(*) FROM narrow0) < 3),
        narrow AS (SELECT * FROM (SELECT *, 0 AS branch FROM narrow0 UNION ALL SELECT *, 1 FROM wide0 WHERE id NOT IN (SELECT id FROM narrow0)) ORDER BY branch, rank DESC, id LIMIT 60),
        page AS (SELECT *, row_number() OVER (ORDER BY branch, rank DESC, id) AS pos FROM (SELECT * FROM narrow WHERE (SELECT count(*) FROM narrow) >= 3
          UNION ALL SELECT *, 0 FROM nofilter WHERE (SELECT count(*) FROM narrow) < 3))""" + FINISH),
)
def _(t: Tables):
    return se.routed_search(t.items(), q="with migrate", as_of=as_of(), index=text_index(t)).select("id", "rank", "pos")


@query(
    "library_hits", "Q05 P14",
    sql("library", """SELECT slug, score AS match_score FROM (SELECT slug, """ + " + ".join(
        f"CASE WHEN contains(lower(coalesce({f}, '')), '{w}') THEN {n} ELSE 0 END" for w in ("steel", "small") for f, n in (("topic_path", 10), ("title", 5), ("tldr", 2)))
        + """ AS score FROM library WHERE status = 'active' AND is_current) WHERE score > 0 ORDER BY score DESC, slug LIMIT 3"""),
)
def _(t: Tables):
    return se.library_hits(t.library(), q="Steel SMALL").select("slug", "match_score")


@query(
    "similar_to_item", "Q06 J04 P08 F47",
    sql("vitems", """SELECT id, round(1 - d, 6) AS similarity FROM (SELECT id, round(1 - list_cosine_similarity(embedding, (SELECT embedding FROM vitems WHERE id = 'd5')), 6) + 0 AS d
      FROM vitems WHERE status = 'processed' AND id <> 'd5' AND embedding IS NOT NULL) WHERE d < 0.75 ORDER BY d, id LIMIT 10"""),
)
def _(t: Tables):
    return sm.similar_by_id(t.items(vectors=True), item_id="d5", radius=0.75).select("id", "similarity")


@query(
    "similar_to_vector", "Q06 J05 P08",
    sql("vitems", f"""SELECT id, round(1 - d, 6) AS similarity FROM (SELECT id, {SIM0} AS d FROM vitems WHERE status = 'processed') WHERE d < 0.8 ORDER BY d, id LIMIT 10"""),
)
def _(t: Tables):
    return sm.similar_by_vector(t.items(vectors=True), vec=query_vector(t), radius=0.8).select("id", "similarity")


def vector_index(t: Tables) -> VectorIndex:
    """The vectors of the processed items, stored in three appends."""
    path = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/vector-index-{uuid.uuid4().hex}"
    vectors = t.items(vectors=True).where(fl.processed()).select("id", c("embedding").alias("vec"))
    index = VectorIndex(t.spark, path, tops=8, leaves=16).create(vectors)
    for k in range(3):
        index.append(vectors.where(F.pmod(F.xxhash64("id"), F.lit(3)) == k), k)
    return index


@query(
    "watchlist_matches", "Q07 J06",
    sql("vitems watchlists", """SELECT watchlist_id, id, round(1 - d, 6) AS match_score, rn FROM (SELECT w.id AS watchlist_id, i.id,
        round(1 - list_cosine_similarity(i.embedding, w.concept_embedding), 6) + 0 AS d, w.similarity_threshold AS thr,
        row_number() OVER (PARTITION BY w.id ORDER BY round(1 - list_cosine_similarity(i.embedding, w.concept_embedding), 6), i.id) AS rn
      FROM vitems i JOIN watchlists w ON w.is_active WHERE i.status = 'processed' AND i.embedding IS NOT NULL) WHERE d <= 1 - thr AND rn <= 20"""),
)
def _(t: Tables):
    return sm.watchlist_matches(t.items(vectors=True), t.watchlists())


@query(
    "watchlist_matches_with_pivots", "Q07 J06",
    sql("vitems watchlists", """SELECT watchlist_id, id, round(1 - d, 6) AS match_score, rn FROM (SELECT w.id AS watchlist_id, i.id,
        round(1 - list_cosine_similarity(i.embedding, w.concept_embedding), 6) + 0 AS d, w.similarity_threshold AS thr,
        row_number() OVER (PARTITION BY w.id ORDER BY round(1 - list_cosine_similarity(i.embedding, w.concept_embedding), 6), i.id) AS rn
      FROM vitems i JOIN watchlists w ON w.is_active WHERE i.status = 'processed' AND i.embedding IS NOT NULL) WHERE d <= 1 - thr AND rn <= 20"""),
)
def _(t: Tables):
    return sm.watchlist_matches(t.items(vectors=True), t.watchlists(), pivots=16, block_rows=256)


@query(
    "watchlist_matches_indexed", "Q07 J06",
    sql("vitems watchlists", """SELECT watchlist_id, id, round(1 - d, 6) AS match_score, rn FROM (SELECT w.id AS watchlist_id, i.id,
        round(1 - list_cosine_similarity(i.embedding, w.concept_embedding), 6) + 0 AS d, w.similarity_threshold AS thr,
        row_number() OVER (PARTITION BY w.id ORDER BY round(1 - list_cosine_similarity(i.embedding, w.concept_embedding), 6), i.id) AS rn
      FROM vitems i JOIN watchlists w ON w.is_active WHERE i.status = 'processed' AND i.embedding IS NOT NULL) WHERE d <= 1 - thr AND rn <= 20"""),
)
def _(t: Tables):
    return sm.watchlist_matches(t.items(vectors=True), t.watchlists(), index=vector_index(t))


NN = f"""pairs AS (SELECT u.id, n.id AS nid, round(1 - list_cosine_similarity(u.embedding, n.embedding), 6) + 0 AS d FROM vitems u JOIN vitems n ON n.id <> u.id
  WHERE u.status = 'processed' AND u.cluster_id IS NULL AND u.created_at >= {AS_OF} - INTERVAL {{days}} DAY AND n.status = 'processed'),
near AS MATERIALIZED (SELECT id, nid, d FROM pairs WHERE d < {{thr}} QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, nid) = 1)"""


@query(
    "nearest_neighbours", "J07",
    sql("vitems", "SELECT id AS query_id, nid AS id, d AS distance FROM near", NN.format(days=30, thr=0.7)),
)
def _(t: Tables):
    return sm.nearest_neighbours(t.items(vectors=True), as_of=as_of(), threshold=0.7, days=30).select("query_id", "id", "distance")


@query(
    "nearest_neighbours_with_pivots", "J07",
    sql("vitems", "SELECT id AS query_id, nid AS id, d AS distance FROM near", NN.format(days=30, thr=0.7)),
)
def _(t: Tables):
    return sm.nearest_neighbours(t.items(vectors=True), as_of=as_of(), threshold=0.7, days=30, pivots=16, block_rows=256).select("query_id", "id", "distance")


@query(
    "nearest_neighbours_indexed", "J07",
    sql("vitems", "SELECT id AS query_id, nid AS id, d AS distance FROM near", NN.format(days=30, thr=0.7)),
)
def _(t: Tables):
    return sm.nearest_neighbours(t.items(vectors=True), as_of=as_of(), threshold=0.7, days=30, index=vector_index(t)).select("query_id", "id", "distance")


@query(
    "cluster_items", "B09 J07",
    sql("vitems", """SELECT id, cluster_id FROM (SELECT w.id, coalesce(e.have, e.label) AS cluster_id FROM walked w JOIN ends e ON e.fin = w.fin
      UNION SELECT fin, label FROM ends WHERE have IS NULL)""",
        NN.format(days=30, thr=0.7) + """,
      hop AS (SELECT a.id, CASE WHEN b.nid = a.id AND a.id < a.nid THEN a.id ELSE a.nid END AS nxt FROM near a LEFT JOIN near b ON b.id = a.nid),
      walk(id, cur, done) AS (SELECT id, nxt, nxt = id FROM hop UNION ALL SELECT w.id, coalesce(h.nxt, w.cur), h.nxt IS NULL OR h.nxt = w.cur FROM walk w LEFT JOIN hop h ON h.id = w.cur WHERE NOT w.done),
      walked AS (SELECT id, cur AS fin FROM walk WHERE done),
      ends AS (SELECT fin, any_value(i.cluster_id) AS have, least(min(w.id), fin) AS label FROM walked w JOIN vitems i ON i.id = w.fin GROUP BY fin)"""),
)
def _(t: Tables):
    return sm.cluster_items(t.items(vectors=True), as_of=as_of(), threshold=0.7, days=30)


@query(
    "near_duplicate_vectors", "J08",
    sql("vitems", f"""SELECT query_id, id, distance FROM (SELECT b.id AS query_id, k.id, round(1 - list_cosine_similarity(b.embedding, k.embedding), 6) + 0 AS distance
      FROM vitems b JOIN vitems k ON b.created_at >= {AS_OF} - INTERVAL 3 DAY AND k.created_at < {AS_OF} - INTERVAL 3 DAY AND k.created_at >= {AS_OF} - INTERVAL 60 DAY)
      WHERE distance < 0.7 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) = 1"""),
)
def _(t: Tables):
    i = t.items(vectors=True)
    new = fl.recent(as_of(), 3, c("created_at"))
    return sm.near_duplicates(i.where(new), i.where(~new), as_of=as_of(), threshold=0.7, days=60).select("query_id", "id", "distance")


@query(
    "related_entries", "Q18 J04",
    sql("library", """SELECT slug, related_slug, round(1 - d, 4) AS relevance, rn FROM (SELECT a.slug, b.slug AS related_slug,
        round(1 - list_cosine_similarity(a.embedding, b.embedding), 6) + 0 AS d, row_number() OVER (PARTITION BY a.slug ORDER BY round(1 - list_cosine_similarity(a.embedding, b.embedding), 6) + 0, b.slug) AS rn
      FROM library a JOIN library b ON a.slug <> b.slug AND a.is_current AND b.is_current) WHERE rn <= 3 AND d <= 0.7"""),
)
def _(t: Tables):
    return sm.related_entries(t.library(vectors=True), min_similarity=0.3)


@query(
    "related_entries_with_pivots", "Q18 J04",
    sql("library", """SELECT slug, related_slug, round(1 - d, 4) AS relevance, rn FROM (SELECT a.slug, b.slug AS related_slug,
        round(1 - list_cosine_similarity(a.embedding, b.embedding), 6) + 0 AS d, row_number() OVER (PARTITION BY a.slug ORDER BY round(1 - list_cosine_similarity(a.embedding, b.embedding), 6) + 0, b.slug) AS rn
      FROM library a JOIN library b ON a.slug <> b.slug AND a.is_current AND b.is_current) WHERE rn <= 3 AND d <= 0.7"""),
)
def _(t: Tables):
    return sm.related_entries(t.library(vectors=True), min_similarity=0.3, pivots=16, block_rows=256)


@query(
    "rank_fusion", "J14 W03",
    """SELECT 'd' || doc_id AS id, round(0.5::DOUBLE / (60 + row_number() OVER (ORDER BY n_chars DESC, doc_id))
      + 0.5::DOUBLE / (60 + row_number() OVER (ORDER BY doc_id)), 8) AS rank_score FROM documents ORDER BY rank_score DESC, id LIMIT 40""",
)
def _(t: Tables):
    d = t.raw("documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "doc_id", "n_chars")
    from feedloom.operators.skew import global_row_number

    by_len = global_row_number(d, [F.desc("n_chars"), F.asc("doc_id")], F.floor(-c("n_chars") / 500), "rn")
    by_id = global_row_number(d, [F.asc("doc_id")], F.floor(c("doc_id") / 1000), "rn")
    out = rk.reciprocal_rank_merge([(by_len, 0.5), (by_id, 0.5)])
    return out.select("id", F.round("rank_score", 8).alias("rank_score")).orderBy(F.desc("rank_score"), "id").limit(40)
