"""Feed and result-list queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.plans import feed as fd
from workload.adapter import Tables, as_of
from workload.oracle import AS_OF, EVENT_TS, SIG, decay, sql, ts_text
from workload.registry import query

PROFILE = {"tech_stack": ["docker"], "providers": ["meta"]}
INTEREST = "['docker','llama','meta']"
N_INTEREST = 3

RANK = f"""round(0.40::DOUBLE * coalesce(relevance_score, 0.5) * {decay(EVENT_TS)} + 0.30::DOUBLE * coalesce(quality_score, 0.5)
  + 0.20::DOUBLE * len(list_filter(tags, lambda t: list_contains({INTEREST}, t)))::DOUBLE / {N_INTEREST}
  + CASE coalesce(s.tier, 'tier3') WHEN 'tier1' THEN 0.10::DOUBLE WHEN 'tier2' THEN 0.10::DOUBLE * 0.5 ELSE 0.10::DOUBLE * 0.2 END, 6)"""
CAND = f"""status = 'processed' AND {EVENT_TS} >= {AS_OF} - INTERVAL 7 DAY
  AND (quality_score >= 0.3 OR significance IN ('breaking','major'))"""


def feed_ctes(rank: str, order: str, n: int, where: str = CAND, limit_pages: str = "") -> str:
    """page -> collapse -> diversify -> url dedup, as the oracle sees it."""
    return f"""page AS (SELECT *, row_number() OVER (ORDER BY {order}) AS pos FROM
      (SELECT i.*, s.type AS source_type, {rank} AS rank FROM items i LEFT JOIN (SELECT id AS sid, type, tier FROM sources) s ON s.sid = i.source_id
       WHERE {where} ORDER BY {order} LIMIT {n} {limit_pages})),
    collapsed AS (SELECT *, count(*) OVER (PARTITION BY coalesce('c:' || cluster_id, 'i:' || id)) AS cluster_count FROM page
      QUALIFY row_number() OVER (PARTITION BY coalesce('c:' || cluster_id, 'i:' || id) ORDER BY coalesce(relevance_score, 0) DESC, pos) = 1),
    slots AS (SELECT *, row_number() OVER (PARTITION BY coalesce(source_type, 'unknown') ORDER BY pos) AS slot,
      min(pos) OVER (PARTITION BY coalesce(source_type, 'unknown')) AS first_pos FROM collapsed),
    dealt AS (SELECT * REPLACE (row_number() OVER (ORDER BY slot, first_pos) AS pos) FROM slots WHERE slot <= 5),
    deduped AS (SELECT * FROM dealt QUALIFY row_number() OVER (PARTITION BY split_part(url, '#', 1) ORDER BY pos) = 1)"""


@query(
    "feed", "Q01 P01 P02 P03 F21 F22 L02 W04 W05 W06 J02",
    sql("items sources", "SELECT id, url, primary_type, significance, rank, cluster_count, pos FROM deduped ORDER BY pos LIMIT 20",
        feed_ctes(RANK, "rank DESC, id", 27)),
)
def _(t: Tables):
    out = fd.feed(t.items(), t.sources(), as_of=as_of(), profile=PROFILE)
    return out.select("id", "url", "primary_type", "significance", "rank", "cluster_count", "pos")


RANK0 = RANK.replace(f"0.20::DOUBLE * len(list_filter(tags, lambda t: list_contains({INTEREST}, t)))::DOUBLE / {N_INTEREST}", "0.20::DOUBLE * 0")
SHOW = "SELECT id, url, rank, cluster_count, pos FROM deduped ORDER BY pos LIMIT {n}"


@query(
    "feed_for_learner", "Q01 P06 P07",
    sql("items sources", SHOW.format(n=20), feed_ctes(
        RANK0, "rank DESC, id", 27, f"status = 'processed' AND {EVENT_TS} >= {AS_OF} - INTERVAL 90 DAY AND (quality_score >= 0.3 OR significance IN ('breaking','major')) AND primary_type IN ('docs','practice')")),
)
def _(t: Tables):
    return fd.feed(t.items(), t.sources(), as_of=as_of(), persona="learner").select("id", "url", "rank", "cluster_count", "pos")


@query(
    "feed_for_curator", "Q01 P07 L01 L02 L03",
    sql("items sources", SHOW.format(n=50), feed_ctes(RANK0, f"{SIG}, rank DESC, id", 66, CAND, "OFFSET 5")),
)
def _(t: Tables):
    return fd.feed(t.items(), t.sources(), as_of=as_of(), persona="curator", offset=5).select("id", "url", "rank", "cluster_count", "pos")


@query(
    "feed_filtered", "Q01 P04 P05 P06",
    sql("items sources", SHOW.format(n=20), feed_ctes(
        RANK0, "rank DESC, id", 27, f"""status = 'processed' AND {EVENT_TS} >= TIMESTAMP '2023-11-15' AND (quality_score >= 0.3 OR significance IN ('breaking','major'))
          AND list_contains(tags, 'en') AND list_has_any(tags, ['docker','deployment','monitoring','ci-cd','infra']) AND significance IN ('major','minor')""")),
)
def _(t: Tables):
    out = fd.feed(
        t.items(), t.sources(), as_of=as_of(), since=F.lit("2023-11-15").cast("timestamp"), tags=["en"], group="devops", significance="major, minor"
    )
    return out.select("id", "url", "rank", "cluster_count", "pos")


DIST = "round(1 - list_cosine_similarity(embedding, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6)"


@query(
    "feed_by_vector", "Q01 P08",
    sql("vitems sources", SHOW.format(n=20), feed_ctes(
        RANK0, f"{DIST}, rank DESC, id", 27, f"status = 'processed' AND {EVENT_TS} >= {AS_OF} - INTERVAL 30 DAY AND (quality_score >= 0.3 OR significance IN ('breaking','major')) AND {DIST} < 0.9").replace("FROM items i", "FROM vitems i")),
)
def _(t: Tables):
    vec = t.raw("embeddings").where("vec_id = 0").select("embedding").first()[0]
    out = fd.feed(t.items(vectors=True), t.sources(), as_of=as_of(), query_vec=vec, radius=0.9, days=30)
    return out.select("id", "url", "rank", "cluster_count", "pos")
