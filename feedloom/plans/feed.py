"""Personalised ranked feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.functions import profile as pf
from feedloom.functions import scores as sc
from feedloom.functions import vectors as vx
from feedloom.operators import filters as fl
from feedloom.operators import rank as rk
from feedloom.operators.joins import with_source

PUBLIC = [
    "id", "source_id", "url", "title", "excerpt", "summary", "primary_type", "tags", "significance",
    "relevance_score", "quality_score", "confidence_score", "created_at", "published_at", "cluster_id",
]


def feed_candidates(
    items: DataFrame, *, as_of: Column, days=7, since: Column | None = None, types=None, tags=None, group=None,
    significance=None, source=None, query_vec=None, radius=0.50,
) -> DataFrame:
    """Rows admitted to the feed before ranking."""
    cond = fl.all_of(
        fl.processed(),
        fl.since(since) if since is not None else fl.recent(as_of, days),
        fl.quality_floor(),
        fl.is_in("source_id", [source] if source else None),
        fl.is_in("primary_type", types),
        fl.has_all_tags(tags) if tags else None,
        fl.has_any_tag(pf.expand_group(group)) if group and pf.expand_group(group) else None,
        fl.is_in("significance", significance),
        fl.within_radius(query_vec, radius) if query_vec is not None else None,
    )
    return items.where(cond)


def feed(
    items: DataFrame, sources: DataFrame, *, as_of: Column, days=7, since=None, types=None, tags=None, group=None,
    significance=None, source=None, persona=None, profile=None, query_vec=None, radius=0.50, sort=None, limit=20,
    offset=0, max_per_type=5,
) -> DataFrame:
    p = pf.resolve_persona(persona, days=days, sort=sort, limit=limit, types=types, significance=significance)
    limit = p["limit"]
    rows = feed_candidates(
        items, as_of=as_of, days=p["days"], since=since, types=p["types"], tags=tags, group=group,
        significance=p["significance"], source=source, query_vec=query_vec, radius=radius,
    )
    extra = ["embedding"] if query_vec is not None else []
    rows = with_source(rows.select(*PUBLIC, *extra), sources, "tier3", ("tier", "type"))
    rows = rows.withColumn("rank", sc.stable(sc.composite_rank(F.col("source_tier"), as_of, pf.expand_profile(profile))))
    order = [F.desc("rank"), F.asc("id")]
    if p["sort"] == "significance":
        order.insert(0, sc.significance_rank(F.col("significance")).asc())
    if query_vec is not None:
        rows = rows.withColumn("distance", sc.stable(vx.distance_to(F.col("embedding"), query_vec))).drop("embedding")
        order.insert(0, F.asc("distance"))
    # only (limit * 1.3 + 1) rows leave the scan stage; everything below runs on that page
    page = rk.top_positions(rows, order, int(limit * 1.3) + 1, offset)
    page = rk.collapse_clusters(page, "relevance_score")
    page = rk.diversify(page, "source_type", max_per_type)
    page = rk.dedup_base_url(page)
    return page.orderBy("pos").limit(limit)


def feed_total(items: DataFrame, **filters) -> DataFrame:
    return feed_candidates(items, **filters).agg(F.count(F.lit(1)).alias("total"))


def advance_cursor(cursors: DataFrame, key_id: int, page: DataFrame, offset: int = 0) -> DataFrame:
    """Cursor of one key moves just past the newest row shown, only on a non-empty first page."""
    if offset:
        return cursors
    seen = page.agg(F.max("created_at").alias("m")).where(F.col("m").isNotNull())
    moved = seen.select(
        F.lit(key_id).cast("long").alias("api_key_id"), F.timestamp_micros(F.unix_micros("m") + 1).alias("last_seen_at")
    )
    both = cursors.select("api_key_id", "last_seen_at").unionByName(moved)
    return both.groupBy("api_key_id").agg(F.max("last_seen_at").alias("last_seen_at"))


def feed_health(sources: DataFrame, *, as_of: Column) -> DataFrame:
    """What an empty feed answers with: is the landing still running."""
    last = F.max("last_successful_poll")
    return sources.agg(
        last.alias("last_ingestion"),
        F.count_if("is_active").alias("sources_active"),
        F.coalesce((F.unix_micros(as_of) - F.unix_micros(last)) < 3_600_000_000, F.lit(False)).alias("healthy"),
    )


def topic_coverage(sources: DataFrame, term: str) -> DataFrame:
    t = term.lower()
    hit = fl.any_of(*[F.lower(F.coalesce(F.col(c), F.lit(""))).contains(t) for c in ("name", "url", "config")])
    return sources.where("is_active").agg(F.count_if(hit).alias("topic_sources"))
