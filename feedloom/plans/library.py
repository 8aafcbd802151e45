"""Knowledge library queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.functions import profile as pf
from feedloom.functions import scores as sc
from feedloom.functions import text as tx
from feedloom.functions import vectors as vx
from feedloom.operators import filters as fl
from feedloom.operators import rank as rk
from feedloom.plans.signals import signal_counts
from feedloom.plans.similar import related_entries

c = F.col
WEIGHTS = {"topic_path": 10, "title": 5, "tags_text": 4, "tldr": 3, "body": 1}  # fixed values
MATCHED = ["topic_path", "title", "tldr", "tags_text"]
SHOWN = ["slug", "title", "tldr", "entry_type", "topic_path"]


def active(library: DataFrame) -> DataFrame:
    return library.where((c("status") == "active") & c("is_current"))


def library_search(
    library: DataFrame, *, q: str, query_vec=None, topic: str | None = None, entry_type: str | None = None, limit: int = 5
) -> DataFrame:
    """Vector hits first, then weighted word hits, each slug once."""
    q = tx.nfc(q)
    words = tx.text_terms(q) or [""]
    rows = active(library).where(fl.all_of(fl.topic_prefix(topic), fl.is_in("entry_type", [entry_type] if entry_type else None)))
    worded = rows.withColumn("tags_text", F.array_join("tags", ", ")).where(fl.substring_match(words, MATCHED))
    worded = worded.select(*SHOWN, fl.substring_score(words, WEIGHTS).cast("double").alias("match_score"))
    by_words = rk.top_positions(worded, [F.desc("match_score"), F.asc("slug")], limit)
    if query_vec is None:
        return by_words
    near = rows.where(c("embedding").isNotNull()).select(
        *SHOWN, sc.stable(1.0 - vx.distance_to(c("embedding"), query_vec), 4).alias("match_score")
    )
    by_vector = rk.top_positions(near, [F.desc("match_score"), F.asc("slug")], limit)
    return rk.merge_in_order(by_vector, by_words, "slug").where(c("pos") <= limit)


def library_recommend(library: DataFrame, *, profile: dict, limit: int = 5) -> DataFrame:
    interest = pf.expand_profile(profile)
    overlap = F.size(F.filter("tags", lambda t: t.isin(*interest))) if interest else F.lit(0)
    rows = active(library).select(*SHOWN, "tags", "graduation_score", "helpful_count", overlap.alias("overlap"))
    if not interest:  # nothing can be recommended without a profile
        rows = rows.where(F.lit(False))
    return rows.orderBy(F.desc("overlap"), F.desc("graduation_score"), F.desc("helpful_count"), "slug").limit(limit)


def library_topic(
    items: DataFrame, signals: DataFrame, *, topic: str, as_of: Column, entry_type: str | None = None, limit: int = 20
) -> DataFrame:
    """Items of a topic (a tag, or a whole tag group) by evergreen score."""
    n = signal_counts(signals).select(c("item_id").alias("id"), "upvotes", "bookmarks")
    rows = items.where(fl.all_of(fl.processed(), fl.tags_or_group(topic), fl.is_in("primary_type", [entry_type] if entry_type else None)))
    rows = rows.drop("content", "embedding").join(n, "id", "left").fillna(0, ["upvotes", "bookmarks"])
    rows = rows.withColumn("evergreen_score", sc.stable(sc.evergreen_score(c("upvotes"), c("bookmarks"), as_of)))
    return rows.orderBy(F.desc("evergreen_score"), "id").limit(limit)


def library_entry(library: DataFrame, *, slug: str) -> DataFrame:
    return library.where(c("is_current") & (c("slug") == slug))


def entry_related(library: DataFrame, *, slug: str, min_similarity: float = 0.85, limit: int = 3) -> DataFrame:
    """Related entries of one slug; ``related_entries`` answers for all of them at once."""
    row = library_entry(library, slug=slug).select("embedding").first()
    rows = library.where(c("is_current") & (c("slug") != slug) & c("embedding").isNotNull())
    if row is None or row[0] is None:
        return rows.where(F.lit(False)).select("slug", "title", F.lit(0.0).alias("relevance"))
    rows = rows.select("slug", "title", sc.stable(1.0 - vx.distance_to(c("embedding"), row[0])).alias("relevance"))
    return rows.where(c("relevance") >= min_similarity).orderBy(F.desc("relevance"), "slug").limit(limit)


def entry_sources(library: DataFrame, items: DataFrame, *, id_pattern: str = ".+", slug: str | None = None) -> DataFrame:
    """(slug, position, id, title, url, published_at) of the items the current entries cite; malformed ids are skipped."""
    cur = library.where("is_current") if slug is None else library_entry(library, slug=slug)
    cited = cur.select("slug", F.posexplode("source_item_ids").alias("position", "id")).where(c("id").rlike(id_pattern))
    return cited.join(items.select("id", "title", "url", "published_at"), "id")


def item_lookup(items: DataFrame, *, item_id: str) -> DataFrame:
    return items.where(fl.processed() & (c("id") == item_id))


__all__ = [
    "active", "library_search", "library_recommend", "library_topic", "library_entry", "entry_related", "entry_sources",
    "item_lookup", "related_entries",
]
