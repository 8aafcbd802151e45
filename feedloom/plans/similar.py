"""Vector neighbours: similar items, watchlists, nearest neighbours, threads by clustering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.functions import scores as sc
from feedloom.functions import vectors as vx
from feedloom.operators import filters as fl
from feedloom.operators.vector_index import VectorIndex
from feedloom.operators.vector_join import nearest_within
from feedloom.session import cut_lineage

c = F.col


def similar_by_vector(items: DataFrame, *, vec, radius: float = 0.45, limit: int = 10) -> DataFrame:
    """Closest processed items to one vector: a scan that keeps ``limit`` rows per task."""
    rows = items.where(fl.processed() & c("embedding").isNotNull()).withColumn(
        "distance", sc.stable(vx.distance_to(c("embedding"), vec)) + 0.0
    )
    rows = rows.where(c("distance") < radius).withColumn("similarity", sc.stable(1.0 - c("distance")))
    return rows.drop("embedding", "content").orderBy("distance", "id").limit(limit)


def similar_by_id(items: DataFrame, *, item_id: str, radius: float = 0.45, limit: int = 10) -> DataFrame:
    found = items.where((c("id") == item_id) & c("embedding").isNotNull()).select("embedding").first()
    if found is None:  # unknown, or not embedded yet: nothing is similar to it
        return similar_by_vector(items.where(F.lit(False)), vec=[0.0], radius=radius, limit=limit)
    return similar_by_vector(items.where(c("id") != item_id), vec=found[0], radius=radius, limit=limit)


def watchlist_matches(items: DataFrame, watchlists: DataFrame, *, limit: int = 20, index: VectorIndex | None = None, **tuning) -> DataFrame:
    """Best items of every active watchlist at once, each with its own similarity threshold. ``index``: the stored vectors
    of the processed items.

    The watchlists are stored before the join, which reads them twice and tells vectors by their bits: a concept is often a
    mean, whose last bits depend on the order in which its parts arrive.
    """
    w = watchlists.where("is_active").select("id", c("concept_embedding").alias("vec"), (1.0 - c("similarity_threshold")).alias("r"))
    w = cut_lineage(w)
    base = items.where(fl.processed()).select("id", c("embedding").alias("vec"))
    how = {"k": limit, "radius": c("r"), "exclude_self": False, "inclusive": True, **tuning}
    m = nearest_within(w, base, **how) if index is None else index.nearest(w, **how)
    return m.select(c("query_id").alias("watchlist_id"), "id", sc.stable(1.0 - c("distance")).alias("match_score"), "rn")


def nearest_neighbours(
    items: DataFrame, *, as_of: Column, threshold: float = 0.15, days: int = 7, index: VectorIndex | None = None, **tuning
) -> DataFrame:
    """(query_id, id, distance): the nearest processed item of every recent item that has no thread yet. ``index``: the
    stored vectors of the processed items; only the recent items' vectors are read besides."""
    base = items.where(fl.processed() & c("embedding").isNotNull())
    fresh = base.where(c("cluster_id").isNull() & fl.recent(as_of, days, c("created_at")))
    asked = fresh.select("id", c("embedding").alias("vec"))
    if index is not None:
        return index.nearest(asked, k=1, radius=threshold, **tuning)
    return nearest_within(asked, base.select("id", c("embedding").alias("vec")), k=1, radius=threshold, **tuning)


def cluster_items(
    items: DataFrame, *, as_of: Column, threshold: float = 0.15, days: int = 7, max_rounds: int = 40, **tuning
) -> DataFrame:
    """(id, cluster_id) of every item that joins a thread.

    Each recent item points at its nearest neighbour. Following the pointers ends at an item that already has a thread
    (whose id is inherited), at one without a pointer, or in a pair pointing at each other (the smaller id is taken as
    the end); the members of a new thread share its smallest member id. Pointers are doubled every round, so a chain of
    length n takes log2(n) rounds, and each round is written to the checkpoint folder.
    """
    near = nearest_neighbours(items, as_of=as_of, threshold=threshold, days=days, **tuning)
    near = cut_lineage(near.select(c("query_id").alias("id"), c("id").alias("next")))
    back = near.select(c("id").alias("next"), c("next").alias("_back"))
    p = near.join(back, "next", "left").select(
        "id", F.when((c("_back") == c("id")) & (c("id") < c("next")), c("id")).otherwise(c("next")).alias("next")
    )
    p = cut_lineage(p)
    for _ in range(max_rounds):
        hop = p.select(c("id").alias("next"), c("next").alias("_next2"))
        q = p.join(hop, "next", "left").select(
            "id", F.coalesce("_next2", "next").alias("next"),
            (F.coalesce("_next2", "next") != c("next")).alias("moved"),
        )
        q = cut_lineage(q)
        p = q.drop("moved")
        if q.where("moved").isEmpty():
            break
    else:
        raise RuntimeError("pointer chains longer than 2**max_rounds")
    ends = p.groupBy("next").agg(F.min("id").alias("_min"))
    known = items.select(c("id").alias("next"), c("cluster_id").alias("_have"))
    ends = ends.join(known, "next", "left").select(
        "next", F.coalesce("_have", F.least("_min", "next")).alias("cluster_id"), c("_have").isNull().alias("_new")
    )
    members = p.join(ends, "next").select("id", "cluster_id")
    # the end of a new thread belongs to it although it points nowhere
    roots = ends.where("_new").select(c("next").alias("id"), "cluster_id")
    return members.unionByName(roots).distinct()


def near_duplicates(
    batch: DataFrame, known: DataFrame, *, as_of: Column, threshold: float = 0.08, days: int = 7, k: int = 1, **tuning
) -> DataFrame:
    """The closest recent known item (or ``k`` of them) below the threshold, per batch row."""
    base = known.where(c("embedding").isNotNull() & fl.recent(as_of, days, c("created_at")))
    return nearest_within(
        batch.select("id", c("embedding").alias("vec")), base.select("id", c("embedding").alias("vec")),
        k=k, radius=threshold, **tuning,
    )


def related_entries(library: DataFrame, *, min_similarity: float = 0.85, limit: int = 3, **tuning) -> DataFrame:
    """Related current entries of every current entry, by slug."""
    cur = library.where(c("is_current") & c("embedding").isNotNull()).select(c("slug").alias("id"), c("embedding").alias("vec"))
    m = nearest_within(cur, cur, k=limit, radius=1.0 - min_similarity, inclusive=True, **tuning)
    return m.select(c("query_id").alias("slug"), c("id").alias("related_slug"), sc.stable(1.0 - c("distance"), 4).alias("relevance"), "rn")


