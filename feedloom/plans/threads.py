"""Story threads: items sharing a cluster id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom import vocab
from feedloom.functions import scores as sc
from feedloom.operators import filters as fl
from feedloom.operators import rank as rk
from feedloom.plans.signals import signal_counts

c = F.col


def dominant_significance() -> Column:
    """Most frequent value; the alphabetically first among equals. Four counters, so no second aggregation."""
    names = sorted(vocab.SIGNIFICANCES)
    counts = [
        F.struct(F.count_if(c("significance") == n).alias("n"), F.lit(-i).alias("o"), F.lit(n).alias("name"))
        for i, n in enumerate(names)
    ]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["name"])


def _members(items: DataFrame, as_of: Column, days: int) -> DataFrame:
    return items.where(fl.processed() & c("cluster_id").isNotNull() & fl.recent(as_of, days, c("created_at")))


def thread_stats(
    items: DataFrame, signals: DataFrame, *, as_of: Column, days: int = 30, min_items: int = 2
) -> DataFrame:
    up = signal_counts(signals).select(c("item_id").alias("id"), "upvotes")
    rows = _members(items, as_of, days).select("id", "cluster_id", "created_at", "relevance_score", "significance")
    rows = rows.join(up, "id", "left")
    g = rows.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("item_count"),  # ids are unique
        F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"),
        F.avg("relevance_score").alias("avg_relevance"), F.coalesce(F.sum("upvotes"), F.lit(0)).alias("total_upvotes"),
        dominant_significance().alias("dominant_significance"),
    )
    recency = F.when(c("last_seen") >= fl.days_back(as_of, 7), 2.0).otherwise(1.0)
    return g.where(c("item_count") >= min_items).withColumn("recency_factor", recency)


def raw_momentum() -> Column:
    return c("avg_relevance") * F.log(1.0 + c("item_count")) * c("recency_factor")


def threads(
    items: DataFrame, signals: DataFrame, *, as_of: Column, days: int = 30, min_items: int = 2, limit: int = 20,
    offset: int = 0,
) -> DataFrame:
    """Page of threads, newest first; momentum is relative to the strongest thread of the page."""
    page = rk.top_positions(
        thread_stats(items, signals, as_of=as_of, days=days, min_items=min_items),
        [F.desc("last_seen"), F.asc("cluster_id")], limit, offset,
    )
    whole = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return page.withColumn("momentum_score", sc.half_up(raw_momentum() / F.max(raw_momentum()).over(whole), 4))


def thread_total(items: DataFrame, *, as_of: Column, days: int = 30, min_items: int = 2) -> DataFrame:
    g = _members(items, as_of, days).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count_if(c("n") >= min_items).alias("total"))


def thread_top_items(items: DataFrame, page: DataFrame, n: int = 3) -> DataFrame:
    """First n members by relevance of each thread on the page (``page`` is at most one result page)."""
    rows = items.where(fl.processed()).join(page.select("cluster_id"), "cluster_id", "left_semi")
    cols = ["cluster_id", "id", "title", "summary", "significance", "tags", "relevance_score"]
    return rk.top_per_group(rows.select(*cols), ["cluster_id"], [F.desc("relevance_score"), F.asc("id")], n)


def _narrative(top: Column) -> Column:
    """``top``: array of at most a few member structs in rank order."""
    tags = F.flatten(F.transform(top, lambda m: F.coalesce(m["tags"], F.array().cast("array<string>"))))
    uniq = F.array_distinct(tags)
    counted = F.transform(
        uniq, lambda t, i: F.struct((-F.size(F.filter(tags, lambda x: x == t))).alias("n"), i.alias("i"), t.alias("t"))
    )
    names = F.transform(F.slice(F.array_sort(counted), 1, 3), lambda s: s["t"])
    top_tags = F.coalesce(F.nullif(F.array_join(names, ", "), F.lit("")), F.lit("general"))
    lead_src = F.coalesce(F.nullif(top[0]["summary"], F.lit("")), top[0]["title"], F.lit(""))
    lead = F.when(F.length(lead_src) > 150, F.concat(F.substring(lead_src, 1, 150), F.lit("..."))).otherwise(lead_src)
    sigs = F.transform(top, lambda m: F.coalesce(m["significance"], F.lit("informational")))
    def share(value):
        n = F.size(F.filter(sigs, lambda s: s == value))
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {value}")))

    parts = F.array_compact(F.array(*[share(v) for v in vocab.SIGNIFICANCES]))
    return F.concat(
        lead, F.lit("\n\n"), c("item_count").cast("string"), F.lit(" items about "), top_tags, F.lit(" ("),
        F.date_format("first_seen", "MMM dd"), F.lit(" – "), F.date_format("last_seen", "MMM dd"),
        F.lit("). Breakdown: "), F.array_join(parts, ", "), F.lit("."),
    )


def thread_narratives(items: DataFrame, page: DataFrame) -> DataFrame:
    top = thread_top_items(items, page).groupBy("cluster_id").agg(
        F.array_sort(F.collect_list(F.struct("rn", "title", "summary", "significance", "tags"))).alias("top")
    )  # three members per thread at most
    j = page.join(top, "cluster_id", "left")
    return j.withColumn("narrative", _narrative(c("top"))).drop("top")


def thread_detail(items: DataFrame, signals: DataFrame, *, cluster_id: str, as_of: Column) -> DataFrame:
    """One summary row; empty when the thread has fewer than two processed members."""
    rows = items.where(fl.processed() & (c("cluster_id") == cluster_id))
    up = signal_counts(signals).select(c("item_id").alias("id"), "upvotes")
    g = rows.join(up, "id", "left").groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("item_count"), F.min("created_at").alias("first_seen"),
        F.max("created_at").alias("last_seen"), F.avg(F.coalesce("relevance_score", F.lit(0.0))).alias("avg_relevance"),
        F.coalesce(F.sum("upvotes"), F.lit(0)).alias("total_upvotes"),
        F.min(sc.significance_rank(F.coalesce("significance", F.lit("informational")))).alias("_sev"),
    )
    g = g.where(c("item_count") >= 2)
    g = g.withColumn("recency_factor", F.when(c("last_seen") >= fl.days_back(as_of, 7), 2.0).otherwise(1.0))
    g = g.withColumn("dominant_significance", F.get(F.array(*map(F.lit, vocab.SIGNIFICANCES)), c("_sev"))).drop("_sev")
    return thread_narratives(items, g).withColumn(
        "momentum_score", sc.half_up(F.least(F.lit(1.0), raw_momentum() / 10.0), 4)
    )


def thread_members(items: DataFrame, *, cluster_id: str) -> DataFrame:
    return items.where(fl.processed() & (c("cluster_id") == cluster_id)).orderBy(F.desc("created_at"), "id")
