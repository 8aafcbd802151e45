"""Trends, tag and type counts, landscapes, digests, deltas and action items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom import vocab
from feedloom.functions import profile as pf
from feedloom.functions import scores as sc
from feedloom.operators import filters as fl
from feedloom.operators import joins as jn
from feedloom.operators import rank as rk

c = F.col


def tag_trends(items: DataFrame, *, as_of: Column, days: int = 14, min_count: int = 3, limit: int = 20) -> DataFrame:
    """Tags by velocity between the two halves of the window, damped for tags of fewer than five sources."""
    rows = items.where(fl.processed() & fl.recent(as_of, days))
    t = jn.explode_tags(rows.withColumn("_new", fl.recent(as_of, days / 2.0)), "source_id", "_new")
    g = t.groupBy("tag").agg(
        F.count_if("_new").alias("window_1_count"), F.count_if(~c("_new")).alias("window_2_count"),
        F.count(F.lit(1)).alias("total_count"), F.countDistinct("source_id").alias("source_count"),
    ).where(c("total_count") >= min_count)
    ratio = c("window_1_count") / F.nullif(c("window_2_count"), F.lit(0))
    out = g.withColumn("velocity_ratio", F.when(c("window_2_count") == 0, F.when(c("window_1_count") > 0, 99.0)).otherwise(
        sc.half_up(ratio, 2)))
    order_key = F.when(c("window_2_count") == 0, F.when(c("window_1_count") > 0, 99.0).otherwise(-1.0)).otherwise(ratio)
    out = out.withColumn("weight", sc.stable(order_key * F.least(c("source_count"), F.lit(5)) / 5.0))
    out = out.orderBy(F.desc("weight"), "tag").limit(limit)
    return out.withColumn("velocity_label", sc.velocity_label(c("velocity_ratio")))


def guard_history(trends: DataFrame) -> DataFrame:
    """Empty when no tag of the page has an older half to compare with (the page is at most ``limit`` rows)."""
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return trends.withColumn("_old", F.max("window_2_count").over(whole)).where(c("_old") > 0).drop("_old")


def trends(items: DataFrame, *, as_of: Column, days: int = 14, min_count: int = 3, limit: int = 20) -> DataFrame:
    return guard_history(tag_trends(items, as_of=as_of, days=days, min_count=min_count, limit=limit))


def tag_counts(items: DataFrame, min_count: int = 1) -> DataFrame:
    t = jn.explode_tags(items.where(fl.processed()))
    return t.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where(c("n") >= min_count)


def tag_page(items: DataFrame, *, min_count: int = 1, limit: int = 100, offset: int = 0) -> DataFrame:
    return tag_counts(items, min_count).orderBy(F.desc("n"), "tag").offset(offset).limit(limit)


def type_counts(items: DataFrame) -> DataFrame:
    return items.where(fl.processed()).groupBy("primary_type").agg(F.count(F.lit(1)).alias("n"))


def topic_label(tag: Column) -> Column:
    from feedloom.functions.text import literal_map

    return F.coalesce(literal_map(vocab.TOPIC_LABELS)[tag], F.initcap(F.replace(tag, F.lit("-"), F.lit(" "))))


def topic_index(items: DataFrame, *, min_items: int = 3, limit: int = 50) -> DataFrame:
    t = jn.explode_tags(items.where(fl.processed()), "quality_score", "relevance_score", "created_at")
    g = t.groupBy("tag").agg(
        F.count(F.lit(1)).alias("item_count"),
        sc.stable(F.avg(c("quality_score") * c("relevance_score")), 4).alias("avg_quality"),
        F.max("created_at").alias("last_updated"),
    ).where(c("item_count") >= min_items)
    g = g.orderBy(F.desc("avg_quality"), F.desc("item_count"), "tag").limit(limit)
    # sub-topics: the other tags of the first group the tag belongs to, unless it is the group's own name
    subs = F.lit(None).cast("array<string>")
    for name, members in reversed(vocab.TAG_GROUPS.items()):
        others = F.array_remove(F.array(*map(F.lit, members)), c("tag"))
        subs = F.when(c("tag").isin(*members) & (c("tag") != name), others).otherwise(subs)
    return g.withColumn("label", topic_label(c("tag"))).withColumn("subtopics", subs)


def topic_frequency(items: DataFrame, *, limit: int = 50) -> DataFrame:
    """Most frequent tags that are not bare type names."""
    t = jn.explode_tags(items.where(fl.processed()), "source_id").where(~c("tag").isin(*vocab.PRIMARY_TYPES))
    g = t.groupBy("tag").agg(F.count(F.lit(1)).alias("tag_count"), F.countDistinct("source_id").alias("source_count"))
    return g.orderBy(F.desc("tag_count"), "tag").limit(limit)


# ---- landscape ---------------------------------------------------------------------------


def _domain(items: DataFrame, domain: str, as_of: Column, days: int) -> DataFrame:
    return items.where(fl.processed() & fl.recent(as_of, days, c("created_at")) & F.array_contains("tags", domain))


def landscape_leaders(items: DataFrame, *, domain: str, as_of: Column, days: int = 30, limit: int = 20) -> DataFrame:
    """Significance here is the most severe one of the group, not the alphabetically last."""
    d = _domain(items, domain, as_of, days)
    recency = F.when(fl.recent(as_of, 7, c("created_at")), 2).otherwise(1)
    sig = c("significance")
    weight = recency * F.when(sig == "breaking", 8).when(sig == "major", 4).otherwise(1)
    g = d.groupBy("title", "url", "primary_type", "source_name").agg(
        F.max("relevance_score").alias("relevance_score"),
        F.min(sc.significance_rank(sig)).alias("_sev"),
        F.count(F.lit(1)).alias("item_count"), F.sum(weight).alias("momentum_weight"),
    )
    names = F.array(*map(F.lit, vocab.SIGNIFICANCES))
    g = g.withColumn("significance", F.get(names, c("_sev"))).drop("_sev")
    return g.orderBy(F.desc("momentum_weight"), F.desc("relevance_score"), "url", "title").limit(limit)


def landscape_positioning(items: DataFrame, *, domain: str, as_of: Column, days: int = 30) -> DataFrame:
    return _domain(items, domain, as_of, days).groupBy("primary_type").agg(F.count(F.lit(1)).alias("n"))


def landscape_gaps(items: DataFrame, *, domain: str, as_of: Column, days: int = 30) -> DataFrame:
    """Types the domain has nothing of."""
    known = items.sparkSession.createDataFrame([(t,) for t in vocab.PRIMARY_TYPES], "primary_type string")
    present = landscape_positioning(items, domain=domain, as_of=as_of, days=days)
    return known.join(present, "primary_type", "left_anti")


# ---- digests and deltas ------------------------------------------------------------------

DIGEST = ["id", "title", "url", "summary", "primary_type", "relevance_score", "significance", "created_at"]


def digest(items: DataFrame, *, as_of: Column, days: int = 7, per_group: int = 10) -> DataFrame:
    rows = items.where(fl.processed() & fl.recent(as_of, days, c("created_at"))).select(*DIGEST)
    return rk.top_per_group(rows, ["primary_type"], [F.desc("relevance_score"), F.asc("id")], per_group)


def severity_order() -> list[Column]:
    return [F.asc("severity"), F.desc("relevance_score"), F.asc("id")]


DELTA = [
    "id", "title", "url", "excerpt", "summary", "primary_type", "tags", "relevance_score", "significance",
    "source_name", "published_at", "created_at",
]


def _delta_rows(items: DataFrame, cutoff: Column, tag, group, significance) -> DataFrame:
    cond = fl.all_of(
        fl.processed(), fl.since(cutoff),
        fl.has_all_tags([tag]) if tag else None,
        fl.has_any_tag(vocab.TAG_GROUPS[group]) if not tag and group in vocab.TAG_GROUPS else None,
        fl.is_in("significance", significance),
    )
    return items.where(cond).select(*DELTA).withColumn("severity", sc.significance_rank(c("significance")))


def diff(
    items: DataFrame, *, profile: dict, as_of: Column, cursor: Column | None = None, days: int = 7, tag=None, group=None,
    significance=None, limit: int = 20, offset: int = 0,
) -> DataFrame:
    """What is new for one profile since its cursor (or for the last days); empty without interest tags."""
    interest = pf.expand_profile(profile)
    cutoff = cursor if cursor is not None else fl.days_back(as_of, days)
    rows = _delta_rows(items, cutoff, tag, group, significance)
    rows = rows.where(fl.has_any_tag(interest) if interest else F.lit(False))
    page = rk.top_positions(rows, severity_order(), limit, offset)
    return page.withColumn("impact", sc.impact_label(c("significance")))


def diff_all(
    items: DataFrame, profiles: DataFrame, *, as_of: Column, days: int = 7, limit: int = 20
) -> DataFrame:
    """The same page for every profile at once.

    An item on a user's page is also among the first ``limit`` of each of its tags the user follows, so only that many
    rows per tag are kept (inside the map tasks). Users of the same tags have the same page: it is made once for each set
    of tags, and the users meet whole pages only. Rows of one user are one profile.
    """
    rows = _delta_rows(items, fl.days_back(as_of, days), None, None, None)
    keep = ["id", "severity", "relevance_score"]
    heads = rk.top_per_group(jn.explode_tags(rows, *keep), ["tag"], severity_order(), limit, "_tag_rn").drop("_tag_rn")
    wants = profiles.select("user_id", F.explode(pf.profile_tags(c("profile"))).alias("tag"))
    users = wants.groupBy("user_id").agg(F.array_sort(F.collect_set("tag")).alias("_tags"))
    sets = users.select("_tags").distinct().select("_tags", F.explode("_tags").alias("tag"))
    pairs = sets.join(heads, "tag").select("_tags", *keep).distinct()
    pages = rk.top_per_group(pairs, ["_tags"], severity_order(), limit, "pos")
    pages = pages.groupBy("_tags").agg(F.collect_list(F.struct(*keep, "pos")).alias("_page"))
    return users.join(pages, "_tags").select("user_id", F.inline("_page"))


def action_items(
    items: DataFrame, signals: DataFrame, sources: DataFrame, *, key_id: int, as_of: Column, profile: dict | None = None,
    limit: int = 5,
) -> DataFrame:
    """Breaking and major items of the last week the key has not dealt with; limited first, clusters collapsed after."""
    interest = pf.expand_profile(profile)
    rows = items.where(
        fl.all_of(fl.processed(), fl.recent(as_of, 7), fl.notable(), fl.has_any_tag(interest) if interest else None)
    ).select(*DELTA, "cluster_id", "source_id")
    rows = jn.unread_for(rows, signals, key_id)
    rows = jn.with_source(rows, sources, "tier3", ("name",)).withColumn("severity", sc.significance_rank(c("significance")))
    return rk.collapse_clusters(rk.top_positions(rows, severity_order(), limit), "relevance_score")


def result_quality(page: DataFrame, score: str = "relevance_score") -> DataFrame:
    """HIGH / MEDIUM / LOW of a result page from its mean positive score and size."""
    s = c(score)
    a = page.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(s > 0, s)).alias("mean"))
    label = (
        F.when(c("n") == 0, F.lit("LOW"))
        .when(c("mean").isNull(), F.when(c("n") >= 3, F.lit("HIGH")).otherwise(F.lit("MEDIUM")))
        .when((c("mean") >= 0.7) & (c("n") >= 3), F.lit("HIGH"))
        .when((c("mean") >= 0.4) | (c("n") >= 2), F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )
    return a.select("n", sc.stable(c("mean")).alias("mean"), label.alias("result_quality"))


def query_relevance(page: DataFrame, query: str) -> DataFrame:
    """Does any of the first three rows mention the query; an empty query or page counts as relevant."""
    hit = fl.mentions_any(query)
    top = page.where(c("pos") <= 3)
    return top.agg(F.coalesce(F.bool_or(hit if hit is not None else F.lit(True)), F.lit(True)).alias("relevant"))


def tldr(page: DataFrame, query: str) -> DataFrame:
    """One line on a result page: how many, how severe, and the first row's summary."""
    sig = F.coalesce(F.nullif(c("significance"), F.lit("")), F.lit("informational"))
    a = page.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(sig == "breaking").alias("b"), F.count_if(sig == "major").alias("m"),
        F.min_by(F.struct("title", "summary"), "pos").alias("top"),
    )
    parts = F.array_compact(
        F.array(
            F.when(c("b") > 0, F.concat(c("b"), F.lit(" breaking"))), F.when(c("m") > 0, F.concat(c("m"), F.lit(" major")))
        )
    )
    sev = F.when(F.size(parts) > 0, F.concat(F.lit(" ("), F.array_join(parts, ", "), F.lit(")"))).otherwise(F.lit(""))
    summary = F.coalesce(c("top.summary"), F.lit(""))
    # \z and not $, which also stands before a last line break: a whole word would go with it
    cut = F.concat(F.regexp_replace(F.substring(summary, 1, 120), r"\s+\S*\z", ""), F.lit("..."))
    lead = F.when(F.length(summary) > 10, cut).otherwise(F.coalesce(F.nullif(c("top.title"), F.lit("")), F.lit("untitled")))
    count = F.concat(c("n"), F.when(c("n") == 1, F.lit(" result")).otherwise(F.lit(" results")))
    text = F.when(c("n") == 0, F.lit(f'No results found for "{query}".')).otherwise(
        F.concat(F.lit("Found "), count, sev, F.lit(". Top: "), lead)
    )
    return a.select(text.alias("tldr"))
