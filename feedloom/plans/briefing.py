"""Token-budgeted briefings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom import vocab
from feedloom.functions import render as rd
from feedloom.functions import scores as sc
from feedloom.functions import vectors as vx
from feedloom.operators import filters as fl
from feedloom.operators import rank as rk
from feedloom.operators import text_match as tm
from feedloom.plans.search import row_count

c = F.col
CHARS_PER_TOKEN = 4
FETCH = 200
LIBRARY_FETCH = 20
SHOWN = [
    "id", "title", "url", "excerpt", "summary", "primary_type", "tags", "relevance_score", "quality_score", "significance",
    "source_name", "published_at", "created_at", "cluster_id",
]


def split_budget(budget: int, include_library: bool, library_budget: int = 0) -> tuple[int, int]:
    """(feed, library) tokens; the library takes 30 % unless told otherwise."""
    lib = library_budget if library_budget > 0 else int(budget * 0.30)
    return (budget - lib if include_library else budget), lib


def _ranked(rows: DataFrame, as_of: Column, sort: str, by_distance: bool) -> DataFrame:
    rows = rows.withColumn("rank", sc.stable(sc.briefing_rank(as_of)))
    order = [F.desc("rank"), F.asc("id")]
    if sort == "significance":
        order.insert(0, sc.significance_rank(c("significance")).asc())
    if by_distance:
        order.insert(0, F.asc("distance"))
    return rk.top_positions(rows, order, FETCH)


def briefing_items(
    items: DataFrame, *, as_of: Column, topic: str | None = None, topic_vec=None, budget: int = 2000, days: int = 14,
    sort: str = "significance", radius: float = 0.45,
) -> DataFrame:
    """Items of a briefing in order, packed into the budget.

    A topic is a tag group, a vector neighbourhood, or a tag; when it finds nothing, the text is searched instead.
    """
    rows = items.where(fl.all_of(fl.processed(), fl.recent(as_of, days), fl.briefing_admission(as_of)))
    by_distance = topic is not None and topic not in vocab.TAG_GROUPS and topic_vec is not None
    if by_distance:
        d = sc.stable(vx.distance_to(c("embedding"), topic_vec))
        wanted = rows.select(*SHOWN, d.alias("distance")).where(c("distance") < radius)
    else:
        wanted = (rows if topic is None else rows.where(fl.tags_or_group(topic))).select(*SHOWN, F.lit(0.0).alias("distance"))
    page = _ranked(wanted, as_of, sort, by_distance)
    if topic is not None:
        text = rows.where(tm.match_all(topic.replace("+", " "))).select(*SHOWN, F.lit(0.0).alias("distance"))
        page = page.unionByName(_ranked(text, as_of, sort, False).where(row_count(page) == 0))
    packed = rk.pack_budget(rk.dedup_briefing(page), F.length(rd.item_text()), budget * CHARS_PER_TOKEN)
    return packed.orderBy("pos")


def briefing_library(library: DataFrame, *, topic: str | None, budget: int) -> DataFrame:
    rows = library.where((c("status") == "active") & c("is_current"))
    if topic is not None:
        rows = rows.where(fl.tags_or_group(topic))
    rows = rows.select("slug", "title", "tldr", "key_points", "gotchas", "graduation_score", "helpful_count")
    page = rk.top_positions(rows, [F.desc("graduation_score"), F.desc("helpful_count"), F.asc("slug")], LIBRARY_FETCH)
    return rk.pack_budget(page, F.length(rd.library_text()), budget * CHARS_PER_TOKEN).orderBy("pos")


def _lead(item: Column) -> Column:
    return F.coalesce(F.nullif(item["summary"], F.lit("")), F.nullif(item["excerpt"], F.lit("")), item["title"], F.lit(""))


def _cut(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def bottom_line(selected: DataFrame, topic: str | None = None) -> DataFrame:
    a = selected.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c("significance") == "breaking").alias("b"),
        F.min_by(F.struct("summary", "excerpt", "title"), "pos").alias("top"),
    )
    on, for_ = (f" on {topic}", f" for {topic}") if topic else ("", "")
    lead = _lead(c("top"))
    lead = F.when(F.length(lead) > 200, F.concat(F.substring(lead, 1, 197), F.lit("..."))).otherwise(lead)
    note = F.when(c("b") > 0, F.concat(F.lit(" ("), c("b").cast("string"), F.lit(" breaking)"))).otherwise(F.lit(""))
    text = F.when(c("n") == 0, F.lit(f"No items found{for_}.")).otherwise(
        F.concat(lead, F.lit("\n\n"), c("n").cast("string"), F.lit(f" items{on}"), note, F.lit("."))
    )
    return a.select(text.alias("bottom_line"))


def compress_briefing(selected: DataFrame, *, max_bullets: int = 5) -> DataFrame:
    """(bullet_no, bullet): one per significance tier; by first tag when there is only one tier.

    ``selected`` is a packed briefing of at most a couple of hundred rows.
    """
    tier = F.lower(F.coalesce(F.nullif(c("significance"), F.lit("")), F.lit("informational")))
    known = F.when(tier.isin(*vocab.SIGNIFICANCES), tier).otherwise(F.lit("informational"))
    rows = selected.withColumn("_tier", known).withColumn("_tag", F.coalesce(F.get("tags", F.lit(0)), F.lit("general")))

    def grouped(key):
        w = Window.partitionBy(key).orderBy("pos")
        head = rows.withColumn("_rn", F.row_number().over(w))
        title = F.when(c("_rn") <= 3, F.struct("_rn", F.coalesce("title", F.lit("untitled")).alias("t")))
        return head.groupBy(c(key).alias("key")).agg(
            F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"),
            F.min_by(F.struct("summary", "excerpt", "title"), "pos").alias("top"),
            F.array_join(F.transform(F.array_sort(F.collect_list(title)), lambda s: s["t"]), "; ").alias("titles"),
        )

    tiers = grouped("_tier")
    n, lead = c("n").cast("string"), _cut(_lead(c("top")), 150)
    text = (
        F.when(c("key") == "breaking", F.concat(F.lit("BREAKING ("), n, F.lit("): "), lead))
        .when(c("key") == "major", F.concat(F.lit("Major update ("), n, F.lit(" items): "), lead))
        .otherwise(F.concat(n, F.lit(" "), c("key"), F.lit(": "), c("titles")))
    )
    by_tier = tiers.select(
        F.row_number().over(Window.orderBy(sc.significance_rank(c("key")))).alias("bullet_no"), text.alias("bullet")
    )
    tags = grouped("_tag")
    by_tag = tags.select(
        F.row_number().over(Window.orderBy(F.desc("n"), "first")).alias("bullet_no"),
        F.concat(n, F.lit(" on "), c("key"), F.lit(": "), c("titles")).alias("bullet"),
    )
    split = (row_count(tiers) <= 1) & (row_count(tags) > 1)
    both = by_tier.where(~split).unionByName(by_tag.where(split))
    return both.where(c("bullet_no") <= max_bullets)


def context_pack(
    items: DataFrame, library: DataFrame | None = None, *, as_of: Column, topic: str | None = None, topic_vec=None,
    budget: int = 2000, days: int = 14, sort: str = "significance", include_library: bool = False,
    library_budget: int = 0, radius: float = 0.45,
) -> DataFrame:
    """The briefing as ordered text blocks (part, pos, block): library entries first, then items."""
    feed_tokens, lib_tokens = split_budget(budget, include_library, library_budget)
    chosen = briefing_items(
        items, as_of=as_of, topic=topic, topic_vec=topic_vec, budget=feed_tokens, days=days, sort=sort, radius=radius
    )
    out = chosen.select(F.lit("item").alias("part"), "pos", rd.item_text().alias("block"))
    if include_library and library is not None:
        lib = briefing_library(library, topic=topic, budget=lib_tokens)
        out = lib.select(F.lit("library").alias("part"), "pos", rd.library_text().alias("block")).unionByName(out)
    return out
