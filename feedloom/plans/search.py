"""Text, hybrid and routed search.

Each takes a stored ``TextIndex`` of the items (``index``): words, phrases and content lengths then come from posting
lists, and the items are read without their texts. Without one, the texts are scanned. Both give the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom import vocab
from feedloom.functions import scores as sc
from feedloom.functions import text as tx
from feedloom.functions import vectors as vx
from feedloom.operators import filters as fl
from feedloom.operators import rank as rk
from feedloom.operators import text_match as tm
from feedloom.operators.text_index import Query, TextIndex
from feedloom.session import cut_lineage

c = F.col
MIN_RANK = 0.001  # fixed value
SHOWN = [
    "id", "title", "url", "summary", "primary_type", "tags", "relevance_score", "quality_score", "significance",
    "created_at", "published_at", "cluster_id",
]
WEIGHTS = {"semantic": 0.25, "fulltext": 0.35, "quality": 0.35, "freshness": 0.05}  # fixed values, sum 1
RRF_K = 60
CANDIDATES = 50


def search_filters(*, as_of, types=None, tag=None, significance=None, days=None, source=None) -> Column:
    return fl.all_of(
        fl.processed(), fl.is_in("primary_type", types), fl.is_in("significance", significance),
        fl.is_in("source_id", [source] if source else None), fl.has_all_tags([tag]) if tag else None,
        fl.recent(as_of, days, c("created_at")) if days else None,
    )


def _finish(page: DataFrame, rank: str, limit: int) -> DataFrame:
    """Clusters collapsed, one row per url without fragment, trimmed."""
    return rk.dedup_base_url(rk.collapse_clusters(page, rank)).orderBy("pos").limit(limit)


# ---- text only ---------------------------------------------------------------------------


def _decay(as_of: Column) -> Column:
    return sc.half_life_decay(sc.event_ts(), as_of) * (0.5 + 0.5 * F.coalesce(c("quality_score"), F.lit(0.5)))


def text_branches(as_of: Column, cond: Column, narrow: Column | None = None) -> list[tuple[Column, Column, bool]]:
    """(admission, factor of the text rank, whether all words must match) of the strict path (all words) and the wide path
    (any word, more relevance, left out of the rank)."""
    decay = _decay(as_of)
    ok = cond if narrow is None else cond & narrow
    strict = ok & (c("relevance_score") >= 0.60), F.coalesce(c("relevance_score"), F.lit(0.5)) * decay, True
    return [strict, (ok & (c("relevance_score") >= 0.65), decay, False)]


def admitted(items: DataFrame, index: TextIndex, cond: Column, *more: Column) -> DataFrame:
    """The items that pass ``cond`` and the search hygiene, as their id and place in the index and ``more``. Texts are not
    read; an item that is not in the index does not appear."""
    rows = items.drop("content", "excerpt").where(cond).join(index.documents(), "id").where(fl.search_hygiene(chars=c("chars")))
    return rows.select("id", "ord", "block", *more)


def indexed_page(items: DataFrame, index: TextIndex, q: str, base: Column, branches: list[tuple[Column, Column, bool]], n: int, offset: int = 0) -> DataFrame:
    """``branched_page`` from posting lists: the branches' best rows by id, then their shown columns."""
    factors = [F.when(ok, factor).alias(f"_f{i}") for i, (ok, factor, _) in enumerate(branches)]
    kept = [F.coalesce(ok, F.lit(False)).alias(f"_ok{i}") for i, (ok, _, _) in enumerate(branches)]
    rows = cut_lineage(admitted(items, index, base, *factors, *kept))
    pages = None
    for i, (_, _, every) in enumerate(branches):
        top = index.top(q, rows.where(f"_ok{i}").select("id", "ord", "block", c(f"_f{i}").alias("factor")), offset + n, every)
        top = top.select("id", F.lit(i).alias("branch"), c("score").alias("rank"))
        pages = top if pages is None else pages.unionByName(top)
    order = Window.partitionBy("branch").orderBy(F.desc("rank"), F.asc("id"))
    pages = pages.withColumn("pos", F.row_number().over(order)).where(c("pos") > offset)
    return items.select(*SHOWN).join(pages, "id").select(*SHOWN, "branch", "rank", "pos")


def text_page(items: DataFrame, index: TextIndex | None, q: str, base: Column, branches: list[tuple[Column, Column, bool]], n: int, offset: int = 0) -> DataFrame:
    if index is not None:
        return indexed_page(items, index, q, base, branches, n, offset)
    rank = tm.text_rank(q)
    scanned = [(ok & (tm.match_all(q) if every else tm.match_any(q)), rank * factor) for ok, factor, every in branches]
    return branched_page(items, base & fl.search_hygiene(), scanned, n, offset)


def branched_page(items: DataFrame, base: Column, branches: list[tuple[Column, Column]], n: int, offset: int = 0) -> DataFrame:
    """Top rows of several result lists in one scan: columns SHOWN, branch, rank, pos.

    Each list is cut to its first rows inside the map tasks (window group limit), so the lists stay small at any scale.
    """
    entries = F.array_compact(
        F.array(*[F.when(ok, F.struct(F.lit(i).alias("branch"), sc.stable(rank).alias("rank"))) for i, (ok, rank) in enumerate(branches)])
    )
    rows = items.where(base).select(*SHOWN, F.explode(entries).alias("_e")).select(*SHOWN, "_e.branch", "_e.rank")
    top = rk.top_per_group(rows, ["branch"], [F.desc("rank"), F.asc("id")], offset + n, "pos")
    return top.where(c("pos") > offset) if offset else top


def row_count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def merge_branches(page: DataFrame, first: int, second: int, n: int, fewer_than: int = 3) -> DataFrame:
    """The first list, followed by the second one when the first has too few rows; ``page`` holds two short lists."""
    whole = Window.orderBy("branch", "pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = page.where(c("branch").isin(first, second)).withColumn("_n", F.count_if(c("branch") == first).over(whole))
    p = p.where((c("branch") == first) | (c("_n") < fewer_than)).drop("_n")
    kept = p.groupBy("id").agg(F.min_by(F.struct(*[c(x) for x in p.columns]), F.struct("branch", "pos")).alias("r")).select("r.*")
    out = kept.withColumn("pos", F.row_number().over(Window.orderBy("branch", "pos")))
    return out.where(c("pos") <= n).drop("branch")


def text_confidence(page: DataFrame, min_rank: float = MIN_RANK) -> DataFrame:
    """Empties a page whose first row ranks below the floor and flags one of little relevance."""
    whole = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = page.withColumn("_first", F.first("rank").over(whole)).withColumn("_mean", F.avg(F.coalesce(c("relevance_score"), F.lit(0.0))).over(whole))
    return p.where(F.coalesce(c("_first"), F.lit(0.0)) >= min_rank).withColumn("out_of_scope", c("_mean") < 0.3).drop("_first", "_mean")


def text_search(items: DataFrame, *, q: str, as_of: Column, limit: int = 20, offset: int = 0, index: TextIndex | None = None, **filters) -> DataFrame:
    """All words must match; when fewer than three rows do, rows matching any word follow."""
    cond = search_filters(as_of=as_of, **filters)
    page = text_page(items, index, q, cond, text_branches(as_of, F.lit(True)), limit * 3, offset)
    return text_confidence(_finish(merge_branches(page, 0, 1, limit * 3), "rank", limit))


def text_total(items: DataFrame, *, q: str, as_of: Column, index: TextIndex | None = None, **filters) -> DataFrame:
    """(total): all rows that ``text_search`` pages through: those with all words, and when fewer than three have all,
    those with any."""
    cond = search_filters(as_of=as_of, **filters)
    strict, wide = (ok for ok, _, _ in text_branches(as_of, F.lit(True)))
    if index is None:
        ok, every, some = items.where(cond & fl.search_hygiene()), tm.match_all(q), tm.match_any(q)
    else:
        ok = admitted(items, index, cond, "relevance_score").join(index.matches(Query.of(q)), "ord")
        every, some = c("every"), c("some")
    every, some = F.coalesce(strict & every, F.lit(False)), F.coalesce(wide & some, F.lit(False))
    n = ok.agg(F.count_if(every).alias("every"), F.count_if(every | some).alias("some"))
    return n.select(F.when(c("every") < 3, c("some")).otherwise(c("every")).alias("total"))


# ---- hybrid ------------------------------------------------------------------------------


def candidate_lists(items: DataFrame, q: str, query_vec, cond: Column, index: TextIndex | None) -> tuple[DataFrame, DataFrame]:
    """The nearest and the best matching 50 rows: columns SHOWN and ``_key``, ascending."""
    distance = sc.stable(vx.distance_to(c("embedding"), query_vec)).alias("_key")
    if index is None:
        ok = items.where(cond & fl.search_hygiene())
        near = ok.where(c("embedding").isNotNull()).select(*SHOWN, distance)
        return near, ok.where(tm.match_all(q)).select(*SHOWN, sc.stable(-tm.text_rank(q)).alias("_key"))
    rows = cut_lineage(admitted(items, index, cond, F.lit(1.0).alias("factor")))
    near = items.where(c("embedding").isNotNull()).join(rows.select("id"), "id", "left_semi").select(*SHOWN, distance)
    words = index.top(q, rows, CANDIDATES).select("id", (-c("score")).alias("_key"))
    return near, items.select(*SHOWN).join(words, "id")


def hybrid_page(items: DataFrame, q: str, query_vec, cond: Column, limit: int, offset: int, index: TextIndex | None = None) -> DataFrame:
    """Four ranked lists fused. The two scans keep 50 rows each; ranking and fusing happens on at most 100."""
    near, words = candidate_lists(items, q, query_vec, cond, index)
    semantic = rk.top_positions(near, [F.asc("_key"), F.asc("id")], CANDIDATES)
    fulltext = rk.top_positions(words, [F.asc("_key"), F.asc("id")], CANDIDATES)
    # each list is computed once: the union of at most 100 rows carries both places, everything else follows from it
    none = F.lit(None).cast("int")
    union = semantic.select(*SHOWN, c("pos").alias("s"), none.alias("f")).unionByName(
        fulltext.select(*SHOWN, none.alias("s"), c("pos").alias("f"))
    )
    row = F.struct(*[c(x) for x in SHOWN])
    both = union.groupBy("id").agg(F.any_value(row).alias("r"), F.max("s").alias("s"), F.max("f").alias("f")).select("r.*", "s", "f")
    by_quality = Window.orderBy(F.desc(F.coalesce("quality_score", F.lit(0.0))), "id")
    by_time = Window.orderBy(F.desc(sc.event_ts()), "id")
    both = both.withColumn("u", F.row_number().over(by_quality)).withColumn("t", F.row_number().over(by_time))

    def part(place, name):
        return F.lit(WEIGHTS[name]) * F.coalesce(1.0 / (RRF_K + c(place)), F.lit(0.0))

    score = part("s", "semantic") + part("f", "fulltext") + part("u", "quality") + part("t", "freshness")
    rows = both.select(*SHOWN, sc.stable(score, 8).alias("rank"))
    return rk.top_positions(rows, [F.desc("rank"), F.asc("id")], limit * 3, offset)


def candidate_total(items: DataFrame, *, q: str, query_vec, as_of: Column, index: TextIndex | None = None, **filters) -> DataFrame:
    """Distinct candidates of the two lists before fusing."""
    near, words = candidate_lists(items, q, query_vec, search_filters(as_of=as_of, **filters), index)
    parts = [part.select("id", "_key").orderBy("_key", "id").limit(CANDIDATES).select("id") for part in (near, words)]
    return parts[0].union(parts[1]).agg(F.countDistinct("id").alias("total"))


def search_confidence(page: DataFrame, fulltext_count: Column) -> DataFrame:
    """Empties a page nobody should trust (few text matches, or weak relevance on top) and flags weak ones."""
    whole = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rel = F.coalesce(c("relevance_score"), F.lit(0.0))
    place = F.row_number().over(Window.orderBy("pos"))
    p = page.withColumn("_place", place)
    p = p.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn(
        "_top", F.avg(F.when(c("_place") <= 5, rel)).over(whole)
    ).withColumn("_mean", F.avg(rel).over(whole))
    low = (fulltext_count < 3) | ((c("_n") >= 3) & (c("_top") < 0.60))
    return p.where(~low).withColumn("out_of_scope", c("_mean") < 0.3).drop("_place", "_n", "_top", "_mean")


def matching(items: DataFrame, q: str, cond: Column, index: TextIndex | None) -> DataFrame:
    """The items that pass ``cond`` and hold all words."""
    if index is None:
        return items.where(cond & tm.match_all(q))
    return items.drop("content", "excerpt").where(cond).join(index.hits(q).where("every").select("id"), "id", "left_semi")


def fulltext_count(items: DataFrame, q: str, cond: Column, index: TextIndex | None = None) -> Column:
    return row_count(matching(items, q, cond, index))


def hybrid_search(
    items: DataFrame, *, q: str, query_vec, as_of: Column, limit: int = 20, offset: int = 0, index: TextIndex | None = None, **filters
) -> DataFrame:
    cond = search_filters(as_of=as_of, **filters)
    page = _finish(hybrid_page(items, q, query_vec, cond, limit, offset, index), "rank", limit)
    return search_confidence(page, fulltext_count(items, q, cond, index))


# ---- routed ------------------------------------------------------------------------------


def detect_intent(q: str) -> dict:
    """Filters implied by one query string (driver side twin of the column functions)."""
    out = {}
    if re.search(vocab.INTENT_TYPE_PATTERN, q):
        out["types"] = ["tool"]
    if re.search(vocab.INTENT_BREAKING_PATTERN, q):
        out["significance"] = ["breaking"]
    return out


def routed_search(
    items: DataFrame, *, q: str, as_of: Column, query_vec=None, limit: int = 20, offset: int = 0, index: TextIndex | None = None, **filters
) -> DataFrame:
    """Search with the filters the query implies; without them when that leaves fewer than three rows."""
    implied = {k: v for k, v in detect_intent(q).items() if not filters.get(k)}
    given = search_filters(as_of=as_of, **filters)
    narrow = fl.all_of(fl.is_in("primary_type", implied.get("types")), fl.is_in("significance", implied.get("significance")))
    if query_vec is None:
        return _routed_text(items, q, as_of, given, narrow if implied else None, limit, offset, index)
    first = hybrid_page(items, q, query_vec, given & narrow, limit, offset, index)
    if not implied:
        return search_confidence(_finish(first, "rank", limit), fulltext_count(items, q, given, index))
    # at most limit * 3 rows each; which of the two counts is decided on these rows
    second = hybrid_page(items, q, query_vec, given, limit, offset, index)
    both = first.withColumn("branch", F.lit(0)).unionByName(second.withColumn("branch", F.lit(1)))
    whole = Window.orderBy("branch", "pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = both.withColumn("_few", F.count_if(c("branch") == 0).over(whole) < 3)
    chosen = both.where(F.when(c("_few"), c("branch") == 1).otherwise(c("branch") == 0))
    out = _finish(chosen.drop("branch"), "rank", limit)
    matches = matching(items, q, given, index).agg(F.struct(F.count_if(narrow).alias("narrow"), F.count(F.lit(1)).alias("wide")).alias("m")).scalar()
    return search_confidence(out, F.when(c("_few"), matches["wide"]).otherwise(matches["narrow"])).drop("_few")


def _routed_text(items: DataFrame, q: str, as_of: Column, given: Column, narrow: Column | None, limit: int, offset: int, index: TextIndex | None = None) -> DataFrame:
    n = limit * 3
    branches = text_branches(as_of, F.lit(True))
    if narrow is None:
        page = text_page(items, index, q, given, branches, n, offset)
        return text_confidence(_finish(merge_branches(page, 0, 1, n), "rank", limit))
    page = text_page(items, index, q, given, [*text_branches(as_of, F.lit(True), narrow), branches[0]], n, offset)
    first = merge_branches(page, 0, 1, n).withColumn("branch", F.lit(0))
    both = first.unionByName(page.where(c("branch") == 2))
    whole = Window.orderBy("branch", "pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = both.withColumn("_few", F.count_if(c("branch") == 0).over(whole) < 3)
    chosen = both.where(F.when(c("_few"), c("branch") == 2).otherwise(c("branch") == 0))
    return text_confidence(_finish(chosen.drop("branch", "_few"), "rank", limit))


def library_hits(library: DataFrame, *, q: str, limit: int = 3) -> DataFrame:
    """Knowledge entries shown beside search results: topic 10, title 5, tldr 2 per word."""
    words = tx.text_terms(q)
    weights = {"topic_path": 10, "title": 5, "tldr": 2}
    rows = library.where((c("status") == "active") & c("is_current") & fl.substring_match(words, list(weights)))
    rows = rows.withColumn("match_score", fl.substring_score(words, weights))
    return rows.orderBy(F.desc("match_score"), "slug").limit(limit)
