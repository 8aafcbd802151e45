"""Ordering, collapsing and packing of result lists.

``pos`` is the 1-based position in the caller's order. It is only ever assigned after a LIMIT, so the unpartitioned
row_number below runs over at most that many rows. Winners per group are picked with ``max_by`` / ``min_by``: these
aggregate before the shuffle, so a cluster or url that holds a third of all rows costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom.functions import urls as ux


def top_positions(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """First ``limit`` rows in the given order (which must be total), numbered by ``pos``."""
    page = df.orderBy(*order)
    if offset:
        page = page.offset(offset)
    return page.limit(limit).withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def _winner(df: DataFrame, key: Column, order: Column, pick, **extra: Column) -> DataFrame:
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(key.alias("_key")).agg(pick(row, order).alias("_row"), *[v.alias(k) for k, v in extra.items()]).select(
        "_row.*", *extra.keys()
    )


def cluster_key() -> Column:
    return F.coalesce(F.concat(F.lit("c:"), F.col("cluster_id")), F.concat(F.lit("i:"), F.col("id")))


def collapse_clusters(df: DataFrame, rank: str = "relevance_score") -> DataFrame:
    """Best row per cluster at its own position; rows without a cluster stay; ``cluster_count`` is added."""
    order = F.struct(F.coalesce(F.col(rank), F.lit(0.0)).alias("r"), (-F.col("pos")).alias("p"))
    return _winner(df, cluster_key(), order, F.max_by, cluster_count=F.count(F.lit(1)))


def dedup_base_url(df: DataFrame) -> DataFrame:
    """First row per url without its fragment."""
    return _winner(df, ux.base_url_fragment(F.col("url")), F.col("pos"), F.min_by)


def diversify(df: DataFrame, type_column: str = "source_type", max_per_type: int = 5) -> DataFrame:
    """At most n rows per type, dealt round-robin; types take turns in order of first appearance."""
    key = F.coalesce(F.col(type_column), F.lit("unknown"))
    per_type = Window.partitionBy("_type")
    dealt = (
        df.withColumn("_type", key)
        .withColumn("slot", F.row_number().over(per_type.orderBy("pos")))
        .where(F.col("slot") <= max_per_type)
        .withColumn("_first", F.min("pos").over(per_type))
    )
    order = Window.orderBy("slot", "_first")
    return dealt.withColumn("pos", F.row_number().over(order)).drop("_type", "_first", "slot")


def dedup_briefing(df: DataFrame, rank: str = "relevance_score") -> DataFrame:
    """Cluster winners by relevance, then the best row per scheme://host/path, set at the group's first position."""
    winners = collapse_clusters(df, rank).drop("cluster_count")
    order = F.struct(F.coalesce(F.col(rank), F.lit(0.0)).alias("r"), (-F.col("pos")).alias("p"))
    best = _winner(winners, ux.base_url_path(F.col("url")), order, F.max_by, _first=F.min("pos"))
    return best.withColumn("pos", F.col("_first")).drop("_first")


def pack_budget(df: DataFrame, length: Column, budget_chars: int, keys: list[str] | None = None) -> DataFrame:
    """Rows in ``pos`` order while their running length fits; the first row always; stop at the first overflow.

    Every block has at least one character, so no more than ``budget_chars`` rows per key can ever fit. That bound is
    applied first as a rank limit, which Spark evaluates before the shuffle: a hot key never reaches one task whole.
    """
    keys = keys or []
    w = Window.partitionBy(*keys).orderBy("pos") if keys else Window.orderBy("pos")
    sized = df.withColumn("block_chars", F.greatest(length, F.lit(1)).cast("long"))
    if keys:
        sized = sized.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max(budget_chars, 1))
    else:
        sized = sized.withColumn("_rn", F.row_number().over(w))
    run = sized.withColumn("running_chars", F.sum("block_chars").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # running length is increasing, so "before the first overflow" is the same as "fits"
    return run.where((F.col("running_chars") <= budget_chars) | (F.col("_rn") == 1)).drop("_rn")


def merge_in_order(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All of ``first`` in its order, then the rows of ``second`` not seen yet; ``pos`` is renumbered."""
    both = first.withColumn("branch", F.lit(0)).unionByName(second.withColumn("branch", F.lit(1)))
    kept = _winner(both, F.col(key), F.struct("branch", "pos"), F.min_by)
    return kept.withColumn("pos", F.row_number().over(Window.orderBy("branch", "pos")))


def reciprocal_rank_merge(lists: list[tuple[DataFrame, float]], k: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion of (id, rn) lists: one union and one aggregation instead of outer joins."""
    parts = [df.select("id", (F.lit(weight) / (F.lit(k) + F.col("rn"))).alias("part")) for df, weight in lists]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("id").agg(F.sum("part").alias("rank_score"))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """row_number <= n; Spark limits each group inside the map task before shuffling (window group limit)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
