"""Joins shared by several plans. No broadcast hints: adaptive execution broadcasts a side it has measured to be small
and otherwise runs a sort-merge join with skewed partitions split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom.functions import urls as ux


def one_per_key(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order: the unique side of a many-to-one join. The rank limit is applied
    inside the map tasks, so a key with very many rows shuffles one row per task."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_nth", first).where("_nth = 1").drop("_nth")


def with_source(items: DataFrame, sources: DataFrame, default_tier: str, columns=("tier", "type", "name")) -> DataFrame:
    """Left join on the source; ``tier`` falls back to the caller's default. Adds source_<column> columns."""
    s = sources.select(F.col("id").alias("source_id"), *[F.col(c).alias(f"source_{c}") for c in columns if c != "name"],
                       *([F.col("name").alias("source_label")] if "name" in columns else []))
    out = items.join(s, "source_id", "left")
    if "tier" in columns:
        out = out.withColumn("source_tier", F.coalesce("source_tier", F.lit(default_tier)))
    return out


def unseen_by_url(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose normalised url is unknown; within the batch the first row per url (by published, id) stays. Rows without
    a url are unseen; ids may be null."""
    b = batch.withColumn("_h", ux.url_hash(F.col("url")))
    first = F.row_number().over(Window.partitionBy("_h").orderBy("published_at", "id"))
    hashes = known.select(ux.url_hash(F.col("url")).alias("_h")).where(F.col("_h").isNotNull()).distinct()
    # the rank limit is applied inside the map tasks: a url of a third of the batch shuffles one row per task
    once = b.where(F.col("_h").isNotNull()).withColumn("_nth", first).where("_nth = 1").drop("_nth")
    return once.join(hashes, "_h", "left_anti").select(*batch.columns).unionByName(b.where(F.col("_h").isNull()).select(*batch.columns))


def without_delivery(items: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Items no alert was ever sent for."""
    return items.join(deliveries.select(F.col("intel_item_id").alias("id")).distinct(), "id", "left_anti")


SEEN_ACTIONS = ["read", "acted_on", "dismiss"]


def unread_for(items: DataFrame, signals: DataFrame, key_id: int) -> DataFrame:
    seen = signals.where((F.col("api_key_id") == key_id) & F.col("action").isin(*SEEN_ACTIONS))
    return items.join(seen.select(F.col("item_id").alias("id")).distinct(), "id", "left_anti")


def seen_pairs(signals: DataFrame) -> DataFrame:
    """Batch form of the same: (item, key) pairs to subtract from any per-key candidate list."""
    return signals.where(F.col("action").isin(*SEEN_ACTIONS)).select("item_id", "api_key_id").distinct()


def explode_tags(items: DataFrame, *keep: str) -> DataFrame:
    return items.select(*keep, F.explode("tags").alias("tag"))


def url_overlap(left: DataFrame, right: DataFrame, url: Column | None = None) -> DataFrame:
    """Rows of ``left`` whose normalised url also occurs in ``right`` (two sets that should be disjoint)."""
    u = F.col("url") if url is None else url
    known = right.select(ux.normalize_url(u).alias("_u")).distinct()
    return left.withColumn("_u", ux.normalize_url(u)).join(known, "_u", "left_semi").drop("_u")


def new_sources(candidates: DataFrame, sources: DataFrame, prefix: str = "github-deep:", min_stars: int | None = 50) -> DataFrame:
    """Tracking sources to create: one per repository that is popular enough and not tracked yet."""
    c = candidates if min_stars is None else candidates.where(F.col("stars") > min_stars)
    c = c.groupBy("repo").agg(F.max("stars").alias("stars"))
    c = c.withColumn("id", F.concat(F.lit(prefix), F.col("repo")))
    return c.join(sources.select("id"), "id", "left_anti").select(
        "id", F.concat("repo", F.lit(" (deep, auto-promoted)")).alias("name"),
        F.concat(F.lit("https://github.com/"), "repo").alias("url"), F.lit("tier2").alias("tier"),
        F.col("stars").alias("promoted_at_stars"),
    )
