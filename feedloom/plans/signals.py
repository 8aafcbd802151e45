"""Reader signals: upsert, counts, contrarian labels, source tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from feedloom import vocab
from feedloom.operators import filters as fl
from feedloom.operators.skew import latest_per_key


def upsert_signals(log: DataFrame) -> DataFrame:
    """One row per (item, key): the last action by (created_at, event_id)."""
    last = latest_per_key(log, ["item_id", "api_key_id"], ["created_at", "event_id"])
    return last.select("item_id", "api_key_id", "action", "created_at")


def signal_counts(signals: DataFrame) -> DataFrame:
    def n(action):
        return F.count_if(F.col("action") == action)

    return signals.groupBy("item_id").agg(
        n("upvote").alias("upvotes"), n("bookmark").alias("bookmarks"), n("dismiss").alias("dismissals"),
        F.count(F.lit(1)).alias("total"),
    )


def contrarian_signals(items: DataFrame, signals: DataFrame, min_total: int = 10) -> DataFrame:
    """Warning labels for every item with enough signals; all five actions count towards the total."""
    c = signal_counts(signals).where(F.col("total") >= min_total)
    j = items.select("id", "tags", "significance").join(c, F.col("id") == F.col("item_id"))
    rate = F.col("dismissals") / F.col("total")
    labels = F.array_compact(
        F.array(
            F.when(rate > 0.6, F.lit("adoption_risk")),
            F.when((F.col("upvotes") > 10) & (F.col("dismissals") >= F.col("upvotes")), F.lit("hype_gap")),
            F.when(fl.notable() & (rate > 0.4), F.lit("regression")),
            F.when(F.array_contains("tags", "security") & (rate > 0.3), F.lit("security_concern")),
        )
    )
    return j.select(
        "id", "upvotes", "bookmarks", "dismissals", "total",
        F.when(F.size(labels) > 0, labels).alias("contrarian_signals"),
    )


def source_tier_adjustment(
    sources: DataFrame, items: DataFrame, signals: DataFrame, *, as_of, days: int = 30, min_total: int = 10
) -> DataFrame:
    """New tier per active source with enough recent signals; promotion and demotion saturate at the ends."""
    recent = signals.where(F.col("created_at") > fl.days_back(as_of, days))
    per_item = signal_counts(recent)
    per_source = (
        items.select("id", "source_id")
        .join(per_item, F.col("id") == F.col("item_id"))
        .groupBy("source_id")
        .agg(
            F.sum("upvotes").alias("positive"), F.sum("dismissals").alias("negative"), F.sum("total").alias("total")
        )
        .where(F.col("total") >= min_total)
    )
    active = sources.where("is_active").select(F.col("id").alias("source_id"), "tier")
    order = F.array(*map(F.lit, vocab.TIER_ORDER))
    at = F.array_position(order, F.col("tier"))
    step = (
        F.when(F.col("negative") / F.col("total") > 0.5, -1)
        .when(F.col("positive") / F.col("total") > 0.7, 1)
        .otherwise(0)
    )
    to = F.greatest(F.lit(1), F.least(F.lit(len(vocab.TIER_ORDER)), at + step))
    return per_source.join(active, "source_id").select(
        "source_id", "tier", "positive", "negative", "total", F.element_at(order, to.cast("int")).alias("new_tier")
    )


def library_counters(log: DataFrame) -> DataFrame:
    """Counters per slug from a log of (slug, action, created_at)."""
    helpful = F.col("action") == "helpful"
    return log.groupBy("slug").agg(
        F.count_if(helpful).alias("helpful_count"),
        F.max(F.when(helpful, F.col("created_at"))).alias("last_confirmed_at"),
        F.bool_or(F.col("action") == "outdated").alias("flagged_outdated"),
    )
