"""Scores (Column -> Column). Nothing is rounded before the last step; rank on ``stable(score)`` then id."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from feedloom import vocab
from feedloom.functions import text as tx

DAY_US = 86_400_000_000


def stable(score: Column, digits: int = 6) -> Column:
    """Rounded score used in every ORDER BY, so that ties do not depend on the last bits of a double."""
    return F.round(score, digits)


def half_up(x: Column, digits: int) -> Column:
    """Half-up rounding of the decimal value: the last bits of a double are dropped first."""
    return F.round(F.round(x, 9), digits)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def age_days(ts: Column, as_of: Column) -> Column:
    """Age in fractional days."""
    return (F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(float(DAY_US))


def whole_days(ts: Column, as_of: Column) -> Column:
    return F.floor(age_days(ts, as_of)).cast("long")


def event_ts() -> Column:
    return F.coalesce(F.col("published_at"), F.col("created_at"))


# ---- freshness, authority, relevance -----------------------------------------------------


def authority(tier: Column) -> Column:
    return F.coalesce(tx.literal_map(vocab.TIER_AUTHORITY)[tier], F.lit(0.3))


def freshness(published: Column, as_of: Column, scale_days: float = 30.0) -> Column:
    """exp(-whole days / 30); unknown age scores .5 and the future scores 1."""
    days = F.greatest(whole_days(published, as_of), F.lit(0))
    return F.when(published.isNull(), F.lit(0.5)).otherwise(F.exp(-days / F.lit(scale_days)))


def relevance(content_match: Column, tier: Column, published: Column, as_of: Column) -> Column:
    mix = content_match * 0.65 + authority(tier) * 0.15 + freshness(published, as_of) * 0.20
    return clamp(mix, 0.0, 1.0)


def half_life_decay(ts: Column, as_of: Column, days: float = 7.0) -> Column:
    return F.exp(F.log(F.lit(0.5)) / F.lit(days) * age_days(ts, as_of))


def significance_rank(sig: Column) -> Column:
    return F.when(sig == "breaking", 0).when(sig == "major", 1).when(sig == "minor", 2).otherwise(3)


def profile_overlap(tags: Column, interest: list[str] | None) -> Column:
    """Share of the interest list found among the tags (a tag listed twice counts twice)."""
    if not interest:
        return F.lit(0.0)
    hits = F.size(F.filter(tags, lambda t: t.isin(*interest)))
    return F.coalesce(hits, F.lit(0)) / F.lit(float(len(interest)))


def composite_rank(tier: Column, as_of: Column, interest: list[str] | None = None) -> Column:
    tier_part = F.when(tier == "tier1", 1.0).when(tier == "tier2", 0.5).otherwise(0.2)
    return (
        0.40 * F.coalesce(F.col("relevance_score"), F.lit(0.5)) * half_life_decay(event_ts(), as_of)
        + 0.30 * F.coalesce(F.col("quality_score"), F.lit(0.5))
        + 0.20 * profile_overlap(F.col("tags"), interest)
        + 0.10 * tier_part
    )


def briefing_rank(as_of: Column) -> Column:
    return (
        F.coalesce(F.col("relevance_score"), F.lit(0.5))
        * half_life_decay(event_ts(), as_of)
        * (0.5 + 0.5 * F.coalesce(F.col("quality_score"), F.lit(0.5)))
    )


def evergreen_score(upvotes: Column, bookmarks: Column, as_of: Column) -> Column:
    sig = F.col("significance")
    bonus = F.when(sig == "breaking", 0.20).when(sig == "major", 0.15).when(sig == "minor", 0.05).otherwise(0.0)
    base = F.col("quality_score") * 0.35 + F.col("relevance_score") * 0.35 + F.col("confidence_score") * 0.10 + bonus
    boost = 1.0 + F.least(upvotes + bookmarks, F.lit(10)) * 0.05
    return base * boost * F.exp(F.lit(-0.693) * age_days(F.col("created_at"), as_of) / 90.0)


# ---- repository quality ------------------------------------------------------------------


def is_stale(pushed_at: Column, as_of: Column, days: int = 180) -> Column:
    return F.coalesce(whole_days(pushed_at, as_of) > days, F.lit(False))


def community_score(stars: Column, forks: Column, subscribers: Column) -> Column:
    def lg(c):
        return F.log10(F.greatest(F.lit(1), c).cast("double"))

    total = (
        F.least(F.lit(1.0), lg(stars) / 5.0)
        + F.least(F.lit(0.1), lg(forks) / 50.0)
        + F.least(F.lit(0.05), lg(subscribers) / 100.0)
    )
    return F.when((stars == 0) & (forks == 0), F.lit(0.0)).otherwise(half_up(F.least(F.lit(1.0), total), 3))


def security_score(findings: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - F.coalesce(F.size(findings), F.lit(0)) * 0.2)


def maintenance_score(pushed_at: Column, archived: Column, as_of: Column) -> Column:
    days = F.greatest(whole_days(pushed_at, as_of), F.lit(0))
    return (
        F.when(archived, F.lit(0.0))
        .when(pushed_at.isNull(), F.lit(0.5))
        .otherwise(clamp(1.0 - days / 365.0, 0.0, 1.0))
    )


def compatibility_score(has_license: Column, archived: Column) -> Column:
    base = F.when(has_license, F.lit(1.0)).otherwise(F.lit(0.5))
    return F.when(archived, F.greatest(F.lit(0.0), base - 0.2)).otherwise(base)


def quality_subscores(signals: Column, content: Column, as_of: Column) -> Column:
    """signals: struct<stars, forks, open_issues, subscribers_count, pushed_at, archived, has_license>."""
    found = F.coalesce(tx.unsafe_findings(content), F.array().cast("array<string>"))
    archived, pushed = F.coalesce(signals["archived"], F.lit(False)), signals["pushed_at"]
    return F.struct(
        half_up(maintenance_score(pushed, archived, as_of), 3).alias("maintenance"),
        F.round(security_score(found), 3).alias("security"),
        F.round(compatibility_score(F.coalesce(signals["has_license"], F.lit(False)), archived), 3).alias(
            "compatibility"
        ),
        community_score(signals["stars"], signals["forks"], signals["subscribers_count"]).alias("community"),
        is_stale(pushed, as_of).alias("is_stale"),
        found.alias("findings"),
        signals.alias("signals"),
    )


def aggregate_quality(sub: Column) -> Column:
    mix = (
        sub["maintenance"] * 0.25
        + F.coalesce(sub["community"], F.lit(0.5)) * 0.30
        + sub["security"] * 0.25
        + sub["compatibility"] * 0.20
    )
    return half_up(clamp(mix, 0.0, 1.0), 3)


# ---- heuristic quality -------------------------------------------------------------------


def title_penalty(title: Column) -> Column:
    flat = F.trim(title)
    return (
        F.when(title.isNull() | flat.isin("", "Untitled"), F.lit(-0.25))
        .when(flat.rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$"), F.lit(-0.25))
        .when(title.rlike(vocab.DEMO_TITLE_PATTERN), F.lit(-0.15))
        .otherwise(F.lit(0.0))
    )


def good_summary(summary: Column) -> Column:
    return F.coalesce(
        (F.length(F.trim(summary)) >= 20) & ~summary.rlike(vocab.BAD_SUMMARY_PATTERN), F.lit(False)
    )


def summary_penalty(summary: Column) -> Column:
    return F.when(good_summary(summary), F.lit(0.0)).otherwise(F.lit(-0.15))


def content_substance(content: Column) -> Column:
    n = F.length(content)
    return (
        F.when(content.isNull(), F.lit(-0.20))
        .when(n < 100, F.lit(-0.15))
        .when(n < 500, F.lit(0.05))
        .when(n < 2000, F.lit(0.15))
        .otherwise(F.lit(0.20))
    )


def heuristic_quality(tier: Column, content: Column, summary: Column, tags: Column, title: Column) -> Column:
    """Score and its parts; a null title carries no penalty here."""
    base = F.coalesce(tx.literal_map(vocab.TIER_QUALITY_BASE)[tier], F.lit(0.15))
    substance = content_substance(content)
    summary_bonus = F.when(good_summary(summary), F.lit(0.15)).otherwise(F.lit(0.0))
    has_tags = F.coalesce(F.size(tags) > 0, F.lit(False))
    tags_bonus = F.when(has_tags, F.lit(0.10)).otherwise(F.lit(0.0))
    title_part = F.when(title.isNull(), F.lit(0.0)).otherwise(title_penalty(title))
    total = base + substance + summary_bonus + tags_bonus + title_part + summary_penalty(summary)
    return F.struct(
        F.lit("heuristic").alias("method"),
        F.coalesce(tier, F.lit("unknown")).alias("source_tier"),
        base.alias("base_score"),
        substance.alias("content_substance"),
        summary_bonus.alias("summary_bonus"),
        tags_bonus.alias("tags_bonus"),
        title_part.alias("title_penalty"),
        summary_penalty(summary).alias("summary_penalty"),
        has_tags.alias("has_tags"),
        half_up(clamp(total, 0.05, 1.0), 3).alias("final_score"),
    )


# ---- labels ------------------------------------------------------------------------------


def graduation_score(up: Column, bookmarks: Column, dismissals: Column, tier: Column, ptype: Column) -> Column:
    by_tier = F.coalesce(tx.literal_map(vocab.TIER_GRADUATION)[tier], F.lit(1.0))
    by_type = F.coalesce(tx.literal_map(vocab.TYPE_GRADUATION)[ptype], F.lit(1.0))
    return (up * 3.0 + bookmarks * 2.0 - dismissals * 2.0) * by_tier * by_type


def confidence_label(n_items: Column, n_sources: Column) -> Column:
    return (
        F.when((n_items >= 10) & (n_sources >= 3), F.lit("high"))
        .when((n_items >= 5) | (n_sources >= 2), F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def velocity_label(ratio: Column) -> Column:
    return (
        F.when(ratio.isNull(), F.lit("emerging"))
        .when(ratio > 1.5, F.lit("accelerating"))
        .when(ratio < 0.67, F.lit("declining"))
        .otherwise(F.lit("plateauing"))
    )


def impact_label(sig: Column) -> Column:
    return F.coalesce(tx.literal_map(vocab.IMPACT_LABELS)[sig], F.lit("Informational update"))


def urgency(ptype: Column, breaking: Column, confidence: Column) -> Column:
    return (
        F.when(breaking, F.lit("critical"))
        .when((ptype == "update") & (confidence >= 0.8), F.lit("important"))
        .otherwise(F.lit("interesting"))
    )


def star_cutoff(tags: Column, url: Column) -> Column:
    low = F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower)

    def overlaps(names):
        return F.arrays_overlap(low, F.array(*map(F.lit, names)))

    return (
        F.when(overlaps(vocab.CORE_TAGS) | F.lower(url).contains("mcp"), 0)
        .when(overlaps(vocab.AGENT_TAGS), 2)
        .otherwise(10)
    )


def quality_label(score: Column) -> Column:
    return (
        F.when(score >= 0.8, F.lit("established")).when(score >= 0.5, F.lit("emerging")).otherwise(F.lit("new/unverified"))
    )


def star_text(stars: Column) -> Column:
    """1234 -> '1.2k'; a round thousand loses its '.0'."""
    thousands = F.regexp_replace(F.format_string("%.1f", half_up(stars / 1000.0, 1)), r"\.0$", "")
    return F.when(stars >= 1000, F.concat(thousands, F.lit("k"))).when(stars > 0, stars.cast("string"))


# ---- spend -------------------------------------------------------------------------------


def to_cents(dollars: Column) -> Column:
    """Half-even cents, and never less than one for a positive charge."""
    cents = F.bround(dollars * 100, 0).cast("long")
    return F.when((cents == 0) & (dollars > 0), F.lit(1).cast("long")).otherwise(cents)


def token_cost(in_tokens: Column, out_tokens: Column, in_price: Column, out_price: Column) -> Column:
    return (in_tokens * in_price + out_tokens * out_price) / 1_000_000.0
