"""Row predicates (arguments -> boolean Column)."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from feedloom import vocab
from feedloom.functions import scores as sc
from feedloom.functions import text as tx
from feedloom.functions import vectors as vx


def all_of(*conds: Column | None) -> Column:
    return reduce(and_, [c for c in conds if c is not None], F.lit(True))


def any_of(*conds: Column) -> Column:
    return reduce(or_, conds, F.lit(False))


def processed() -> Column:
    return F.col("status") == "processed"


def since(cutoff: Column, ts: Column | None = None) -> Column:
    return (sc.event_ts() if ts is None else ts) >= cutoff


def days_back(as_of: Column, days: float) -> Column:
    """as_of minus a number of days, as a timestamp."""
    return F.timestamp_micros(F.unix_micros(as_of) - F.lit(int(days * sc.DAY_US)))


def recent(as_of: Column, days: float, ts: Column | None = None) -> Column:
    return since(days_back(as_of, days), ts)


def notable() -> Column:
    return F.col("significance").isin("breaking", "major")


def quality_floor(floor: float = 0.3) -> Column:
    return (F.col("quality_score") >= floor) | notable()


def has_all_tags(tags: list[str], column: str = "tags") -> Column:
    return all_of(*[F.array_contains(column, t) for t in tags])


def has_any_tag(tags: list[str], column: str = "tags") -> Column:
    return F.arrays_overlap(F.col(column), F.array(*map(F.lit, tags)))


def tags_or_group(topic: str, column: str = "tags") -> Column:
    group = vocab.TAG_GROUPS.get(topic)
    return has_any_tag(group, column) if group else has_all_tags([topic], column)


def is_in(column: str, values) -> Column | None:
    """A list, or a comma separated string; nothing given means no condition."""
    if not values:
        return None
    if isinstance(values, str):
        values = [v.strip() for v in values.split(",") if v.strip()]
    return F.col(column).isin(*values)


def within_radius(vec, radius: float, column: str = "embedding") -> Column:
    return F.col(column).isNotNull() & (vx.distance_to(F.col(column), vec) < radius)


def search_hygiene(min_quality: float = 0.40, min_chars: int = 100, chars: Column | None = None) -> Column:
    """``chars``: the content's length where it is stored beside the text."""
    return all_of(
        ~F.coalesce(F.col("summary"), F.lit("")).contains("unavailable"),
        (F.length(F.coalesce(F.col("content"), F.lit(""))) if chars is None else chars) >= min_chars,
        F.coalesce(F.col("quality_score"), F.lit(0.0)) >= min_quality,
    )


def briefing_admission(as_of: Column) -> Column:
    return all_of(
        F.col("relevance_score") >= 0.50,
        (F.coalesce(F.col("quality_score"), F.lit(0.0)) >= 0.55) | recent(as_of, 7) | notable(),
        ~F.coalesce(F.col("summary"), F.lit("")).contains("unavailable"),
    )


def transition_allowed(current: Column, target: Column, table: dict = vocab.TRANSITIONS) -> Column:
    allowed = F.create_map(
        *[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))]
    )
    return F.coalesce(F.array_contains(allowed[current], target), F.lit(False))


def substring_score(words: list[str], weights: dict[str, int]) -> Column:
    """Sum over words and fields of the field's weight where the field contains the word."""
    parts = [
        F.when(F.lower(F.coalesce(F.col(field), F.lit(""))).contains(w), F.lit(weight)).otherwise(F.lit(0))
        for w in words
        for field, weight in weights.items()
    ]
    return reduce(lambda a, b: a + b, parts, F.lit(0))


def substring_match(words: list[str], fields: list[str]) -> Column:
    return any_of(*[F.lower(F.coalesce(F.col(f), F.lit(""))).contains(w) for w in words for f in fields])


def topic_prefix(topic: str | None) -> Column | None:
    return F.col("topic_path").startswith(topic) if topic else None


def mentions_any(query: str, skip=vocab.RELEVANCE_SKIP_WORDS) -> Column | None:
    """Does an item's title, summary or tags mention a meaningful word of the query; None when it has none."""
    words = [w for w in query.lower().split() if len(w) >= 3 and w not in skip]
    if not words:
        return None
    hay = F.lower(
        F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")), F.array_join("tags", " "))
    )
    return any_of(*[hay.contains(w) for w in words])


def transition(items: DataFrame, current: str, target: str) -> DataFrame:
    """Move rows that are in ``current``; rows in any other state stay as they are."""
    if target not in vocab.TRANSITIONS.get(current, []):
        raise ValueError(f"no transition {current} -> {target}")
    return items.withColumn("status", F.when(F.col("status") == current, F.lit(target)).otherwise(F.col("status")))


def alert_haystack() -> Column:
    return tx.alert_text(F.col("title"), F.col("content"), F.col("tags"))
