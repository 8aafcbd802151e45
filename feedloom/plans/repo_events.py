"""Repository events from successive snapshots (repo, ts, stars, commits, description, file_text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom import vocab
from feedloom.functions import text as tx
from feedloom.operators.skew import previous_in_bucketed_order

c = F.col


def with_previous(snapshots: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Adds prev_<column>; each repository's history is walked month by month, so a very long one uses many tasks."""
    return previous_in_bucketed_order(snapshots, keys or ["repo"], F.trunc("ts", "month"), ["ts"], columns)


def star_milestones(snapshots: DataFrame, milestones=vocab.STAR_MILESTONES) -> DataFrame:
    """Milestones crossed since the previous snapshot; before the first one the count is taken as zero."""
    s = with_previous(snapshots.select("repo", "ts", "stars"), ["stars"])
    crossed = F.filter(
        F.array(*map(F.lit, milestones)), lambda m: (m > F.coalesce("prev_stars", F.lit(0))) & (m <= c("stars"))
    )
    s = s.select("repo", "ts", "stars", F.explode(crossed).alias("milestone"))
    return s.select(
        "repo", "ts", "stars", "milestone",
        F.concat("repo", F.lit(":star_milestone:"), c("milestone").cast("string")).alias("external_id"),
        F.concat(F.lit("https://github.com/"), "repo", F.lit("#star-milestone-"), c("milestone").cast("string")).alias("url"),
        F.concat("repo", F.lit(" reached "), F.format_number("milestone", 0), F.lit(" stars")).alias("title"),
    )


def is_burst(now: Column, before: Column, threshold: int) -> Column:
    return (now > threshold) & (now > F.coalesce(before, F.lit(0)) * 2)


def commit_bursts(snapshots: DataFrame, *, threshold: int = 20) -> DataFrame:
    """Weeks with more than ``threshold`` commits and more than twice the previous snapshot's."""
    s = with_previous(snapshots.select("repo", "ts", "commits"), ["commits"])
    s = s.where(is_burst(c("commits"), c("prev_commits"), threshold)).withColumn("week", tx.iso_week(c("ts")))
    return s.select(
        "repo", "ts", "commits", F.coalesce("prev_commits", F.lit(0)).alias("previous"), "week",
        F.concat("repo", F.lit(":commit_burst:"), "week").alias("external_id"),
    )


def description_changes(snapshots: DataFrame) -> DataFrame:
    """The first observation of a repository is no change."""
    s = snapshots.select("repo", "ts", tx.short_hash(c("description")).alias("hash"))
    s = with_previous(s, ["hash"]).where(c("prev_hash").isNotNull() & (c("hash") != c("prev_hash")))
    return s.select("repo", "ts", "hash", F.concat("repo", F.lit(":description_changed:"), "hash").alias("external_id"))


def file_changes(files: DataFrame) -> DataFrame:
    """Changed watched files (repo, path, ts, file_text); a text with BREAKING in it gets a tag."""
    s = files.select("repo", "path", "ts", "file_text", F.sha2("file_text", 256).alias("sha"))
    s = with_previous(s, ["sha"], ["repo", "path"]).where(c("prev_sha").isNotNull() & (c("sha") != c("prev_sha")))
    tags = F.array_compact(
        F.array(F.lit("changelog"), F.lit("update"), F.when(F.upper("file_text").contains("BREAKING"), F.lit("breaking-changes")))
    )
    return s.select(
        "repo", "path", "ts", tags.alias("tags"), F.substring("file_text", 1, 2000).alias("content"),
        F.concat("repo", F.lit(":file_changed:"), "path", F.lit(":"), F.substring("sha", 1, 8)).alias("external_id"),
    )


def silence_gaps(heartbeats: DataFrame, *, hours: float = 4.0, keys: list[str] | None = None) -> DataFrame:
    """Gaps longer than the limit between consecutive heartbeats (ts), overall or per key."""
    keys = keys or []
    seconds = heartbeats.select(*keys, F.timestamp_seconds(F.unix_seconds("ts")).alias("ts")).distinct()
    s = previous_in_bucketed_order(seconds, keys, F.date_trunc("hour", "ts"), ["ts"], ["ts"])
    gap = (F.unix_seconds("ts") - F.unix_seconds("prev_ts")) / 3600.0
    return s.where(gap > hours).select(*keys, c("prev_ts").alias("silent_from"), c("ts").alias("silent_to"), F.round(gap, 4).alias("hours"))


def polls_allowed(polls: DataFrame) -> DataFrame:
    """(source_id, ts, poll_id, poll_interval_seconds) -> the polls that were not inside a cooldown."""
    from feedloom.operators.cooldown import greedy_cooldown

    e = polls.select(
        c("source_id").cast("string").alias("key"), "ts", c("poll_id").alias("id"), c("poll_interval_seconds").alias("cooldown_seconds")
    )
    return greedy_cooldown(e).select(c("key").alias("source_id"), "ts", c("id").alias("poll_id"))
