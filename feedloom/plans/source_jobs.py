"""Source bookkeeping jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom import vocab
from feedloom.functions import scores as sc
from feedloom.operators import filters as fl
from feedloom.operators.skew import running_totals

c = F.col


def source_errors(polls: DataFrame, *, max_errors: int = 5) -> DataFrame:
    """State per source from a poll log (source_id, ts, poll_id, ok, attempt).

    Only first attempts count as errors, a success resets the counter, and a source that ever reached ``max_errors`` in
    a row is inactive. The error streaks are separated by a running count of successes, taken day by day so that a
    source with most of the log is spread over many tasks.
    """
    p = polls.withColumn("_day", F.to_date("ts"))
    run = running_totals(p, ["source_id"], c("_day"), [F.asc("ts"), F.asc("poll_id")], {"streak": c("ok").cast("long")})
    streaks = run.groupBy("source_id", "streak").agg(
        F.count_if(~c("ok") & (c("attempt") == 1)).alias("errors"), F.max("ts").alias("last_fetched_at"),
        F.max(F.when(c("ok"), c("ts"))).alias("last_successful_poll"),
    )
    return streaks.groupBy("source_id").agg(
        F.max_by("errors", "streak").alias("consecutive_errors"),
        (F.max("errors") < max_errors).alias("is_active"),
        F.max("last_fetched_at").alias("last_fetched_at"), F.max("last_successful_poll").alias("last_successful_poll"),
    )


def source_recovery(sources: DataFrame, *, as_of: Column, hours: int = 48, max_attempts: int = 3) -> DataFrame:
    """Inactive for long enough and not tried too often: active again. ``dead_for_good`` marks the others' end state."""
    dead = ~c("is_active")
    again = dead & (c("last_fetched_at") < fl.days_back(as_of, hours / 24.0)) & (c("recovery_attempts") < max_attempts)
    s = sources.withColumn("_again", F.coalesce(again, F.lit(False))).withColumn(
        "dead_for_good", dead & (c("recovery_attempts") >= max_attempts)
    )
    return s.withColumn("is_active", c("is_active") | c("_again")).withColumn(
        "consecutive_errors", F.when(c("_again"), 0).otherwise(c("consecutive_errors"))
    ).withColumn("recovery_attempts", c("recovery_attempts") + c("_again").cast("int")).drop("_again")


def source_thresholds(
    sources: DataFrame, *, threshold: float = 0.50, types=vocab.RELEASE_SOURCE_TYPES, named: list[str] | None = None
) -> DataFrame:
    """Lower gate for release-like sources; sources that never worked but rarely failed get another chance."""
    lower = c("type").isin(*types)
    if named:
        lower = lower | c("id").isin(*named)
    again = ~c("is_active") & c("last_successful_poll").isNull() & (c("consecutive_errors") < 3)
    conf = F.coalesce(F.from_json("config", "map<string,string>"), F.create_map().cast("map<string,string>"))
    others = F.map_filter(conf, lambda k, _: k != "relevance_threshold")
    updated = F.to_json(F.map_concat(others, F.create_map(F.lit("relevance_threshold"), F.lit(str(threshold)))))
    s = sources.withColumn("_again", again)
    return s.withColumn("config", F.when(lower, updated).otherwise(c("config"))).withColumn(
        "is_active", c("is_active") | c("_again")
    ).withColumn("consecutive_errors", F.when(c("_again"), 0).otherwise(c("consecutive_errors"))).drop("_again")


def source_silence(polls: DataFrame, *, as_of: Column, hours: float = 4.0) -> DataFrame:
    """Current silence of the whole landing: one row with the last heartbeat and whether it is too old."""
    last = polls.agg(F.max("ts").alias("last_heartbeat"))
    age = (F.unix_micros(as_of) - F.unix_micros("last_heartbeat")) / F.lit(3.6e9)
    return last.select("last_heartbeat", sc.stable(age, 4).alias("silent_hours"), F.coalesce(age > hours, F.lit(True)).alias("alarm"))
