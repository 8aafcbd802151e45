"""Alert rules: matching, cooldown, delivery rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from feedloom.functions import scores as sc
from feedloom.functions import text as tx
from feedloom.operators import filters as fl
from feedloom.operators import joins as jn
from feedloom.operators.cooldown import cooldown_after_delivery, greedy_cooldown
from feedloom.operators.keyword_join import contained_keywords

c = F.col
DEFAULT_COOLDOWN_MINUTES = 60
MOST_KEYWORDS = 50_000  # that one automaton may hold


def cooldown_seconds() -> Column:
    """A rule without a cooldown, or with one of zero, waits the default time."""
    minutes = F.coalesce(F.nullif(c("cooldown_minutes"), F.lit(0)), F.lit(DEFAULT_COOLDOWN_MINUTES))
    return minutes.cast("long") * 60


def _keywords(rules: DataFrame) -> DataFrame:
    return rules.where("is_active").select(
        c("id").alias("rule_id"), F.posexplode("keywords").alias("place", "_k")
    ).select("rule_id", "place", F.lower("_k").alias("keyword")).where(c("keyword") != "")


def keyword_finder(words: list[str]):
    """Arrow UDF: all given words contained in a lower-cased text, by one automaton pass over it, built once per task. Of a
    batch only one text at a time is a Python string."""

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for w in words:
            machine.add_word(w, w)
        machine.make_automaton()
        for texts in batches:
            yield pa.array((sorted({w for _, w in machine.iter(t.as_py())}) if t.is_valid else [] for t in texts), pa.list_(pa.string()))

    find.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(find, ArrayType(StringType()))


def active_keywords(rules: DataFrame) -> list[str]:
    """The distinct keywords of the active rules, where there are few: every task gets them, at about a hundred bytes each."""
    found = sorted(r[0] for r in _keywords(rules).select("keyword").distinct().limit(MOST_KEYWORDS + 1).collect())
    if len(found) > MOST_KEYWORDS:
        raise ValueError(f"more than {MOST_KEYWORDS} keywords: match micro-batches with match_rules, which joins them")
    return found


def keyword_hits(items: DataFrame, rules: DataFrame, *, keep: list[str], most: int = MOST_KEYWORDS) -> DataFrame:
    """(keep..., keyword): keywords of any active rule found in the item's text, case-insensitively, as substrings.

    Up to ``most`` distinct keywords are one automaton, which passes over each text once; more of them are joined with the
    texts' grams (``keyword_join``), so that no task holds them all. Both give the same rows.
    """
    distinct = _keywords(rules).select("keyword").distinct()
    rows = items.select(*keep, F.lower(fl.alert_haystack()).alias("_text"))
    if distinct.limit(most + 1).count() > most:
        name = F.struct(*keep).alias("_keep")
        found = contained_keywords(rows.select(name, c("_text").alias("text")), distinct, key="_keep")
        return found.select("_keep.*", "keyword")
    words = sorted(r[0] for r in distinct.collect())
    if not words:
        return rows.where(F.lit(False)).select(*keep, F.lit("").alias("keyword"))
    return rows.select(*keep, F.explode(keyword_finder(words)(c("_text"))).alias("keyword"))


def match_rules(items: DataFrame, rules: DataFrame, *, most_keywords: int = MOST_KEYWORDS) -> DataFrame:
    """(rule_id, item_id, keyword, by_significance): every match of every active rule; keyword is the rule's first hit."""
    hits = keyword_hits(items, rules, keep=["id"], most=most_keywords)
    worded = hits.join(_keywords(rules), "keyword").groupBy("rule_id", c("id").alias("item_id")).agg(
        F.min_by("keyword", "place").alias("keyword")
    )
    triggers = rules.where("is_active").select(c("id").alias("rule_id"), F.explode("significance_trigger").alias("significance"))
    urgent = items.select(c("id").alias("item_id"), "significance").join(triggers.distinct(), "significance").select(
        "rule_id", "item_id", F.lit(None).cast("string").alias("keyword"), F.lit(True).alias("by_significance")
    )
    both = worded.withColumn("by_significance", F.lit(False)).unionByName(urgent)
    return both.groupBy("rule_id", "item_id").agg(
        F.max("keyword").alias("keyword"), F.bool_or("by_significance").alias("by_significance")
    )


def rule_events(items: DataFrame, rules: DataFrame) -> DataFrame:
    """(key = rule, ts, id = item, cooldown_seconds), at most one per (rule trigger, second).

    Items are first reduced to the earliest one per (keyword, second) and per (significance, second). Only these small
    summaries meet the rules, so a rule that matches everything does not multiply the items.
    """
    def earliest(df, trigger):
        f = df.groupBy(trigger, F.unix_seconds("created_at").alias("_s")).agg(F.min(F.struct("created_at", "id")).alias("f"))
        return f.select(trigger, c("f.created_at").alias("ts"), c("f.id").alias("id"))

    words = earliest(keyword_hits(items, rules, keep=["id", "created_at"]), "keyword")
    sigs = earliest(items.select("id", "created_at", "significance"), "significance")
    wait = rules.where("is_active").select(c("id").alias("rule_id"), cooldown_seconds().alias("cooldown_seconds"))
    by_word = words.join(_keywords(rules).select("rule_id", "keyword").distinct(), "keyword").select("rule_id", "ts", "id")
    triggers = rules.where("is_active").select(c("id").alias("rule_id"), F.explode("significance_trigger").alias("significance")).distinct()
    by_sig = sigs.join(triggers, "significance").select("rule_id", "ts", "id")
    both = by_word.unionByName(by_sig).join(wait, "rule_id")
    return both.select(c("rule_id").alias("key"), "ts", "id", "cooldown_seconds")


def fired_alerts(items: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, item_id, ts): alerts left after each rule's cooldown, in event time."""
    f = greedy_cooldown(rule_events(items, rules))
    return f.select(c("key").alias("rule_id"), c("id").alias("item_id"), "ts")


def tried_alerts(items: DataFrame, rules: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(rule_id, item_id, ts, delivered): the deliveries that are tried when a rule's cooldown starts only after one that
    succeeded. ``outcomes`` (rule_id, item_id, delivered) are the results; an attempt without one counts as failed."""
    results = outcomes.groupBy("rule_id", "item_id").agg(F.bool_or("delivered").alias("delivered"))
    wait = rules.where("is_active").select(c("id").alias("rule_id"), cooldown_seconds().alias("cooldown_seconds"))
    hits = match_rules(items, rules).select("rule_id", "item_id").join(items.select(c("id").alias("item_id"), c("created_at").alias("ts")), "item_id")
    events = hits.join(wait, "rule_id").join(results, ["rule_id", "item_id"], "left")
    tried = cooldown_after_delivery(events.select(c("rule_id").alias("key"), "ts", c("item_id").alias("id"), "cooldown_seconds", F.coalesce("delivered", F.lit(False)).alias("delivered")))
    return tried.select(c("key").alias("rule_id"), c("id").alias("item_id"), "ts", "delivered")


def delivery_rows(fired: DataFrame, items: DataFrame, channel: str = "chat") -> DataFrame:
    """Outbox rows of fired alerts; ids are derived, so a repeated run writes the same rows."""
    facts = items.select(
        c("id").alias("item_id"), "primary_type", "confidence_score",
        tx.is_breaking_text(c("title"), c("content"), c("tags")).alias("_brk"),
    )
    j = fired.join(facts, "item_id")
    urgent = sc.urgency(c("primary_type"), (c("primary_type") == "update") & c("_brk"), c("confidence_score"))
    return j.select(
        F.substring(F.sha2(F.concat_ws("|", "rule_id", "item_id", F.lit(channel)), 256), 1, 32).alias("id"),
        c("rule_id").alias("alert_rule_id"), c("item_id").alias("intel_item_id"), urgent.alias("urgency"),
        F.lit("pending").alias("status"), F.lit(channel).alias("channel"), c("ts").alias("created_at"),
    )


def unalerted_items(items: DataFrame, deliveries: DataFrame, *, as_of: Column, hours: int = 24, limit: int = 100) -> DataFrame:
    """Processed items of the last day without any delivery, oldest first."""
    rows = items.where(fl.processed() & fl.recent(as_of, hours / 24.0, c("created_at")))
    return jn.without_delivery(rows, deliveries).orderBy("created_at", "id").limit(limit)


def breaking_notices(items: DataFrame) -> DataFrame:
    """One notification row per processed breaking item; works on a stream as well."""
    return items.where(fl.processed() & (c("significance") == "breaking")).select(
        "id", F.coalesce(F.nullif(c("title"), F.lit("")), F.lit("Untitled")).alias("title"), "url", "primary_type",
        F.lit("critical").alias("urgency"), "created_at",
    )
