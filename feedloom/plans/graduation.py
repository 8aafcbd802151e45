"""Knowledge library jobs: graduation, staleness, synthesis, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.functions import labels as lb
from feedloom.functions import scores as sc
from feedloom.functions import text as tx
from feedloom.operators import filters as fl
from feedloom.operators import rank as rk
from feedloom.plans.insight import topic_frequency
from feedloom.plans.signals import signal_counts

c = F.col
CONFIRMING = ["upvote", "bookmark"]


def graduation_candidates(items: DataFrame, sources: DataFrame, signals: DataFrame, *, as_of: Column) -> DataFrame:
    """Processed items of at least seven days that qualify by score, by source, or by quality and age."""
    rows = items.where(fl.processed() & (c("created_at") <= fl.days_back(as_of, 7))).select(
        "id", "source_id", "title", "summary", "primary_type", "relevance_score", "quality_score", "tags", "created_at"
    )
    s = sources.select(c("id").alias("source_id"), "tier")
    n = signal_counts(signals).select(c("item_id").alias("id"), "upvotes", "bookmarks", "dismissals")
    j = rows.join(s, "source_id").join(n, "id", "left").fillna(0, ["upvotes", "bookmarks", "dismissals"])
    rel, q = F.coalesce("relevance_score", F.lit(0.0)), F.coalesce("quality_score", F.lit(0.0))
    score = sc.graduation_score(
        c("upvotes"), c("bookmarks"), c("dismissals"), F.coalesce("tier", F.lit("tier3")), F.coalesce("primary_type", F.lit("docs"))
    )
    fast = (c("tier") == "tier1") & c("primary_type").isin("practice", "docs") & (rel >= 0.85)
    steady = (rel >= 0.70) & (q >= 0.60) & (sc.whole_days(c("created_at"), as_of) >= 14) & c("primary_type").isin("practice", "docs", "tool")
    j = j.withColumn("graduation_score", sc.stable(score)).withColumn("fast_track", F.coalesce(fast, F.lit(False)))
    return j.where((c("graduation_score") >= 15.0) | c("fast_track") | steady)


def linked_items(library: DataFrame) -> DataFrame:
    return library.where("is_current").select(F.explode("source_item_ids").alias("id")).distinct()


def graduate(items: DataFrame, sources: DataFrame, signals: DataFrame, library: DataFrame, *, as_of: Column) -> DataFrame:
    """New candidate entries; items an entry already cites are left out.

    A slug taken in the library, or by a smaller item id of this run, gets the item id as suffix. The owner of a
    slug is found by aggregation, so titles shared by very many items do not gather in one task.
    """
    g = graduation_candidates(items, sources, signals, as_of=as_of).join(linked_items(library), "id", "left_anti")
    topic = F.coalesce(F.get("tags", F.lit(0)), "primary_type", F.lit("general"))
    g = g.withColumn("topic_path", topic).withColumn(
        "_slug", tx.slugify(F.concat(topic, F.lit("-"), F.substring("title", 1, 40)))
    )
    owner = g.groupBy("_slug").agg(F.min("id").alias("_owner"))
    taken = library.select(c("slug").alias("_slug")).distinct().withColumn("_taken", F.lit(True))
    j = g.join(owner.join(taken, "_slug", "left"), "_slug")
    clash = c("_taken").isNotNull() | (c("_owner") != c("id"))
    return j.select(
        F.when(clash, F.concat("_slug", F.lit("-"), "id")).otherwise(c("_slug")).alias("slug"),
        "title", F.coalesce(F.nullif(c("summary"), F.lit("")), "title").alias("body"), "topic_path", "tags",
        F.lit("candidate").alias("status"), "graduation_score",
        F.when(c("fast_track"), F.lit("source_type")).otherwise(F.lit("signal")).alias("graduation_method"),
        as_of.alias("graduated_at"), F.array("id").alias("source_item_ids"),
        F.lit(1).alias("source_item_count"), F.lit(1).alias("source_count"),
        sc.confidence_label(F.lit(1), F.lit(1)).alias("confidence"), F.lit(1).alias("version"), F.lit(True).alias("is_current"),
    )


def promote_candidates(library: DataFrame, *, as_of: Column, min_score: float = 8.0, days: int = 3) -> DataFrame:
    ready = (c("status") == "candidate") & c("is_current") & (c("graduation_score") >= min_score) & (
        c("graduated_at") <= fl.days_back(as_of, days)
    )
    return library.withColumn("status", F.when(ready, F.lit("active")).otherwise(c("status")))


def confirmed_entries(library: DataFrame, signals: DataFrame) -> DataFrame:
    """Ids of active entries with an upvote or bookmark on a cited item since they were last confirmed."""
    newest = signals.where(c("action").isin(*CONFIRMING)).groupBy("item_id").agg(F.max("created_at").alias("newest"))
    cited = library.where((c("status") == "active") & c("is_current")).select(
        "id", F.coalesce("last_confirmed_at", "graduated_at", "created_at").alias("_since"), F.explode("source_item_ids").alias("item_id")
    )
    return cited.join(newest, "item_id").where(c("newest") > c("_since")).select("id").distinct()


def stale_entries(
    library: DataFrame, signals: DataFrame, *, as_of: Column, stale_days: int = 180, archive_days: int = 30
) -> DataFrame:
    """Confirm, then flag for review, then archive; a row touched in this run is not old enough for the next step."""
    hit = confirmed_entries(library, signals).withColumn("_hit", F.lit(True))
    j = library.join(hit, "id", "left")
    j = j.withColumn("last_confirmed_at", F.when(c("_hit"), as_of).otherwise(c("last_confirmed_at")))
    old = F.coalesce("last_confirmed_at", "graduated_at") <= fl.days_back(as_of, stale_days)
    flag = F.coalesce((c("status") == "active") & c("is_current") & old, F.lit(False))
    archive = (c("status") == "review_needed") & c("is_current") & (c("updated_at") <= fl.days_back(as_of, archive_days))
    status = F.when(flag, F.lit("review_needed")).when(archive, F.lit("archived")).otherwise(c("status"))
    touched = F.coalesce(c("_hit"), F.lit(False)) | flag | archive
    return j.withColumn("_status", status).withColumn("updated_at", F.when(touched, as_of).otherwise(c("updated_at"))).withColumn(
        "status", c("_status")
    ).drop("_status", "_hit")


def topics_to_synthesise(
    items: DataFrame, library: DataFrame, *, n_topics: int = 50, per_topic: int = 10, min_growth: float = 0.20
) -> DataFrame:
    """Topics whose material grew by more than a fifth since their guide was written, with their best items as text.

    Entries waiting as 'pending' count as topics without items of their own. The text generation itself is external.
    """
    topics = topic_frequency(items, limit=n_topics).select(c("tag").alias("topic"), c("tag_count").alias("item_count"), "source_count")
    pending = library.where((c("status") == "pending") & c("is_current")).select(
        c("slug").alias("topic"), F.lit(0).cast("long").alias("item_count"), F.lit(1).cast("long").alias("source_count")
    )
    topics = topics.unionByName(pending.join(topics.select("topic"), "topic", "left_anti"))
    topics = topics.withColumn("slug", tx.slugify(c("topic")))
    guides = library.where(c("is_current") & (c("graduation_method") == "synthesis")).groupBy("slug").agg(
        F.max("source_item_count").alias("_had"), F.max("version").alias("_version")
    )
    j = topics.join(guides, "slug", "left")
    growth = (c("item_count") - c("_had")) / F.greatest(c("_had"), F.lit(1))
    due = j.where(c("_had").isNull() | (growth > min_growth)).drop("_had")

    rows = items.where(fl.processed()).select(
        "id", "title", "summary", (c("relevance_score") * 0.5 + c("quality_score") * 0.5).alias("mean"),
        F.explode(F.array_union("tags", F.array("primary_type"))).alias("topic"),
    ).withColumn("mean", sc.stable(c("mean")))
    # only the best few rows per tag leave the map tasks
    best = rk.top_per_group(rows, ["topic"], [F.desc("mean"), F.asc("id")], per_topic)
    line = F.concat(F.lit("["), c("rn").cast("string"), F.lit("] "), c("title"), F.lit(": "), F.coalesce("summary", F.lit("(no summary)")))
    packed = best.join(due.select("topic"), "topic", "left_semi").groupBy("topic").agg(
        F.array_sort(F.collect_list(F.struct("rn", "id", line.alias("line")))).alias("_top")
    )
    return due.join(packed, "topic").select(
        "topic", "slug", "item_count", "source_count", F.coalesce("_version", F.lit(0)).alias("version"),
        F.transform("_top", lambda x: x["id"]).alias("source_item_ids"),
        F.array_join(F.transform("_top", lambda x: x["line"]), "\n").alias("prompt"),
    )


SYNTHESIS_SCHEMA = "tldr string, body string, key_points array<string>, gotchas array<struct<title:string,detail:string>>"


def load_synthesis(library: DataFrame, requests: DataFrame, answers: DataFrame, *, as_of: Column) -> DataFrame:
    """Library with the parsed guides added as new current versions; answers: (slug, raw_text). Empty bodies are skipped."""
    a = answers.select("slug", F.from_json(lb.unfence(c("raw_text")), SYNTHESIS_SCHEMA).alias("g"))
    a = a.where(F.coalesce(c("g.body"), F.lit("")) != "")
    j = requests.join(a, "slug")
    new = j.select(
        F.concat(F.lit("syn-"), "slug", F.lit("-"), (c("version") + 1).cast("string")).alias("id"), "slug",
        tx.smart_title(c("topic")).alias("title"), c("g.tldr").alias("tldr"), c("g.body").alias("body"),
        F.coalesce(c("g.key_points"), F.array().cast("array<string>")).alias("key_points"),
        c("g.gotchas").alias("gotchas"), c("topic").alias("topic_path"), F.array("topic").alias("tags"),
        F.lit("active").alias("status"), c("item_count").cast("double").alias("graduation_score"),
        F.lit("synthesis").alias("graduation_method"), as_of.alias("graduated_at"), as_of.alias("last_confirmed_at"),
        as_of.alias("updated_at"), as_of.alias("created_at"), "source_item_ids",
        c("item_count").cast("int").alias("source_item_count"), c("source_count").cast("int").alias("source_count"),
        sc.confidence_label(c("item_count"), c("source_count")).alias("confidence"),
        tx.library_content_hash(c("g.body"), c("g.key_points")).alias("content_hash"),
        (c("version") + 1).alias("version"), F.lit(True).alias("is_current"),
    )
    replaced = new.select("slug").withColumn("_new", F.lit(True))
    synthesis = c("graduation_method") == "synthesis"
    old = library.join(replaced, "slug", "left").withColumn(
        "is_current", c("is_current") & ~(F.coalesce("_new", F.lit(False)) & synthesis)
    ).drop("_new")
    return old.unionByName(new, allowMissingColumns=True)


def number_versions(revisions: DataFrame, *, order: list[str]) -> DataFrame:
    """version 1..n and is_current per slug from an unnumbered revision log.

    The log is counted month by month per slug, so a slug with very many revisions is numbered by many tasks.
    """
    from feedloom.operators.skew import latest_per_key, running_totals

    r = running_totals(revisions, ["slug"], F.trunc(order[0], "month"), [F.asc(o) for o in order], {"version": F.lit(1).cast("long")})
    last = latest_per_key(r.select("slug", "version"), ["slug"], ["version"]).withColumnRenamed("version", "_last")
    return r.join(last, "slug").withColumn("is_current", c("version") == c("_last")).drop("_last")
