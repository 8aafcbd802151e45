"""Status stages: snapshot in, snapshot out. Rows in any other status pass through unchanged."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from feedloom.functions import labels as lb
from feedloom.functions import scores as sc
from feedloom.functions import text as tx
from feedloom.functions import urls as ux
from feedloom.operators import filters as fl
from feedloom.operators.joins import one_per_key, with_source
from feedloom.operators.vector_join import cosine_distances, nearest_within, unit_rows

c = F.col
MAX_SHIPPED_REFERENCES = 2000


def noise_stage(items: DataFrame) -> DataFrame:
    """Raw rows that are noise, or have neither title nor content, become 'filtered'."""
    blank = (F.trim(F.coalesce("title", F.lit(""))) == "") & (F.trim(F.coalesce("content", F.lit(""))) == "")
    drop = (c("status") == "raw") & (tx.is_noise(c("title"), c("content"), c("url")) | blank)
    return items.withColumn("status", F.when(drop, F.lit("filtered")).otherwise(c("status")))


def embed_stage(items: DataFrame, *, vectors: DataFrame | None = None, embedder=None, model: str = "external") -> DataFrame:
    """Raw rows get a vector from a (id, embedding) table, or from the caller's pandas UDF string -> array<float>."""
    raw = c("status") == "raw"
    base = items if "embedding" in items.columns else items.withColumn("embedding", F.lit(None).cast("array<float>"))
    if vectors is not None:
        v = one_per_key(vectors.select("id", c("embedding").alias("_new")), "id", c("_new"))
        base = base.join(v, "id", "left")
    else:
        base = base.withColumn("_new", F.when(raw, embedder(tx.embed_input(c("title"), c("content")))))
    done = raw & c("_new").isNotNull()
    return base.select(
        *[x for x in base.columns if x not in ("status", "embedding", "_new", "embedding_model_version")],
        F.when(done, c("_new")).otherwise(c("embedding")).alias("embedding"),
        F.when(done, F.lit(model)).alias("embedding_model_version"),
        F.when(done, F.lit("embedded")).otherwise(c("status")).alias("status"),
    )


# ---- relevance gate ----------------------------------------------------------------------


def _score(max_positive: Column, max_negative: Column) -> Column:
    p, n = F.coalesce(max_positive, F.lit(0.0)), F.coalesce(max_negative, F.lit(0.0))
    return sc.clamp(p - 0.5 * n, 0.0, 1.0)


def gate_scores(items: DataFrame, references: DataFrame, *, k: int = 20, max_shipped: int = MAX_SHIPPED_REFERENCES) -> DataFrame:
    """Adds ``gate_score``: best positive minus half the best negative among the k nearest references.

    A calibration set of at most ``max_shipped`` rows travels to the tasks and each Arrow batch is one matrix product.
    A larger one goes through the block join instead. Null where the row has no vector; 0 where there are no references.
    """
    refs = references.where(c("embedding").isNotNull()).select("id", "embedding", "is_positive")
    rows = refs.orderBy("id").limit(max_shipped + 1).collect()
    if not rows:
        return items.withColumn("gate_score", F.lit(0.0))
    if len(rows) > max_shipped:
        near = nearest_within(
            items.select("id", c("embedding").alias("vec")), refs.select("id", c("embedding").alias("vec")),
            k=k, radius=2.0, exclude_self=False, inclusive=True,
        )
        near = near.join(refs.select("id", "is_positive"), "id").withColumn("sim", 1.0 - c("distance"))
        best = near.groupBy(c("query_id").alias("id")).agg(
            _score(F.max(F.when(c("is_positive"), c("sim"))), F.max(F.when(~c("is_positive"), c("sim")))).alias("gate_score")
        )
        return items.join(best, "id", "left")

    shipped = items.sparkSession.sparkContext.broadcast(
        (unit_rows([r["embedding"] for r in rows]), np.array([bool(r["is_positive"]) for r in rows]))
    )

    def score(vectors: pd.Series) -> pd.Series:
        refs_m, positive = shipped.value
        out = np.full(len(vectors), np.nan)
        have = np.flatnonzero(vectors.notna().to_numpy())
        if len(have):
            d = cosine_distances(unit_rows(vectors.iloc[have]), refs_m)
            top = np.argsort(d, axis=1, kind="stable")[:, :k]
            sim, pos = 1.0 - np.take_along_axis(d, top, axis=1), positive[top]
            best_p = np.where(pos, sim, -np.inf).max(axis=1)
            best_n = np.where(~pos, sim, -np.inf).max(axis=1)
            best_p, best_n = (np.where(np.isinf(b), 0.0, b) for b in (best_p, best_n))
            out[have] = np.clip(best_p - 0.5 * best_n, 0.0, 1.0)
        return pd.Series(out)

    return items.withColumn("gate_score", F.nanvl(F.pandas_udf(score, DoubleType())(c("embedding")), F.lit(None)))


def gate_stage(
    items: DataFrame, sources: DataFrame, references: DataFrame, *, as_of: Column, threshold: float = 0.65, k: int = 20,
    max_shipped: int = MAX_SHIPPED_REFERENCES,
) -> DataFrame:
    """Embedded rows become queued or filtered; relevance takes its freshness from created_at. Without references all pass."""
    due = (c("status") == "embedded") & c("embedding").isNotNull()
    empty = references.where(c("embedding").isNotNull()).isEmpty()
    s = sources.select(
        c("id").alias("source_id"), c("tier").alias("_tier"), F.get_json_object("config", "$.relevance_threshold").try_cast("double").alias("_limit")
    )
    scored = gate_scores(
        items.withColumn("_vec", c("embedding")).withColumn("embedding", F.when(due, c("embedding"))), references, k=k, max_shipped=max_shipped
    ).withColumn("embedding", c("_vec")).drop("_vec")
    j = scored.join(s, "source_id", "left")
    g = sc.half_up(c("gate_score"), 6)
    relevant = F.lit(True) if empty else g >= F.coalesce("_limit", F.lit(threshold))
    value = sc.relevance(g, F.coalesce("_tier", F.lit("tier3")), c("created_at"), as_of)
    return j.withColumn("relevance_score", F.when(due, sc.half_up(value, 6)).otherwise(c("relevance_score"))).withColumn(
        "status", F.when(due, F.when(relevant, F.lit("queued")).otherwise(F.lit("filtered"))).otherwise(c("status"))
    ).drop("_tier", "_limit")


# ---- labels and quality ------------------------------------------------------------------


def apply_labels(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows being processed take their classifier answer (id, raw_text); those without one fail. Of several answers to a
    row the newest counts, by ``answered_at`` where there is one, then by text."""
    order = [F.desc("answered_at")] if "answered_at" in answers.columns else []
    a = one_per_key(answers, "id", *order, F.desc("raw_text")).select("id", lb.parse_label_json(c("raw_text")).alias("_l"))
    j = items.join(a, "id", "left")
    due = c("status") == "processing"
    hit = due & c("_l").isNotNull()

    def put(col, value):
        return F.when(hit, value).otherwise(c(col)).alias(col)

    new = {
        "primary_type": lb.normalize_type(c("_l.primary_type")), "tags": c("_l.tags"),
        "confidence_score": c("_l.confidence"), "summary": lb.normalize_summary(c("_l.summary")),
        "significance": lb.normalize_significance(c("_l.significance")),
    }
    status = F.when(hit, F.lit("processed")).when(due, F.lit("failed")).otherwise(c("status")).alias("status")
    keep = [x for x in items.columns if x not in new and x != "status"]
    return j.select(*keep, *[put(k, v) for k, v in new.items()], status)


def quality_stage(items: DataFrame, sources: DataFrame, repo_signals: DataFrame, *, as_of: Column) -> DataFrame:
    """quality_score and its details for processed rows.

    Repository urls with known signals (repo, signals struct) use them; a repository host whose url names no repository
    scores .5; everything else, and repositories without signals, uses the heuristic.
    """
    j = with_source(items.withColumn("_repo", ux.repo_slug(c("url"))), sources, "tier2", ("tier",))
    # the rows that name a repository alone meet the signals; all others would share one null key
    known = one_per_key(repo_signals.select(c("repo").alias("_repo"), "signals"), "_repo", F.to_json("signals"))
    other = j.where(c("_repo").isNull()).withColumn("signals", F.lit(None).cast(dict(repo_signals.dtypes)["signals"]))
    j = j.where(c("_repo").isNotNull()).join(known, "_repo", "left").unionByName(other)
    sub = sc.quality_subscores(c("signals"), c("content"), as_of)
    h = sc.heuristic_quality(c("source_tier"), c("content"), c("summary"), c("tags"), c("title"))
    j = j.withColumn("_sub", F.when(c("signals").isNotNull(), sub)).withColumn("_h", h)
    hosted, due = F.coalesce(c("url").contains("github.com"), F.lit(False)), fl.processed()
    score = F.when(c("_sub").isNotNull(), sc.aggregate_quality(c("_sub"))).when(
        hosted & c("_repo").isNull(), F.lit(0.5)
    ).otherwise(c("_h.final_score"))
    details = F.when(c("_sub").isNotNull(), F.to_json("_sub")).when(
        hosted & c("_repo").isNull(), F.lit('{"error":"unparseable_url"}')
    ).otherwise(F.to_json("_h"))
    out = j.withColumn("quality_score", F.when(due, score).otherwise(c("quality_score")))
    had = c("quality_score_details") if "quality_score_details" in items.columns else F.lit(None).cast("string")
    out = out.withColumn("quality_score_details", F.when(due, details).otherwise(had))
    return out.drop("_repo", "_sub", "_h", "signals", "source_tier")


EPOCH = "1970-01-01 00:00:00"


def first_rows(rows: DataFrame, limit: int | None, *order) -> DataFrame:
    """The first ``limit`` rows in this order; all of them, in no order, without a limit."""
    return rows if limit is None else rows.orderBy(*order).limit(limit)


def stalest_first(items: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Repository items by the time their details were last tracked; never tracked counts as the epoch."""
    tracked = F.get_json_object("quality_score_details", "$.last_tracked_at").try_cast("timestamp")
    rows = items.where(fl.processed() & c("url").contains("github.com"))
    rows = rows.withColumn("last_tracked_at", F.coalesce(tracked, F.lit(EPOCH).cast("timestamp")))
    return first_rows(rows, limit, "last_tracked_at", "id")


def refresh_quality(items: DataFrame, repo_signals: DataFrame, *, as_of: Column, limit: int | None = None) -> DataFrame:
    """(id, quality_score, quality_score_details) for the repository items that have fresh signals.

    With a limit, the stalest of those; items without signals do not use it up.
    """
    due = items.withColumn("repo", ux.repo_slug(c("url")))
    j = stalest_first(due.join(one_per_key(repo_signals.select("repo", "signals"), "repo", F.to_json("signals")), "repo"), limit=limit)
    sub = sc.quality_subscores(c("signals"), F.lit(None).cast("string"), as_of)
    j = j.select("id", sub.alias("sub"))
    details = F.to_json(
        F.struct(
            "sub.*", c("sub.signals.stars").alias("stars"), c("sub.signals.forks").alias("forks"),
            c("sub.signals.open_issues").alias("open_issues"), c("sub.signals.pushed_at").alias("pushed_at"),
            c("sub.signals.archived").alias("archived"), as_of.alias("last_tracked_at"),
        )
    )
    return j.select("id", sc.aggregate_quality(c("sub")).alias("quality_score"), details.alias("quality_score_details"))


def stuck_recovery(items: DataFrame, *, as_of: Column, minutes: int = 10) -> DataFrame:
    """Rows 'processing' for too long go back to the queue."""
    stuck = (c("status") == "processing") & (c("updated_at") < fl.days_back(as_of, minutes / 1440.0))
    return items.withColumn("status", F.when(stuck, F.lit("queued")).otherwise(c("status"))).withColumn(
        "updated_at", F.when(stuck, as_of).otherwise(c("updated_at"))
    )


def _clearable(as_of: Column, hours: int) -> Column:
    return (c("status") == "filtered") & c("embedding").isNotNull() & (c("updated_at") < fl.days_back(as_of, hours / 24.0))


def clear_filtered_vectors(items: DataFrame, *, as_of: Column, hours: int = 24) -> DataFrame:
    old = _clearable(as_of, hours)
    return items.withColumn("_clear", old).withColumn(
        "embedding", F.when(c("_clear"), F.lit(None)).otherwise(c("embedding"))
    ).withColumn("updated_at", F.when(c("_clear"), as_of).otherwise(c("updated_at"))).drop("_clear")


def clearable_estimate(items: DataFrame, *, as_of: Column, hours: int = 24) -> DataFrame:
    """How many vectors would go, and the megabytes of 4-byte floats they hold."""
    rows = items.where(_clearable(as_of, hours))
    return rows.agg(
        F.count(F.lit(1)).alias("vectors"),
        sc.half_up(F.coalesce(F.sum(F.size("embedding")), F.lit(0)) * 4 / 1048576.0, 2).alias("megabytes"),
    )


# ---- README jobs -------------------------------------------------------------------------


def _readme_text(description: Column, readme: Column) -> Column:
    d = F.coalesce(description, F.lit(""))
    return F.when(d != "", F.concat(d, F.lit("\n\n"), readme)).otherwise(readme)


def readme_backfill(items: DataFrame, readmes: DataFrame, *, limit: int | None = None, short: int = 200, max_chars: int | None = None) -> DataFrame:
    """New content for thin repository items, best first; readmes: (repo, readme, stars, description).

    A row whose repository is popular enough for its tags is reset to 'raw' so that it is embedded and judged again. With
    a limit, the best of the rows that have a README; the stored text is the whole README, or its first ``max_chars``
    characters, the hash that of the whole.
    """
    rows = items.where(
        fl.processed() & c("url").contains("github.com") & (F.length(F.coalesce("content", F.lit(""))) < short)
    )
    rows = rows.withColumn("repo", ux.repo_slug_strict(c("url"))).join(one_per_key(readmes, "repo", c("readme")), "repo")
    rows = rows.where((c("stars") >= sc.star_cutoff(c("tags"), c("url"))) & c("readme").isNotNull())
    text = c("readme") if max_chars is None else F.substring(c("readme"), 1, max_chars)
    return first_rows(rows, limit, F.desc("relevance_score"), "id").select(
        "id", _readme_text(c("description"), text).alias("content"), tx.short_hash(c("readme")).alias("content_hash"),
        F.lit("raw").alias("status"), "stars",
    )


def readme_refresh(items: DataFrame, readmes: DataFrame, *, limit: int | None = None, min_stars: int = 50, max_chars: int | None = None) -> DataFrame:
    """Changed READMEs of popular repository items, longest untouched first."""
    stars = F.coalesce(F.get_json_object("quality_score_details", "$.stars").try_cast("int"), F.lit(0))
    rows = items.where(
        fl.processed() & c("url").contains("github.com") & (F.length(F.coalesce("content", F.lit(""))) >= 200) & (stars >= min_stars)
    )
    rows = rows.withColumn("repo", ux.repo_slug_strict(c("url"))).join(one_per_key(readmes, "repo", c("readme")), "repo")
    text = c("readme") if max_chars is None else F.substring(c("readme"), 1, max_chars)
    h = tx.short_hash(c("readme"))
    return first_rows(rows.where(c("readme").isNotNull() & (h != F.coalesce("content_hash", F.lit("")))), limit, "updated_at", "id").select(
        "id", _readme_text(c("description"), text).alias("content"), h.alias("content_hash"), F.lit("raw").alias("status")
    )


def rising_repos(old: DataFrame, new: DataFrame, *, factor: int = 3, min_stars: int = 50) -> DataFrame:
    """Repositories whose stars at least tripled; both sides (repo, stars)."""
    j = new.select("repo", c("stars").alias("new_stars")).join(old.select("repo", c("stars").alias("old_stars")), "repo")
    return j.where((c("old_stars") > 0) & (c("new_stars") >= c("old_stars") * factor) & (c("new_stars") >= min_stars))
