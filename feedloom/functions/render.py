"""Text and JSON renderings of items as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.functions.scores import half_up

INTERNAL_COLUMNS = [
    "quality_score_details", "confidence_score", "cluster_id", "contrarian_signals", "status", "source_id",
]


def _or(*cols) -> Column:
    """First non-empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def item_text() -> Column:
    """Plain block of one item; its length is what a briefing budget counts."""
    return F.concat(
        F.lit("## "), F.col("title"), F.lit("\n"),
        _or(F.col("summary"), F.col("excerpt")), F.lit("\nURL: "), F.col("url"),
        F.lit("\nType: "), F.col("primary_type"),
        F.lit(" | Sig: "), _or(F.col("significance"), F.lit("informational")),
        F.lit(" | Score: "), F.format_string("%.2f", half_up(F.coalesce(F.col("relevance_score"), F.lit(0.0)), 2)),
        F.lit("\nTags: "), F.array_join(F.col("tags"), ", "), F.lit("\n\n"),
    )


def library_text() -> Column:
    """Plain block of one knowledge entry with its bullets."""
    def bullets(head, col):
        body = F.concat(F.lit(head + "\n"), F.array_join(F.transform(col, lambda x: F.concat(F.lit("- "), x)), "\n"))
        return F.when(F.coalesce(F.size(col), F.lit(0)) > 0, body)

    details = F.transform(
        F.col("gotchas"),
        lambda g: F.concat(F.coalesce(g["title"], F.lit("")), F.lit(": "), F.coalesce(g["detail"], F.lit(""))),
    )
    return F.concat(
        F.concat_ws(
            "\n",
            F.concat(F.lit("## Library: "), F.col("title")),
            F.nullif(F.col("tldr"), F.lit("")),
            bullets("Key points:", F.col("key_points")),
            bullets("Gotchas:", details),
        ),
        F.lit("\n\n"),
    )


def render_markdown() -> Column:
    day = F.date_format(F.coalesce(F.col("published_at"), F.col("created_at")), "yyyy-MM-dd")
    return F.concat(
        F.lit("## ["), F.col("title"), F.lit("]("), F.col("url"), F.lit(")\n\n**"),
        _or(F.col("significance"), F.lit("informational")), F.lit("** · "), F.col("primary_type"), F.lit(" · "),
        _or(F.col("source_name"), F.lit("Unknown source")), F.lit("\n\n"),
        _or(F.col("summary"), F.col("excerpt")), F.lit("\n\n*Tags: "), F.array_join(F.col("tags"), ", "),
        F.lit("* · *"), F.coalesce(day, F.lit("")), F.lit("*"),
    )


def escape_chat(c: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def render_chat_blocks() -> Column:
    """Block JSON for a chat tool."""
    title = escape_chat(F.col("title"))
    body = escape_chat(_or(F.col("summary"), F.col("excerpt"), F.col("title")))

    def text(c):
        return F.struct(F.lit("mrkdwn").alias("type"), c.alias("text"))

    foot = F.concat(
        _or(F.col("significance"), F.lit("info")), F.lit(" · "), F.col("primary_type"), F.lit(" · "),
        escape_chat(F.coalesce(F.col("source_name"), F.lit(""))),
    )
    section = F.to_json(
        F.struct(
            F.lit("section").alias("type"),
            text(F.concat(F.lit("*<"), F.col("url"), F.lit("|"), title, F.lit(">*\n"), body)).alias("text"),
        )
    )
    context = F.to_json(F.struct(F.lit("context").alias("type"), F.array(text(foot)).alias("elements")))
    return F.concat(F.lit('{"blocks":['), section, F.lit(","), context, F.lit("]}"))


def render_terminal() -> Column:
    bold, dim, reset = "\033[1m", "\033[2m", "\033[0m"
    tags = F.array_join(F.transform(F.col("tags"), lambda t: F.concat(F.lit("["), t, F.lit("]"))), " ")
    return F.concat(
        F.lit(bold), F.col("title"), F.lit(f"{reset}\n{dim}"), F.col("url"), F.lit(f"{reset}\n"),
        _or(F.col("summary"), F.col("excerpt")), F.lit(f"\n{dim}"), tags, F.lit(reset),
    )


def clean_item(items: DataFrame) -> DataFrame:
    """Public form: internal columns gone, days for timestamps, scores to two digits, one summary text, stars lifted."""
    out = items
    if "quality_score_details" in items.columns:
        stars = F.get_json_object("quality_score_details", "$.signals.stars").try_cast("long")
        out = out.withColumn("github_stars", F.when(stars > 0, stars))
    for c in ("created_at", "published_at"):
        if c in items.columns:
            out = out.withColumn(c, F.date_format(c, "yyyy-MM-dd"))
    for c in ("relevance_score", "quality_score", "similarity", "rank"):
        if c in items.columns:
            out = out.withColumn(c, half_up(F.col(c), 2))
    if {"excerpt", "summary"} <= set(items.columns):
        out = out.withColumn("excerpt", F.when(F.coalesce(F.col("summary"), F.lit("")) == "", F.col("excerpt")))
    return out.drop(*INTERNAL_COLUMNS)


def project_fields(items: DataFrame, fields: list[str] | None) -> DataFrame:
    """Only the fields asked for; the id always stays."""
    if not fields:
        return items
    keep = set(fields) | {"id"}
    return items.select(*[c for c in items.columns if c in keep])
