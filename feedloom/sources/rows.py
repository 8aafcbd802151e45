"""The landing row every normaliser produces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.functions import text as tx
from feedloom.functions import urls as ux

LANDED = [
    "source_id", "source_name", "external_id", "url", "url_hash", "title", "content", "excerpt", "tags", "published_at",
    "content_hash", "status", "primary_type",
]


def text_or(*cols: Column) -> Column:
    """First non-empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def head(text: Column, n: int = 500) -> Column:
    return F.nullif(F.substring(text, 1, n), F.lit(""))


def no_tags() -> Column:
    return F.array().cast("array<string>")


def iso_time(text: Column) -> Column:
    """ISO 8601 with or without a zone; null when it is no time."""
    return F.try_to_timestamp(F.nullif(F.trim(text), F.lit("")))


def mail_time(text: Column) -> Column:
    """RFC 822 dates as feeds carry them."""
    flat = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]+,\s*", ""), r"(GMT|UTC|UT)$", "+0000")
    return F.try_to_timestamp(flat, F.lit("d MMM yyyy HH:mm:ss Z"))


def land(
    df: DataFrame, *, external_id: Column, url: Column, title: Column, content: Column, excerpt: Column | None = None,
    tags: Column | None = None, published_at: Column | None = None, fingerprint_of: Column | None = None,
) -> DataFrame:
    """Canonical raw rows; rows without an url are dropped."""
    body = F.coalesce(content, F.lit(""))
    marked = body if fingerprint_of is None else F.coalesce(fingerprint_of, F.lit(""))
    out = df.select(
        "source_id", "source_name", external_id.cast("string").alias("external_id"), url.alias("url"),
        ux.url_hash(url).alias("url_hash"), title.alias("title"), body.alias("content"),
        (head(body) if excerpt is None else excerpt).alias("excerpt"),
        (no_tags() if tags is None else F.coalesce(tags, no_tags())).alias("tags"),
        (F.lit(None).cast("timestamp") if published_at is None else published_at).alias("published_at"),
        tx.content_fingerprint(marked).alias("content_hash"), F.lit("raw").alias("status"), F.lit("unknown").alias("primary_type"),
    )
    return out.where(F.coalesce(F.col("url"), F.lit("")) != "")


def watermark(df: DataFrame, seconds: Column) -> DataFrame:
    """Newest event second per source over everything fetched, duplicates included."""
    return df.groupBy("source_id").agg(F.max(seconds).alias("last_poll_ts"))
