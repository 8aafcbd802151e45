"""Web pages and sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.functions import text as tx
from feedloom.operators import filters as fl
from feedloom.operators.joins import one_per_key
from feedloom.sources.rows import head, iso_time, text_or

c = F.col


def _inside(html: Column, tag: str) -> Column:
    return F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)


def _attr_pair(html: Column, name: str, value: str) -> Column:
    """content="..." of the meta tag with name=value, whichever attribute comes first."""
    key = rf"{name}=[\"']{value}[\"']"
    body = r"content=[\"'](.*?)[\"']"
    first = F.regexp_extract(html, rf"(?i)<meta\s+{key}\s+{body}", 1)
    second = F.regexp_extract(html, rf"(?i)<meta\s+{body}\s+{key}", 1)
    return text_or(first, second)


def extract_page(html: Column) -> Column:
    """struct<title, excerpt, body>: article, else main, else body; scripts, styles and tags gone."""
    title = tx.strip_tags(F.trim(_inside(html, "title")))
    about = F.trim(F.coalesce(_attr_pair(html, "name", "description"), _attr_pair(html, "property", "og:description"), F.lit("")))
    raw = F.when(html.rlike("(?is)<article[^>]*>.*?</article>"), _inside(html, "article")).when(
        html.rlike("(?is)<main[^>]*>.*?</main>"), _inside(html, "main")
    )
    raw = text_or(raw, _inside(html, "body"), F.lit(""))
    for pattern, by in ((r"(?is)<script[^>]*>.*?</script>", ""), (r"(?is)<style[^>]*>.*?</style>", ""), ("<[^>]+>", " "), (r"\s+", " ")):
        raw = F.regexp_replace(raw, pattern, by)
    return F.struct(title.alias("title"), about.alias("excerpt"), F.trim(raw).alias("body"))


def extract_published(html: Column) -> Column:
    """Open graph time, then JSON-LD published or modified dates, then the first time tag; null when none parses."""
    prop = r"property=[\"']article:published_time[\"']"
    body = r"content=[\"'](.*?)[\"']"
    og = text_or(
        F.regexp_extract(html, rf"(?i)<meta\s+[^>]*{prop}\s+{body}", 1), F.regexp_extract(html, rf"(?i)<meta\s+[^>]*{body}\s+[^>]*{prop}", 1)
    )
    blocks = F.regexp_extract_all(
        html, F.lit(r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1)
    )

    def dates(block):
        # an object, or a list of objects: one object reads as a list of one
        found = F.coalesce(F.from_json(block, "array<struct<datePublished:string,dateModified:string>>"), F.array())
        return F.flatten(F.transform(found, lambda x: F.array(iso_time(x["datePublished"]), iso_time(x["dateModified"]))))

    linked = F.get(F.array_compact(F.flatten(F.transform(blocks, dates))), F.lit(0))
    timed = F.regexp_extract(html, r"(?i)<time[^>]+datetime=[\"'](.*?)[\"']", 1)
    return F.coalesce(iso_time(og), linked, iso_time(timed))


def page_rows(pages: DataFrame) -> DataFrame:
    """(url, html) -> (url, title, content, excerpt, published_at, content_hash); pages without a title are dropped."""
    p = pages.withColumn("x", extract_page(c("html")))
    title, body = F.trim("x.title"), c("x.body")
    return p.where(title != "").select(
        "url", title.alias("title"), body.alias("content"), head(text_or(F.trim("x.excerpt"), F.substring(body, 1, 500), F.lit(""))).alias("excerpt"),
        extract_published(c("html")).alias("published_at"), tx.content_fingerprint(text_or(body, title)).alias("content_hash"),
    )


def page_refresh(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Items whose page changed after they were stored take the new text and start over without a vector.

    pages: (url, lastmod, title, content, excerpt, published_at, content_hash). Unknown urls are not handled here; of a
    page fetched more than once the newest counts.
    """
    pages = one_per_key(pages, "url", F.desc("lastmod"), c("content_hash"), c("title"), c("content"))
    new = pages.select("url", "lastmod", *[c(x).alias(f"_{x}") for x in ("title", "content", "excerpt", "published_at", "content_hash")])
    j = items.join(new, "url", "left")
    hit = F.coalesce(c("lastmod") > c("created_at"), F.lit(False))
    for x in ("title", "content", "excerpt", "published_at", "content_hash"):
        if x in items.columns:
            j = j.withColumn(x, F.when(hit, c(f"_{x}")).otherwise(c(x)))
    if "embedding" in items.columns:
        j = j.withColumn("embedding", F.when(hit, F.lit(None)).otherwise(c("embedding")))
    j = j.withColumn("status", F.when(hit, F.lit("raw")).otherwise(c("status")))
    return j.select(*items.columns)


URLSET = "url array<struct<loc:string,lastmod:string>>"
INDEX = "sitemap array<struct<loc:string>>"


def parse_sitemap(payloads: DataFrame) -> DataFrame:
    """(source_id, payload) -> (source_id, kind, url, lastmod): pages of a urlset, or children of a sitemap index."""
    root = F.regexp_extract("payload", r"(?s)<(?:\w+:)?(urlset|sitemapindex)\b", 1)
    p = payloads.withColumn("_root", root)
    pages = p.where(c("_root") == "urlset").select(
        "source_id", F.explode(F.from_xml("payload", URLSET)["url"]).alias("e")
    ).select("source_id", F.lit("page").alias("kind"), F.trim("e.loc").alias("url"), iso_time(c("e.lastmod")).alias("lastmod"))
    children = p.where(c("_root") == "sitemapindex").select(
        "source_id", F.explode(F.from_xml("payload", INDEX)["sitemap"]).alias("e")
    ).select("source_id", F.lit("child").alias("kind"), F.trim("e.loc").alias("url"), F.lit(None).cast("timestamp").alias("lastmod"))
    return pages.unionByName(children).where(F.coalesce("url", F.lit("")) != "")


def sitemap_filter(
    entries: DataFrame, *, patterns: str | list[str] | None = None, max_age_days: int | None = None, as_of: Column | None = None
) -> DataFrame:
    """Any of the path patterns; entries without a date are kept, dated ones only when recent."""
    if isinstance(patterns, str):
        patterns = [p.strip() for p in patterns.split(",") if p.strip()]
    cond = fl.any_of(*[c("url").contains(p) for p in patterns]) if patterns else F.lit(True)
    if max_age_days is not None:
        cond = cond & (c("lastmod").isNull() | (c("lastmod") >= fl.days_back(as_of, max_age_days)))
    return entries.where(cond)
