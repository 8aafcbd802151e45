"""RSS and Atom feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.functions import text as tx
from feedloom.sources.rows import head, iso_time, land, mail_time, text_or

c = F.col
RSS = (
    "channel struct<item:array<struct<link:string,title:string,description:string,guid:string,pubDate:string,"
    "category:array<string>>>>"
)
ATOM = (
    "entry array<struct<link:array<struct<_href:string,_rel:string>>,title:string,summary:string,content:string,"
    "id:string,published:string,updated:string,category:array<struct<_term:string>>>>"
)


def parse_rss(payloads: DataFrame) -> DataFrame:
    """(source_id, source_name, payload xml) -> one row per item."""
    p = payloads.select("source_id", "source_name", F.from_xml("payload", RSS).alias("x"))
    return p.select("source_id", "source_name", F.explode("x.channel.item").alias("e")).select(
        "source_id", "source_name", c("e.link").alias("link"), c("e.title").alias("title"), c("e.description").alias("summary"),
        c("e.guid").alias("id"), mail_time(c("e.pubDate")).alias("published"), F.lit(None).cast("timestamp").alias("updated"),
        c("e.category").alias("terms"),
    )


def parse_atom(payloads: DataFrame) -> DataFrame:
    p = payloads.select("source_id", "source_name", F.from_xml("payload", ATOM).alias("x"))
    e = p.select("source_id", "source_name", F.explode("x.entry").alias("e"))
    links = c("e.link")
    main = F.filter(links, lambda k: k["_rel"].isNull() | (k["_rel"] == "alternate"))
    return e.select(
        "source_id", "source_name", F.coalesce(F.get(main, F.lit(0))["_href"], F.get(links, F.lit(0))["_href"]).alias("link"),
        c("e.title").alias("title"), text_or(c("e.summary"), c("e.content")).alias("summary"), c("e.id").alias("id"),
        iso_time(c("e.published")).alias("published"), iso_time(c("e.updated")).alias("updated"),
        F.transform("e.category", lambda t: t["_term"]).alias("terms"),
    )


def release_title(source_name: Column, title: Column) -> Column:
    """A bare version gets its project's name in front; a missing title becomes the name."""
    flat = F.trim(F.coalesce(title, F.lit("Untitled")))
    return (
        F.when(flat.isin("", "Untitled"), text_or(source_name, F.coalesce(title, F.lit("Untitled"))))
        .when(~flat.contains(" "), F.concat(source_name, F.lit(" "), flat))
        .otherwise(flat)
    )


def normalize_feed(entries: DataFrame, kind: str = "rss", bodies: DataFrame | None = None) -> DataFrame:
    """Entries of rss, reddit, youtube, releasebot, gh_releases or arxiv feeds as landing rows.

    ``bodies`` (url, body) may supply fetched article text for rss entries with less than 50 characters of summary.
    """
    when = F.coalesce("published", "updated")
    if kind == "arxiv":
        url, abstract = F.coalesce("id", F.lit("")), F.coalesce("summary", F.lit(""))
        title = F.trim(F.replace(F.coalesce("title", F.lit("Untitled")), F.lit("\n"), F.lit(" ")))
        terms = F.filter(F.coalesce("terms", F.array().cast("array<string>")), lambda t: F.coalesce(t, F.lit("")) != "")
        return land(entries, external_id=url, url=url, title=title, content=abstract, tags=terms, published_at=when)
    raw = F.coalesce("summary", F.lit(""))
    marked = text_or(c("summary"), c("title"))
    if kind != "rss":
        title = release_title(c("source_name"), c("title")) if kind == "gh_releases" else text_or(c("title"), F.lit("Untitled"))
        return land(
            entries, external_id=F.coalesce("id", "link"), url=c("link"), title=title, content=raw, published_at=when,
            fingerprint_of=marked,
        )
    e = entries.withColumn("body", F.trim(tx.strip_tags(raw)))
    if bodies is not None:
        b = bodies.select(c("url").alias("link"), c("body").alias("_fetched"))
        thin = F.length("body") < 50
        e = e.join(b, "link", "left").withColumn("body", F.when(thin, F.coalesce("_fetched", "body")).otherwise(c("body")))
    cut = F.when(F.length("body") > 100, F.concat(F.substring("body", 1, 100), F.lit("..."))).otherwise(c("body"))
    return land(
        e, external_id=F.coalesce("id", "link"), url=c("link"), title=text_or(c("title"), cut, F.lit("Untitled")),
        content=c("body"), excerpt=head(c("body")), published_at=when, fingerprint_of=marked,
    )


def detect_feed_type(payload: Column, content_type: Column | None = None) -> Column:
    """json_feed, atom, rss or unknown; the declared content type is looked at first."""
    kind = F.coalesce(content_type, F.lit("")) if content_type is not None else F.lit("")
    version = F.when(F.ltrim(payload).startswith("{"), F.get_json_object(payload, "$.version"))
    prolog = r"(?is)^\s*(?:<\?xml[^>]*\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*"
    return (
        F.when(kind.contains("application/feed+json"), F.lit("json_feed"))
        .when(F.lower(version).contains("jsonfeed"), F.lit("json_feed"))
        .when(payload.rlike(prolog + r"<(?:\w+:)?feed\b"), F.lit("atom"))
        .when(payload.rlike(prolog + r"<(?:rss|rdf:RDF|RDF)\b"), F.lit("rss"))
        .otherwise(F.lit("unknown"))
    )
