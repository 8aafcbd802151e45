"""JSON payloads of catalogues, boards, registries and mail.

Landing frames carry (source_id, source_name, payload). One payload is one fetched page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom import vocab
from feedloom.functions import text as tx
from feedloom.functions import urls as ux
from feedloom.sources.rows import head, iso_time, land, no_tags, text_or

c = F.col


def _open(payloads: DataFrame, schema: str, path: str, *keep: str) -> DataFrame:
    p = payloads.select("source_id", "source_name", *keep, F.from_json("payload", schema).alias("p"))
    return p.select("source_id", "source_name", *keep, F.explode(f"p.{path}").alias("e"))


def _blank(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


# ---- stories, repositories, discussions --------------------------------------------------

HITS = "hits array<struct<objectID:string,url:string,title:string,story_text:string,created_at_i:long>>"


def open_hits(payloads: DataFrame) -> DataFrame:
    return _open(payloads, HITS, "hits")


def normalize_hn(payloads: DataFrame) -> DataFrame:
    h = open_hits(payloads)
    url = text_or(c("e.url"), F.concat(F.lit("https://news.ycombinator.com/item?id="), c("e.objectID")))
    at = F.when(c("e.created_at_i") > 0, F.timestamp_seconds("e.created_at_i"))
    return land(
        h, external_id=c("e.objectID"), url=url, title=text_or(c("e.title"), url),
        content=text_or(c("e.story_text"), c("e.title")), published_at=at,
    )


def hn_watermark(payloads: DataFrame) -> DataFrame:
    """Newest story second per source, before any de-duplication."""
    return open_hits(payloads).groupBy("source_id").agg(F.max("e.created_at_i").alias("last_poll_ts"))


REPOS = (
    "items array<struct<id:long,html_url:string,full_name:string,description:string,topics:array<string>,"
    "created_at:string,stargazers_count:long>>"
)


def open_repos(payloads: DataFrame) -> DataFrame:
    return _open(payloads, REPOS, "items")


def normalize_repo_search(payloads: DataFrame) -> DataFrame:
    r = open_repos(payloads)
    return land(
        r, external_id=c("e.id"), url=c("e.html_url"), title=text_or(c("e.full_name"), c("e.html_url")),
        content=c("e.description"), tags=c("e.topics"), published_at=iso_time(c("e.created_at")),
    )


def repo_candidates(payloads: DataFrame, *, min_stars: int = 50, topics=vocab.REPO_TOPICS) -> DataFrame:
    """(repo, stars) worth tracking closely: popular, and about one of the topics."""
    r = open_repos(payloads)
    about = F.arrays_overlap(F.coalesce("e.topics", no_tags()), F.array(*map(F.lit, topics)))
    return r.where((c("e.stargazers_count") > min_stars) & about).select(
        c("e.full_name").alias("repo"), c("e.stargazers_count").alias("stars")
    )


NODES = "nodes array<struct<id:string,url:string,title:string,bodyText:string,createdAt:string,category:struct<name:string>>>"


def normalize_discussions(payloads: DataFrame, *, last_poll: Column | None = None) -> DataFrame:
    """Discussions after the watermark (payload pages also carry ``repo``)."""
    d = _open(payloads, NODES, "nodes").withColumn("_at", iso_time(c("e.createdAt")))
    if last_poll is not None:
        d = d.where(c("_at").isNull() | (c("_at") > last_poll))
    body = _blank(c("e.bodyText"))
    tags = F.array_compact(F.array(F.lit("github-discussions"), F.lower(F.nullif(c("e.category.name"), F.lit("")))))
    return land(
        d, external_id=c("e.id"), url=c("e.url"), title=text_or(c("e.title"), F.lit("(No title)")),
        content=F.substring(body, 1, 2000), excerpt=head(body), tags=tags, published_at=c("_at"), fingerprint_of=body,
    )


def last_discussions(payloads: DataFrame) -> DataFrame:
    """Newest discussion id per repository; of several of the same time the first, where numbers in ids go by their value."""
    d = _open(payloads, NODES, "nodes", "repo").withColumn("_at", iso_time(c("e.createdAt"))).where(c("_at").isNotNull())
    return d.groupBy("repo").agg(F.min_by("e.id", F.struct(-F.unix_micros("_at"), F.length("e.id"), "e.id")).alias("last_id"), F.max("_at").alias("last_at"))


# ---- package catalogues ------------------------------------------------------------------

NPM = (
    "objects array<struct<package:struct<name:string,description:string,date:string,keywords:array<string>,"
    "links:struct<npm:string>>>>"
)


def normalize_npm(payloads: DataFrame, *, last_poll_ts: int = 0, readmes: DataFrame | None = None) -> DataFrame:
    """Packages newer than the watermark; a README (name, readme) is preferred to the description."""
    p = _open(payloads, NPM, "objects").select("source_id", "source_name", c("e.package").alias("p"))
    p = p.withColumn("_ts", F.unix_timestamp(iso_time(c("p.date"))))
    p = p.where(c("_ts").isNull() | (c("_ts") > last_poll_ts))
    name = _blank(c("p.name"))
    url = text_or(c("p.links.npm"), F.when(name != "", F.concat(F.lit("https://www.npmjs.com/package/"), name)))
    p = p.withColumn("_readme", F.lit(None).cast("string")) if readmes is None else p.join(
        readmes.select(c("name").alias("_name"), c("readme").alias("_readme")), c("p.name") == c("_name"), "left"
    )
    about = _blank(c("p.description"))
    return land(
        p, external_id=name, url=url, title=name, content=text_or(c("_readme"), about), excerpt=head(about), tags=c("p.keywords")
    )


PYPI = (
    "info struct<name:string,version:string,summary:string,description:string,keywords:string,classifiers:array<string>>,"
    "urls array<struct<upload_time_iso_8601:string>>"
)


def normalize_pypi(payloads: DataFrame, *, last_versions: DataFrame | None = None) -> DataFrame:
    """One payload per package; only versions not seen before, (package, version)."""
    p = payloads.select("source_id", "source_name", "package", F.from_json("payload", PYPI).alias("p"))
    p = p.withColumn("version", c("p.info.version")).where(_blank(c("version")) != "")
    if last_versions is not None:
        p = p.join(last_versions.select("package", "version").distinct(), ["package", "version"], "left_anti")
    summary, full = _blank(c("p.info.summary")), _blank(c("p.info.description"))
    body = F.when(F.length(full) > 50, F.substring(full, 1, 5000)).otherwise(summary)
    words = F.filter(F.transform(F.split(_blank(c("p.info.keywords")), ","), lambda k: F.trim(k)), lambda k: k != "")
    dotted = F.filter(F.coalesce("p.info.classifiers", no_tags()), lambda x: x.contains(" :: "))
    tails = F.slice(F.array_distinct(F.transform(dotted, lambda x: F.lower(F.substring_index(x, " :: ", -1)))), 1, 10)
    name = F.concat_ws(" ", "package", "version")
    title = F.when(F.length(summary) > 5, F.concat(name, F.lit(" — "), F.substring(summary, 1, 80))).otherwise(
        F.concat(name, F.lit(" release"))
    )
    return land(
        p, external_id=F.concat("package", F.lit("=="), "version"),
        url=F.concat(F.lit("https://pypi.org/project/"), "package", F.lit("/"), "version", F.lit("/")), title=title,
        content=body, excerpt=head(summary), tags=F.when(F.size(words) > 0, words).otherwise(tails),
        published_at=iso_time(F.get("p.urls", F.lit(0))["upload_time_iso_8601"]),
    )


EXTENSIONS = (
    "extensions array<struct<publisher:struct<publisherName:string>,extensionName:string,displayName:string,"
    "shortDescription:string,versions:array<struct<version:string,lastUpdated:string>>,"
    "statistics:array<struct<statisticName:string,value:double>>>>"
)


def normalize_extensions(payloads: DataFrame, *, last_poll_ts: float = 0.0) -> DataFrame:
    """Payload pages also carry the ``query`` they answer."""
    x = _open(payloads, EXTENSIONS, "extensions", "query")
    newest = F.get("e.versions", F.lit(0))
    x = x.withColumn("_at", iso_time(newest["lastUpdated"])).withColumn("_version", _blank(newest["version"]))
    pub, name = c("e.publisher.publisherName"), c("e.extensionName")
    x = x.where((_blank(pub) != "") & (_blank(name) != ""))
    x = x.where(c("_at").isNull() | (F.unix_micros("_at") > int(last_poll_ts * 1_000_000)))

    def stat(key):
        found = F.filter(F.coalesce("e.statistics", F.array().cast("array<struct<statisticName:string,value:double>>")),
                         lambda s: s["statisticName"] == key)
        return F.coalesce(F.element_at(F.transform(found, lambda s: s["value"]), F.when(F.size(found) > 0, -1).otherwise(None)), F.lit(0.0))

    installs = stat("install").cast("long")
    usage = F.when(
        installs > 0,
        F.concat(F.lit("Installs: "), F.format_number(installs, 0), F.lit(". Rating: "), F.format_string("%.1f", stat("weightedRating"))),
    )
    about, key = _blank(c("e.shortDescription")), F.concat(pub, F.lit("."), name)
    return land(
        x, external_id=F.concat(key, F.lit("=="), "_version"),
        url=F.concat(F.lit("https://marketplace.visualstudio.com/items?itemName="), key),
        title=F.concat(F.coalesce("e.displayName", name), F.lit(" ("), key, F.lit(")")),
        content=F.concat_ws(" | ", F.nullif(about, F.lit("")), usage), excerpt=head(about), tags=F.array("query"),
        published_at=c("_at"), fingerprint_of=about,
    )


SERVERS = (
    "servers array<struct<server:struct<name:string,description:string,websiteUrl:string,repository:struct<url:string>>,"
    "name:string,description:string,websiteUrl:string,repository:struct<url:string>>>"
)


def normalize_registry(payloads: DataFrame, *, readmes: DataFrame | None = None) -> DataFrame:
    """Servers, nested or flat; a README (repo, readme) replaces descriptions under 200 characters."""
    s = _open(payloads, SERVERS, "servers")
    flat = F.struct("e.name", "e.description", "e.websiteUrl", "e.repository")
    s = s.withColumn("s", F.coalesce(c("e.server"), flat))
    s = s.withColumn("_url", text_or(c("s.websiteUrl"), c("s.repository.url"), F.lit(""))).withColumn("_about", _blank(c("s.description")))
    if readmes is None:
        s = s.withColumn("_readme", F.lit(None).cast("string"))
    else:
        s = s.withColumn("_repo", ux.repo_slug(c("_url"))).join(
            readmes.select(c("repo").alias("_repo"), c("readme").alias("_readme")), "_repo", "left"
        )
    body = F.when((F.length("_about") < 200) & (_blank(c("_readme")) != ""), c("_readme")).otherwise(c("_about"))
    return land(s, external_id=_blank(c("s.name")), url=c("_url"), title=_blank(c("s.name")), content=body, excerpt=head(c("_about")))


PLUGINS = (
    "name string, plugins array<struct<name:string,description:string,version:string,author:string,category:string,"
    "keywords:array<string>,homepage:string,repository:string,license:string,source:string,mcpServers:string,"
    "commands:string,agents:string,hooks:string,lspServers:string>>"
)
COMPONENTS = {
    "mcpServers": "mcp-server", "commands": "commands", "agents": "agents", "hooks": "hooks", "lspServers": "lsp-server",
}


def _given(value: Column) -> Column:
    """A JSON value that is neither missing nor empty."""
    return ~F.coalesce(F.trim(value), F.lit("")).isin("", "[]", "{}", "null", "false")


def plugin_source_url(source: Column) -> Column:
    """A browsable url from a plugin's source object; a plain path has none."""
    def get(key):
        return F.nullif(F.get_json_object(source, f"$.{key}"), F.lit(""))

    kind, link = get("source"), get("url")
    hosted = link.contains("github.com") | link.contains("gitlab.com")
    return F.when(
        F.ltrim(source).startswith("{"),
        F.when((kind == "github") & get("repo").isNotNull(), F.concat(F.lit("https://github.com/"), get("repo")))
        .when(kind.isin("url", "git-subdir") & hosted, F.regexp_replace(link, r"\.git$", ""))
        .when((kind == "npm") & get("package").isNotNull(), F.concat(F.lit("https://www.npmjs.com/package/"), get("package"))),
    )


def normalize_marketplace(payloads: DataFrame) -> DataFrame:
    p = payloads.select("source_id", "source_name", F.from_json("payload", PLUGINS).alias("p"))
    m = p.select("source_id", "source_name", c("p.name").alias("market"), F.explode("p.plugins").alias("e"))
    m = m.where(_blank(c("e.name")) != "")
    url = text_or(
        c("e.homepage"), c("e.repository"), plugin_source_url(c("e.source")),
        F.concat(F.lit("marketplace://"), "market", F.lit("/"), "e.name"),
    )
    parts = F.array_compact(F.array(*[F.when(_given(c(f"e.{k}")), F.lit(v)) for k, v in COMPONENTS.items()]))
    author = F.get_json_object("e.author", "$.name")

    def labelled(label, col):
        return F.concat(F.lit(f"{label}: "), F.nullif(col, F.lit("")))

    text = F.concat_ws(
        " | ", F.nullif(c("e.description"), F.lit("")), labelled("Version", c("e.version")), labelled("Author", author),
        labelled("Category", c("e.category")), labelled("License", c("e.license")),
        F.when(F.size(parts) > 0, F.concat(F.lit("Components: "), F.array_join(parts, ", "))),
    )
    tags = F.concat(
        F.array(F.lit("claude-code-plugin"), F.concat(F.lit("marketplace:"), "market")),
        F.slice(F.coalesce("e.keywords", no_tags()), 1, 10),
        F.array_compact(F.array(F.nullif(c("e.category"), F.lit("")))), parts,
    )
    return land(
        m, external_id=F.concat("market", F.lit("/"), "e.name"), url=url, title=F.concat("e.name", F.lit(" (Claude Code plugin)")),
        content=text_or(text, c("e.name")), excerpt=head(_blank(c("e.description"))), tags=tags,
    )


# ---- posts, mail, scraped rows -----------------------------------------------------------

POSTS = "posts array<struct<uri:string,author:struct<handle:string>,record:struct<text:string,created_at:string>>>"


def normalize_posts(payloads: DataFrame) -> DataFrame:
    p = _open(payloads, POSTS, "posts").withColumn("_text", F.trim(_blank(c("e.record.text"))))
    url = F.concat(
        F.lit("https://bsky.app/profile/"), "e.author.handle", F.lit("/post/"), F.substring_index("e.uri", "/", -1)
    )
    return land(
        p.where(c("_text") != ""), external_id=c("e.uri"), url=url, title=F.trim(F.substring("_text", 1, 100)), content=c("_text"),
        tags=F.array(F.lit("bluesky"), F.lit("social")), published_at=iso_time(c("e.record.created_at")),
    )


def normalize_email(messages: DataFrame) -> DataFrame:
    """(source_id, source_name, token, sender, subject, body_html, body_plain, stripped_text) -> newsletter rows."""
    key = F.concat(F.lit("mailgun:"), "token", F.lit(":"), "sender", F.lit(":"), "subject")
    url = F.concat(F.lit("mailgun://email/"), F.substring(F.sha2(key, 256), 1, 16))
    text = _blank(F.substring(F.trim(tx.strip_tags(text_or(c("stripped_text"), c("body_plain"), F.lit("")))), 1, 500))
    m = messages.withColumn("_text", text).where((c("_text") != "") | (_blank(c("subject")) != ""))
    return land(
        m, external_id=ux.url_hash(url), url=url, title=text_or(c("subject"), F.lit("(No subject)")), content=c("_text"),
        excerpt=c("_text"), tags=F.array(F.lit("newsletter")),
    )


def scraped_rows(rows: DataFrame, *, seen: DataFrame | None = None) -> DataFrame:
    """(source_id, source_name, base_url, title, href, excerpt) of scraped listings, without urls seen before."""
    r = rows.withColumn("_url", ux.resolve_url(c("href"), c("base_url"))).where(
        (_blank(F.trim("title")) != "") & (_blank(c("href")) != "")
    )
    if seen is not None:
        r = r.join(seen.select("source_id", c("url").alias("_url")).distinct(), ["source_id", "_url"], "left_anti")
    text = text_or(F.trim("excerpt"), F.trim("title"))
    return land(r, external_id=c("_url"), url=c("_url"), title=F.trim("title"), content=text, excerpt=head(_blank(F.trim("excerpt"))))


def remember_seen(seen: DataFrame, found: DataFrame, *, keep: int = 100) -> DataFrame:
    """The last ``keep`` urls per source in order of first sight; both sides (source_id, url, seen_no)."""
    both = seen.select("source_id", "url", "seen_no").unionByName(found.select("source_id", "url", "seen_no"))
    first = both.groupBy("source_id", "url").agg(F.min("seen_no").alias("seen_no"))
    from feedloom.operators.rank import top_per_group

    return top_per_group(first, ["source_id"], [F.desc("seen_no"), F.desc("url")], keep).drop("rn")


def trending_repos(rows: DataFrame, *, seen: DataFrame | None = None) -> DataFrame:
    """(source_id, source_name, href, description, stars_text, language) of a trending page."""
    parts = F.split(F.regexp_replace(F.trim("href"), "^/+|/+$", ""), "/")
    r = rows.withColumn("_repo", F.concat(F.get(parts, F.lit(0)), F.lit("/"), F.get(parts, F.lit(1)))).where(c("_repo").isNotNull())
    r = r.withColumn("_url", F.concat(F.lit("https://github.com"), F.trim("href")))
    if seen is not None:
        r = r.join(seen.select("source_id", c("url").alias("_url")).distinct(), ["source_id", "_url"], "left_anti")

    def labelled(label, col):
        return F.concat(F.lit(f"{label}: "), F.nullif(col, F.lit("")), F.lit("."))

    text = F.concat_ws(" ", F.nullif(c("description"), F.lit("")), labelled("Stars", c("stars_text")), labelled("Language", c("language")))
    tags = F.array_compact(F.array(F.lit("github"), F.lit("trending"), F.lower(F.nullif(c("language"), F.lit("")))))
    return land(
        r, external_id=c("_url"), url=c("_url"), title=c("_repo"), content=text_or(text, c("_repo")),
        excerpt=head(_blank(c("description"))), tags=tags,
    )
