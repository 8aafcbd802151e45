"""Landing normalisers. Payloads are derived from the tables; the oracle starts from the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import text as tx
from feedloom.operators import joins as jn
from feedloom.sources import feeds as fe
from feedloom.sources import html as ht
from feedloom.sources import markdown as md
from feedloom.sources import payloads as pl
from workload.adapter import Tables, as_of
from workload.oracle import AS_OF, sql, ts_text
from workload.q_insight import ts
from workload.registry import query

c = F.col
FP = "sha256(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_]+', '', 'g'))"
ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def show(df, *more):
    """Landing rows in comparable form; whole texts as digests."""
    return df.select(
        "external_id", "url", "title", F.md5("content").alias("content_md5"), F.md5(F.coalesce("excerpt", F.lit("-"))).alias("excerpt_md5"),
        F.array_join("tags", ",").alias("tags"), ts("published_at"), "content_hash", *more,
    )


def out_sql(ext, url, title, content, excerpt=None, tags="''", published="NULL", marked=None) -> str:
    excerpt = excerpt or f"nullif(substr({content}, 1, 500), '')"
    pub = "CAST(NULL AS VARCHAR)" if published == "NULL" else ts_text(published)
    return f"""SELECT {ext} AS external_id, {url} AS url, {title} AS title, md5({content}) AS content_md5, md5(coalesce({excerpt}, '-')) AS excerpt_md5,
      {tags} AS tags, {pub} AS published_at, {FP.format(marked or content)} AS content_hash"""


def xml(col):
    """XML text of a value; characters XML 1.0 cannot carry were already removed by ``clean``."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        col = F.replace(col, F.lit(a), F.lit(b))
    return col


def clean(col):
    return F.trim(F.regexp_replace(col, r"[^\p{L}\p{N} .,<>&-]+", " "))


CLEAN = "trim(regexp_replace({}, '[^\\p{{L}}\\p{{N}} .,<>&-]+', ' ', 'g'))"
DOC_AT = f"{AS_OF} - to_minutes(CAST((doc_id * 7919) % 129600 AS BIGINT))"


def docs(t: Tables):
    return t.items().select(
        c("external_id").cast("long").alias("doc_id"), "source_id", "source_name", clean(c("content")).alias("body"), "created_at"
    )


def rss_payload(t: Tables):
    """One small feed per document: its item, and one without a link that must be skipped."""
    body = F.concat(F.lit("<p>"), c("body"), F.lit("</p>"))
    item = F.concat(
        F.lit("<item><link>https://news.example.org/"), c("doc_id"), F.lit("</link>"),
        F.when(c("doc_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("<title>Story "), c("doc_id"), F.lit("</title>"))),
        F.lit("<description>"), xml(body), F.lit("</description><guid>g"), c("doc_id"), F.lit("</guid><pubDate>"),
        F.date_format("created_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item>"),
    )
    return docs(t).select(
        "source_id", "source_name",
        F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>x</title>'), item,
                 F.lit("<item><title>no link</title></item></channel></rss>")).alias("payload"),
    )


RSS_D = f"d AS (SELECT doc_id, {CLEAN.format('text')} AS body, {DOC_AT} AS made, trim(regexp_replace({CLEAN.format('text')}, '<[^>]+>', '', 'g')) AS plain FROM documents)"


@query(
    "landing_rss", "S01",
    "WITH " + RSS_D + " " + out_sql(
        "'g' || doc_id", "'https://news.example.org/' || doc_id",
        "CASE WHEN doc_id % 3 > 0 THEN 'Story ' || doc_id WHEN length(plain) > 100 THEN substr(plain, 1, 100) || '...' WHEN plain <> '' THEN plain ELSE 'Untitled' END",
        "plain", published="made", marked="'<p>' || body || '</p>'") + " FROM d",
)
def _(t: Tables):
    return show(fe.normalize_feed(fe.parse_rss(rss_payload(t)), "rss"))


def atom_payload(t: Tables, title):
    entry = F.concat(
        F.lit('<entry><id>tag:'), c("doc_id"), F.lit('</id><title>'), title, F.lit('</title><link rel="alternate" href="https://rel.example.org/'),
        c("doc_id"), F.lit('"/><summary>'), xml(c("body")), F.lit("</summary><updated>"), F.date_format("created_at", ISO),
        F.lit('</updated><category term="cs.AI"/><category term="cs.LG"/></entry>'),
    )
    return docs(t).select(
        "source_id", "source_name", F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title>'), entry, F.lit("</feed>")).alias("payload")
    )


ATOM_D = f"d AS (SELECT doc_id, 'Source ' || substr(source, 4) AS source_name, {CLEAN.format('text')} AS body, {DOC_AT} AS made FROM documents)"


@query(
    "landing_releases", "S05",
    "WITH " + ATOM_D + " " + out_sql(
        "'tag:' || doc_id", "'https://rel.example.org/' || doc_id",
        "CASE doc_id % 3 WHEN 0 THEN source_name || ' v1.' || doc_id WHEN 1 THEN 'Big release ' || doc_id ELSE source_name END", "body", published="made") + " FROM d",
)
def _(t: Tables):
    title = F.when(c("doc_id") % 3 == 0, F.concat(F.lit("v1."), "doc_id")).when(c("doc_id") % 3 == 1, F.concat(F.lit("Big release "), "doc_id")).otherwise(F.lit("Untitled"))
    return show(fe.normalize_feed(fe.parse_atom(atom_payload(t, title)), "gh_releases"))


@query(
    "landing_papers", "S06",
    "WITH " + ATOM_D + " " + out_sql("'tag:' || doc_id", "'tag:' || doc_id", "'Paper on ' || doc_id", "body", tags="'cs.AI,cs.LG'", published="made") + " FROM d",
)
def _(t: Tables):
    return show(fe.normalize_feed(fe.parse_atom(atom_payload(t, F.concat(F.lit("Paper\non "), "doc_id"))), "arxiv"))


@query(
    "landing_boards", "S02 S03 S04",
    "WITH " + ATOM_D + ", k AS (SELECT unnest(['reddit','youtube','releasebot']) AS kind) " + out_sql(
        "'tag:' || doc_id", "'https://rel.example.org/' || doc_id", "'Post ' || doc_id", "body", published="made") + ", kind FROM d CROSS JOIN k",
)
def _(t: Tables):
    e = fe.parse_atom(atom_payload(t, F.concat(F.lit("Post "), "doc_id")))
    out = None
    for kind in ("reddit", "youtube", "releasebot"):
        part = show(fe.normalize_feed(e, kind), F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "feed_types", "S23",
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'rss' WHEN 1 THEN 'atom' WHEN 2 THEN 'json_feed' WHEN 3 THEN 'json_feed' ELSE 'unknown' END AS feed_type FROM documents""",
)
def _(t: Tables):
    """Whole documents inside the frames of each kind of feed."""
    k = c("doc_id") % 5
    whole = xml(c("text"))
    payload = (
        F.when(k == 0, F.concat(F.lit('<?xml version="1.0"?>\n<!-- c --><rss version="2.0"><channel><description>'), whole, F.lit("</description></channel></rss>")))
        .when(k == 1, F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>'), whole, F.lit("</title></feed>")))
        .when(k == 2, F.to_json(F.struct(F.lit("https://JSONFeed.org/version/1.1").alias("version"), c("text").alias("title"))))
        .otherwise(c("text"))
    )
    kind = F.when(k == 3, F.lit("application/feed+json; charset=utf-8")).otherwise(F.lit("text/html"))
    return t.raw("documents").select("doc_id", fe.detect_feed_type(payload, kind).alias("feed_type"))


def hn_payload(t: Tables):
    hit = F.struct(
        c("doc_id").cast("string").alias("objectID"), F.when(c("doc_id") % 4 > 0, F.concat(F.lit("https://site.example.org/"), "doc_id")).alias("url"),
        F.concat(F.lit("Ask "), "doc_id").alias("title"), F.when(c("doc_id") % 3 > 0, c("content")).alias("story_text"),
        F.unix_timestamp("created_at").alias("created_at_i"),
    )
    d = t.items().withColumn("doc_id", c("external_id").cast("long"))
    return d.select("source_id", "source_name", F.to_json(F.struct(F.array(hit).alias("hits"))).alias("payload"))


HN = f"h AS (SELECT doc_id, source, {DOC_AT} AS made, CASE WHEN doc_id % 4 > 0 THEN 'https://site.example.org/' || doc_id ELSE 'https://news.ycombinator.com/item?id=' || doc_id END AS u, CASE WHEN doc_id % 3 > 0 AND text <> '' THEN text ELSE 'Ask ' || doc_id END AS body FROM documents)"


@query("landing_stories", "S07", "WITH " + HN + " " + out_sql("CAST(doc_id AS VARCHAR)", "u", "'Ask ' || doc_id", "body", published="made") + " FROM h")
def _(t: Tables):
    return show(pl.normalize_hn(hn_payload(t)))


@query("stories_watermark", "S07 T01", "WITH " + HN + " SELECT source AS source_id, CAST(max(epoch(made)) AS BIGINT) AS last_poll_ts FROM h GROUP BY 1")
def _(t: Tables):
    return pl.hn_watermark(hn_payload(t))


def repo_payload(t: Tables):
    repo = F.struct(
        c("c_custkey").alias("id"), F.concat(F.lit("https://github.com/own/repo"), "c_custkey").alias("html_url"),
        F.concat(F.lit("own/repo"), "c_custkey").alias("full_name"), F.when(c("c_custkey") % 5 > 0, c("c_mktsegment")).alias("description"),
        F.when(c("c_custkey") % 2 == 0, F.array(F.lit("mcp"), F.lit("x"))).otherwise(F.array(F.lit("y"))).alias("topics"),
        F.date_format(F.timestamp_seconds(c("c_custkey") * 86400), ISO).alias("created_at"), (c("c_custkey") % 120).alias("stargazers_count"),
    )
    return t.raw("customer").select(F.lit("github").alias("source_id"), F.lit("GitHub").alias("source_name"), F.to_json(F.struct(F.array(repo).alias("items"))).alias("payload"))


@query(
    "landing_repositories", "S08",
    out_sql("CAST(c_custkey AS VARCHAR)", "'https://github.com/own/repo' || c_custkey", "'own/repo' || c_custkey", "CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment ELSE '' END",
            tags="CASE WHEN c_custkey % 2 = 0 THEN 'mcp,x' ELSE 'y' END", published="make_timestamp(c_custkey * 86400000000)") + " FROM customer",
)
def _(t: Tables):
    return show(pl.normalize_repo_search(repo_payload(t)))


@query(
    "repository_candidates", "S08 J21",
    "SELECT 'github-deep:own/repo' || c_custkey AS id, c_custkey % 120 AS promoted_at_stars FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 120 > 50 AND c_custkey % 7 > 0",
)
def _(t: Tables):
    tracked = t.raw("customer").where("c_custkey % 7 = 0").select(F.concat(F.lit("github-deep:own/repo"), "c_custkey").alias("id"))
    return jn.new_sources(pl.repo_candidates(repo_payload(t)), tracked).select("id", "promoted_at_stars")


def discussion_payload(t: Tables):
    d = t.items().withColumn("doc_id", c("external_id").cast("long"))
    node = F.struct(
        F.concat(F.lit("D"), "doc_id").alias("id"), F.when(c("doc_id") % 10 > 0, F.concat(F.lit("https://github.com/o/r/discussions/"), "doc_id")).alias("url"),
        F.when(c("doc_id") % 6 > 0, F.concat(F.lit("Talk "), "doc_id")).alias("title"), c("content").alias("bodyText"),
        F.date_format("created_at", ISO).alias("createdAt"), F.when(c("doc_id") % 4 > 0, F.struct(F.lit("Ideas").alias("name"))).alias("category"),
    )
    return d.select("source_id", "source_name", c("source_id").alias("repo"), F.to_json(F.struct(F.array(node).alias("nodes"))).alias("payload"))


@query(
    "landing_discussions", "S09",
    f"WITH d AS (SELECT *, {DOC_AT} AS made FROM documents) " + out_sql(
        "'D' || doc_id", "'https://github.com/o/r/discussions/' || doc_id", "CASE WHEN doc_id % 6 > 0 THEN 'Talk ' || doc_id ELSE '(No title)' END", "substr(text, 1, 2000)",
        tags="CASE WHEN doc_id % 4 > 0 THEN 'github-discussions,ideas' ELSE 'github-discussions' END", published="made", marked="text") + f" FROM d WHERE doc_id % 10 > 0 AND made > {AS_OF} - INTERVAL 40 DAY",
)
def _(t: Tables):
    from feedloom.operators.filters import days_back

    return show(pl.normalize_discussions(discussion_payload(t), last_poll=days_back(as_of(), 40)))


@query("last_discussions", "S09", f"WITH d AS (SELECT *, {DOC_AT} AS made FROM documents) SELECT source AS repo, 'D' || arg_max(doc_id, made) AS last_id, {ts_text('max(made)')} AS last_at FROM d GROUP BY 1")
def _(t: Tables):
    return pl.last_discussions(discussion_payload(t)).select("repo", "last_id", ts("last_at"))


def npm_payload(t: Tables):
    pkg = F.struct(
        F.concat(F.lit("pkg-"), "p_partkey").alias("name"), c("p_type").alias("description"), F.date_format(F.timestamp_seconds(c("p_partkey") * 3600), ISO).alias("date"),
        F.array("p_brand").alias("keywords"), F.struct(F.when(c("p_partkey") % 2 == 0, F.concat(F.lit("https://npm.example.org/"), "p_partkey")).alias("npm")).alias("links"),
    )
    return t.raw("part").select(F.lit("npm").alias("source_id"), F.lit("npm").alias("source_name"), F.to_json(F.struct(F.array(F.struct(pkg.alias("package"))).alias("objects"))).alias("payload"))


@query(
    "landing_npm", "S10",
    "WITH p AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_type END AS body FROM part WHERE p_partkey * 3600 > 360000) " + out_sql(
        "'pkg-' || p_partkey", "CASE WHEN p_partkey % 2 = 0 THEN 'https://npm.example.org/' || p_partkey ELSE 'https://www.npmjs.com/package/pkg-' || p_partkey END", "'pkg-' || p_partkey",
        "body", excerpt="p_type", tags="p_brand") + " FROM p",
)
def _(t: Tables):
    readmes = t.raw("part").where("p_partkey % 3 = 0").select(F.concat(F.lit("pkg-"), "p_partkey").alias("name"), c("p_name").alias("readme"))
    return show(pl.normalize_npm(npm_payload(t), last_poll_ts=360000, readmes=readmes))


def pypi_payload(t: Tables):
    info = F.struct(
        F.concat(F.lit("1."), c("p_size")).alias("version"), c("p_type").alias("summary"),
        F.when(c("p_partkey") % 2 == 0, F.repeat(F.concat("p_name", F.lit(" ")), 6)).alias("description"),
        F.when(c("p_partkey") % 3 == 0, F.concat("p_brand", F.lit(", a,, b "))).alias("keywords"),
        F.array(F.lit("Topic :: AI"), F.lit("License :: OSI :: MIT"), F.lit("plain"), F.lit("X :: AI")).alias("classifiers"),
    )
    up = F.struct(F.date_format(F.timestamp_seconds(c("p_partkey") * 3600), ISO).alias("upload_time_iso_8601"))
    return t.raw("part").select(
        F.lit("pypi").alias("source_id"), F.lit("PyPI").alias("source_name"), F.concat(F.lit("lib"), "p_partkey").alias("package"),
        F.to_json(F.struct(info.alias("info"), F.array(up).alias("urls"))).alias("payload"),
    )


@query(
    "landing_pypi", "S11",
    "WITH p AS (SELECT *, 'lib' || p_partkey AS lib, '1.' || p_size AS ver, CASE WHEN p_partkey % 2 = 0 AND length(repeat(p_name || ' ', 6)) > 50 THEN substr(repeat(p_name || ' ', 6), 1, 5000) ELSE p_type END AS body FROM part WHERE p_partkey % 5 > 0) "
    + out_sql("lib || '==' || ver", "'https://pypi.org/project/' || lib || '/' || ver || '/'", "lib || ' ' || ver || CASE WHEN length(p_type) > 5 THEN ' — ' || substr(p_type, 1, 80) ELSE ' release' END", "body", excerpt="p_type",
              tags="CASE WHEN p_partkey % 3 = 0 THEN p_brand || ',a,b' ELSE 'ai,mit' END", published="make_timestamp(p_partkey * 3600000000)") + " FROM p",
)
def _(t: Tables):
    seen = t.raw("part").where("p_partkey % 5 = 0").select(F.concat(F.lit("lib"), "p_partkey").alias("package"), F.concat(F.lit("1."), "p_size").alias("version"))
    return show(pl.normalize_pypi(pypi_payload(t), last_versions=seen))


def extension_payload(t: Tables):
    ext = F.struct(
        F.struct(c("p_brand").alias("publisherName")).alias("publisher"), F.concat(F.lit("ext"), "p_partkey").alias("extensionName"), c("p_name").alias("displayName"),
        c("p_type").alias("shortDescription"),
        F.array(F.struct(F.lit("2.0").alias("version"), F.date_format(F.timestamp_seconds(c("p_partkey") * 3600), ISO).alias("lastUpdated"))).alias("versions"),
        F.array(F.struct(F.lit("install").alias("statisticName"), (c("p_partkey") % 4 * 1234.0).alias("value")), F.struct(F.lit("weightedRating").alias("statisticName"), F.lit(4.25).alias("value"))).alias("statistics"),
    )
    return t.raw("part").select(F.lit("vs").alias("source_id"), F.lit("VS").alias("source_name"), F.lit("mcp").alias("query"), F.to_json(F.struct(F.array(ext).alias("extensions"))).alias("payload"))


@query(
    "landing_extensions", "S12",
    "WITH p AS (SELECT *, p_brand || '.ext' || p_partkey AS k, p_type || CASE WHEN p_partkey % 4 > 0 THEN ' | Installs: ' || [ '1,234', '2,468', '3,702' ][p_partkey % 4] || '. Rating: 4.3' ELSE '' END AS body FROM part WHERE p_partkey * 3600 > 360000) "
    + out_sql("k || '==2.0'", "'https://marketplace.visualstudio.com/items?itemName=' || k", "p_name || ' (' || k || ')'", "body", excerpt="p_type", tags="'mcp'",
              published="make_timestamp(p_partkey * 3600000000)", marked="p_type") + " FROM p",
)
def _(t: Tables):
    return show(pl.normalize_extensions(extension_payload(t), last_poll_ts=360000.0))


def registry_payload(t: Tables):
    s = F.struct(
        c("p_name").alias("name"), c("p_type").alias("description"), F.when(c("p_partkey") % 3 == 0, F.concat(F.lit("https://mcp.example.org/"), "p_partkey")).alias("websiteUrl"),
        F.struct(F.when(c("p_partkey") % 3 == 1, F.concat(F.lit("https://github.com/own/srv"), "p_partkey")).alias("url")).alias("repository"),
    )
    nested = F.to_json(F.struct(F.array(F.struct(s.alias("server"))).alias("servers")))
    flat = F.to_json(F.struct(F.array(s).alias("servers")))
    return t.raw("part").select(F.lit("reg").alias("source_id"), F.lit("Registry").alias("source_name"), F.when(c("p_partkey") % 2 == 0, nested).otherwise(flat).alias("payload"))


@query(
    "landing_registry", "S13",
    "WITH p AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 'https://mcp.example.org/' || p_partkey ELSE 'https://github.com/own/srv' || p_partkey END AS u, CASE WHEN p_partkey % 3 = 1 THEN 'Readme of ' || p_name ELSE p_type END AS body FROM part WHERE p_partkey % 3 < 2) "
    + out_sql("p_name", "u", "p_name", "body", excerpt="p_type") + " FROM p",
)
def _(t: Tables):
    readmes = t.raw("part").select(F.concat(F.lit("own/srv"), "p_partkey").alias("repo"), F.concat(F.lit("Readme of "), "p_name").alias("readme"))
    return show(pl.normalize_registry(registry_payload(t), readmes=readmes))


def market_payload(t: Tables):
    k = c("p_partkey") % 4
    obj = F.when(k == 0, F.to_json(F.struct(F.lit("github").alias("source"), F.concat(F.lit("own/pl"), "p_partkey").alias("repo")))).when(
        k == 1, F.to_json(F.struct(F.lit("url").alias("source"), F.concat(F.lit("https://gitlab.com/o/p"), "p_partkey", F.lit(".git")).alias("url")))
    ).when(k == 2, F.to_json(F.struct(F.lit("npm").alias("source"), F.concat(F.lit("np"), "p_partkey").alias("package")))).otherwise(F.lit('"./local"'))
    rest = F.to_json(
        F.struct(
            F.concat(F.lit("plug"), "p_partkey").alias("name"), c("p_type").alias("description"), F.lit("1.0").alias("version"),
            F.struct(c("p_brand").alias("name")).alias("author"), F.lit("dev").alias("category"), F.array(F.lit("k1"), F.lit("k2")).alias("keywords"),
            F.when(c("p_partkey") % 5 == 0, F.lit("https://home.example.org")).alias("homepage"), F.lit("MIT").alias("license"),
            F.when(c("p_partkey") % 2 == 0, F.struct(F.lit(1).alias("a"))).alias("mcpServers"), F.array(F.lit("c")).alias("commands"),
        )
    )
    plugin = F.concat(F.expr("substr(x, 1, length(x) - 1)"), F.lit(',"source":'), c("obj"), F.lit("}"))
    d = t.raw("part").withColumn("x", rest).withColumn("obj", obj)
    return d.select(F.lit("mk").alias("source_id"), F.lit("Market").alias("source_name"), F.concat(F.lit('{"name":"main","plugins":['), plugin, F.lit("]}")).alias("payload"))


@query(
    "landing_marketplace", "S14",
    """WITH p AS (SELECT *, p_type || ' | Version: 1.0 | Author: ' || p_brand || ' | Category: dev | License: MIT | Components: ' || CASE WHEN p_partkey % 2 = 0 THEN 'mcp-server, commands' ELSE 'commands' END AS body FROM part) """
    + out_sql("'main/plug' || p_partkey", """CASE WHEN p_partkey % 5 = 0 THEN 'https://home.example.org' WHEN p_partkey % 4 = 0 THEN 'https://github.com/own/pl' || p_partkey
        WHEN p_partkey % 4 = 1 THEN 'https://gitlab.com/o/p' || p_partkey WHEN p_partkey % 4 = 2 THEN 'https://www.npmjs.com/package/np' || p_partkey ELSE 'marketplace://main/plug' || p_partkey END""",
              "'plug' || p_partkey || ' (Claude Code plugin)'", "body", excerpt="p_type",
              tags="'claude-code-plugin,marketplace:main,k1,k2,dev,' || CASE WHEN p_partkey % 2 = 0 THEN 'mcp-server,commands' ELSE 'commands' END") + " FROM p",
)
def _(t: Tables):
    return show(pl.normalize_marketplace(market_payload(t)))


@query(
    "landing_posts", "S15",
    "WITH p AS (SELECT *, trim(text) AS body FROM conversations WHERE trim(text) <> '') " + out_sql(
        "'at://x/' || conv_id || '-' || turn", "'https://bsky.app/profile/h' || conv_id || '/post/' || conv_id || '-' || turn", "trim(substr(body, 1, 100))", "body", tags="'bluesky,social'",
        published="make_timestamp(conv_id * 3600000000)") + " FROM p",
)
def _(t: Tables):
    post = F.struct(
        F.concat(F.lit("at://x/"), "conv_id", F.lit("-"), "turn").alias("uri"), F.struct(F.concat(F.lit("h"), "conv_id").alias("handle")).alias("author"),
        F.struct("text", F.date_format(F.timestamp_seconds(c("conv_id") * 3600), ISO).alias("created_at")).alias("record"),
    )
    p = t.raw("conversations").select(F.lit("bs").alias("source_id"), F.lit("Posts").alias("source_name"), F.to_json(F.struct(F.array(post).alias("posts"))).alias("payload"))
    return show(pl.normalize_posts(p))


@query(
    "landing_mail", "S22",
    "WITH m AS (SELECT *, conv_id || '-' || turn AS token, CASE WHEN turn % 3 > 0 THEN 'Issue ' || turn ELSE '' END AS subject, substr(trim(regexp_replace(CASE WHEN turn % 4 > 0 THEN '<b>' || text || '</b>' ELSE '' END, '<[^>]+>', '', 'g')), 1, 500) AS body FROM conversations), "
    "u AS (SELECT *, 'mailgun://email/' || substr(sha256('mailgun:' || token || ':' || role || ':' || subject), 1, 16) AS url FROM m WHERE body <> '' OR subject <> '') "
    + out_sql("sha256(url)", "url", "CASE WHEN subject <> '' THEN subject ELSE '(No subject)' END", "body", excerpt="body", tags="'newsletter'") + " FROM u",
)
def _(t: Tables):
    m = t.raw("conversations").select(
        F.lit("mail").alias("source_id"), F.lit("Mail").alias("source_name"), F.concat("conv_id", F.lit("-"), "turn").alias("token"), c("role").alias("sender"),
        F.when(c("turn") % 3 > 0, F.concat(F.lit("Issue "), "turn")).otherwise(F.lit("")).alias("subject"), F.lit("").alias("body_html"),
        F.when(c("turn") % 4 > 0, F.concat(F.lit("<b>"), "text", F.lit("</b>"))).alias("body_plain"), F.lit("").alias("stripped_text"),
    )
    return show(pl.normalize_email(m))


LINKS_SQL = r"""l AS (SELECT page_id, url AS page_url, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 2)) AS title,
  generate_subscripts(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 1), 1) AS n FROM pages)"""


@query(
    "landing_scraped", "S20",
    "WITH " + LINKS_SQL + ", r AS (SELECT regexp_extract(page_url, '^[a-z]+://[^/?#]+') || href AS u, trim(title) AS t FROM l WHERE trim(title) <> '' AND page_id % 9 > 0) "
    + out_sql("u", "u", "t", "t", excerpt="NULL") + " FROM r",
)
def _(t: Tables):
    anchor = '<li><a href="([^"]*)">([^<]*)</a>'
    p = t.raw("pages").select(
        F.concat(F.lit("s"), "page_id").alias("source_id"), F.lit("Scrape").alias("source_name"), c("url").alias("base_url"),
        F.explode(F.arrays_zip(F.regexp_extract_all("html", F.lit(anchor), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(anchor), F.lit(2)).alias("title"))).alias("a"),
    ).select("source_id", "source_name", "base_url", "a.href", "a.title", F.lit(None).cast("string").alias("excerpt"))
    from feedloom.functions.urls import resolve_url

    seen = p.where(F.expr("cast(substr(source_id, 2) AS int) % 9 = 0")).select("source_id", resolve_url(c("href"), c("base_url")).alias("url"))
    return show(pl.scraped_rows(p, seen=seen))


@query(
    "remembered_urls", "S20",
    "SELECT 's' || (event_id % 5) AS source_id, 'u' || user_id AS url, min(event_id) AS seen_no FROM events GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY seen_no DESC, url DESC) <= 20",
)
def _(t: Tables):
    e = t.raw("events").select(F.concat(F.lit("s"), c("event_id") % 5).alias("source_id"), F.concat(F.lit("u"), "user_id").alias("url"), c("event_id").alias("seen_no"))
    return pl.remember_seen(e.where("seen_no % 2 = 0"), e.where("seen_no % 2 = 1"), keep=20)


@query(
    "landing_trending", "S21",
    "WITH r AS (SELECT *, 'https://github.com/own/t' || c_custkey AS u, c_mktsegment || ' Stars: ' || c_custkey || '.' || CASE WHEN c_custkey % 2 = 0 THEN ' Language: Python.' ELSE '' END AS body FROM customer) "
    + out_sql("u", "u", "'own/t' || c_custkey", "body", excerpt="c_mktsegment", tags="CASE WHEN c_custkey % 2 = 0 THEN 'github,trending,python' ELSE 'github,trending' END") + " FROM r",
)
def _(t: Tables):
    r = t.raw("customer").select(
        F.lit("tr").alias("source_id"), F.lit("Trending").alias("source_name"), F.concat(F.lit("/own/t"), "c_custkey").alias("href"), c("c_mktsegment").alias("description"),
        c("c_custkey").cast("string").alias("stars_text"), F.when(c("c_custkey") % 2 == 0, F.lit("Python")).otherwise(F.lit("")).alias("language"),
    )
    return show(pl.trending_repos(r))


PAGE_X = r"""x AS (SELECT page_id, url, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS raw_title,
  coalesce(nullif(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), ''), regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1)) AS raw FROM pages),
y AS (SELECT page_id, url, trim(regexp_replace(raw_title, '<[^>]+>', '', 'g')) AS title, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '(?is)<script[^>]*>.*?</script>', '', 'g'),
  '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM x)"""


@query(
    "page_extraction", "S18 S19",
    "WITH " + PAGE_X + f" SELECT url, title, md5(body) AS body_md5, md5(coalesce(nullif(substr(body, 1, 500), ''), '-')) AS excerpt_md5, {FP.format('body')} AS content_hash, CAST(NULL AS VARCHAR) AS published_at FROM y WHERE title <> ''",
)
def _(t: Tables):
    p = ht.page_rows(t.raw("pages").select("url", "html"))
    return p.select("url", "title", F.md5("content").alias("body_md5"), F.md5(F.coalesce("excerpt", F.lit("-"))).alias("excerpt_md5"), "content_hash", ts("published_at"))


@query(
    "sitemap_pages", "S17 S26",
    f"""SELECT 's' || page_id AS source_id, 'page' AS kind, url, {ts_text(f"{AS_OF} - to_days(CAST(page_id % 90 AS INTEGER))")} AS lastmod FROM pages WHERE page_id % 5 > 0
      AND (contains(url, '/en/') OR contains(url, '/fr/')) AND page_id % 90 <= 30
    UNION ALL SELECT 's' || page_id, 'child', url, NULL FROM pages WHERE page_id % 5 = 0 AND (contains(url, '/en/') OR contains(url, '/fr/'))""",
)
def _(t: Tables):
    p = t.raw("pages")
    mod = F.date_format(F.timestamp_micros(F.unix_micros(as_of()) - (c("page_id") % 90) * 86_400_000_000), ISO)
    urlset = F.concat(
        F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>'), xml(c("url")), F.lit("</loc><lastmod>"), mod, F.lit("</lastmod></url></urlset>")
    )
    index = F.concat(F.lit("<sitemapindex><sitemap><loc>"), xml(c("url")), F.lit("</loc></sitemap></sitemapindex>"))
    payload = p.select(F.concat(F.lit("s"), "page_id").alias("source_id"), F.when(c("page_id") % 5 == 0, index).otherwise(urlset).alias("payload"))
    e = ht.sitemap_filter(ht.parse_sitemap(payload), patterns="/en/, /fr/", max_age_days=30, as_of=as_of())
    return e.select("source_id", "kind", "url", ts("lastmod"))


@query(
    "page_refresh", "S25",
    sql("items", f"""SELECT id, CASE WHEN hit THEN 'raw' ELSE status END AS status, CASE WHEN hit THEN 'New ' || external_id ELSE title END AS title, md5(CASE WHEN hit THEN source_name ELSE content END) AS content_md5 FROM
      (SELECT *, CAST(external_id AS BIGINT) % 2 = 0 AND {AS_OF} - INTERVAL 45 DAY > created_at AS hit FROM items)"""),
)
def _(t: Tables):
    from feedloom.operators.filters import days_back

    i = t.items()
    pages = i.where(c("external_id").cast("long") % 2 == 0).select(
        "url", days_back(as_of(), 45).alias("lastmod"), F.concat(F.lit("New "), "external_id").alias("title"), c("source_name").alias("content"),
        c("source_name").alias("excerpt"), F.lit(None).cast("timestamp").alias("published_at"), F.lit("h").alias("content_hash"),
    )
    return ht.page_refresh(i, pages).select("id", "status", "title", F.md5("content").alias("content_md5"))


@query(
    "page_refresh_twice", "S25",
    sql("items", f"""SELECT id, CASE WHEN hit THEN 'raw' ELSE status END AS status, CASE WHEN hit THEN 'New ' || external_id ELSE title END AS title FROM
      (SELECT *, CAST(external_id AS BIGINT) % 2 = 0 AND {AS_OF} - INTERVAL 45 DAY > created_at AS hit FROM items)"""),
)
def _(t: Tables):
    """Every page was fetched three times; the newest fetch counts."""
    from feedloom.operators.filters import days_back

    i = t.items()
    pages = i.where(c("external_id").cast("long") % 2 == 0).select(
        "url", days_back(as_of(), 45).alias("lastmod"), F.concat(F.lit("New "), "external_id").alias("title"), c("source_name").alias("content"),
        c("source_name").alias("excerpt"), F.lit(None).cast("timestamp").alias("published_at"), F.lit("h").alias("content_hash"),
    )
    older = pages.withColumns({"lastmod": days_back(as_of(), 50), "title": F.lit("stale")})
    return ht.page_refresh(i, pages.unionByName(older).unionByName(pages)).select("id", "status", "title")


@query(
    "page_dates", "S19",
    f"""SELECT page_id, {ts_text("TIMESTAMP '2023-01-01 00:00:00' + to_days(CAST(page_id % 300 AS INTEGER))")} AS published_at FROM pages WHERE page_id % 6 < 5 UNION ALL SELECT page_id, NULL FROM pages WHERE page_id % 6 = 5""",
)
def _(t: Tables):
    """Open graph tags in both orders, JSON-LD objects and lists (the date in the fourth object), time tags, and none."""
    k = c("page_id") % 6
    day = F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), (c("page_id") % 300).cast("int")), "yyyy-MM-dd")
    iso = F.concat(day, F.lit("T00:00:00Z"))
    ld = '<script type="application/ld+json">'
    tag = (
        F.when(k == 0, F.concat(F.lit('<meta property="article:published_time" content="'), iso, F.lit('">')))
        .when(k == 1, F.concat(F.lit('<meta content="'), iso, F.lit('" property="article:published_time">')))
        .when(k == 2, F.concat(F.lit(ld + '{"@type":"Article","datePublished":"'), iso, F.lit('"}</script>')))
        .when(k == 3, F.concat(F.lit(ld + '[{"@type":"A"},{"name":"b"},{},{"dateModified":"'), iso, F.lit('"}]</script>')))
        .when(k == 4, F.concat(F.lit('<time class="x" datetime="'), iso, F.lit('">')))
        .otherwise(F.lit(""))
    )
    bare = F.regexp_replace(F.regexp_replace("html", "(?i)<time", "<span"), "(?is)<script.*?</script>", "")
    return t.raw("pages").select("page_id", ts_of(ht.extract_published(F.concat(tag, bare))).alias("published_at"))


def ts_of(value):
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss")


@query(
    "items_round_trip", "S27",
    sql("items", f"SELECT id, source_id, {ts_text('created_at')} AS created_at, md5(content) AS content_md5 FROM items WHERE created_at >= {AS_OF} - INTERVAL 30 DAY"),
)
def _(t: Tables):
    """Written by day and read back from a day on."""
    from feedloom.sources.tables import read_items, write_items
    from feedloom.streaming.jobs import scratch

    path = scratch(t.spark, "items")
    write_items(t.items(), path)
    return read_items(t.spark, path, "2024-01-01").select("id", "source_id", ts_of("created_at").alias("created_at"), F.md5("content").alias("content_md5"))


@query(
    "log_append", "S28",
    "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL",
)
def _(t: Tables):
    """A log that is appended to in three runs."""
    from feedloom.sources.tables import append_log
    from feedloom.streaming.jobs import scratch

    path = scratch(t.spark, "log")
    rows = t.raw("events").select("event_id", "user_id", c("ts").alias("created_at"))
    for k in range(3):
        append_log(rows.where(c("event_id") % 3 == k), path)
    return t.spark.read.parquet(path).groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"))


def readme_lines(t: Tables):
    k = c("p_partkey")
    line = F.when(
        k % 4 == 0, F.concat(F.lit("- ["), "p_name", F.lit("](https://x.example.org/"), k, F.lit(") - About "), "p_type")
    ).when(
        k % 4 == 1, F.concat(F.lit("  - [A"), k, F.lit("](https://y.example.org/"), k, F.lit(") and [B](https://z.example.org/b.svg?x=1) — more"))
    ).when(k % 4 == 2, F.concat(F.lit("- [![badge](https://q.example.org/badges/1)](https://w.example.org/"), k, F.lit(")"))).otherwise(c("p_name"))
    return t.raw("part").select(F.lit("list").alias("list_id"), k.alias("line_no"), line.alias("line"))


@query(
    "markdown_links", "S16",
    """SELECT p_partkey AS line_no, p_name AS name, 'https://x.example.org/' || p_partkey AS url, 'About ' || p_type AS description FROM part WHERE p_partkey % 4 = 0
    UNION ALL SELECT p_partkey, 'A' || p_partkey, 'https://y.example.org/' || p_partkey, 'and [B](https://z.example.org/b.svg?x=1) — more' FROM part WHERE p_partkey % 4 = 1""",
)
def _(t: Tables):
    return md.extract_markdown_links(readme_lines(t)).select("line_no", "name", "url", "description")


@query(
    "markdown_added_links", "S16 U05",
    """SELECT p_name AS name, 'https://x.example.org/' || p_partkey AS url FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 3 = 0
    UNION ALL SELECT 'A' || p_partkey, 'https://y.example.org/' || p_partkey FROM part WHERE p_partkey % 4 = 1 AND p_partkey % 3 = 0""",
)
def _(t: Tables):
    new = readme_lines(t)
    old = new.where("line_no % 3 <> 0")
    return md.extract_markdown_links(new, old).select("name", "url")


@query(
    "table_scan", "S27",
    sql("items", f"SELECT source_id, count(*) AS n, {ts_text('max(created_at)')} AS newest FROM items WHERE created_at >= {AS_OF} - INTERVAL 30 DAY GROUP BY 1"),
)
def _(t: Tables):
    from feedloom.operators.filters import recent

    return t.items().where(recent(as_of(), 30, c("created_at"))).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), ts_max().alias("newest"))


def ts_max():
    return F.date_format(F.max("created_at"), "yyyy-MM-dd HH:mm:ss")
