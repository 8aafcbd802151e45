"""Edge cases of the landing normalisers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from feedloom.sources import feeds as fe
from feedloom.sources import html as ht
from feedloom.sources import markdown as md
from feedloom.sources import payloads as pl

UTC = dt.timezone.utc
c = F.col


def payload(spark, text, **more):
    cols = ", ".join(f"'{v}' AS {k}" for k, v in more.items())
    return spark.sql(f"SELECT 's' AS source_id, 'Src' AS source_name{', ' + cols if cols else ''}").withColumn("payload", F.lit(text))


def test_rss_edge_cases(spark):
    xml = """<?xml version="1.0"?><rss><channel>
      <item><link>https://a.org/1</link><description>&lt;b&gt;%s&lt;/b&gt;</description><pubDate>Tue, 02 Jan 2024 10:00:00 +0200</pubDate></item>
      <item><link>https://a.org/2</link><title></title><description></description></item>
      <item><title>no link</title></item></channel></rss>""" % ("w" * 120)
    got = {r.url: r for r in fe.normalize_feed(fe.parse_rss(payload(spark, xml)), "rss").collect()}
    assert set(got) == {"https://a.org/1", "https://a.org/2"}
    assert got["https://a.org/1"].title == "w" * 100 + "..." and got["https://a.org/1"].content == "w" * 120
    assert got["https://a.org/1"].published_at == dt.datetime(2024, 1, 2, 8)
    assert got["https://a.org/2"].title == "Untitled" and got["https://a.org/2"].excerpt is None and got["https://a.org/2"].published_at is None


def test_rss_uses_fetched_body_for_thin_entries(spark):
    e = spark.sql("select 's' source_id, 'n' source_name, 'u' link, 't' title, 'thin' summary, null id, null published, null updated, null terms")
    b = spark.createDataFrame([("u", "a long fetched article")], "url string, body string")
    assert fe.normalize_feed(e, "rss", bodies=b).first().content == "a long fetched article"


@pytest.mark.parametrize("title,want", [("1.2.0", "Src 1.2.0"), (" v2 ", "Src v2"), ("Big news", "Big news"), ("", "Src"), ("Untitled", "Src")])
def test_release_titles(spark, title, want):
    assert spark.range(1).select(fe.release_title(F.lit("Src"), F.lit(title))).first()[0] == want


@pytest.mark.parametrize("html,want", [
    ('<meta property="article:published_time" content="2024-03-01T10:00:00Z">', dt.datetime(2024, 3, 1, 10)),
    ("<META content='2024-03-02' property='article:published_time'>", dt.datetime(2024, 3, 2)),
    ('<script type="application/ld+json">{"datePublished": "2024-03-03T00:00:00+00:00"}</script>', dt.datetime(2024, 3, 3)),
    ('<script type="application/ld+json">{"dateModified": "2024-03-04"}</script>', dt.datetime(2024, 3, 4)),
    ('<script type="application/ld+json">[{"a":1},{"datePublished": "2024-03-05"}]</script>', dt.datetime(2024, 3, 5)),
    ('<script type="application/ld+json">not json</script><time class="x" datetime="2024-03-06">', dt.datetime(2024, 3, 6)),
    ('<meta property="article:published_time" content="nonsense"><time datetime="2024-03-07">', dt.datetime(2024, 3, 7)),
    ("<p>none</p>", None),
])
def test_published_dates(spark, html, want):
    assert spark.range(1).select(ht.extract_published(F.lit(html))).first()[0] == want


def test_page_parts(spark):
    page = """<html><head><title> A <i>b</i> </title><meta property="og:description" content="About"></head>
      <body>x<main><script>var a = "<p>";</script><p>Kept   text</p><style>p{}</style></main></body></html>"""
    r = spark.range(1).select(ht.extract_page(F.lit(page)).alias("p")).first().p
    assert (r.title, r.excerpt, r.body) == ("A b", "About", "Kept text")
    none = ht.page_rows(spark.createDataFrame([("u", "<body>no title</body>")], "url string, html string"))
    assert none.count() == 0


def test_sitemap_bad_xml_and_missing_dates(spark):
    rows = spark.createDataFrame(
        [("a", "<urlset><url><loc> https://x.org/blog/1 </loc></url><url><loc></loc></url></urlset>"), ("b", "not xml"), ("c", "<urlset></urlset>")],
        "source_id string, payload string",
    )
    e = ht.parse_sitemap(rows)
    assert [(r.source_id, r.url, r.lastmod) for r in e.collect()] == [("a", "https://x.org/blog/1", None)]
    kept = ht.sitemap_filter(e, patterns="/blog/", max_age_days=1, as_of=F.current_timestamp())
    assert kept.count() == 1 and ht.sitemap_filter(e, patterns=["/news/"]).count() == 0


@pytest.mark.parametrize("text,kind,want", [
    ('{"version":"https://jsonfeed.org/version/1"}', None, "json_feed"), ("x", "application/feed+json", "json_feed"), ("<feed xmlns='a'>", None, "atom"),
    ("<rdf:RDF xmlns='a'>", None, "rss"), ("<html><feed/></html>", None, "unknown"), ('{"version": 3}', None, "unknown"),
])
def test_feed_types(spark, text, kind, want):
    assert spark.range(1).select(fe.detect_feed_type(F.lit(text), F.lit(kind).cast("string"))).first()[0] == want


def test_plugin_sources(spark):
    for text, want in (
        ('{"source":"github","repo":"a/b"}', "https://github.com/a/b"), ('{"source":"git-subdir","url":"https://github.com/a/b.git"}', "https://github.com/a/b"),
        ('{"source":"url","url":"https://other.org/x.git"}', None), ('{"source":"npm","package":"p"}', "https://www.npmjs.com/package/p"), ('"./x"', None),
    ):
        assert spark.range(1).select(pl.plugin_source_url(F.lit(text))).first()[0] == want


def test_stories_without_text(spark):
    p = payload(spark, '{"hits":[{"objectID":"1","created_at_i":0},{"objectID":"2","title":"T","created_at_i":1700000000}]}')
    got = {r.external_id: r for r in pl.normalize_hn(p).collect()}
    assert got["1"].title == got["1"].url == "https://news.ycombinator.com/item?id=1" and got["1"].published_at is None
    assert got["2"].content == "T" and got["2"].tags == []


def test_extension_statistics(spark):
    p = payload(spark, '{"extensions":[{"publisher":{"publisherName":"p"},"extensionName":"e","shortDescription":"d"},{"extensionName":"no publisher"}]}', query="q")
    r = pl.normalize_extensions(p).collect()
    assert len(r) == 1 and r[0].content == "d" and r[0].external_id == "p.e==" and r[0].title == "e (p.e)"


def test_markdown_edge_cases(spark):
    lines = spark.createDataFrame([("l", 1, "- [A](https://a.org) — one"), ("l", 2, "* [B](https://b.org)"), ("l", 3, "- [![i](https://s.org/x.svg)](https://c.org)"), ("l", 4, "- plain")], "list_id string, line_no int, line string")
    got = [(r.name, r.url, r.description) for r in md.extract_markdown_links(lines).collect()]
    assert got == [("A", "https://a.org", "one")]
