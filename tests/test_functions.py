"""Hand-computed values of the scalar functions."""

import math

import pytest
from pyspark.sql import functions as F

from feedloom.functions import labels as lb
from feedloom.functions import profile as pf
from feedloom.functions import render as rd
from feedloom.functions import scores as sc
from feedloom.functions import text as tx
from feedloom.functions import urls as ux
from feedloom.functions import vectors as vec
from feedloom.operators import text_match as tm

c = F.col


def one(spark, *cols, **values):
    names = list(values)
    df = spark.range(1).select(*[F.lit(values[n]).alias(n) for n in names]) if names else spark.range(1)
    r = df.select(*cols).first()
    return r[0] if len(cols) == 1 else tuple(r)


@pytest.mark.parametrize("url,want", [
    ("https://a.org/x///#top", "https://a.org/x"), ("https://smithery.ai/servers/q/", "https://smithery.ai/server/q"), ("", ""),
])
def test_normalize_url(spark, url, want):
    assert one(spark, ux.normalize_url(c("u")), u=url) == want


@pytest.mark.parametrize("url,want", [
    ("https://github.com/a/b", "a/b"), ("http://github.com/a/b.git", "a/b"), ("https://github.com/a/b/tree/x", "a/b"),
    ("https://github.com/a", None), ("https://gitlab.com/a/b", None),
])
def test_repo_slug(spark, url, want):
    assert one(spark, ux.repo_slug(c("u")), u=url) == want


@pytest.mark.parametrize("href,want", [
    ("/p", "https://a.org/p"), ("p", "https://a.org/d/p"), ("https://b.org/q", "https://b.org/q"), ("//b.org/q", "https://b.org/q"),
])
def test_resolve_url(spark, href, want):
    assert one(spark, ux.resolve_url(c("h"), F.lit("https://a.org/d/e.html?x=1")), h=href) == want


def test_base_url_path_and_strict(spark):
    assert one(spark, ux.base_url_path(c("u")), u="https://a.org/p?q#f") == "https://a.org/p"
    assert one(spark, ux.base_url_path(c("u")), u="a.org/p?q") == "a.org/p?q"
    assert one(spark, ux.repo_slug_strict(c("u")), u="https://www.github.com/a/b?tab=1") == "a/b"
    assert one(spark, ux.repo_slug_strict(c("u")), u="https://github.com/a/topics") is None


def test_fingerprint_is_unicode_aware(spark):
    a, b, d = one(spark, tx.content_fingerprint(F.lit("É té, x!")), tx.content_fingerprint(F.lit("éTÉ x")), tx.content_fingerprint(F.lit("t x")))
    assert a == b != d


@pytest.mark.parametrize("text,noise", [("We're HIRING now", True), ("raises $5m", True), ("series b round", True), ("plain news", False)])
def test_noise(spark, text, noise):
    assert one(spark, tx.is_noise(c("t"), F.lit(""), F.lit("https://a.org")), t=text) is noise


def test_noise_looks_at_500_characters_and_badges(spark):
    assert one(spark, tx.is_noise(F.lit("t"), F.lit("x" * 500 + " unsubscribe"))) is False
    assert one(spark, tx.is_noise(F.lit("t"), F.lit(""), F.lit("https://img.shields.io/x"))) is True


def test_unsafe_findings(spark):
    found = one(spark, tx.unsafe_findings(F.lit("eval (x); os.system('a'); AKIA" + "A" * 16)))
    assert found == ["usage of eval()", "os.system() call", "potential AWS access key"]
    assert one(spark, sc.security_score(F.array(*[F.lit("x")] * 7))) == 0.0


def test_scores(spark):
    as_of = F.lit("2024-01-31").cast("timestamp")

    def back(days):
        return F.lit("2024-01-31").cast("timestamp") - F.make_dt_interval(F.lit(days))

    assert one(spark, sc.freshness(back(30), as_of)) == pytest.approx(math.exp(-1))
    assert one(spark, sc.freshness(F.lit(None).cast("timestamp"), as_of)) == 0.5
    assert one(spark, sc.freshness(back(-3), as_of)) == 1.0
    assert one(spark, sc.half_life_decay(back(7), as_of)) == pytest.approx(0.5)
    assert one(spark, sc.relevance(F.lit(0.8), F.lit("tier1"), back(0), as_of)) == pytest.approx(0.87)
    assert one(spark, sc.relevance(F.lit(5.0), F.lit("tier1"), back(0), as_of)) == 1.0
    assert one(spark, sc.authority(F.lit("other"))) == 0.3
    assert one(spark, sc.is_stale(back(180), as_of)) is False and one(spark, sc.is_stale(back(181), as_of)) is True
    assert one(spark, sc.community_score(F.lit(0), F.lit(0), F.lit(9))) == 0.0
    assert one(spark, sc.community_score(F.lit(1000), F.lit(0), F.lit(0))) == 0.6
    assert one(spark, sc.community_score(F.lit(10**7), F.lit(10**6), F.lit(10**6))) == 1.0


@pytest.mark.parametrize("title,want", [
    ("", -0.25), ("Untitled", -0.25), ("own/repo", -0.25), ("my first try", -0.15), ("Hello-World", -0.15), ("A real title", 0.0),
])
def test_title_penalty(spark, title, want):
    assert one(spark, sc.title_penalty(c("t")), t=title) == want


def test_heuristic_quality(spark):
    h = one(spark, sc.heuristic_quality(F.lit("tier1"), F.lit("x" * 2500), F.lit("A summary of useful length"), F.array(F.lit("a")), F.lit("Good title")))
    assert h.final_score == 0.85 and h.has_tags
    low = one(spark, sc.heuristic_quality(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.lit("")))
    assert low.final_score == 0.05 and low.source_tier == "unknown"


@pytest.mark.parametrize("ratio,label", [(None, "emerging"), (1.6, "accelerating"), (1.5, "plateauing"), (0.66, "declining")])
def test_velocity(spark, ratio, label):
    assert one(spark, sc.velocity_label(F.lit(ratio).cast("double"))) == label


@pytest.mark.parametrize("stars,text", [(0, None), (999, "999"), (1000, "1k"), (1234, "1.2k"), (98000, "98k")])
def test_star_text(spark, stars, text):
    assert one(spark, sc.star_text(F.lit(stars))) == text


@pytest.mark.parametrize("dollars,cents", [(0.0, 0), (0.0001, 1), (0.125, 12), (0.135, 14), (3.0, 300)])
def test_cents(spark, dollars, cents):
    assert one(spark, sc.to_cents(F.lit(dollars))) == cents


def test_labels(spark):
    raw = '```json\n{"primary_type": "Tutorial", "tags": ["a"], "confidence": 0.4, "summary": " ", "significance": "breaking-change"}\n```'
    l = one(spark, lb.parse_label_json(c("r")), r=raw)
    assert (l.primary_type, l.tags, l.confidence) == ("Tutorial", ["a"], 0.4)
    assert one(spark, lb.normalize_type(F.lit("Tutorial"))) == "docs" and one(spark, lb.normalize_type(F.lit(None).cast("string"))) == "docs"
    assert one(spark, lb.normalize_summary(F.lit("  "))).startswith("[Summary unavailable")
    bad = one(spark, lb.parse_label_json(F.lit("no json")))
    assert (bad.primary_type, bad.tags, bad.significance) == ("unknown", [], "informational")
    tail = one(spark, lb.parse_label_json(F.lit('{"primary_type": "tool"} trailing words')))
    assert tail.primary_type == "tool"


def test_profiles(spark):
    want = sorted({"x", "docker", "deployment", "monitoring", "ci-cd", "meta", "llama", "own-tool"})
    p = {"tech_stack": ["x"], "skills": ["devops"], "providers": ["meta"], "tools": ["own-tool"]}
    assert pf.expand_profile(p) == want and pf.expand_profile({}) == []
    s = F.struct(*[F.array(*map(F.lit, p[k])).alias(k) for k in ("tech_stack", "skills", "tools", "providers")])
    assert one(spark, pf.profile_tags(s)) == want


def test_personas():
    assert pf.resolve_persona("curator")["limit"] == 50 and pf.resolve_persona("curator", limit=5)["limit"] == 5
    assert pf.resolve_persona("learner", days=3)["days"] == 3 and pf.resolve_persona("learner")["types"] == ["docs", "practice"]
    assert pf.resolve_persona("agent")["new"] is True and pf.resolve_persona(None)["days"] == 7
    assert pf.resolve_persona("agent-builder", significance=["minor"])["significance"] == ["minor"]


@pytest.mark.parametrize("q,route", [
    ("urgent thing", "breaking"), ("browse the api", "search"), ("system health", "status"), ("action items", "action-items"),
    ("catch me up", "briefing"), ("a vs b", "similar"), ("how to test", "library"), ("latest models", "feed"), ("migration guide", "breaking"),
])
def test_query_route(spark, q, route):
    assert one(spark, tx.query_route(c("q")), q=q) == route


def test_titles_and_weeks(spark):
    assert one(spark, tx.slugify(F.lit("/A b__C\\d/"))) == "a-b-c-d"
    assert one(spark, tx.smart_title(F.lit("mcp-vscode-tips"))) == "MCP VS Code Tips"
    assert one(spark, tx.iso_week(F.lit("2024-12-30").cast("timestamp"))) == "2025-W01"
    assert one(spark, tx.mask_email(F.lit("abc"))) == "***" and one(spark, tx.mask_email(F.lit("abcd@x"))) == "abc***"
    assert tx.query_terms("MCP, best-practices!") == ["mcp", "best", "practices"]
    assert one(spark, tx.nfc_col(F.lit("é"))) == "é"


def test_web_query_and_matching(spark):
    w = tm.web_query('alpha "two words" beta OR gamma -skip')
    assert w == {"groups": [["alpha"], ["beta", "gamma"]], "phrases": [["two", "words"]], "excluded": ["skip"]}
    text = dict(title="Alpha rises", excerpt="", content="here two words meet gamma rays")

    def hit(q):
        return one(spark, tm.match_all(q), **text)

    assert hit("alpha gamma") and hit('"two words"') and not hit('"words two"') and not hit("alph") and not hit("alpha -rays")
    assert hit("beta OR gamma") and not hit("beta") and not hit("!!!")
    rank = one(spark, tm.text_rank("alpha"), **text)
    assert rank == pytest.approx(1.0 + 0.5)


def test_item_and_library_text(spark):
    df = spark.sql("select 'T' title, '' summary, 'E' excerpt, 'u' url, 'tool' primary_type, null significance, 0.456D relevance_score, array('a','b') tags")
    assert df.select(rd.item_text()).first()[0] == "## T\nE\nURL: u\nType: tool | Sig: informational | Score: 0.46\nTags: a, b\n\n"
    lib = spark.sql("select 'T' title, 'tl' tldr, array('k') key_points, array(named_struct('title','g','detail','d')) gotchas")
    assert lib.select(rd.library_text()).first()[0] == "## Library: T\ntl\nKey points:\n- k\nGotchas:\n- g: d\n\n"


def test_zero_and_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    got = {r[0]: r[1] for r in df.select("id", vec.distance_to(F.col("v"), [1.0, 0.0])).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: None, 4: 1.0}
    assert df.where("id = 1").select(vec.distance_to(F.col("v"), [0.0, 0.0])).first()[0] == 1.0
    assert df.where("id = 2").select(vec.cosine_distance(F.col("v"), F.col("v"))).first()[0] == 1.0


def test_query_words_are_unicode():
    assert tx.text_terms("Größe, données 日本") == ["größe", "données", "日本"]


def test_long_words_keep_their_end(spark):
    df = spark.createDataFrame([("mcp-" + "a" * 1_200_000,)], "s string")
    assert df.select(F.length(tx.smart_title(F.col("s")))).first()[0] == 1_200_004
