"""Text functions (Column -> Column). Letters and digits are Unicode classes, never ``\\w``."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from feedloom import vocab

TOKEN = r"[\p{L}\p{N}]+"


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def content_fingerprint(text: Column) -> Column:
    """sha256 of the lower-cased text without anything but letters, digits and '_'."""
    return F.sha2(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", ""), 256)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(F.trim(F.coalesce(text, F.lit(""))), 256), 1, 16)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def strip_html(text: Column, max_chars: int = 5000, min_chars: int = 50) -> Column:
    """Tags out, white space to single blanks; null when too little is left."""
    flat = F.trim(F.regexp_replace(strip_tags(text), r"\s+", " "))
    return F.when(F.length(flat) > min_chars, F.substring(flat, 1, max_chars))


def is_noise(title: Column, content: Column, url: Column | None = None) -> Column:
    """Job adverts, sponsored posts, funding news and mail boilerplate; badge urls."""
    head = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.substring(F.coalesce(content, F.lit("")), 1, 500))
    hit = head.rlike(vocab.NOISE_PATTERN)
    if url is not None:
        hit = hit | F.coalesce(url, F.lit("")).rlike(vocab.BADGE_URL_PATTERN)
    return hit


def unsafe_findings(content: Column, patterns=vocab.UNSAFE_PATTERNS) -> Column:
    """Labels of the unsafe patterns found, in pattern order."""
    return F.array_compact(F.array(*[F.when(content.rlike(p), F.lit(label)) for p, label in patterns]))


def embed_input(title: Column, content: Column, max_chars: int = 4000) -> Column:
    return F.concat(title, F.lit("\n\n"), F.substring(content, 1, max_chars))


def slugify(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), r"[/\\]", "-")
    out = F.regexp_replace(out, "[^a-z0-9-]", "-")
    return F.regexp_replace(F.regexp_replace(out, "-+", "-"), "^-|-$", "")


def smart_title(slug: Column, acronyms: dict = vocab.ACRONYMS) -> Column:
    names = literal_map(acronyms)
    words = F.split(F.replace(slug, F.lit("/"), F.lit(" -- ")), "-")

    def cased(w):
        plain = F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))
        return F.coalesce(names[F.lower(w)], plain)

    return F.array_join(F.transform(words, cased), " ")


def library_content_hash(body: Column, key_points: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(body, F.lit("")), F.coalesce(F.to_json(key_points), F.lit("[]"))), 256)


def iso_week(ts: Column) -> Column:
    year = F.date_part(F.lit("YEAROFWEEK"), ts).cast("string")
    return F.concat(year, F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def mask_email(email: Column) -> Column:
    return F.when(F.length(email) > 3, F.concat(F.substring(email, 1, 3), F.lit("***"))).otherwise(F.lit("***"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def token_text(text: Column) -> Column:
    """The lower-cased text for a splitter outside the JVM. Characters that the JVM's Unicode does not know are blanks, as
    ``tokens`` takes them for separators where a newer Unicode may see letters."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike(r"\p{Cn}"), F.regexp_replace(low, r"\p{Cn}", " ")).otherwise(low)


def query_terms(q: str) -> list[str]:
    """ASCII words of one query, lower-cased, in order (driver side: one query is one small string)."""
    return re.findall(r"[a-zA-Z0-9]+", q.lower())


def text_terms(q: str) -> list[str]:
    """Words of one query as the texts are split: runs of Unicode letters and digits of the NFC form, lower-cased."""
    return re.findall(r"[^\W_]+", nfc(q).lower())


def query_terms_col(q: Column) -> Column:
    return F.regexp_extract_all(F.lower(q), F.lit("([a-zA-Z0-9]+)"), F.lit(1))


def or_form(q: Column) -> Column:
    """'a b c' -> 'a | b | c'; a query without words stays as it is."""
    terms = query_terms_col(q)
    return F.when(F.size(terms) > 0, F.array_join(terms, " | ")).otherwise(q)


def escape_like(value: Column) -> Column:
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("%"), F.lit("\\%"))
    return F.replace(out, F.lit("_"), F.lit("\\_"))


def nfc(text: str) -> str:
    return unicodedata.normalize("NFC", text)


@F.pandas_udf(StringType())
def nfc_col(s: pd.Series) -> pd.Series:
    """Unicode NFC for a column; the JVM side has no such function."""
    return s.str.normalize("NFC")


# ---- queries -----------------------------------------------------------------------------


def intent_type(q: Column) -> Column:
    return F.when(q.rlike(vocab.INTENT_TYPE_PATTERN), F.lit("tool"))


def intent_significance(q: Column) -> Column:
    return F.when(q.rlike(vocab.INTENT_BREAKING_PATTERN), F.lit("breaking"))


# routes in order of precedence: name, whole words, phrases found anywhere (fixed values)
QUERY_ROUTES = [
    ("breaking", ["breaking", "urgent", "deprecated", "deprecation"], ["migration guide"]),
    ("status", ["status", "health"], []),
    (
        "action-items", [],
        ["action item", "action items", "needs attention", "security issue", "security alert", "vulnerability"],
    ),
    ("briefing", [], ["briefing", "catch me up", "summarize", "overview of", "what's happening"]),
    (
        "similar", ["compare", "comparison", "alternative", "alternatives"],
        [" vs ", "versus", "difference between", "different from"],
    ),
    (
        "library",
        [
            "guide", "pattern", "patterns", "tutorial", "recommend", "recommendation", "gotcha", "gotchas",
            "pitfall", "pitfalls",
        ],
        ["how to", "best practice"],
    ),
    (
        "feed", ["new", "latest", "recent", "trending", "changelog", "updates"],
        ["what changed", "this week", "release notes", "updates on"],
    ),
]


def query_route(q: Column, routes=QUERY_ROUTES) -> Column:
    """Which of the eight query kinds a free-text query asks for."""
    low = F.lower(q)
    words = F.split(low, r"\s+")
    chain = None
    for name, whole, phrases in routes:
        tests = [F.arrays_overlap(words, F.array(*map(F.lit, whole)))] if whole else []
        tests += [low.contains(p) for p in phrases]
        hit = tests[0]
        for t in tests[1:]:
            hit = hit | t
        chain = F.when(hit, F.lit(name)) if chain is None else chain.when(hit, F.lit(name))
    return chain.otherwise(F.lit("search"))


def matching_keyword(keywords: Column, haystack: Column) -> Column:
    """First keyword (in list order) found case-insensitively in the text, null if none."""
    low = F.lower(haystack)
    return F.get(F.filter(keywords, lambda k: low.contains(F.lower(k))), F.lit(0))


def alert_text(title: Column, content: Column, tags: Column) -> Column:
    return F.concat_ws(
        " ", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit("")), F.array_join(tags, " ")
    )


def is_breaking_text(title: Column, content: Column, tags: Column, keywords=vocab.BREAKING_KEYWORDS) -> Column:
    low = F.lower(alert_text(title, content, tags))
    hit = F.lit(False)
    for k in keywords:
        hit = hit | low.contains(k)
    return hit
