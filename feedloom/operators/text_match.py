"""Full-text matching over title (A), excerpt (B) and content (C).

Tokens are runs of Unicode letters and digits, lower-cased, without stemming. A single query is evaluated per row by
counting whole-token hits; nothing is exploded or shuffled. ``build_index`` is the stored form for many queries.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.functions import text as tx
from feedloom.operators.filters import all_of, any_of

FIELD_WEIGHTS = {"title": 1.0, "excerpt": 0.4, "content": 0.2}  # fixed values
PHRASE_WEIGHT = 0.5
_EDGE = r"[\p{L}\p{N}]"


def web_query(q: str) -> dict:
    """Quoted phrases, OR groups and -exclusions of one query string (driver side)."""
    phrases = [tx.text_terms(p) for p in re.findall(r'"([^"]+)"', q)]
    rest = re.sub(r'"[^"]*"', " ", q)
    excluded, groups, join = [], [], False
    for word in rest.split():
        if word.upper() == "OR" and groups:
            join = True
            continue
        terms = tx.text_terms(word)
        if not terms:
            continue
        if word.startswith("-"):
            excluded += terms
        elif join:
            groups[-1] += terms
        else:
            groups.append(terms)
        join = False
    return {"groups": groups, "phrases": [p for p in phrases if p], "excluded": excluded}


def hits(field: str, terms: list[str]) -> Column:
    """Occurrences of a token sequence in a field."""
    body = r"[^\p{L}\p{N}]+".join(re.escape(t) for t in terms)
    pattern = rf"(?<!{_EDGE}){body}(?!{_EDGE})"
    return F.regexp_count(F.lower(F.coalesce(F.col(field), F.lit(""))), F.lit(pattern))


def has_term(term: str, fields=FIELD_WEIGHTS) -> Column:
    # a plain substring test first: it rejects most rows before any pattern runs
    return any_of(*[
        F.lower(F.coalesce(F.col(f), F.lit(""))).contains(term) & (hits(f, [term]) > 0) for f in fields
    ])


def has_phrase(terms: list[str], fields=FIELD_WEIGHTS) -> Column:
    return any_of(*[hits(f, terms) > 0 for f in fields])


def match_all(q: str) -> Column:
    """Web syntax: every word (or one of an OR group), every quoted phrase, no excluded word."""
    w = web_query(q)
    return all_of(
        *[any_of(*[has_term(t) for t in group]) for group in w["groups"]],
        *[has_phrase(p) for p in w["phrases"]],
        *[~has_term(t) for t in w["excluded"]],
        F.lit(bool(w["groups"] or w["phrases"])),
    )


def match_any(q: str) -> Column:
    return any_of(*[has_term(t) for t in tx.text_terms(q)])


def text_rank(q: str, weights=FIELD_WEIGHTS) -> Column:
    """Sum over fields and terms of weight * (1 + ln tf), plus half the field weight where the whole phrase occurs."""
    terms = list(dict.fromkeys(tx.text_terms(q)))
    parts = []
    for f, w in weights.items():
        for t in terms:
            tf = hits(f, [t])
            parts.append(F.when(tf > 0, F.lit(w) * (1.0 + F.log(tf.cast("double")))).otherwise(F.lit(0.0)))
        parts.append(F.when(hits(f, tx.text_terms(q)) > 0, F.lit(PHRASE_WEIGHT * w)).otherwise(F.lit(0.0)))
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


# ---- stored index ------------------------------------------------------------------------


def build_index(items: DataFrame, weights=FIELD_WEIGHTS) -> DataFrame:
    """(term, id, score): postings with the field-weighted (1 + ln tf) already summed.

    Counting per (term, id, field) combines almost completely inside the map task, because a document's tokens are
    produced by one row. Write it partitioned by a hash of the term; a frequent term's postings then spread over files.
    """
    fields = F.array(*[
        F.struct(F.lit(f).alias("field"), F.lit(w).alias("weight"), tx.tokens(F.col(f)).alias("tokens"))
        for f, w in weights.items()
    ])
    one = items.select("id", F.explode(fields).alias("f")).select(
        "id", "f.field", "f.weight", F.explode("f.tokens").alias("term")
    )
    tf = one.groupBy("id", "term", "field", "weight").agg(F.count(F.lit(1)).alias("tf"))
    part = F.col("weight") * (1.0 + F.log(F.col("tf").cast("double")))
    return tf.groupBy("id", "term").agg(F.sum(part).alias("score"))


def search_index(index: DataFrame, q: str, mode: str = "all") -> DataFrame:
    """(id, n_terms, score) of the rows holding all (or any) of the query's words."""
    terms = list(dict.fromkeys(tx.text_terms(q)))
    g = index.where(F.col("term").isin(*terms)).groupBy("id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum("score").alias("score")
    )
    return g.where(F.col("n_terms") == len(terms)) if mode == "all" else g
