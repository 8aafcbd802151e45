"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding lower-cases, maps homoglyphs and digit substitutions to one letter each and turns punctuation into spaces, in the
lexicon as in the texts. Lexicon entries are word beginnings (any ending) and whole words; their weights are smoothed log
odds of document frequency in labelled toxic against other documents. A phrase of a lexicon word and a neighbour that
occurs in clean documents and hardly in toxic ones is an exception and cancels the match inside it. The score is a
logistic function of the summed weight and of that weight normalised by length.

The lexicon, the exceptions and the logistic function are fitted on at most ``SAMPLE`` labelled documents of each class
(those with the smallest hash of their text); scoring covers every whole text.

Edge cases: null and empty texts have no match and get the score of a text without any; a document with several labels
is toxic if one says so; null labels are ignored; without labelled toxic documents every score is 0; repeated rows
are scored each on its own; result columns replace input columns of the same name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import fold, released, stored, table, with_columns

SAMPLE = 10_000  # labelled documents of each class used for fitting
CANDIDATES = 50_000  # most frequent terms of toxic documents that are weighed
PREFIX, WORD = range(4, 11), range(2, 24)  # lengths of word beginnings and whole words
LEAST_ODDS, LEAST_SHARE, LEAST_DOCS = 3.5, 0.003, 4

# Look-alikes of Latin letters (Cyrillic, Greek), digit and sign substitutions. "l" and "1" fold to "i", so that either reading matches.
FOLDED = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b",
    "ԁ": "d", "ɡ": "g", "һ": "h", "ո": "n", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "l": "i", "ı": "i",
}
_FOLD = str.maketrans(FOLDED | dict.fromkeys("!\"#%&'()*+,-./:;<=>?[\\]^_`{|}~«»„“”‘’¡¿…–—", " ") | dict.fromkeys("​‌‍⁠﻿­", None))


def folded(text: str | None) -> list[str]:
    """The folded words."""
    if not text:
        return []
    if not text.isascii():
        import unicodedata

        text = unicodedata.normalize("NFKC", text)
    return text.lower().translate(_FOLD).split()


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float]  # " beginning" or " word "
    exceptions: frozenset[str]  # " word neighbour "
    coefficients: tuple[float, float, float]  # of 1, log(1 + weight), weight per root of length

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for term, w in self.weights.items():
            a.add_word(term, (len(term.rstrip()), w))
        for phrase in self.exceptions:
            a.add_word(phrase, (len(phrase), None))
        if len(a):
            a.make_automaton()
        return a


def matches(words: list[str], automaton) -> list[tuple[int, int, float]]:
    """(start, end, weight) in the joined text, without those inside an exception phrase."""
    if not len(automaton) or not words:
        return []
    hits, pardons = [], []
    line = f" {' '.join(words)} "
    for end, (length, weight) in automaton.iter(line):
        if weight is None:
            pardons.append((end - length + 1, end))
        else:
            start = end + 1 - length - (line[end] == " ")
            hits.append((start, start + length - 1, weight))
    if pardons:
        hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b in pardons)]
    return hits


def features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(weight)), np.log1p(weight), weight / np.sqrt(words + 1.0)], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; both classes weigh the same."""
    w = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(x.shape[1]), x.T @ (w * (y - p)) - penalty @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _terms(words: list[str]) -> set[str]:
    out = set()
    for w in set(words):
        n = len(w)
        out.update(f" {w[:k]}" for k in PREFIX if k <= n)
        if n in WORD:
            out.add(f" {w} ")
    return out


TALLY = 200_000  # terms that a task counts before it passes them on


def _count(sample: DataFrame, per_doc, at_least: int = 1) -> DataFrame:
    """Documents per term; every task counts its own first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally: Counter = Counter()
        for b in released(batches):
            for text in b["text"]:
                tally.update(per_doc(folded(text)))
                if len(tally) > TALLY:
                    yield pd.DataFrame({"term": list(tally), "n": list(tally.values())})
                    tally.clear()
        yield pd.DataFrame({"term": list(tally), "n": list(tally.values())}).astype({"n": "int64", "term": object})

    return sample.select("text").mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= at_least)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Lexicon:
    """``usable``: which documents' labels may be learned from (a condition on ``docs``' id column)."""
    spark = docs.sparkSession
    marks = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).where(usable).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    marks = marks.withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    chosen = [marks.where(F.col("toxic") == c).orderBy(F.xxhash64(id_col), id_col).limit(sample) for c in (0, 1)]
    picked = spark.createDataFrame([tuple(r) for c in chosen for r in c.select(id_col, "toxic").collect()], f"__id {dict(docs.dtypes)[id_col]}, toxic int")
    # at most 2 x sample ids: a bounded broadcast, so that no text is shuffled
    seen = stored(docs.join(F.broadcast(picked), docs[id_col] == picked["__id"]).select(docs[text].alias("text"), "toxic"), "labelled")
    bad, good = seen.where("toxic = 1"), seen.where("toxic = 0")
    n_bad, n_good = bad.count(), good.count()
    if not n_bad:
        return Lexicon({}, frozenset(), (-30.0, 0.0, 0.0))
    least = max(LEAST_DOCS, int(LEAST_SHARE * n_bad))
    frequent = {r["term"]: r["n"] for r in _count(bad, _terms, least).orderBy(F.desc("n"), "term").limit(CANDIDATES).collect()}
    shared = spark.sparkContext.broadcast(frozenset(frequent))
    clean = {r["term"]: r["n"] for r in _count(good, lambda words: _terms(words) & shared.value).collect()}
    odds = {t: float(np.log((n + 0.5) / (n_bad + 1) / ((clean.get(t, 0) + 0.5) / (n_good + 1)))) for t, n in frequent.items()}
    weights: dict[str, float] = {}
    for t in sorted((t for t, w in odds.items() if w >= LEAST_ODDS), key=lambda t: (len(t), t)):
        if not any(t[:k] in weights for k in range(2, len(t))):
            weights[t] = odds[t]
    lexicon = Lexicon(weights, frozenset(), (0.0, 0.0, 0.0))

    def phrases(words: list[str]) -> set[str]:
        out = set()
        for start, end, _ in matches(words, lexicon.automaton() if not hasattr(phrases, "a") else phrases.a):
            line = f" {' '.join(words)} "
            stop = line.find(" ", end)
            before, after = line[:start].rsplit(" ", 1)[-1], line[stop + 1 :].split(" ", 1)[0]
            word = line[start + 1 : stop]
            out.update([f" {before} {word} "] * bool(before) + [f" {word} {after} "] * bool(after))
        return out

    def with_automaton(words: list[str]) -> set[str]:
        if not hasattr(phrases, "a"):
            phrases.a = lexicon.automaton()
        return phrases(words)

    pardoned = _count(good, with_automaton, 3).alias("g").join(_count(bad, with_automaton).alias("b"), "term", "left")
    exceptions = frozenset(r["term"] for r in pardoned.where("coalesce(b.n, 0) * 10 <= g.n").select("term").orderBy("term").limit(CANDIDATES).collect())
    lexicon = Lexicon(weights, exceptions, (0.0, 0.0, 0.0))
    rows = measure(seen, lexicon, "text").select("__weight", "__words", "toxic").toPandas()  # at most 2 x sample rows
    x = features(rows["__weight"].to_numpy(), rows["__words"].to_numpy())
    beta = logistic(x, rows["toxic"].to_numpy()) if n_good else np.array([0.0, 1.0, 0.0])
    return Lexicon(weights, exceptions, tuple(float(b) for b in beta))


def measure(docs: DataFrame, lexicon: Lexicon, text: str) -> DataFrame:
    @F.pandas_udf("weight double, words long")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for texts in released(batches):
            out = []
            for t in texts:
                words = folded(t)
                out.append((sum(w for _, _, w in matches(words, automaton)), len(words)))
            yield pd.DataFrame(out, columns=["weight", "words"]).astype({"weight": "float64", "words": "int64"})

    m = docs.withColumn("__m", weigh(F.col(text)))
    return m.select(*docs.columns, F.col("__m.weight").alias("__weight"), F.col("__m.words").alias("__words"))


def toxicity(docs: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``."""
    a, b, c = lexicon.coefficients
    m = measure(docs, lexicon, text)
    z = F.lit(a) + F.lit(b) * F.log1p("__weight") + F.lit(c) * F.col("__weight") / F.sqrt(F.col("__words") + 1.0)
    out = with_columns(m, {"score": 1.0 / (1.0 + F.exp(-z))}).drop("__weight", "__words")
    return with_columns(out, {"predicted": (F.col("score") >= threshold).cast("int")})


def op4_toxicity(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold(F.col("doc_id"), 3) == 1
    lexicon = fit(docs, table(spark, sf_dir, "labels"), ~held)
    return toxicity(docs, lexicon).select("doc_id", held.alias("held_out"), "score", "predicted")
