"""Language identification by segmentation-marginalised unigram models.

The pieces are those of a fixed public vocabulary. Each language has a probability for every piece; the probability of a
word is the sum over all its segmentations into pieces, computed by a forward pass, and that of a text the product over
its words. The probabilities come from expectation-maximisation (forward-backward) over the word counts of a sample of
labelled texts with about ``SAMPLE_CHARS`` characters for each language; prediction covers whole texts.

The forward pass runs over many words at once: words of similar length form a matrix, and each step adds the pieces that
end at one position for all words and languages. Words are remembered inside a worker (bounded), which changes no score.

Edge cases: a text that is null or has no letter is ``und`` with score 0; characters outside the vocabulary use a reserve
probability; very long words are rescaled as they go, so nothing underflows; without labelled texts every text is
``und``; ties go to the alphabetically first language; result columns replace input columns of the same name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import fold, released, stored, table, with_columns
from feedloom.llm.vocab import vocabulary_path

SAMPLE_CHARS = 3_000_000  # characters of labelled text per language used for fitting
MAX_LANGUAGES = 1000
LONGEST = 8  # characters of a piece, the word mark included
ROUNDS = 3
MARK = "▁"
MEMO = 300_000
_LETTER = re.compile(r"[^\W\d_]")
_PUNCTUATION = str.maketrans(dict.fromkeys("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~0123456789«»„“”¡¿…–—", " "))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return text.lower().translate(_PUNCTUATION).split()


@dataclass(frozen=True)
class Pieces:
    """Hashes of the pieces by length, sorted, with their numbers; the last number is the reserve for other characters."""

    hashes: tuple[np.ndarray, ...]
    numbers: tuple[np.ndarray, ...]
    size: int


@lru_cache(maxsize=2)
def pieces(path: str, longest: int = LONGEST) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    names = sorted({p for p in names if len(p) <= longest and p == p.lower()})
    hashes, numbers = [], []
    for n in range(1, longest + 1):
        own = [k for k, p in enumerate(names) if len(p) == n]
        h = np.zeros(len(own), np.uint64)
        for j in range(n):
            h = h * _BASE + np.fromiter((ord(names[k][j]) for k in own), np.uint64, len(own))
        at = np.argsort(h)
        hashes.append(h[at])
        numbers.append(np.array(own, np.int64)[at])
    return Pieces(tuple(hashes), tuple(numbers), len(names) + 1)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, character matrix) of words with equal length, mark included; at most about 400,000 characters each."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        n = int(lengths[order[at]])
        stop = min(int(np.searchsorted(lengths[order], n, "right")), at + max(1, 400_000 // n))
        rows = order[at:stop]
        text = "".join(MARK + words[k] for k in rows)
        yield rows, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(rows), n).astype(np.uint64)
        at = stop


def lattice(chars: np.ndarray, vocabulary: Pieces) -> list[np.ndarray]:
    """For each piece length n: piece numbers of the substrings that end at each position, -1 where there is none.
    A single character outside the vocabulary gets the reserve number."""
    out, h = [], np.zeros_like(chars)
    for n in range(1, min(len(vocabulary.hashes), chars.shape[1]) + 1):
        h = h[:, (n > 1) :] if n == 1 else h[:, :-1]
        h = h * _BASE + chars[:, n - 1 :]
        known, number = vocabulary.hashes[n - 1], vocabulary.numbers[n - 1]
        ids = np.full(h.shape, -1, np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            ids = np.where(known[at] == h, number[at], -1)
        if n == 1:
            ids = np.where(ids < 0, vocabulary.size - 1, ids)
        out.append(ids)
    return out


def forward(ids: list[np.ndarray], prob: np.ndarray, keep: bool = False):
    """Log probability of every word under every language; with ``keep`` also all forward values (short words only).
    ``prob``: (pieces + 1, languages), the last row zero (for number -1)."""
    rows, length = ids[0].shape
    alpha = [np.ones((rows, prob.shape[1]))]
    scale = np.zeros(rows)
    for i in range(length):
        new = np.zeros_like(alpha[-1])
        for n in range(1, min(len(ids), i + 1) + 1):
            new += alpha[-n] * prob[ids[n - 1][:, i - n + 1]]
        alpha.append(new)
        if not keep:
            alpha = alpha[-len(ids) :]
            if i % 8 == 7:
                top = np.maximum(np.max(np.stack(alpha), axis=(0, 2)), 1e-250)
                alpha = [a / top[:, None] for a in alpha]
                scale += np.log(top)
    logs = np.log(np.maximum(alpha[-1], 1e-300)) + scale[:, None]
    return (logs, alpha) if keep else logs


def expected(words: list[str], counts: np.ndarray, vocabulary: Pieces, prob: np.ndarray) -> np.ndarray:
    """Expected uses of every piece in every language. Words of more than 40 characters teach nothing about pieces."""
    total = np.zeros((vocabulary.size, prob.shape[1]))
    for rows, chars in by_length(words):
        if chars.shape[1] > 41:
            continue
        ids = lattice(chars, vocabulary)
        _, alpha = forward(ids, prob, keep=True)
        length = chars.shape[1]
        beta = [np.zeros_like(alpha[0]) for _ in range(length)] + [counts[rows] / np.maximum(alpha[-1], 1e-300)]
        for i in range(length - 1, -1, -1):
            for n in range(1, min(len(ids), length - i) + 1):
                piece = ids[n - 1][:, i]
                use = prob[piece] * beta[i + n]
                beta[i] += use
                use = use * alpha[i]
                there = piece >= 0
                for k in range(prob.shape[1]):
                    total[:, k] += np.bincount(piece[there], use[there, k], vocabulary.size)
    return total


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    prior: np.ndarray
    prob: np.ndarray  # (pieces + 1, languages)
    path: str


def normalised(uses: np.ndarray) -> np.ndarray:
    p = (uses + 0.01) / (uses + 0.01).sum(axis=0)
    return np.vstack([p, np.zeros((1, uses.shape[1]))])


def fit(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", vocabulary: str = "piece_bpe_32k.model",
        sample_chars: int = SAMPLE_CHARS, rounds: int = ROUNDS) -> Model:
    """``usable``: which documents may be learned from."""
    spark = docs.sparkSession
    path = vocabulary_path(vocabulary)
    labelled = docs.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = labelled.groupBy(lang).agg(F.sum(F.length(text)).alias("chars"), F.count(F.lit(1)).alias("n")).orderBy(lang).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return Model((), np.zeros(0), np.zeros((0, 0)), path)
    languages = tuple(r[lang] for r in sizes)
    share = F.create_map(*[x for r in sizes for x in (F.lit(r[lang]), F.lit(min(1.0, sample_chars / max(1, r["chars"]))))])[F.col(lang)]
    chosen = labelled.where(F.pmod(F.xxhash64(text), F.lit(1 << 30)) < share * F.lit(1 << 30)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in released(batches):
            tally: Counter = Counter()
            for name, t in zip(b["lang"], b["text"]):
                tally.update((name, w) for w in words_of(t))
            yield pd.DataFrame([(k[0], k[1], n) for k, n in tally.items()], columns=["lang", "word", "n"]).astype({"n": "int64", "lang": object, "word": object})

    per_word = chosen.mapInPandas(count, "lang string, word string, n long").groupBy("word").agg(
        F.array(*[F.coalesce(F.sum(F.when(F.col("lang") == name, F.col("n"))), F.lit(0)).cast("double") for name in languages]).alias("counts"))
    per_word = stored(per_word, "words")
    size = pieces(path).size
    prob = normalised(np.ones((size, len(languages))))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(prob)  # bounded by vocabulary and languages

        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            v, total = pieces(path), 0
            for b in released(batches):
                if len(b):
                    total = total + expected(list(b["word"]), np.stack(b["counts"].to_list()), v, shared.value)
            if not np.isscalar(total):
                used = np.flatnonzero(total.sum(axis=1) > 0)
                yield pd.DataFrame({"piece": used, "uses": list(total[used])})

        uses = np.zeros((size, len(languages)))
        parts = per_word.mapInPandas(step, "piece int, uses array<double>").groupBy("piece").agg(
            F.array(*[F.sum(F.col("uses")[k]) for k in range(len(languages))]).alias("uses")).collect()  # one row per piece
        for r in parts:
            uses[r["piece"]] = r["uses"]
        prob = normalised(uses)
    prior = np.log(np.array([r["n"] for r in sizes], float) / sum(r["n"] for r in sizes))
    return Model(languages, prior, prob, path)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.vocabulary = pieces(model.path)
        self.known: dict[str, int] = {}
        self.logs = np.zeros((0, len(model.languages)))

    def learn(self, words: list[str]) -> None:
        logs = np.zeros((len(words), len(self.model.languages)))
        for rows, chars in by_length(words):
            logs[rows] = forward(lattice(chars, self.vocabulary), self.model.prob)
        at = len(self.known)
        if at + len(words) > len(self.logs):
            self.logs = np.vstack([self.logs[:at], np.zeros((max(at, len(words)), logs.shape[1]))])
        self.logs[at : at + len(words)] = logs
        self.known.update(zip(words, range(at, at + len(words))))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        rows = [words_of(t) if t and _LETTER.search(t) else [] for t in texts]
        new = list(dict.fromkeys(w for r in rows for w in r if w not in self.known))
        if len(self.known) + len(new) > MEMO:
            self.known.clear()
            self.logs = self.logs[:0]
            new = list(dict.fromkeys(w for r in rows for w in r))
        if new and self.model.languages:
            self.learn(new)
        out = []
        for r in rows:
            if not r or not self.model.languages:
                out.append(("und", 0.0))
                continue
            z = self.logs[np.fromiter(map(self.known.__getitem__, r), np.int64, len(r))].sum(axis=0) + self.model.prior
            best = int(z.argmax())
            out.append((self.model.languages[best], float(1 / np.exp(z - z[best]).sum())))
        return out


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = Scorer(shared.value)
        for texts in released(batches):
            rows = list(texts)
            out = [x for k in range(0, len(rows), 100) for x in score(rows[k : k + 100])]
            yield pd.DataFrame(out, columns=["lang_pred", "score"]).astype({"score": "float64"})

    m = docs.withColumn("__m", identify(F.col(text)))
    return with_columns(m, {"lang_pred": F.col("__m.lang_pred"), "score": F.col("__m.score")}).drop("__m")


def op1_language_id(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold(F.col("doc_id"), 5) == 0
    return predict(docs.drop("lang"), fit(docs, ~held)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
