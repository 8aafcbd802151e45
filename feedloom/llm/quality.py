"""Quality rules with risk-controlled thresholds.

Rule metrics are computed from the whole text of each document. Labelled good documents serve as a holdout: for every
rule and stratum the cutoffs of a fixed grid are tested from lenient to strict by the exact (Clopper-Pearson) upper bound
of their false rejection rate, until the first bound exceeds that rule's share of the limit (fixed-sequence testing); the
confidence is corrected (Bonferroni) for all rules and strata. A stratum with too few labelled good documents gets no cutoff and rejects nothing.

Edge cases: a null text has no words and fails the base rule; repeated rows are scored each on its own; null strata form
a stratum of their own; an empty label table yields no cutoffs; columns of the input that bear a result's name are replaced.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import WHITE, released, stored, table, text_bytes, with_columns

SYMBOLS = b"#*$%&|<>"
_DROP = bytes(i for i in range(256) if i not in SYMBOLS)
WINDOW = 8


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more. Exact: window identities by doubling ranks."""
    n = len(words)
    if n <= width:
        return 0
    distinct = dict.fromkeys(words)
    if len(distinct) == n:
        return 0
    ids = np.fromiter(map(dict(zip(distinct, range(n))).__getitem__, words), np.int64, n)
    span = 1
    while span < width:  # ids[i]: identity of the span words from i
        step = min(span, width - span)
        pair = ids[: len(ids) - step] * (int(ids.max()) + 1) + ids[step:]
        values, ids = np.unique(pair, return_inverse=True)
        if len(values) == len(ids):
            return 0
        span += step
    again = np.bincount(ids)[ids] > 1
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + width, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def metrics_of(text: str | None) -> tuple[int, int, int, int, int]:
    raw = text_bytes(text)
    words = raw.split()
    chars = sum(map(len, words)) if raw.isascii() else len(text) - sum(map(text.count, WHITE))
    symbols = len(raw.translate(None, _DROP))
    lines: dict[bytes, int] = {}
    dup = 0
    for line in raw.split(b"\n"):
        if line.strip():
            if line in lines:
                dup += 1
            else:
                lines[line] = 1
    return len(words), chars, symbols, dup, repeated_words(words)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the five counts and ``base_failed``."""

    @F.pandas_udf(", ".join(f"{n} long" for n in COUNTS))
    def metrics(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in released(batches):
            yield pd.DataFrame([metrics_of(t) for t in texts], columns=COUNTS, dtype="int64")

    m = docs.withColumn("__m", metrics(F.col(text)))
    out = m.select(*[m[c] for c in docs.columns if c not in (*COUNTS, "base_failed")], *[F.col(f"__m.{n}").alias(n) for n in COUNTS])
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30))


def ratios() -> dict[str, Column]:
    """The rules: each is a number that is high in bad documents."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbol_rate": F.col("n_symbols") / words,
        "repeat_rate": F.col("n_repeat_words") / words,
        "dup_line_rate": F.col("n_dup_lines") / words,
        "word_length": F.col("word_chars") / words,
        "shortness": 1.0 / words,
    }


#: Cutoffs that are tried, from strict to lenient: 48 quarter-octave steps for each rule, in units of its step.
GRID_POINTS = 48
RULE_SCALE = {"symbol_rate": 0.02, "repeat_rate": 0.005, "dup_line_rate": 0.002, "word_length": 2.0, "shortness": 0.0005}


def grid(rule: str) -> list[float]:
    step = 0.25 if rule != "word_length" else 0.125
    return [RULE_SCALE[rule] * 2 ** (step * i) for i in range(GRID_POINTS)]


def binomial_upper(rejected: int, n: int, error: float) -> float:
    """Exact one-sided Clopper-Pearson upper bound: the rate at which ``rejected`` or fewer of ``n`` have probability ``error``."""
    if n == 0 or rejected >= n:
        return 1.0

    k = np.arange(rejected + 1)
    log_fact = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    ways = log_fact[n] - log_fact[k] - log_fact[n - k]

    def tail(p: float) -> float:
        logs = ways + k * math.log(p) + (n - k) * math.log1p(-p)
        return float(np.exp(logs).sum())

    low, high = rejected / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) > error else (low, mid)
    return high


def risk_cutoffs(measured: DataFrame, labels: DataFrame, stratum: Column, id_col: str = "doc_id", limit: float = 0.02, error: float = 0.05) -> DataFrame:
    """Rows (stratum, rule, cutoff, n_good, bound). ``limit`` is the false rejection rate allowed for a stratum over all
    rules together, ``error`` the probability that any of the bounds fails. Of the grid points whose bound holds, the most
    lenient one is taken that still rejects 98 % of the labelled bad documents which the strictest rejects; a rule that
    rejects hardly more bad than good documents (under ten times the bound) is not used. A document with several labels
    counts as good only if all call it good. Only counts per stratum, rule and grid point come to the driver; strata must
    be few."""
    rules = ratios()
    names = list(rules)
    marks = labels.where(F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("__id")).agg((F.min("quality") > 0).alias("good"))

    # for each rule, how many grid points the value exceeds; no second Python worker beside the one that measures
    def above(name: str, value: Column) -> Column:
        return F.size(F.filter(F.array(*[F.lit(g) for g in grid(name)]), lambda g: g < value))

    base = measured.where(~F.col("base_failed")).select(F.col(id_col).alias("__id"), stratum.alias("stratum"), F.array(*[above(n, x) for n, x in rules.items()]).alias("__above"))
    cells = base.join(marks, "__id").select("stratum", "good", F.posexplode("__above").alias("rule", "above"))
    found = cells.groupBy("stratum", "good", "rule", "above").agg(F.count(F.lit(1)).alias("n")).collect()
    tally: dict = defaultdict(lambda: np.zeros(GRID_POINTS + 1, np.int64))
    for r in found:
        tally[r["stratum"], r["rule"], r["good"]][r["above"]] += r["n"]
    strata = list(dict.fromkeys(r["stratum"] for r in found))
    tests = max(1, len(strata)) * len(names)
    rows = []
    for s in strata:
        for k, name in enumerate(names):
            n_good, n_bad = int(tally[s, k, True].sum()), int(tally[s, k, False].sum())
            good, bad = (tally[s, k, g][::-1].cumsum()[::-1][1:] for g in (True, False))  # rejected at each grid point
            bounds: dict[int, float] = {}
            for i in reversed(range(GRID_POINTS)):  # fixed sequence: stop where the first bound fails
                bound = binomial_upper(int(good[i]), n_good, error / tests)
                if bound > limit / len(names):
                    break
                bounds[i] = bound
            strictest = min(bounds, default=None)
            if strictest is None or bad[strictest] < 10 * bounds[strictest] * max(1, n_bad):
                continue
            best = max(i for i in bounds if bad[i] >= 0.98 * bad[strictest])
            rows.append((s, name, float(grid(name)[best]), n_good, float(bounds[best])))
    return measured.sparkSession.createDataFrame(rows, "stratum string, rule string, cutoff double, n_good long, bound double")


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: Column) -> DataFrame:
    """``measured`` with ``kept``: false if the base rule fails or any rule of the document's stratum is above its cutoff.
    The cutoffs are at most one row per stratum and rule; they become one constant expression."""
    broken = F.lit(False)
    for c in cutoffs.collect():
        here = stratum.isNull() if c["stratum"] is None else stratum == F.lit(c["stratum"])
        broken = broken | (F.coalesce(here, F.lit(False)) & (ratios()[c["rule"]] > F.lit(c["cutoff"])))
    return with_columns(measured, {"kept": ~F.col("base_failed") & ~broken})


def size_stratum() -> Column:
    """Strata by length: short, medium and long documents behave differently under every rule."""
    return F.when(F.col("n_words") < 100, "short").when(F.col("n_words") < 1000, "medium").otherwise("long")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", limit: float = 0.02, error: float = 0.05) -> DataFrame:
    """``docs`` with the counts, ``base_failed`` and ``kept``. Documents are measured once for the cutoffs, where only counts
    meet the labels, and again for the verdict, so that no text is shuffled or stored."""
    cuts = risk_cutoffs(measure(docs, text).drop(text), labels, size_stratum(), id_col, limit, error)
    return judge(measure(docs, text), cuts, size_stratum())


def op8_quality_rules(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = stored(measure(docs).drop("text"), "quality")
    cuts = risk_cutoffs(counted, table(spark, sf_dir, "labels"), size_stratum())
    return judge(counted, cuts, size_stratum()).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
