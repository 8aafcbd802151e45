"""Language-model scoring by prediction by partial matching.

A text is the sequence of its lower-cased words, each followed by a space, then an end mark; the model predicts its bytes.
The trie of byte contexts up to ``ORDER`` bytes is a set of tables: how often each (context, byte) occurs in the training
documents, at every order. A byte that its longest context has seen gets count / (occurrences + distinct bytes); otherwise
the escape share (distinct / (occurrences + distinct)) is paid and the next shorter context is asked, with the bytes that
the longer one has seen excluded from its counts; below order 0 all bytes left are equal. The score of a document is the
log10 probability of its bytes under this pretrained model, whose tables grow with the corpus and are never broadcast
(only those of at most 65,536 rows, bounded by the alphabet, are).
A context holds up to 5 bytes, so that a window packs into one integer.

Documents are dealt into batches of about ``BATCH_BYTES``. A batch gathers its distinct windows (context and byte) and
words once; these meet the corpus counts in shuffles and come back to the batch, where the documents are scored. So the
shuffles carry distinct windows and words per batch, not occurrences. Texts that are alike should share batches: the
caller may give a column (a language, say) that is equal for such texts; it changes no result.

Edge cases: a null or empty text is the end mark alone; without training documents every byte has probability 1/256;
repeated rows are scored each on its own; words are identified by their 64-bit hash; result columns replace input columns
of the same name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import fold, released, stored, table, text_bytes

ORDER = 5
BATCH_BYTES = 10 << 20
GROUPS = 64  # at most so many groups of texts that share batches
END = b"\n"
CHUNK = 1 << 20  # bytes windowed at a time; whole documents, memory only
WINDOW, WORD = 0, 1


def sequence(text: str | None) -> bytes:
    words = text_bytes(text).lower().split()
    return b" ".join(words) + b" " + END if words else END


def windows(seqs: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed (context, byte) windows of all positions, and where each sequence begins."""
    pad = END * order
    joined = np.frombuffer(pad + pad.join(seqs), np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, seqs), np.int64, len(seqs))
    n = len(joined) - order
    packed = np.zeros(n, np.int64)
    for k in range(order + 1):
        packed = (packed << 8) | joined[k : k + n]
    starts = np.cumsum(sizes + order) - sizes - order
    real = np.ones(n, bool)
    for k in range(order):  # positions that lie in the padding between two sequences
        real[starts[1:] - 1 - k] = False
    return packed[real], np.cumsum(sizes) - sizes


def chunks(seqs: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    at, total = 0, 0
    for k, s in enumerate(seqs):
        if total and total + len(s) > most:
            yield at, k
            at, total = k, 0
        total += len(s)
    if at < len(seqs):
        yield at, len(seqs)


def word_keys(words) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(w) for w in words), np.uint64).view(np.int64)


def _unpacked(column) -> list[bytes]:
    import zstandard

    d = zstandard.ZstdDecompressor()
    return [d.decompress(z) for z in column]


def _gather(order: int):
    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        """Distinct windows and words of a batch with their counts in its training documents."""
        seqs, train = _unpacked(frame["z"]), frame["train"].to_numpy()
        seen, trained, counts = [], [], []
        words: Counter = Counter()
        every: set[bytes] = set()
        for a, b in chunks(seqs):
            for part, use in (([s for s, t in zip(seqs[a:b], train[a:b]) if t], True), ([s for s, t in zip(seqs[a:b], train[a:b]) if not t], False)):
                if not part:
                    continue
                packed, _ = windows(part, order)
                values, n = np.unique(packed, return_counts=True)
                seen.append(values)
                if use:
                    trained.append(values)
                    counts.append(n)
                    for s in part:
                        words.update(s.split())
                    words[END] += len(part)
                else:
                    for s in part:
                        every.update(s.split())
                    every.add(END)
        seen = np.unique(np.concatenate(seen))
        n = np.zeros(len(seen), np.int64)
        if trained:
            np.add.at(n, np.searchsorted(seen, np.concatenate(trained)), np.concatenate(counts))
        for w in every:
            if w not in words:
                words[w] = 0
        kinds = np.repeat(np.array([WINDOW, WORD], np.int32), [len(seen), len(words)])
        return pd.DataFrame({
            "batch": int(frame["batch"].iloc[0]), "kind": kinds, "key": np.concatenate([seen, word_keys(words)]),
            "n": np.concatenate([n, np.fromiter(words.values(), np.int64, len(words))]),
        })

    return gather


def _score(order: int):
    def score(docs: pd.DataFrame, tables: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame(columns=["row", "n_tokens", "n_known", "counted", "score"])
        seqs = _unpacked(docs["z"])
        kind = tables["kind"].to_numpy()
        keys, n, value = (tables[c].to_numpy() for c in ("key", "n", "value"))
        w = np.flatnonzero(kind == WINDOW)
        w = w[np.argsort(keys[w])]
        window, logs = keys[w], value[w].astype(np.float64)
        w = np.flatnonzero(kind == WORD)
        w = w[np.argsort(keys[w])]
        word, count = keys[w], n[w]
        del tables, keys, n, value, w, kind
        number: dict[bytes, int] = {}
        tokens = []
        for s in seqs:
            mine = s.split()
            mine.append(END)
            tokens.append([number.setdefault(t, len(number)) for t in mine])
        c = count[np.searchsorted(word, word_keys(number))]
        log_c, known = np.log10(c + 1), c > 0
        out = np.zeros(len(seqs))
        for a, b in chunks(seqs):
            packed, starts = windows(seqs[a:b], order)
            values_, inverse = _inverse(packed, order)
            out[a:b] = np.add.reduceat(logs[np.searchsorted(window, values_)][inverse], starts)
        return pd.DataFrame({
            "row": docs["row"].to_numpy(), "n_tokens": [len(t) for t in tokens], "n_known": [int(known[t].sum()) for t in tokens],
            "counted": [float(log_c[t].sum()) for t in tokens], "score": out,
        })

    return score


_NUMBERS: list[np.ndarray] = []


def _dense(values: np.ndarray) -> np.ndarray:
    """Small numbers for 24-bit values, the same throughout a worker."""
    if not _NUMBERS:
        _NUMBERS.extend((np.full(1 << 24, -1, np.int32), np.zeros(1, np.int64)))
    number, used = _NUMBERS
    out = number[values]
    if (out < 0).any():
        new = np.unique(values[out < 0])
        number[new] = np.arange(used[0], used[0] + len(new))
        used += len(new)
        out = number[values]
    return out.astype(np.int64)


def _inverse(packed: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows and the number of each position's window. Window numbers and positions are sorted as one integer,
    which is much faster than sorting positions by window."""
    room = max(1, len(packed).bit_length())
    small = packed
    if order > 2:
        small = _dense(packed >> 24) << 24 | packed & 0xFFFFFF
    if int(small.max()).bit_length() + room > 63:
        return np.unique(packed, return_inverse=True)
    both = np.sort(small << room | np.arange(len(packed)))
    value, position = both >> room, both & ((1 << room) - 1)
    first = np.r_[True, value[1:] != value[:-1]]
    inverse = np.empty(len(packed), np.int64)
    inverse[position] = np.cumsum(first) - 1
    return packed[position[first]], inverse


def low(column: Column, n_bytes: int) -> Column:
    return column.bitwiseAND(F.lit((1 << 8 * n_bytes) - 1))


def window_scores(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, value): log10 probability of the byte of every window, from ``counts`` (key, n: training occurrences)."""
    seen = counts.where("n > 0").select("key", "n")
    entries, contexts = [], []
    for j in range(order + 1):  # entries: (w, c); contexts: (u, n, d, e), e: counts of u's bytes in the next shorter context
        e = stored(seen.groupBy(low(F.col("key"), j + 1).alias("w")).agg(F.sum("n").alias("c")), f"order{j}")
        u = e.withColumn("u", F.shiftright("w", 8))
        if j:
            shorter = entries[j - 1].select(F.col("w").alias("v"), F.col("c").alias("c_"))
            u = u.withColumn("v", low(F.col("w"), j)).join(F.broadcast(shorter) if j <= 2 else shorter, "v")
        else:
            u = u.withColumn("c_", F.lit(0).cast("long"))
        contexts.append(stored(u.groupBy("u").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("d"), F.sum("c_").alias("e")), f"contexts{j}"))
        entries.append(e)
    q = counts.select("key", F.col("n").alias(f"c{order}"), F.shiftright("key", 8).alias("u"))
    top = contexts[order].select("u", F.col("n").alias("n_"), F.col("d").alias("d_"))
    known = q.where(F.col(f"c{order}") > 0).join(top, "u").select("key", F.log10(F.col(f"c{order}") / (F.col("n_") + F.col("d_"))).alias("value"))
    # windows that no training document has: walk down the orders
    x = q.where(F.col(f"c{order}") == 0).select("key")
    for j in range(order, -1, -1):
        small = j <= 2  # at most 256^j contexts and 256^(j+1) entries; broadcast up to 65,536 rows
        u = contexts[j].select(F.col("u").alias("u_"), F.col("n").alias(f"n{j}"), F.col("d").alias(f"d{j}"), F.col("e").alias(f"e{j}"))
        x = x.withColumn("u_", low(F.shiftright("key", 8), j)).join(F.broadcast(u) if small else u, "u_", "left").drop("u_")
        if j < order:
            w = entries[j].select(F.col("w").alias("w_"), F.col("c").alias(f"c{j}"))
            x = x.withColumn("w_", low(F.col("key"), j + 1)).join(F.broadcast(w) if j <= 1 else w, "w_", "left").drop("w_")
    total, open_ = F.lit(0.0), F.lit(True)
    used = F.lit(0)  # bytes excluded so far; their counts in the context that is asked
    gone = F.lit(0)
    for j in range(order, -1, -1):
        there = F.col(f"n{j}").isNotNull()
        n, d = F.col(f"n{j}") - gone, F.col(f"d{j}") - used
        hit = F.col(f"c{j}").isNotNull() if j < order else F.lit(False)
        asked = open_ & there & (d > 0)
        gain = F.when(hit, F.log10(F.col(f"c{j}") / (n + d)) if j < order else F.lit(0.0)).otherwise(F.log10(d / (n + d)))
        total = total + F.when(asked, gain).otherwise(0.0)
        open_ = open_ & ~(asked & hit)
        used = F.when(there, F.col(f"d{j}")).otherwise(F.lit(0))
        gone = F.when(there, F.col(f"e{j}")).otherwise(F.lit(0))
    total = total + F.when(open_, -F.log10(F.greatest(F.lit(256) - used, F.lit(1)).cast("double"))).otherwise(0.0)
    return known.unionByName(x.select("key", total.alias("value")))


def score_texts(docs: DataFrame, train: Column, text: str = "text", order: int = ORDER, batch_bytes: int = BATCH_BYTES, alike: Column | None = None) -> DataFrame:
    """``docs`` without its text, with n_tokens, n_known, train_tokens, base_score and score. ``train``: which rows teach;
    ``alike``: equal for texts that should share batches."""

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for texts in released(batches):
            yield pd.Series([z.compress(sequence(t)) for t in texts], dtype=object)

    group = F.pmod(F.xxhash64(alike if alike is not None else F.lit(0)), F.lit(GROUPS)).cast("int")
    sizes = docs.groupBy(group.alias("g")).agg(F.sum(F.octet_length(text)).alias("b")).collect()  # at most GROUPS rows
    first, many, batches = {}, {}, 0
    for r in sorted(sizes, key=lambda r: r["g"]):
        first[r["g"]], many[r["g"]] = batches, max(1, math.ceil((r["b"] or 0) / batch_bytes))
        batches += many[r["g"]]
    from_, count = (F.coalesce(F.get(F.array(*[F.lit(x.get(g, d)) for g in range(GROUPS)]), group), F.lit(d)) for x, d in ((first, 0), (many, 1)))
    results = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    others = [c for c in docs.columns if c != text and c not in results]
    batch = (from_ + F.pmod(F.xxhash64(text, *others), count)).cast("int")
    rows = docs.select(F.struct(*others).alias("row"), F.coalesce(train, F.lit(False)).alias("train"), batch.alias("batch"), packed(F.col(text)).alias("z"))
    gathered = rows.select("batch", "train", "z").groupBy("batch").applyInPandas(_gather(order), "batch int, kind int, key long, n int")
    corpus = stored(gathered.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.collect_list("batch").alias("batches")), "corpus")
    word = corpus.where(F.col("kind") == WORD)
    totals = word.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count_if(F.col("n") > 0).alias("types")).first()
    scores = window_scores(corpus.where(F.col("kind") == WINDOW).select("key", "n"), order)
    zero = F.lit(0)
    back = corpus.where(F.col("kind") == WINDOW).join(scores, "key").select("kind", "key", zero.cast("long").alias("n"), F.col("value").cast("float").alias("value"), "batches")
    back = back.unionByName(word.select("kind", "key", "n", zero.cast("float").alias("value"), "batches"))
    back = back.select(F.explode("batches").alias("batch"), "kind", "key", "n", "value")
    schema = f"row {rows.schema['row'].dataType.simpleString()}, n_tokens long, n_known long, counted double, score double"
    scored = rows.select("batch", "row", "z").groupBy("batch").cogroup(back.groupBy("batch")).applyInPandas(_score(order), schema)
    base = F.col("counted") - F.col("n_tokens") * F.lit(math.log10(totals["tokens"] + totals["types"] + 1))
    return scored.select("row.*", "n_tokens", "n_known", F.lit(totals["tokens"]).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op5_ppm(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold(F.col("doc_id"), 7) == 2
    out = score_texts(docs.withColumn("held_out", held), ~held, alike=F.col("lang"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
