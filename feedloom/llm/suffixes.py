"""Repeated substrings across a corpus by sampled suffixes and context hashes, in place of bucket-pointer refinement.

The dealt method, refining each bucket by the bucket identifiers of later offsets round by round, is not what runs: it
needs all suffixes, by estimate a shuffle of some twenty times the text. Only steps 1 to 3 below are done.

A byte is removed if a ``MIN_LENGTH``-byte string that covers it also starts anywhere else, in the same document or
another. Suffixes are sampled so that no such string is missed: of each ``MIN_LENGTH`` consecutive bytes, the ``Q``-gram
with the least hash starts a sampled suffix, so equal strings sample the same offset.

1. Initial buckets are the hashes of the sampled suffixes' first ``Q`` bytes; singletons are final and leave.
2. A bucket is refined by the bucket identifier of the bytes around the suffix: all ``MIN_LENGTH``-byte strings that
   can have this suffix as their sample lie in a context of fixed size. Suffixes that agree in it are done: all of their
   strings repeat, whatever the number of copies, and one of them stands for all in the next step.
3. What remains are buckets with different contexts. There every string, offset by offset, gets an identifier that is
   updated from that of the offset before, and the bucket is sorted on it; strings that meet their equal are repeated. A crowded bucket
   is refined in parts, and the strings that met no equal in their part meet in a shuffle by string.

Identifiers are 64-bit hashes, compared only inside the bucket of an earlier identifier (two independent ones decide
equality of a string). Texts pass one shuffle, contexts are carried only for step 3, and copies never meet in one task.

Edge cases: a null text is empty; texts shorter than ``MIN_LENGTH`` bytes lose nothing; overlapping repeats inside one
document count; repeated rows (same id and text) are copies of each other; an empty table gives an empty result; result
columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import released, stored, table, with_columns
from feedloom.llm.graph import by_group

MIN_LENGTH, Q = 200, 48
PART = 100_000  # contexts of a bucket that are refined together
CHUNK = 1 << 20  # bytes hashed at a time; a limit of memory, texts are covered whole
_TABLES = np.random.default_rng(20240611).integers(0, 2**64, (2, 256), dtype=np.uint64)
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_INVERSES = tuple(np.uint64(pow(int(f), -1, 2**64)) for f in _FACTORS)
_POWERS: dict[tuple[int, bool], np.ndarray] = {}
_POSITION = np.uint64((1 << 24) - 1)


def _powers(which: int, inverse: bool, n: int) -> np.ndarray:
    known = _POWERS.get((which, inverse))
    if known is None or len(known) < n:
        known = np.full(max(n, CHUNK + 4 * MIN_LENGTH), (_INVERSES if inverse else _FACTORS)[which], np.uint64)
        known[0] = 1
        _POWERS[which, inverse] = known = np.cumprod(known)
    return known[:n]


class Hasher:
    """Hashes of windows of a byte array: sum of table[byte] / factor^position, wrapping at 64 bits, then mixed."""

    def __init__(self, raw: np.ndarray, which: int = 0):
        self.up = _powers(which, False, len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_TABLES[which][raw] * _powers(which, True, len(raw)), out=self.sums[1:])

    def __call__(self, start, stop) -> np.ndarray:
        # multiplying by the factor's power undoes the position, so equal windows agree wherever they start
        h = (self.sums[stop] - self.sums[start]) * self.up[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return h


def samples(raw: np.ndarray, starts: np.ndarray, hasher: Hasher, length: int, q: int) -> np.ndarray:
    """Positions of the sampled suffixes: for every window start, the first least ``q``-gram inside the window."""
    if not len(starts):
        return starts
    n = len(raw) - q + 1
    w = length - q + 1
    grams = hasher(slice(0, n), slice(q, n + q))
    grams = (grams & ~_POSITION) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // w) * w, np.uint64(2**64 - 1))
    padded[:n] = grams
    blocks = padded.reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[starts], before[starts + w - 1]) & _POSITION
    chosen = np.zeros(n, bool)
    chosen[least.astype(np.int64)] = True
    return np.flatnonzero(chosen)


def _segments(sizes: list[int], length: int) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """Groups of (text, from, to, first window start, last window start + 1): short texts whole and together, long ones
    in stretches whose windows are disjoint and whose ends show the bytes that contexts need."""
    group, total = [], 0
    for k, n in enumerate(sizes):
        if n < length:
            continue
        for a in range(0, n - length + 1, CHUNK):
            b = min(a + CHUNK, n - length + 1)
            seg = (k, max(0, a - length), min(n, b + 2 * length), a, b)
            if group and total + seg[2] - seg[1] > CHUNK:
                yield group
                group, total = [], 0
            group.append(seg)
            total += seg[2] - seg[1]
    if group:
        yield group


def suffix_table(texts: list[bytes], length: int, q: int) -> tuple[np.ndarray, ...]:
    """(text, position, bucket, refined bucket) of every sampled suffix."""
    sizes = [len(t) for t in texts]
    out = [], [], [], []
    last: tuple[int, int] = (-1, -1)  # the furthest position given so far of the text that was cut
    for group in _segments(sizes, length):
        raw = np.frombuffer(b"".join(texts[k][a:b] for k, a, b, _, _ in group), np.uint8)
        k, frm, to, first, stop = (np.array(x, np.int64) for x in zip(*group))
        base = np.r_[0, np.cumsum(to - frm)]
        starts = np.concatenate([np.arange(o + f - a, o + s - a) for o, a, f, s in zip(base, frm, first, stop)])
        hasher = Hasher(raw)
        at = samples(raw, starts, hasher, length, q)
        seg = np.searchsorted(base, at, "right") - 1
        text, pos = k[seg], at - base[seg] + frm[seg]
        if last[0] == text[0]:  # a suffix that the stretch before has given already
            new = (text != last[0]) | (pos > last[1])
            at, seg, text, pos = at[new], seg[new], text[new], pos[new]
        if not len(at):
            continue
        left = np.minimum(pos, length - q)
        right = np.minimum(np.array(sizes, np.int64)[text] - pos, length)
        refined = hasher(at - left, at + right) + (left * (length + 1) + right).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
        for o, x in zip(out, (text, pos, hasher(at, at + q).view(np.int64), refined.view(np.int64))):
            o.append(x)
        last = (int(text[-1]), int(pos[-1]))
    return tuple(np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)


def _bytes(column: pa.Array) -> list[bytes]:
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def suffixes(keyed: DataFrame, length: int, q: int) -> DataFrame:
    """(a, b, pos, h, c): the sampled suffixes of the texts of ``keyed`` (a, b, raw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            raw = batch.column("raw")
            step = 256
            for at in range(0, len(raw), step):
                text, pos, h, c = suffix_table(_bytes(raw.slice(at, step)), length, q)
                take = pa.array(text + at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("a").take(take), batch.column("b").take(take), pa.array(pos), pa.array(h), pa.array(c)], ["a", "b", "pos", "h", "c"])

    return keyed.select("a", "b", "raw").mapInArrow(run, "a long, b long, pos long, h long, c long")


def contexts(asked: DataFrame, length: int, q: int) -> DataFrame:
    """(h, part, parts, a, b, pos, own, left, raw): the bytes around every suffix in ``asked`` (a, b, raw, wanted)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in released(batches):
            rows = []
            for a, b, raw, wanted in zip(batch["a"], batch["b"], batch["raw"], batch["wanted"]):
                for w in wanted:
                    left = min(w["pos"], length - q)
                    rows.append((w["h"], w["part"], w["parts"], a, b, w["pos"], left, w["own"], bytes(raw[w["pos"] - left : w["pos"] + length])))
            yield pd.DataFrame(rows, columns=["h", "part", "parts", "a", "b", "pos", "left", "own", "raw"])

    return asked.mapInPandas(run, "h long, part int, parts int, a long, b long, pos long, left int, own boolean, raw binary")


def _refine(length: int, q: int):
    most = length - q  # the largest offset of a string before its sample

    def string_ids(columns: np.ndarray) -> Iterator[np.ndarray]:
        """Identifiers of the strings that begin 0, 1, … bytes before the sample, from one to the next."""
        values = [(_TABLES[w], _FACTORS[w], np.uint64(pow(int(_FACTORS[w]), length - 1, 2**64))) for w in (0, 1)]
        h = [np.zeros(columns.shape[1], np.uint64) for _ in values]
        for col in columns[most:][::-1]:
            for k, (value, factor, _) in enumerate(values):
                h[k] = h[k] * factor + value[col]
        yield h
        for j in range(1, most + 1):
            first, gone = columns[most - j], columns[most - j + length]
            for k, (value, factor, top) in enumerate(values):
                h[k] = (h[k] - value[gone] * top) * factor + value[first]
            yield h

    def work(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        n = len(frame)
        a, b, pos, left, own = (frame[c].to_numpy() for c in ("a", "b", "pos", "left", "own"))
        several = frame["parts"].to_numpy() > 1
        columns = np.zeros((most + length, n), np.uint8)  # the sample begins in row ``most``
        size = np.zeros(n, np.int64)
        for k, raw in enumerate(frame["raw"]):
            columns[most - left[k] : most - left[k] + len(raw), k] = np.frombuffer(raw, np.uint8)
            size[k] = len(raw)
        group = np.repeat(np.arange(len(starts), dtype=np.uint64), np.diff(np.r_[starts, n])) * np.uint64(0x9E3779B97F4A7C15)
        met = np.zeros((most + 2, n), bool)  # by offset, with an empty row at the end
        pending = []
        for j, (x, y) in enumerate(string_ids(columns)):
            there = np.flatnonzero((left >= j) & (size - left >= length - j))
            if not len(there):
                continue
            key = (x + group)[there]
            order = np.argsort(key)
            key, at = key[order], there[order]
            same = np.r_[False, (key[1:] == key[:-1]) & (y[at][1:] == y[at][:-1])]
            hit = same | np.r_[same[1:], False]
            met[j, at[hit]] = True
            keep = several[at] & ~same  # one of each string of this part, to meet the other parts
            if keep.any():
                k = at[keep]
                pending.append(pd.DataFrame({
                    "x": x[k].view(np.int64), "y": y[k].view(np.int64), "a": a[k], "b": b[k], "start": pos[k] - j, "stop": pos[k] - j + length,
                    "open": True, "done": hit[keep] | ~own[k]}))
        # runs of offsets whose strings are repeated become one span
        met &= own
        row, last = np.nonzero((met[:-1] & ~met[1:]).T)
        row_, first = np.nonzero((met & ~np.vstack([np.zeros((1, n), bool), met[:-1]])).T)
        spans = pd.DataFrame({"x": 0, "y": 0, "a": a[row], "b": b[row], "start": pos[row] - last, "stop": pos[row] - first + length, "open": False, "done": True})
        return pd.concat([spans, *pending], ignore_index=True)

    return work


def repeated_spans(keyed: DataFrame, length: int = MIN_LENGTH, q: int = Q, part: int = PART) -> DataFrame:
    """(a, b, start, stop): byte ranges whose union is what repeats. ``keyed``: (a, b, raw), one key per row."""
    table_ = stored(suffixes(keyed, length, q), "suffixes")
    crowd = table_.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).where("n > 1")
    crowd = stored(crowd.select("h", (F.col("low") != F.col("high")).alias("open")), "buckets")
    left = stored(table_.join(crowd, "h").withColumn("o", F.xxhash64("a", "b", "pos")), "bucketed")
    same = stored(left.groupBy("h", "c").agg(F.count(F.lit(1)).alias("m"), F.min("o").alias("first")), "refined")
    known = left.join(same, ["h", "c"])
    done = known.where("m > 1").select("a", "b", F.greatest(F.col("pos") - (length - q), F.lit(0)).alias("start"), (F.col("pos") + length).alias("stop"))
    wanted = known.where("open and (m = 1 or o = first)")
    crowded = same.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts")).where("parts > 1")
    wanted = wanted.join(crowded, "h", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    wanted = wanted.withColumn("part", F.pmod(F.xxhash64("o"), F.col("parts")).cast("int"))
    asked = wanted.groupBy("a", "b").agg(F.collect_list(F.struct("pos", "h", "part", "parts", (F.col("m") == 1).alias("own"))).alias("wanted"))
    around = contexts(keyed.join(asked.hint("shuffle_hash"), ["a", "b"]).select("a", "b", "raw", "wanted"), length, q)
    grouped = around.withColumn("group", F.struct("h", "part")).withColumn("side", F.lit(0)).drop("h", "part")
    found = stored(by_group(grouped, _refine(length, q), "x long, y long, a long, b long, start long, stop long, open boolean, done boolean"), "strings")
    across = found.where("open").groupBy("x", "y").agg(F.collect_set(F.struct("a", "b", "start", "stop")).alias("at"), F.collect_set(F.when(~F.col("done"), F.struct("a", "b", "start", "stop"))).alias("need"))
    across = across.where(F.size("at") > 1).select(F.explode("need").alias("s")).select("s.a", "s.b", "s.start", "s.stop")
    near = found.where("not open").select("a", "b", "start", "stop").unionByName(across)
    return done.unionByName(near)


def with_key(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.withColumns({"__a": F.coalesce(F.xxhash64(id_col), F.lit(0)), "__b": F.xxhash64(raw), "__raw": raw})


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = MIN_LENGTH, q: int = Q, whole_characters: bool = False) -> DataFrame:
    """``docs`` with ``kept_bytes`` (what remains), ``n_bytes``, ``n_removed`` and ``n_spans``. With ``whole_characters`` a
    character that the border of a span splits goes with it, so that what remains is UTF-8."""

    @F.pandas_udf("kept binary, bytes long, removed long, spans long")
    def cut(raws: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.DataFrame:
        rows = []
        for raw, start, stop in zip(raws, starts, stops):
            n = len(raw)
            if start is None or not len(start):
                rows.append((raw, n, 0, 0))
                continue
            order = np.argsort(start, kind="stable")
            start, stop = np.asarray(start)[order], np.minimum(np.maximum.accumulate(np.asarray(stop)[order]), n)
            first = np.flatnonzero(np.r_[True, start[1:] > stop[:-1]])
            begin, end = start[first], stop[np.r_[first[1:] - 1, len(start) - 1]]
            pieces, at = [], 0
            for s, e in zip(begin.tolist(), end.tolist()):
                if whole_characters:
                    while 0 < s < n and raw[s] & 0xC0 == 0x80:
                        s -= 1
                    while e < n and raw[e] & 0xC0 == 0x80:
                        e += 1
                pieces.append(raw[at:s])
                at = e
            pieces.append(raw[at:])
            rows.append((b"".join(pieces), n, int((end - begin).sum()), len(begin)))
        return pd.DataFrame(rows, columns=["kept", "bytes", "removed", "spans"])

    keyed = with_key(docs, id_col, text)
    spans = repeated_spans(keyed.select(F.col("__a").alias("a"), F.col("__b").alias("b"), F.col("__raw").alias("raw")), length, q)
    spans = stored(spans.groupBy("a", "b").agg(F.collect_list("start").alias("__start"), F.collect_list("stop").alias("__stop")), "spans")
    joined = keyed.join(spans.withColumnsRenamed({"a": "__a", "b": "__b"}).hint("shuffle_hash"), ["__a", "__b"], "left")
    done = joined.withColumn("__c", cut("__raw", "__start", "__stop"))
    new = {"kept_bytes": F.col("__c.kept"), "n_bytes": F.col("__c.bytes"), "n_removed": F.col("__c.removed"), "n_spans": F.col("__c.spans")}
    return done.select(*[c for c in docs.columns if c not in new], *[v.alias(k) for k, v in new.items()])


def op10_suffix_array(spark, sf_dir) -> DataFrame:
    docs = drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))
