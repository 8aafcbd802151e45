"""Stored full-text index: positional posting lists in blocks of documents, with a score bound for each block.

A block holds the documents (4,096) that follow each other in one task of the build; the task inverts it in memory, in
pieces of up to 1,000,000 tokens however long the texts are, so only finished posting rows are shuffled. A posting row is one
(group, block, piece), where a group is the terms of one hash (32 groups a folder): the terms, and one after the other their
documents as delta-coded numbers, occurrences by field, delta-coded positions, and the highest score that each term reaches in
a document of the piece. Rows of single terms would be fifty times as many, and their sort and their files were most of the
build. Numbers are bytes of 7 bits, low ones first. Rows lie in folders by the hash, sorted by group, so a query opens the
folders of its words and skips the pages of other groups. One directory row for each piece names its documents. A frequent
term's rows are spread over files by block. Texts are lower-cased by Spark and split by Arrow.

Terms of a query meet block by block (a group holds the rows of its words in one block, whatever the table's size): words and OR
groups by document numbers, phrases by merging positions. ``top`` finds the best k by score * factor without scoring all
blocks: it scores the blocks with the highest bounds, takes the k-th score as a floor and scores only those other blocks
whose bound reaches it.

Documents are added batch by batch (``append``); a later batch replaces earlier versions of an id. Edge cases: null
fields have no tokens; an id without any token is known and matches nothing; rows of one batch must have distinct ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions import scores as sc
from feedloom.functions import text as tx
from feedloom.operators import text_match as tm

BITS = 12  # of a document's number inside its block
TOKENS = 1_000_000  # that a task inverts at once
BATCH = 39  # bits of a block number below the batch: 2^18 tasks of 2^33 rows; 4,095 batches before a rebuild
DIRECTORY = -1  # bucket of the directory rows
PARTS = 32  # groups of terms in a folder
WARM = 8  # blocks that give the first floor
SCHEMA = (
    "bucket int, part int, block long, terms string, bounds array<double>, sizes binary, docs binary, counts binary, "
    "places array<bigint>, numbers array<int>, ids array<string>, chars array<int>"
)
SEPARATOR = r"[^\p{L}\p{N}]+"


def _coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends of the values in them): 7 bits a byte, low ones first, the high bit set in all but the last."""
    high = values >> 7
    more = np.flatnonzero(high)
    if not len(more):
        return values.astype(np.uint8), np.arange(len(values) + 1)
    size, rest = np.ones(len(values), np.int64), high[more]
    at = more
    while len(at):
        size[at] += 1
        rest = rest >> 7
        at, rest = at[rest > 0], rest[rest > 0]
    ends = np.r_[0, np.cumsum(size)]
    out = np.empty(ends[-1], np.uint8)
    out[ends[:-1]] = (values & 127) | ((high > 0) << 7)
    at, rest = ends[more] + 1, high[more]
    while len(at):
        high = rest >> 7
        out[at] = (rest & 127) | ((high > 0) << 7)
        at, rest = at[high > 0] + 1, high[high > 0]
    return out, ends


def _numbers(coded: np.ndarray) -> np.ndarray:
    """The values that ``_coded`` wrote."""
    last = coded < 128
    start = np.r_[0, np.flatnonzero(last)[:-1] + 1] if len(coded) else np.zeros(0, int)
    place = np.arange(len(coded)) - np.repeat(start, np.diff(np.r_[start, len(coded)]))
    return np.add.reduceat((coded & 127).astype(np.int64) << 7 * place, start) if len(coded) else np.zeros(0, np.int64)


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One string of bytes for each run of values."""
    data, at = _coded(values)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(at[ends].astype(np.int32)), pa.py_buffer(data)])


def _words(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The same as lists of words of eight bytes, filled up with zeros."""
    data, at = _coded(values)
    size = np.diff(at[ends])
    words = np.r_[0, np.cumsum(-(-size // 8))]
    out = np.zeros(words[-1] * 8, np.uint8)
    out[np.arange(len(data)) + np.repeat(words[:-1] * 8 - at[ends][:-1], size)] = data
    return pa.ListArray.from_arrays(pa.array(words, pa.int32()), pa.array(out.view(np.int64)))


def _split(texts: pa.Array) -> pa.ListArray:
    """The tokens of lower-cased texts, as ``text.tokens`` finds them."""
    lists = pc.split_pattern_regex(texts, SEPARATOR)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)  # the ends of a text that begins or ends with a separator are empty
    ends = np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))]
    return pa.ListArray.from_arrays(pa.array(ends[offsets - offsets[0]], pa.int32()), flat.filter(full))


def _tokenised(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches with lists of tokens in place of texts, ``rows`` texts at a time."""
    for b in batches:
        for start in range(0, b.num_rows, rows):
            part = b.slice(start, rows)
            yield pa.RecordBatch.from_arrays([_split(x) if pa.types.is_string(x.type) and name != "id" else x for name, x in zip(part.schema.names, part.columns)], part.schema.names)


def _ends(of: np.ndarray, groups: int) -> np.ndarray:
    """Ends of runs of equal, ascending group numbers."""
    return np.r_[0, np.cumsum(np.bincount(of, minlength=groups))]


def _part(term: bytes, buckets: int) -> int:
    """The group of a term; its folder is this number modulo ``buckets``."""
    return zlib.crc32(term) % (buckets * PARTS)


def _pieces(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[pa.Table]:
    """Runs of rows of one block that hold up to ``tokens`` tokens, or one document more than that."""
    kept: list[pa.RecordBatch] = []
    held, last = 0, None
    for b in batches:
        block = b.column(0).to_pylist()
        size = sum(np.diff(lists.offsets.to_numpy()) for lists in b.columns if pa.types.is_list(lists.type)).tolist()
        start = 0
        for k, (at, n) in enumerate(zip(block, size)):
            if last is not None and (at != last or held + n > tokens):
                if start < k:
                    kept.append(b.slice(start, k - start))
                yield pa.Table.from_batches(kept)
                kept, held, start = [], 0, k
            last = at
            held += n
        if start < len(block):
            kept.append(b.slice(start))
    if kept:
        yield pa.Table.from_batches(kept)


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, place before) in ascending order, equal keys as they came; plain numbers sort several times faster than places."""
    bits = len(key).bit_length()
    if int(key.max(initial=0)) >> 63 - bits:
        order = np.argsort(key, kind="stable")
        return key[order], order
    both = np.sort((key << bits) | np.arange(len(key)))
    return both >> bits, both & (1 << bits) - 1


def _inverted(block: pa.Table, weights: list[float], buckets: int) -> pa.RecordBatch:
    """Posting rows and the directory row of documents of one block (columns block, local, id, chars, one list of tokens per field)."""
    local = block["local"].to_numpy()
    fields = len(weights)
    terms, at, place = [], [], []
    for f in range(fields):
        lists = block[f"f{f}"].combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        terms.append(lists.flatten())
        at.append(np.repeat(np.arange(len(local)) * fields + f, size))
        place.append(np.arange(size.sum(), dtype=np.int32) - np.repeat((np.cumsum(size) - size).astype(np.int32), size))
    coded = pa.concat_arrays(terms).dictionary_encode()
    del terms
    words, n = coded.dictionary, len(coded.dictionary)
    part = np.array([_part(w, buckets) for w in words.cast(pa.binary()).to_pylist()], np.int64)
    by_part = np.argsort(part, kind="stable")
    part, rank = part[by_part], np.empty(n, np.int64)
    rank[by_part] = np.arange(n)
    # one number for term, document and field; places of equal ones already follow each other
    key, order = _sorted(rank[coded.indices.to_numpy()] * (len(local) * fields) + np.concatenate(at))
    step = np.concatenate(place)[order]
    run = np.flatnonzero(np.r_[True, np.diff(key) != 0]) if len(key) else np.zeros(0, int)
    starts, occurs = step[run], np.diff(np.r_[run, len(key)])
    step[1:] -= step[:-1].copy()
    step[run] = starts
    pair = key[run] // fields
    new = np.r_[True, np.diff(pair) != 0] if len(pair) else np.zeros(0, bool)
    entry = np.flatnonzero(new)
    counts = np.zeros((len(entry), fields), np.int64)
    counts[np.cumsum(new) - 1, key[run] % fields] = occurs
    logs = np.r_[0, 1 + np.log(np.arange(1, counts.max(initial=0) + 1))]
    score = logs[counts] @ np.array(weights)
    owner, number = pair[entry] // max(len(local), 1), local[pair[entry] % max(len(local), 1)]
    first = np.flatnonzero(np.r_[True, np.diff(owner) != 0]) if len(owner) else entry
    delta = number.copy()
    delta[1:] -= number[:-1]
    delta[first] = number[first]
    bound = np.maximum.reduceat(score, first) if n else np.zeros(0)
    # runs of terms of one group, and where their documents and places end
    head = np.flatnonzero(np.r_[True, np.diff(part) != 0]) if n else np.zeros(0, int)
    term_ends = np.r_[head, n]
    doc_ends = np.r_[first, len(owner)][term_ends]
    place_ends = np.r_[0, np.cumsum(counts.sum(axis=1))][doc_ends]
    rows, offsets, blocks = len(head), pa.array(term_ends, pa.int32()), block["block"][0].as_py()
    postings = [
        pa.array(part[head] % buckets, pa.int32()), pa.array(part[head], pa.int32()), pa.array(np.full(rows, blocks)),
        pc.binary_join(pa.ListArray.from_arrays(offsets, words.take(pa.array(by_part))), " "), pa.ListArray.from_arrays(offsets, pa.array(bound)),
        _binary(np.diff(np.r_[first, len(owner)]), term_ends), _binary(delta, doc_ends), _binary(counts.ravel(), doc_ends * fields), _words(step, place_ends),
        pa.nulls(rows, pa.list_(pa.int32())), pa.nulls(rows, pa.list_(pa.string())), pa.nulls(rows, pa.list_(pa.int32())),
    ]
    empty = pa.nulls(1, pa.binary())
    names = pa.array([block["id"].to_pylist()], pa.list_(pa.string()))
    directory = [
        pa.array([DIRECTORY], pa.int32()), pa.nulls(1, pa.int32()), pa.array([blocks]), pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.float64())), empty, empty, empty,
        pa.nulls(1, pa.list_(pa.int64())), pa.array([local.tolist()], pa.list_(pa.int32())), names, pa.array([block["chars"].to_pylist()], pa.list_(pa.int32())),
    ]
    columns = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(postings, directory)], columns)


@dataclass(frozen=True)
class Query:
    """One query string, split on the driver."""

    groups: list
    phrases: list
    excluded: list
    words: list  # distinct words of the rank
    sequence: list  # the whole query as one phrase

    @classmethod
    def of(cls, q: str) -> Query:
        w, sequence = tm.web_query(q), tx.text_terms(q)
        return cls(w["groups"], w["phrases"], w["excluded"], list(dict.fromkeys(sequence)), sequence)

    @property
    def terms(self) -> list[str]:
        return list(dict.fromkeys([*self.words, *self.excluded, *(t for g in [*self.groups, *self.phrases] for t in g)]))


def _held(row: dict, terms: list[str], fields: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(term, documents, counts, position steps) of those ``terms`` that a posting row holds."""
    held = row["terms"].split(" ")
    docs, counts, ends = (_numbers(np.frombuffer(row[c], np.uint8)) for c in ("docs", "counts", "sizes"))
    counts, ends = counts.reshape(-1, fields), np.r_[0, np.cumsum(ends)]
    places = np.r_[0, np.cumsum(counts.sum(axis=1))][ends]
    steps = _numbers(np.array(row["places"], np.int64).view(np.uint8))
    for t in terms:
        if t in held:
            k = held.index(t)
            a, b = ends[k], ends[k + 1]
            yield t, np.cumsum(docs[a:b]), counts[a:b], steps[places[k] : places[k + 1]]


def _decoded(rows: list[tuple], fields: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(occurrences by document of the block and field, ascending keys document | field | position) of one term."""
    tf, keys = np.zeros((block, fields), np.int64), []
    for docs, counts, steps in rows:
        tf[docs] = counts
        size = counts.ravel()[counts.ravel() > 0]
        start = np.cumsum(size) - size
        total = np.cumsum(steps)
        place = total - np.repeat(total[start] - steps[start], size)
        at = np.repeat(docs, fields).reshape(-1, fields) * fields + np.arange(fields)
        keys.append((np.repeat(at.ravel()[counts.ravel() > 0], size).astype(np.int64) << 32) | place)
    return tf, np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)


def _merged(rows: list[dict], q: Query, weights: list[float], block: int) -> tuple[np.ndarray, ...]:
    """(numbers of the block's documents with any word, whether all words and phrases, whether any word, score)."""
    fields = len(weights)
    by: dict[str, list[tuple]] = {}
    for r in rows:
        for t, *found in _held(r, q.terms, fields):
            by.setdefault(t, []).append(found)
    held = {t: _decoded(by.get(t, []), fields, block) for t in q.terms}
    has = {t: tf.any(axis=1) for t, (tf, _) in held.items()}

    def phrase(terms: list[str]) -> np.ndarray:
        """Fields of each document that hold the words one after the other."""
        keys = reduce(np.intersect1d, [held[t][1] - k for k, t in enumerate(terms)])
        out = np.zeros(block * fields, bool)
        out[np.unique(keys >> 32)] = True
        return out.reshape(block, fields)

    every = np.full(block, bool(q.groups or q.phrases))
    for group in q.groups:
        every &= np.logical_or.reduce([has[t] for t in group])
    for p in q.phrases:
        every &= phrase(p).any(axis=1)
    for t in q.excluded:
        every &= ~has[t]
    some = np.logical_or.reduce([has[t] for t in q.words]) if q.words else np.zeros(block, bool)
    score = np.zeros(block)
    whole = phrase(q.sequence) if q.sequence else np.zeros((block, fields), bool)
    for f, w in enumerate(weights):
        for t in q.words:
            tf = held[t][0][:, f]
            score += np.where(tf > 0, w * (1 + np.log(np.maximum(tf, 1))), 0)
        score += np.where(whole[:, f], tm.PHRASE_WEIGHT * w, 0)
    at = np.flatnonzero(every | some)
    return at, every[at], some[at], score[at]


@dataclass(frozen=True)
class TextIndex:
    spark: SparkSession
    path: str
    buckets: int = 64
    weights: dict = field(default_factory=lambda: dict(tm.FIELD_WEIGHTS))
    bits: int = BITS
    tokens: int = TOKENS

    # ---- writing ----

    def append(self, items: DataFrame, batch: int = 0, spread: int = 4) -> TextIndex:
        """Add ``items`` (id and the weighted fields). ``batch`` numbers the calls; a repeated call with the same number
        replaces what it wrote before, so a job that failed half way is run again as it is."""
        weights, buckets, bits = list(self.weights.values()), self.buckets, self.bits
        order = items.select(F.col("id").cast("string").alias("id"), *self.weights).sortWithinPartitions("id")
        at = F.monotonically_increasing_id()
        rows = order.select("id", at.alias("at"), F.length(F.coalesce("content", F.lit(""))).alias("chars"), *[tx.token_text(F.col(f)).alias(f"f{k}") for k, f in enumerate(self.weights)])
        rows = rows.select((F.shiftright("at", bits) + F.lit(batch << BATCH + BITS - bits)).alias("block"), F.col("at").bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("local"), "id", "chars", *[f"f{k}" for k in range(len(weights))])

        tokens = self.tokens

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in _pieces(_tokenised(batches), tokens):
                yield _inverted(piece, weights, buckets)

        out = rows.mapInArrow(run, SCHEMA).repartition(F.col("bucket"), F.pmod(F.xxhash64("block"), F.lit(spread)))
        # the folder of the batch is named here: a column for it would have the writer sort all rows again
        out.sortWithinPartitions("bucket", "part", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={batch}")
        return self

    # ---- reading ----

    def _read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA.replace("bucket int, ", "") + ", batch int, bucket int").parquet(self.path)

    def documents(self) -> DataFrame:
        """(ord, block, id, chars) of the newest version of each document."""
        rows = self._read().where(F.col("bucket") == DIRECTORY)
        each = rows.select("block", F.explode(F.arrays_zip("numbers", "ids", "chars")).alias("d"))
        each = each.select((F.shiftleft("block", self.bits) + F.col("d.numbers")).alias("ord"), F.col("d.ids").alias("id"), F.col("d.chars").alias("chars"))
        newest = each.groupBy("id").agg(F.max(F.struct("ord", "chars")).alias("m"))
        return newest.select("m.ord", F.shiftright("m.ord", self.bits).alias("block"), "id", "m.chars")

    def postings(self, q: Query) -> DataFrame:
        """Posting rows that hold words of the query; they hold other words of the same groups too."""
        parts = sorted({_part(t.encode("utf-8", "surrogatepass"), self.buckets) for t in q.terms})
        rows = self._read().where(F.col("bucket").isin({p % self.buckets for p in parts}) & F.col("part").isin(parts))
        words = F.array(*map(F.lit, q.terms)).cast("array<string>")
        return rows.where(F.arrays_overlap(F.split("terms", " "), words)).drop("batch", "bucket", "part", "numbers", "ids", "chars")

    def bounds(self, q: Query, every: bool = True) -> DataFrame:
        """(block, bound): no document of the block scores more. With ``every`` only blocks that hold a word of each group."""
        each = self.postings(q).select("block", F.explode(F.arrays_zip(F.split("terms", " ").alias("term"), F.col("bounds").alias("bound"))).alias("t"))
        words = each.where(F.col("t.term").isin(q.terms)).groupBy("block", F.col("t.term").alias("term")).agg(F.max("t.bound").alias("bound"))
        blocks = words.groupBy("block").agg(F.sum(F.when(F.col("term").isin(q.words), F.col("bound"))).alias("bound"), F.collect_set("term").alias("terms"))
        if every:
            for group in [*q.groups, *([t] for p in q.phrases for t in p)]:
                blocks = blocks.where(F.arrays_overlap("terms", F.array(*map(F.lit, group))))
        more = tm.PHRASE_WEIGHT * sum(self.weights.values())
        return blocks.select("block", (F.coalesce("bound", F.lit(0.0)) + F.lit(more)).alias("bound"))

    def matches(self, q: Query, blocks: DataFrame | None = None) -> DataFrame:
        """(ord, every, some, score) of the documents with any word (old versions included), in ``blocks`` or everywhere."""
        weights, bits = list(self.weights.values()), self.bits
        rows = self.postings(q)
        if blocks is not None:
            rows = rows.join(blocks.select("block"), "block", "left_semi")

        def run(table: pa.Table) -> pa.Table:
            block = table["block"][0].as_py()
            at, every, some, score = _merged(table.drop_columns(["block"]).to_pylist(), q, weights, 1 << bits)
            return pa.table({"ord": (block << bits) + at, "every": every, "some": some, "score": score})

        return rows.drop("bounds").groupBy("block").applyInArrow(run, "ord long, every boolean, some boolean, score double")

    def hits(self, q: str) -> DataFrame:
        """(id, chars, every, some, score) of the current documents with any word of the query."""
        return self.matches(Query.of(q)).join(self.documents().drop("block"), "ord").drop("ord")

    def top(self, q: str, allowed: DataFrame, k: int, every: bool = True, warm: int = WARM) -> DataFrame:
        """(id, score): the ``k`` best of ``allowed`` (id, ord, block, factor; factor from 0 to 1) by score * factor, rounded,
        ties by id. Blocks whose bound cannot reach the k-th score of the ``warm`` first ones are not read."""
        query = Query.of(q)
        most = allowed.groupBy("block").agg(F.max("factor").alias("factor"), F.count_if(F.col("factor").isNull()).alias("open"))
        limits = self.bounds(query, every).join(most, "block")
        limits = limits.select("block", (F.col("bound") * F.coalesce("factor", F.lit(0.0))).alias("limit"), "open")

        def best(blocks: DataFrame) -> DataFrame:
            found = self.matches(query, blocks).where("every" if every else "some").join(allowed, "ord")
            return found.select("id", sc.stable(F.col("score") * F.col("factor")).alias("score")).orderBy(F.desc("score"), F.asc("id")).limit(k)

        first = [r["score"] for r in best(limits.orderBy(F.desc("limit"), "block").limit(warm)).select("score").collect()]  # at most k numbers
        if len(first) == k and None not in first:
            limits = limits.where(F.col("limit") >= F.lit(first[-1] - 1e-6))
        return best(limits)
