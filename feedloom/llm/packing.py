"""Best-fit packing in bulk-synchronous rounds.

Pieces are sorted by length and gaps by size. A round takes the pieces of one length, longest first: a successor search
finds the smallest gaps that still hold it, conflicts for a gap are settled by rank inside the length, the gaps shrink,
and the next round begins; where no gap is left, sequences are opened. Pieces of equal length are interchangeable and so
are equal gaps, so a round matches runs (length, ranks from, ranks to) with runs (gap, sequences from, to): its state is one
counter per length, at most ``capacity`` numbers however large the table, and the rounds move no rows. The result needs as
many sequences as best-fit decreasing over the single pieces. Spark ranks the pieces (lengths, each cut into slices of
bounded size so that a length that holds a third of all rows is shared by many tasks) and places each by its rank.

Edge cases: a null text is an empty text and packs its end id alone; repeated rows are packed each on its own, so are rows
without an id; an empty table gives an empty result; pieces of exactly the capacity fill a sequence; texts of any length
are encoded whole; columns named like a result are replaced.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import released, stored, table
from feedloom.llm.vocab import WordEncoder, as_chunk, json_tokenizer, rank_table, together, vocabulary_path

CAPACITY = 1024
END = 2
RANKED = 200_000  # rows of one length that are ranked in one task, about


@lru_cache(maxsize=2)
def encoder(path: str, ranks: str) -> WordEncoder:
    """Ids of the json tokenizer. Words are encoded by the rank table of the same vocabulary; texts with a special token's
    string go through the json tokenizer itself."""
    import public_tokenizers
    import tiktoken

    tokenizer = json_tokenizer(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=rank_table(ranks), special_tokens={}).encode_ordinary

    def whole(text: str) -> bytes:
        if any(s in text for s in special):
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<i4").tobytes()
        return np.array(bpe(text), "<i4").tobytes()

    return WordEncoder(whole, lambda parts: [array("i", bpe(as_chunk(p))).tobytes() for p in parts], special)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full pieces, the first may be shorter."""
    head = n % capacity
    out = [(0, head)] if head else []
    return out + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: (id, piece, start, length, ids_crc32)."""
    path, rank_path = vocabulary_path(vocabulary), vocabulary_path(ranks)

    @F.arrow_udf("array<struct<piece:int,start:long,length:long,ids_crc32:long>>")
    def cut_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = encoder(path, rank_path)
        tail = np.array([end], "<u4").tobytes()
        for texts in together(released(batches)):
            for ids, stops in encode(texts):
                ends, cells = [0], []
                raw = ids.astype("<u4").tobytes()
                for a, b in zip(stops[:-1].tolist(), stops[1:].tolist()):
                    own = raw[4 * a : 4 * b] + tail
                    cells += [(k, s, n, zlib.crc32(own[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(b - a + 1, capacity))]
                    ends.append(len(cells))
                names = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
                columns = zip(*cells) if cells else ((),) * len(names)
                fields = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, names.values())], list(names))
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields)

    cells = docs.select(F.col(id_col), F.explode(cut_up(F.col(text))).alias("__p"))
    return cells.select(id_col, "__p.piece", "__p.start", "__p.length", "__p.ids_crc32")


def sweep_rounds(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Placements of runs: (length, rank from, rank to, first sequence, offset). Ranks are those inside a length; the pieces
    of a run lie in consecutive sequences. As many sequences as best-fit decreasing of the single pieces needs."""
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs (first sequence, sequences)
    sizes: list[int] = []  # gaps that have runs, ascending
    placed, sequences = [], 0

    def keep(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not gaps[gap]:
                insort(sizes, gap)
            gaps[gap].append((first, n))

    for length in sorted((n for n, c in counts.items() if c > 0), reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)  # the successor: the smallest gap that holds the length
            if at < len(sizes):
                gap = sizes[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del sizes[at]
            else:
                gap, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            # conflicts by rank: each sequence of the run takes pieces until its gap is too small, the last one what is left
            each = gap // length
            full = min(n, left // each)
            for used, into, per in ((full, first, each), (1 if full < n and left - full * each else 0, first + full, left - full * each)):
                if not used:
                    continue
                for k in range(per):
                    placed.append((length, rank, rank + used, into, capacity - gap + k * length))
                    rank += used
                left -= used * per
                keep(gap - per * length, into, used)
                first, n = into + used, n - used
            keep(gap, first, n)
    return placed


def best_fit(cells: DataFrame, order: list[str], capacity: int = CAPACITY, slices: int | None = None) -> DataFrame:
    """``cells`` (with ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``. ``order`` breaks ties. Pieces of
    the whole capacity fill sequences of their own; the others are ranked in (length, slice) groups of bounded size."""
    spark = cells.sparkSession
    kept = [c for c in cells.columns if c not in ("sequence_id", "offset")]
    cells = cells.select(*kept)
    alone = cells.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    part = cells.where(F.col("length") < capacity)
    total = {r["length"]: r["n"] for r in part.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    slices = slices or max(64, -(-max(total.values(), default=0) // RANKED))
    part = part.withColumn("__s", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    shares = part.groupBy("length", "__s").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1))
    shares = shares.select("length", "__s", F.coalesce(before, F.lit(0)).alias("__from"))
    runs = np.array(sorted(sweep_rounds(total, capacity)) or np.zeros((0, 5)), np.int64)
    shared = spark.sparkContext.broadcast(runs)
    rank = F.row_number().over(Window.partitionBy("length", "__s").orderBy(*order)) - 1

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def put(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        runs = shared.value
        n, rank = length.to_numpy(), rank.to_numpy()
        # runs are sorted by (length, first rank): the last one that does not begin after the piece holds it
        big = int(runs[:, 2].max(initial=0)) + 1
        at = np.searchsorted(runs[:, 0] * big + runs[:, 1], n * big + rank, "right") - 1
        return pd.DataFrame({"sequence_id": runs[at, 3] + rank - runs[at, 1], "offset": runs[at, 4]})

    out = part.withColumn("__r", rank.cast("long")).join(shares, ["length", "__s"]).withColumn("__o", put("length", F.col("__r") + F.col("__from")))
    return out.select(*kept, "__o.sequence_id", "__o.offset").unionByName(alone)


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    return best_fit(stored(pieces(docs, id_col, text, capacity=capacity), "pieces"), [id_col, "piece"], capacity)


def op9_best_fit(spark, sf_dir) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
