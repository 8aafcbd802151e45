"""Byte-level BPE by a hierarchical-bitmap rank queue.

Every match of the split pattern is merged on its own. Its bytes form a linked list; each mergeable pair waits in the
bucket of its rank. A two-level bitmap marks the ranks whose bucket is not empty: find-first-set on the summary and then
on one leaf gives the lowest rank, its bucket gives the leftmost position, and entries that merging has made stale are
skipped. One merge costs a constant number of word operations plus a heap step inside one bucket, so a pre-token of any
length takes close to linear time.

Words repeat, so Arrow splits and dictionary-encodes the texts and each distinct word goes through the queue once (see
``vocab.WordEncoder``), the short ones of a slice through one queue together (``BulkQueue``); decoding gathers the ids' bytes from one flat table.

Edge cases: a null text encodes to no ids and decodes to no bytes; null ids decode to null, as do ids outside the
vocabulary. Rows are independent, so repeats, ties and empty tables need no care; a result column replaces an input
column of the same name.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import released, table, with_columns
from feedloom.llm.vocab import MEMO, SLICE, WordEncoder, as_chunk, gathered, rank_table, together, vocabulary_path

LEAF = 8  # bits of a rank inside one leaf word
LOW = (1 << LEAF) - 1
BIT = [1 << k for k in range(1 << LEAF)]
LONG = 64  # bytes; longer pieces have a queue of their own


class RankQueue:
    """Buckets by rank and the two-level bitmap over them. Merging drains the queue, so one instance serves all pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        most = max(ranks.values(), default=0) + 1
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=0)
        self.buckets: list[list[int] | None] = [None] * most
        self.leaves = [0] * ((most >> LEAF) + 1)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        get, longest, buckets, leaves, bit = ranks.get, self.longest, self.buckets, self.leaves, BIT
        after = list(range(1, n + 2))  # start of the next part; n: the end
        before = list(range(-1, n))
        waiting = [-1] * (n + 1)  # rank under which the pair that starts here waits
        summary = 0
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                waiting[i] = r
                bucket = buckets[r]
                if bucket is None:
                    buckets[r] = [i]
                    hi = r >> LEAF
                    leaves[hi] |= bit[r & LOW]
                    summary |= 1 << hi
                else:
                    bucket.append(i)  # ascending, hence a heap
        while summary:
            hi = (summary & -summary).bit_length() - 1
            leaf = leaves[hi]
            r = hi << LEAF | (leaf & -leaf).bit_length() - 1
            bucket = buckets[r]
            if len(bucket) == 1:
                i = bucket[0]
                buckets[r] = None
                leaf &= leaf - 1
                leaves[hi] = leaf
                if not leaf:
                    summary &= summary - 1
            else:
                i = heappop(bucket)
            if waiting[i] != r:
                continue  # stale
            gone = after[i]
            end = after[gone]
            after[i] = end
            waiting[gone] = waiting[i] = -1
            before[end] = i
            if end < n:
                stop = after[end]
                q = get(piece[i:stop]) if stop - i <= longest else None
                if q is not None:
                    waiting[i] = q
                    bucket = buckets[q]
                    if bucket is None:
                        buckets[q] = [i]
                        hi = q >> LEAF
                        leaves[hi] |= bit[q & LOW]
                        summary |= 1 << hi
                    else:
                        heappush(bucket, i)
            if i:
                s = before[i]
                q = get(piece[s:end]) if end - s <= longest else None
                if q is None:
                    waiting[s] = -1
                else:
                    waiting[s] = q
                    bucket = buckets[q]
                    if bucket is None:
                        buckets[q] = [s]
                        hi = q >> LEAF
                        leaves[hi] |= bit[q & LOW]
                        summary |= 1 << hi
                    else:
                        heappush(bucket, s)
        out, i = [], 0
        while i < n:
            stop = after[i]
            out.append(ranks[piece[i:stop]])
            i = stop
        return out


class PairTable:
    """Rank of the bytes of two neighbouring tokens, for arrays of token pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        cells = {}
        for piece, r in ranks.items():
            for cut in range(1, len(piece)):
                left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if left is not None and right is not None:
                    cells[left << 32 | right] = r
        self.keys = np.array(sorted(cells), np.int64)
        self.ranks = np.array([cells[k] for k in self.keys.tolist()], np.int32)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks; -1 where the two do not merge."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], np.int32(-1))


class BulkQueue:
    """The same queue for many short pieces at once: positions run over all pieces, the bitmap is two arrays, and the
    entries of the lowest rank are merged together, the leftmost of each piece first (a merge may give that piece a lower
    rank than its next entry has; pieces do not touch each other)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.pairs = PairTable(ranks)
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.most = (max(ranks.values(), default=0) >> LEAF) + 1

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, ends of the pieces' ids)."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        token = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(token)
        if not n or not len(self.pairs.keys):
            return token, np.r_[0, np.cumsum(size)]
        # the position behind the end belongs to no piece
        piece = np.full(n + 1, -1, np.int32)
        piece[:n] = np.repeat(np.arange(len(pieces), dtype=np.int32), size)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        waiting = np.full(n + 1, -1, np.int32)
        waiting[: n - 1] = np.where(piece[1:n] != piece[: n - 1], np.int32(-1), self.pairs(token[:-1], token[1:]))
        token = np.append(token, np.int32(0))
        order = np.flatnonzero(waiting >= 0).astype(np.int32)
        order = order[np.argsort(waiting[order], kind="stable")]
        rank = waiting[order]
        begin = np.searchsorted(rank, np.arange((self.most << LEAF) + 1))
        present = np.zeros((self.most, 1 << LEAF), bool)
        flat = present.reshape(-1)
        flat[rank] = True
        del rank
        summary = present.any(axis=1)
        pushed: dict[int, list[int]] = defaultdict(list)
        while True:
            hi = int(summary.argmax())  # find first set
            if not summary[hi]:
                break
            r = hi << LEAF | int(present[hi].argmax())
            flat[r] = False
            summary[hi] = present[hi].any()
            at = order[begin[r] : begin[r + 1]]
            begin[r] = begin[r + 1]
            more = pushed.pop(r, None)
            if more:
                at = np.unique(np.concatenate([at, np.array(more, np.int32)]))
            at = at[waiting[at] == r]  # the others are stale
            if not len(at):
                continue
            owner = piece[at]
            first = np.r_[True, owner[1:] != owner[:-1]]
            if not first.all():
                pushed[r] = at[~first].tolist()
                flat[r] = summary[hi] = True
                at, owner = at[first], owner[first]
            gone = after[at]
            end = after[gone]
            after[at] = end
            before[end] = at
            token[at] = r
            waiting[gone] = -1
            ahead = np.where(piece[end] == owner, self.pairs(token[at], token[end]), -1)
            waiting[at] = ahead
            prior = before[at]
            inside = (prior >= 0) & (piece[prior] == owner)
            prior, here = prior[inside], at[inside]
            behind = self.pairs(token[prior], token[here])
            waiting[prior] = behind
            q, p = np.concatenate([ahead, behind]), np.concatenate([at, prior])
            good = q >= 0
            q, p = q[good], p[good]
            flat[q] = True
            summary[q >> LEAF] = True
            for x, y in zip(q.tolist(), p.tolist()):
                pushed[x].append(y)
        # the starts that are left: those reached from the start of their piece
        alive = np.ones(n, bool)
        inner = np.flatnonzero(after[:n] - np.arange(n) > 1)
        length = after[inner] - inner - 1
        alive[np.repeat(inner + 1, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)] = False
        kept = np.flatnonzero(alive)
        return token[kept], np.r_[0, np.cumsum(np.bincount(piece[kept], minlength=len(pieces)))]


class Codec:
    """Encoder and decoder of one rank file, with a bounded memory of chunks and pre-tokens."""

    def __init__(self, path: str, pattern: str):
        import public_tokenizers
        import regex

        self.ranks = rank_table(path)
        self.merge = RankQueue(self.ranks).merge
        self.split = regex.compile(pattern).findall
        self.pieces: dict[str, bytes] = {}
        self.bulk = BulkQueue(self.ranks).merge
        # other patterns may match across words
        self.texts = WordEncoder(self.encode, self._words, chunked=pattern == public_tokenizers.PATTERN)
        token = [b""] * (max(self.ranks.values()) + 1)
        for b, r in self.ranks.items():
            token[r] = b
        self.bytes = np.frombuffer(b"".join(token), np.uint8)
        self.size = np.fromiter(map(len, token), np.int64, len(token))
        self.start = np.cumsum(self.size) - self.size

    def _ids(self, piece: str) -> bytes:
        return array("i", self.merge(piece.encode("utf-8", "surrogatepass"))).tobytes()

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            got = self._ids(piece)
            if len(piece) <= 64:
                if len(self.pieces) >= MEMO:
                    self.pieces.clear()
                self.pieces[piece] = got
        return got

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian 32-bit integers."""
        return b"".join(map(self._piece, self.split(text))) if text else b""

    def _words(self, parts: list[str]) -> list[bytes]:
        """Ids of words with the white space before them. Letters after a space are one match of the pattern."""
        pieces: list[str] = []
        ends = [0]
        for p in parts:
            if p.isalpha():
                pieces.append(" " + p)
            else:
                pieces += self.split(as_chunk(p))
            ends.append(len(pieces))
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        whole = list(map(self.ranks.get, raw))
        rest = [k for k, r in enumerate(whole) if r is None]
        long = [k for k in rest if len(raw[k]) > LONG]
        short = [k for k in rest if len(raw[k]) <= LONG]
        ids, cut = self.bulk([raw[k] for k in short])
        lists = [self.merge(raw[k]) for k in long]
        # one pool: ranks of whole tokens, ids of the short pieces, ids of the long ones
        pool = np.concatenate([np.array([r or 0 for r in whole], np.int32), ids.astype(np.int32), np.array([i for x in lists for i in x], np.int32)])
        start, size = np.arange(len(pieces)), np.ones(len(pieces), np.int64)
        start[short], size[short] = len(pieces) + cut[:-1], np.diff(cut)
        size[long] = [len(x) for x in lists]
        start[long] = len(pieces) + len(ids) + np.cumsum(size[long]) - size[long]
        flat = gathered(pool, start, size).astype("<i4").tobytes()
        at = (4 * np.r_[0, np.cumsum(size)][ends]).tolist()
        return [flat[a:b] for a, b in zip(at, at[1:])]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all lists of ids, the ends of the lists' bytes, and whether each list holds only known ids."""
        known = (ids >= 0) & (ids < len(self.size))
        bad = np.r_[0, np.cumsum(~known)]
        use = np.where(known, ids, 0)
        size = np.where(known, self.size[use], 0)
        return gathered(self.bytes, self.start[use], size), np.r_[0, np.cumsum(size)][ends], bad[ends[1:]] == bad[ends[:-1]]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _settings(vocabulary: str, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return vocabulary_path(vocabulary), pattern or public_tokenizers.PATTERN


def encode(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None) -> DataFrame:
    """``df`` with an ``array<int>`` of token ids."""
    path, pattern = _settings(vocabulary, pattern)

    @F.arrow_udf("array<int>")
    def to_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        for texts in together(released(batches)):
            for ids, ends in c.texts(texts):
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))

    return with_columns(df, {ids: to_ids(df[text].cast("string"))})


def decode(df: DataFrame, ids: str = "ids", decoded: str = "decoded", vocabulary: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None) -> DataFrame:
    """``df`` with the bytes of the ids."""
    path, pattern = _settings(vocabulary, pattern)

    @F.arrow_udf("binary")
    def to_bytes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        for lists in released(batches):
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)
            valid = lists.is_valid().to_numpy(zero_copy_only=False)
            out, at = [pa.array([], pa.binary())], 0
            while at < len(lists):
                stop = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE // 8, "right")) - 1)
                raw, cut, known = c.decode(flat[ends[at] : ends[stop]], ends[at : stop + 1] - ends[at])
                null = ~(valid[at:stop] & known)
                mask = pa.py_buffer(np.packbits(~null, bitorder="little")) if null.any() else None
                out.append(pa.Array.from_buffers(pa.binary(), stop - at, [mask, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(raw)]))
                at = stop
            yield pa.concat_arrays(out)

    return with_columns(df, {decoded: to_bytes(df[ids])})


def op2_byte_bpe(spark, sf_dir) -> DataFrame:
    ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return decode(ids).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
