"""Byte-level BPE, token counts and packing against the tokenizers' own libraries."""

import base64
import math
import random
import uuid
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from feedloom.llm import bpe, packing, token_counts, vocab
from feedloom.llm.vocab import rank_table
from feedloom.session import ensure_checkpoint_dir

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_and_decode(docs, corpus, library):
    out = bpe.decode(bpe.encode(docs)).select("doc_id", "text", "ids", "decoded", "lang").collect()
    assert len(out) == len(corpus)
    for r in out:
        assert r["ids"] == library.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode() and r["lang"] == "xx"


def test_bpe_of_nothing_and_of_odd_ids(spark, nothing):
    assert bpe.decode(bpe.encode(nothing)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [10**9]), (3, [-1]), (4, []), (5, [104, 105])], "k int, ids array<int>")
    got = {r["k"]: r["decoded"] for r in bpe.decode(odd).collect()}
    assert got[1] is None and got[2] is None and got[3] is None and bytes(got[4]) == b""
    assert bytes(got[5]) == b"".join(k for v in (104, 105) for k, x in rank_table(RANKS).items() if x == v)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_any_text(text):
    with open(RANKS, "rb") as f:
        assert f.read(1)
    c = bpe.codec(RANKS, P.PATTERN)
    enc = _library()
    ids = np.frombuffer(c.encode(text), "<i4").tolist()
    assert ids == enc.encode_ordinary(text)
    ((many, ends),) = c.texts(pa.array([text, "a " + text, None, text + "\n" + text]))
    lists = np.split(many, ends[1:-1])
    assert [x.tolist() for x in lists] == [enc.encode_ordinary(t) for t in (text, "a " + text, "", text + "\n" + text)]
    raw, cut, known = c.decode(many, ends)
    assert known.all() and [raw[a:b].tobytes().decode() for a, b in zip(cut, cut[1:])] == [text, "a " + text, "", text + "\n" + text]


_CACHE = []
_BULK = []


def _bulk():
    if not _BULK:
        _BULK.append(bpe.BulkQueue(rank_table(RANKS)))
    return _BULK[0]


def _library():
    if not _CACHE:
        _CACHE.append(tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=rank_table(RANKS), special_tokens={}))
    return _CACHE[0]


def test_very_long_pre_tokens():
    rng = random.Random(3)
    queue = bpe.RankQueue(rank_table(RANKS))
    for text in ("a" * 3001, "".join(rng.choice("theand") for _ in range(20000)), "é" * 777):
        assert queue.merge(text.encode()) == _library().encode_ordinary(text)
    assert all(b is None for b in queue.buckets) and not any(queue.leaves)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="theandioré aAt", min_size=1, max_size=30).map(str.encode), max_size=40))
def test_many_pieces_in_one_queue(pieces):
    queue, bulk = bpe.RankQueue(rank_table(RANKS)), _bulk()
    ids, ends = bulk.merge(pieces)
    # ``merge`` returns a piece that is a token whole, as the bulk queue finds it by merging unless no merges lead there
    for p, a, b in zip(pieces, ends, ends[1:]):
        if p not in queue.ranks:
            assert ids[a:b].tolist() == queue.merge(p)


def test_token_counts(spark, docs, corpus):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    cache = f"{ensure_checkpoint_dir(spark)}/cache-{uuid.uuid4().hex}"
    for _ in range(2):  # the second time everything is in the cache
        got = token_counts.token_counts(docs, cache).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == Counter(
            (i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in corpus)
        stored = spark.read.parquet(cache)
        assert stored.count() == stored.select("digest").distinct().count() == len({(x or "").strip(" ") for _, x in corpus})
    more = spark.createDataFrame([(1, "something new"), (2, "one")], "doc_id long, text string")
    assert token_counts.token_counts(more, cache).count() == 2
    # an append that was repeated after a failure changes nothing
    spark.read.parquet(cache).write.mode("append").parquet(cache + "-twice")
    spark.read.parquet(cache).write.mode("append").parquet(cache + "-twice")
    assert sorted(token_counts.token_counts(docs, cache + "-twice").select("n_bytes", "n_tokens").collect()) == sorted((r["n_bytes"], r["n_tokens"]) for r in got)
    assert spark.read.parquet(cache).count() == stored.count() + 1


def test_token_counts_of_nothing(spark, nothing):
    assert token_counts.token_counts(nothing, f"{ensure_checkpoint_dir(spark)}/cache-{uuid.uuid4().hex}").count() == 0


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack(docs, corpus):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = packing.pack(docs).collect()
    expected = Counter()
    for i, x in corpus:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids))):
            expected[(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    total = sum(r["length"] for r in rows)
    assert check_packing(rows, 1024) <= math.ceil(total / 1024) + 2


def test_pack_nothing(nothing):
    assert packing.pack(nothing).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_is_valid_and_close_to_the_bound(spark, seed):
    rng = random.Random(seed)
    sizes = [[rng.randint(1, 64) for _ in range(800)], [33] * 300 + [31] * 300, [64] * 20, [1] * 500, [40, 24] * 200, [20] * 900][seed]
    cells = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "k long, length long")
    rows = packing.best_fit(cells, ["k"], capacity=64, slices=5).collect()
    assert sorted(r["k"] for r in rows) == list(range(len(sizes)))
    used = check_packing(rows, 64)
    best = [math.ceil(sum(sizes) / 64) * 1.02 + 1, 300, 20, 8, 200, 300][seed]
    assert used <= best


@given(st.lists(st.integers(1, 30), max_size=60))
@settings(max_examples=100, deadline=None)
def test_sweeps_place_every_rank_once(sizes):
    counts = Counter(sizes)
    load = Counter()
    ranks = Counter()
    for length, a, b, first, offset in packing.sweep_rounds(counts, 30):
        for k in range(b - a):
            ranks[(length, a + k)] += 1
            assert load[first + k] == offset
            load[first + k] += length
    assert ranks == Counter((n, k) for n, c in counts.items() for k in range(c)) and max(load.values(), default=0) <= 30
    # as many as best-fit decreasing of the single pieces
    gaps = []
    for n in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else 30) - n)
    assert len(load) == len(gaps)


def test_split_by_arrow_is_the_split_of_words():
    space = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    odd = pc.match_substring_regex(pa.array([f"a{c}b" for c in space] + ["a b\nc", "a  b", "a\n b", "a b", "x\x1bé"]), vocab._IRREGULAR).to_pylist()
    assert odd == [c not in " \n" for c in space] + [False, True, True, False, False]


def test_null_ids_and_clashing_columns_pack(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (None, None), (1, "x")], "doc_id long, text string")
    rows = packing.pack(docs, capacity=4).collect()
    assert Counter(r["doc_id"] for r in rows) == {None: 3, 1: 1} and check_packing(rows, 4) == 3


def test_rank_columns_survive(spark):
    cells = spark.createDataFrame([(1, 5, 9)], "k long, length long, offset long")
    assert packing.best_fit(cells, ["k"], 64).select(F.sum("offset")).first()[0] == 0
