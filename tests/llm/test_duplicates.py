"""SimHash, vectors, components and repeated substrings against brute force."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
import xxhash

from feedloom.llm import graph, simhash, suffixes, vectors


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(1, 50)] + [(200, 200)]
    links += [(rng.randint(300, 360), rng.randint(300, 360)) for _ in range(40)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    # a root itself is not listed
    expected = roots({x for p in links for x in p}, links)
    assert all(expected[n] == c for n, c in got.items()) and {n for n, c in expected.items() if n != c} == set(got)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_links_that_differ_between_evaluations(spark):
    """Each evaluation gives another spanning tree of the same groups."""

    def trees(batches):
        rng = np.random.default_rng()
        for batch in batches:
            for g in batch["g"]:
                order = rng.permutation(60) + 100 * g
                yield pd.DataFrame({"a": order[1:], "b": [order[rng.integers(0, k)] for k in range(1, 60)]})

    links = spark.createDataFrame([(g,) for g in range(20)], "g long").mapInPandas(trees, "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(links).collect()}
    assert got == {100 * g + k: 100 * g for g in range(20) for k in range(1, 60)}


def test_forest():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 200, 150), rng.integers(0, 200, 150)
    x, y = graph.forest(a, b)
    nodes = {*a.tolist(), *b.tolist()}
    assert roots(nodes, zip(a.tolist(), b.tolist())) == roots(nodes, zip(x.tolist(), y.tolist())) and len(set(x.tolist())) == len(x)


def test_covering_design():
    sets = simhash.covering()
    assert all(any(set(s) <= set(m) for s in sets) for m in combinations(range(8), 5)) and len(sets) <= 24


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    shingles = [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash_groups(docs, corpus):
    got = simhash.simhash_groups(docs).collect()
    prints = [(i, plain_fingerprint(t)) for i, t in corpus]
    links = [(a[1], b[1]) for a, b in combinations(prints, 2) if (a[1] ^ b[1]).bit_count() <= 3]
    root = roots({p for _, p in prints}, links)
    low = {}
    for i, p in prints:
        if i is not None:
            low[root[p]] = min(low.get(root[p], i), i)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == Counter((i, f"{p:016x}", low.get(root[p])) for i, p in prints)


@pytest.mark.parametrize("block", [8, 1000])
def test_close_fingerprints_in_crowded_lists(spark, block):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    values = {s ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))) for s in seeds for _ in range(60)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    links = graph.components(simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), block)).collect()
    got = {v: v for v in signed} | {r["node"]: r["component"] for r in links}
    expected = roots(signed, [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 3])
    assert len(set(expected.values())) == len(set(got.values())) and all(got[a] == got[b] for a, b in expected.items())


def test_simhash_of_nothing(nothing):
    assert simhash.simhash_groups(nothing).count() == 0


def vector_table():
    rng = np.random.default_rng(11)
    rows = []
    for label in (0, 1, None):
        for c in range(8):
            center = rng.standard_normal(24)
            for k in range(25):
                v = center + rng.standard_normal(24) * (0.05 if k % 2 else 0.28)
                rows.append((len(rows), [float(np.float32(x)) for x in v], label))
    same = rows[0][1]
    rows += [(len(rows) + k, same, 0) for k in range(30)] + [(900, same, 1), (901, [2 * x for x in same], 0), (5, same, 1)]
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [1.0] * 5, [1.0] * 5]
    return rows + [(1000 + k, v, 0) for k, v in enumerate(odd)]


@pytest.mark.parametrize("block", [6, 512])
def test_near_vectors(spark, block):
    rows = vector_table()
    frame = spark.createDataFrame([(i, v, lab, "clash") for i, v, lab in rows], "vec_id long, embedding array<float>, label int, n_links string")
    got = Counter(tuple(r) for r in vectors.near_vectors(frame, block=block).collect())

    def sound(v, lab):
        return lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links = []
    for a, b in combinations(range(n), 2):
        (_, v, x), (_, w, y) = rows[a], rows[b]
        if x == y and sound(v, x) and sound(w, y) and len(v) == len(w):
            v, w = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
            if v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.93:
                links.append((a, b))
    root = roots(range(n), links)
    degree = Counter(x for p in links for x in p)
    low = {}
    for k in range(n):
        low[root[k]] = min(low.get(root[k], 10**9), rows[k][0])
    expected = Counter((rows[k][0], degree[k], low[root[k]], rows[k][0] == low[root[k]]) for k in range(n))
    right = sum((got & expected).values())
    assert sum(got.values()) == n and right >= 0.97 * n  # hashing may miss a few pairs at the threshold itself
    assert sum(r[1] * c for r, c in got.items()) >= 0.99 * 2 * len(links)
    assert sum(r[1] * c for r, c in got.items()) <= 2 * len(links)


def test_vectors_of_nothing(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def brute_cut(rows, length):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out[(i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_drop_repeats(docs, corpus):
    got = suffixes.drop_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_bytes").collect()
    assert Counter((r[0], r[1], r[2], r[3], hashlib.sha256(bytes(r[4])).hexdigest()) for r in got) == brute_cut(corpus, 200)


@pytest.mark.parametrize("chunk", [64, 1 << 21])
def test_small_repeats_in_crowded_buckets(spark, monkeypatch, chunk):
    rng = random.Random(9)
    shared = ["".join(rng.choice("abcd") for _ in range(n)) for n in (14, 17, 25, 60)]
    rows = []
    for i in range(150):
        text = "".join(rng.choice([*shared, "".join(rng.choice("abcdxyz") for _ in range(rng.randint(1, 30)))]) for _ in range(rng.randint(0, 6)))
        rows.append((i, text))
    rows += [(500, "ab" * 40), (501, "z" * 50), (502, None), rows[3], rows[3]]
    parts = [suffixes.suffix_table([(t or "").encode() for _, t in rows], 12, 5)]
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    parts.append(suffixes.suffix_table([(t or "").encode() for _, t in rows], 12, 5))
    assert all((x == y).all() for x, y in zip(*parts))  # stretches of any size sample the same suffixes
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keyed = suffixes.with_key(frame, "doc_id", "text").selectExpr("doc_id", "text", "__a a", "__b b", "__raw raw")
    spans = suffixes.repeated_spans(keyed.select("a", "b", "raw"), 12, 5, part=3).collect()
    keys = {(r["a"], r["b"]): (r["doc_id"], r["text"]) for r in keyed.collect()}
    covered = {k: bytearray(len((t or "").encode())) for k, (_, t) in keys.items()}
    for r in spans:
        c = covered[r["a"], r["b"]]
        for k in range(r["start"], min(r["stop"], len(c))):
            c[k] = 1
    wanted = {(x[0], x[2]) for x in brute_cut(rows, 12)}
    assert {(keys[k][0], sum(c)) for k, c in covered.items()} == wanted


def test_repeats_of_nothing(nothing):
    assert suffixes.drop_repeats(nothing).count() == 0


def test_vectors_equal_their_oracle(spark):
    from feedloom.llm.queries import ORACLES, QUERIES
    from workload.check import compare, duck

    folder = "/root/testdata/sf0.001"
    status, rows, _, note = compare("op3_near_vectors", spark, duck(folder), folder, QUERIES, ORACLES)
    assert status == "ok" and rows > 0, note
