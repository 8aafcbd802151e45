"""The Merkle manifest against plain hashing."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feedloom.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root string, i string, tree string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def leaf(row, add=0):
    out = []
    for name in FIELDS:
        value = row[name]
        if value is not None:
            value = str(value + add if name == "n_chars" else value)
            value = f"{len(value.encode())}:{value}"
        out.append("-" if value is None else value)
    return digest(*out)


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree, i):
    for level in tree[:-1]:
        yield i % 2, level[i ^ 1] if i ^ 1 < len(level) else None
        i //= 2


def expected(rows, tampered):
    """Sorted (doc_id, leaf, subroot, root, proof, folded root, verified)."""
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {x: sorted((r for r in rows if r["lang"] == x), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for x in langs}
    trees = {x: levels([leaf(r) for r in groups[x]]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(groups[x]):
            steps = [*path(trees[x], i), *path(top, k)]
            now = leaf(r, tampered(r))
            for right, other in steps:
                now = digest(now) if other is None else digest(other, now) if right else digest(now, other)
            out.append((r["doc_id"], trees[x][0][i], trees[x][-1][0], top[-1][0], digest(*[s for _, s in steps if s]), now, now == top[-1][0]))
    return sorted(out, key=repr)


def result(rows, hit):
    new = F.when(hit, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))
    got = merkle.merkle(rows, FIELDS, replaced={"n_chars": new})
    text = [F.lower(F.hex(c)) for c in ("leaf", "subroot", "root", "proof", "folded_root")]
    return sorted((tuple(r) for r in got.select("doc_id", *text, "verified").collect()), key=repr)


@given(st.lists(st.binary(min_size=32, max_size=32), min_size=1, max_size=9), st.data())
@settings(max_examples=40, deadline=None)
def test_midstates_resume_as_the_hash_does(leaves, data):
    n = len(leaves)
    height = (n - 1).bit_length()
    nodes, states = merkle._grown([np.frombuffer(b"".join(leaves), np.uint8).reshape(-1, 32)], [height])
    plain = levels([x.hex() for x in leaves])
    assert nodes[0].hex() == "".join("".join(x) for x in plain)
    at, new = data.draw(st.integers(0, n - 1)), data.draw(st.binary(min_size=32, max_size=32))
    now, want = np.frombuffer(new, np.uint8).reshape(1, 32), new.hex()
    blobs = [np.frombuffer(x, np.uint8).reshape(-1, 32) for x in (nodes[0], states[0])]
    for (kind, sibling, before), (right, other) in zip(merkle._steps(n, height, *blobs, np.array([at])), path(plain, at)):
        now = merkle.resumed(now, merkle.unpacked(before), sibling, kind)
        want = digest(want) if other is None else digest(other, want) if right else digest(want, other)
    assert now.tobytes().hex() == want


@pytest.mark.parametrize("fan", [4, 256])
def test_trees_of_several_layers(spark, fan, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", fan.bit_length() - 1)
    monkeypatch.setattr(merkle, "FAN", fan)
    rng = random.Random(2)
    langs = [None, "", "de", "ein", "é"] + [f"l{k}" for k in range(30)]
    rows = [
        {"doc_id": k, "source": rng.choice([None, "web", ""]), "lang": "de" if k % 3 else rng.choice(langs), "n_chars": rng.choice([None, 5, 10**9]), "text": rng.choice([None, "", "äö", f"t{k}"])}
        for k in range(400)
    ]
    rows += [{**rows[0], "doc_id": None}] * 3 + [rows[7]] * 5 + [{**rows[1], "text": "x" * 300_000}, {**rows[2], "lang": "alone"}, {**rows[4], "n_chars": 2**63 - 1}]
    docs = spark.createDataFrame([(*[r[c] for c in FIELDS], "clash", "clash", "clash", "clash") for r in rows], SCHEMA).repartition(5)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0

    def tampered(r):
        return int(r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0)

    want = expected(rows, tampered)
    assert result(docs, hit) == want
    assert {w[-1] for w in want} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 256, 257])
def test_sizes_at_the_edge_of_a_block(spark, n):
    rows = [{"doc_id": k, "source": "s", "lang": "en", "n_chars": k, "text": "t"} for k in range(n)]
    docs = spark.createDataFrame([(*[r[c] for c in FIELDS], "", "", "", "") for r in rows], SCHEMA)
    assert result(docs, F.col("doc_id") == 0) == expected(rows, lambda r: int(r["doc_id"] == 0))


def test_no_rows(spark):
    assert result(spark.createDataFrame([], SCHEMA), F.lit(True)) == []
