"""Stages of the corpus pipeline against brute force."""

import random
from itertools import combinations

import pytest

import corpus_pipeline
from feedloom.llm import simhash
from tests.llm.conftest import SCHEMA, words
from tests.llm.test_duplicates import roots


def shingles(text, width=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width, 0) + 1)} if w else {()}


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) >= 0.8 * len(a | b) - 1e-9


def changed(rng, text, n):
    """``n`` words replaced, far from each other."""
    w = text.split()
    for k in range(n):
        w[10 + k * (len(w) // n) % (len(w) - 10)] = words(rng, 1) + "zz"
    return " ".join(w)


@pytest.fixture(scope="module")
def copies():
    """Texts of 300 words, each with copies at Jaccard 0.97, 0.9, 0.83 and 0.7."""
    rng = random.Random(3)
    out = []
    for _ in range(30):
        base = words(rng, 300)
        out += [base, changed(rng, base, 1), changed(rng, base, 3), changed(rng, base, 5), changed(rng, words(rng, 1) + " " + base, 11)]
    return out + ["one two", "One  two", "", None, "x y z"]


def grouped(spark, texts, **settings):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("node", simhash.text_key(simhash.F.col("text")))
    node = {r["doc_id"]: r["node"] for r in rows.collect()}
    part = {r["node"]: r["component"] for r in simhash.similar_texts(rows, **settings).collect()}
    return [part.get(node[i], node[i]) for i in range(len(texts))]


@pytest.mark.parametrize("settings", [{"block": 16, "nodes": 256}, {"block": 1024, "nodes": 256}, {"block": 4, "nodes": 2}])
def test_near_duplicates_at_the_stated_similarity(spark, copies, settings):
    got = grouped(spark, copies, **settings)
    links = [(i, j) for i, j in combinations(range(len(copies)), 2) if alike(copies[i], copies[j])]
    want = roots(range(len(copies)), links)
    assert any(not alike(copies[i], copies[i + 4]) for i in range(0, 150, 5))
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i, j in combinations(range(len(copies)), 2))


@pytest.mark.parametrize("nodes", [8, 256])
def test_groups_of_near_copies_of_every_shape(spark, nodes):
    """Copies of one text each with its own changes (linked through it alone, through any other, or by a chain)."""
    rng = random.Random(11)
    star = words(rng, 300)
    dense = words(rng, 300)
    texts = [star] + [changed(rng, star, 5) for _ in range(40)] + [changed(rng, dense, 1) for _ in range(60)]
    chain = [words(rng, 300)]
    for _ in range(12):
        chain.append(changed(rng, chain[-1], 3))
    texts += chain
    rng.shuffle(texts)
    got = grouped(spark, texts, block=8, nodes=nodes)
    links = [(i, j) for i, j in combinations(range(len(texts)), 2) if alike(texts[i], texts[j])]
    want = roots(range(len(texts)), links)
    assert len(set(want.values())) == 3
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i, j in combinations(range(len(texts)), 2))


def test_sizes_of_similar_sets_share_a_class(spark):
    sizes = [(a, b) for a in [*range(1, 80), *range(250, 262), *range(1020, 1030), 16000, 16384, 16390] for b in range(a, int(a / 0.8) + 1)]
    rows = spark.createDataFrame(sizes, "a long, b long").select("a", "b", *[simhash.size_classes(simhash.F.col(c), 0.8).alias(f"c{c}") for c in "ab"])
    assert rows.where("not arrays_overlap(ca, cb)").count() == 0
    assert max(r["n"] for r in rows.selectExpr("size(ca) AS n").collect()) == 2


def test_near_copies_leave_the_stage(spark, copies):
    docs = spark.createDataFrame([(i, t, "xx", "", "", "") for i, t in enumerate(copies)], SCHEMA)
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()}
    want = roots(range(len(copies)), [(i, j) for i, j in combinations(range(len(copies)), 2) if alike(copies[i], copies[j])])
    assert kept == set(want.values())


def test_one_row_of_each_group_stays_whatever_the_ids(spark, copies):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 3, i + 10]), t) for i, t in enumerate(copies)]
    rows += [(None, words(rng, 80)) for _ in range(5)] + [(1, words(rng, 80)) for _ in range(5)]
    rows += [(5, copies[0]), (5, copies[0]), (None, copies[0]), (None, None)] + [rows[-1]] * 3
    docs = spark.createDataFrame([(i, t, "xx", "", "", "") for i, t in rows], SCHEMA).repartition(3)
    got = corpus_pipeline.near_dedup_stage(spark, docs, "").collect()
    want = roots(range(len(rows)), [(i, j) for i, j in combinations(range(len(rows)), 2) if alike(rows[i][1], rows[j][1])])
    at = {(i, t): want[k] for k, (i, t) in enumerate(rows)}
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(want[k], []).append(i)
    kept = {at[r["doc_id"], r["text"]]: r["doc_id"] for r in got}
    assert len(got) == len(kept) == len(ids)
    assert all(kept[g] == min((i for i in x if i is not None), default=None) for g, x in ids.items())


def test_characters_that_a_cut_splits_go_and_no_others(spark):
    rng = random.Random(6)
    shared = words(rng, 80)
    texts = ["\ufffd start é" + shared + "é \ufffd end " + words(rng, 10), "other ê" + shared + "ê tail " + words(rng, 10), "\ufffd alone", "", None]
    docs = spark.createDataFrame([(i, t, "xx", "web", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in corpus_pipeline.passages_stage(spark, docs, "").collect()}
    assert got[0]["text"].startswith("\ufffd start ") and got[0]["text"].count("\ufffd") == 2 and shared not in got[0]["text"]
    assert got[0]["text"].count("é") == 1 and got[1]["text"].count("ê") == 1  # the first byte of the second one belongs to the passage
    assert [got[i]["text"] for i in (2, 3, 4)] == texts[2:] and got[0]["n_chars"] == len(got[0]["text"])


def test_empty_tables_pass_every_stage(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (corpus_pipeline.near_dedup_stage, corpus_pipeline.passages_stage, corpus_pipeline.packing_stage):
        assert stage(spark, docs, "").collect() == []
    for stage in (corpus_pipeline.quality_stage, corpus_pipeline.toxicity_stage):
        assert stage(spark, docs, "/root/testdata/sf0.001").collect() == []
