"""The stored text index against the scanning form."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedloom.functions import text as tx
from feedloom.operators import text_match as tm
from feedloom.operators import text_index as ti
from feedloom.operators.text_index import DIRECTORY, Query, TextIndex
from feedloom.plans import search as se
from tests.conftest import files_read
from workload.adapter import Tables, as_of

WORDS = ["alpha", "beta", "gamma", "delta", "größe", "été", "日本", "x1", "2024"]
QUERIES = [
    "alpha", "alpha beta", '"alpha beta"', '"alpha alpha"', '"beta alpha beta" gamma', "alpha -beta", "alpha OR größe gamma", '"x1 2024" OR delta', "-alpha", "nothing", "", "ÉTÉ 日本",
    '"gamma delta" "alpha beta" -x1', "alpha alpha",
]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)

    def text(n):
        return rng.choice([None, ""]) if rng.random() < 0.05 else rng.choice([" ", ", ", "-"]).join(rng.choices(WORDS, [30, 20, 5, 5, 3, 2, 2, 2, 1], k=n))

    rows = [(f"d{i}", text(rng.randint(1, 4)), text(rng.randint(1, 8)), text(rng.randint(1, 60))) for i in range(300)]
    return spark.createDataFrame(rows + [("none", None, None, None)], "id string, title string, excerpt string, content string").repartition(3)


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    return TextIndex(spark, str(tmp_path_factory.mktemp("ix") / "index"), buckets=8, bits=4).append(texts)


@pytest.mark.parametrize("q", QUERIES)
def test_hits_equal_the_scan(texts, index, q):
    rows = texts.select("id", F.coalesce(tm.match_all(q), F.lit(False)).alias("a"), F.coalesce(tm.match_any(q), F.lit(False)).alias("o"), F.round(tm.text_rank(q), 9).alias("r"))
    want = {tuple(r) for r in rows.where("a or o").collect()}
    assert {tuple(r) for r in index.hits(q).select("id", "every", "some", F.round("score", 9)).collect()} == want


@pytest.mark.parametrize("q,every", [("alpha", True), ("alpha beta", True), ("größe été", False), ('"alpha beta"', True)])
def test_best_rows_without_reading_all_blocks(texts, index, q, every):
    factor = F.when(F.col("id").endswith("7"), 1.0).when(F.col("id").endswith("3"), F.lit(None)).otherwise(0.01)
    allowed = index.documents().withColumn("factor", factor)
    match = tm.match_all(q) if every else tm.match_any(q)
    want = texts.where(match).select("id", F.round(tm.text_rank(q) * factor, 6).alias("s")).orderBy(F.desc("s"), "id").limit(5).collect()
    got = index.top(q, allowed, 5, every, warm=3).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_blocks_below_the_floor_are_not_scored(spark, index):
    allowed = index.documents().withColumn("factor", F.when(F.col("block") % 3 == 0, 1.0).otherwise(0.001))
    limits = index.bounds(Query.of("alpha")).join(allowed.groupBy("block").agg(F.max("factor").alias("f")), "block")
    floor = index.top("alpha", allowed, 5).collect()[-1]["score"]
    assert 0 < limits.where(F.col("bound") * F.col("f") >= floor).count() < limits.count() / 2


def test_bounds_hold(index):
    query = Query.of("alpha beta")
    best = index.matches(query).where("every").groupBy(F.shiftright("ord", index.bits).alias("block")).agg(F.max("score").alias("s"))
    assert best.join(index.bounds(query), "block", "left").where("s > bound or bound is null").count() == 0


def test_later_batches_replace_earlier_versions(spark, texts, tmp_path):
    ix = TextIndex(spark, str(tmp_path / "ix"), buckets=4, bits=5)
    old = texts.withColumn("content", F.lit("alpha outdated"))
    ix.append(old, 0).append(texts.where("id < 'd2'"), 1).append(texts.where("id >= 'd2'"), 2)
    ix.append(texts.where("id >= 'd2'"), 2)  # run again after a failure
    assert ix.hits("outdated").count() == 0 and ix.documents().count() == texts.count()
    want = {r["id"] for r in texts.where(tm.match_all("alpha gamma")).collect()}
    assert {r["id"] for r in ix.hits("alpha gamma").where("every").collect()} == want


def test_a_query_opens_the_folders_of_its_words_only(index):
    q = Query.of("alpha größe")
    every = files_read(index._read().where(F.col("bucket") != DIRECTORY))
    assert 0 < files_read(index.postings(q)) <= every / 2


def test_indexed_search_reads_no_content(spark, tmp_path):
    path = str(tmp_path / "items")
    Tables(spark, "/root/testdata/sf0.001").items().write.parquet(path)
    items = spark.read.parquet(path)
    ix = TextIndex(spark, str(tmp_path / "ix")).append(items)
    page = se.text_search(items, q="that with", as_of=as_of(), index=ix)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    schemas = re.findall(r"ReadSchema: (\S+)", page._jdf.queryExecution().explainString(mode))
    assert schemas and not any("content:" in s for s in schemas)
    rows = se.admitted(items, ix, se.search_filters(as_of=as_of()))
    assert "content:" not in rows._jdf.queryExecution().explainString(mode)
    assert sorted(map(tuple, page.select("id", "rank", "pos").collect())) == sorted(map(tuple, se.text_search(items, q="that with", as_of=as_of()).select("id", "rank", "pos").collect()))


def test_a_block_of_long_texts_is_inverted_in_pieces(spark, texts, tmp_path):
    whole = TextIndex(spark, str(tmp_path / "whole"), buckets=4).append(texts.coalesce(1))
    cut = TextIndex(spark, str(tmp_path / "cut"), buckets=4, tokens=500).append(texts.coalesce(1))
    most = cut._read().where(F.col("bucket") != DIRECTORY).select(F.max(F.size("places"))).first()[0]
    assert most <= 500 < whole._read().where(F.col("bucket") != DIRECTORY).select(F.max(F.size("places"))).first()[0]
    for q in QUERIES:
        a, b = (sorted(map(tuple, ix.hits(q).select("id", "chars", "every", "some", "score").collect())) for ix in (whole, cut))
        assert a == b
    assert sorted(map(tuple, whole.documents().select("id", "ord").collect())) == sorted(map(tuple, cut.documents().select("id", "ord").collect()))


def test_one_text_longer_than_a_piece(spark, tmp_path):
    rows = spark.createDataFrame([("a", "one", None, "x " * 50), ("b", "two", "", ""), ("c", "one two", "x", "y x")], "id string, title string, excerpt string, content string").coalesce(1)
    ix = TextIndex(spark, str(tmp_path / "ix"), buckets=2, tokens=10).append(rows)
    assert sorted((r["id"], round(r["score"], 6)) for r in ix.hits("x").select("id", "score").collect()) == [("a", 1.082405), ("c", 0.9)]


def test_rows_do_not_grow_with_the_terms(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{i}", f"t{i}", None, " ".join(f"w{i * 200 + k}" for k in range(200))) for i in range(50)], "id string, title string, excerpt string, content string").coalesce(1)
    ix = TextIndex(spark, str(tmp_path / "ix"), buckets=4).append(rows)
    assert ix._read().where(F.col("bucket") != DIRECTORY).count() <= 4 * 32  # 10,050 terms
    for q, want in (("w0", {"d0"}), ("w1999", {"d9"}), ("w10000", set()), ("t7 OR w0 w1400", {"d7"})):
        assert {r["id"] for r in ix.hits(q).where("every").collect()} == want


def test_texts_are_split_as_spark_splits_them(spark):
    points = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["", " ", "a", " a", "a ", "..a--b..", None] + ["x".join(points[i : i + 500]) for i in range(0, len(points), 500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", tx.tokens(F.col("t")).alias("want"), tx.token_text(F.col("t")).alias("low")).orderBy("i").collect()
    assert ti._split(pa.array([r["low"] for r in rows])).to_pylist() == [r["want"] for r in rows]
    part = pa.array([r["low"] for r in rows]).slice(3, 3)
    assert ti._split(part).to_pylist() == [["a"], ["a"], ["a", "b"]]


@pytest.mark.parametrize("values", [[], [0], [127, 128, 0], [16383, 16384, 5, 2**31 - 1, 2**40]])
def test_coded_numbers(values):
    coded, ends = ti._coded(np.array(values, np.int64))
    assert ti._numbers(coded).tolist() == values and ends[-1] == len(coded)


def test_sorting_with_places():
    small, large = np.array([3, 1, 3, 0, 1]), np.array([2**62, 5, 2**62, 5])
    for key in (small, large, np.zeros(0, np.int64)):
        got, order = ti._sorted(key)
        assert got.tolist() == sorted(key.tolist()) and order.tolist() == np.argsort(key, kind="stable").tolist()
