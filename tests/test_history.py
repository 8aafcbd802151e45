"""The bucketed key history and de-duplication through it."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from feedloom.plans import dedup as dd
from feedloom.operators import joins as jn
from feedloom.sources.history import KeyedHistory
from tests.conftest import files_read
from workload.adapter import as_of

NOW = dt.datetime(2024, 1, 30)


def keys(spark, names):
    return spark.createDataFrame([(n,) for n in names], "key string")


def names(df):
    return sorted(r["key"] for r in df.collect())


@pytest.fixture()
def history(spark, tmp_path):
    return KeyedHistory(spark, str(tmp_path / "h"), buckets=16, file_keys=1000)


def test_lookups_equal_the_set_of_keys(spark, history):
    seen = set()
    for batch in range(4):
        new = {f"k{batch}-{i}" for i in range(300)} | {"shared"}
        asked = new | {f"k{b}-{i}" for b in range(4) for i in range(0, 300, 7)} | {"absent"}
        assert names(history.known(keys(spark, asked), skip=batch)) == sorted(asked & seen)
        history.add(keys(spark, new - seen), batch)
        seen |= new
    assert names(history.keys()) == sorted(seen)
    assert history.compact(most_files=3) == 16 and history.compact(most_files=3) == 0
    history.add(keys(spark, ["after"]), 4)
    assert names(history.keys()) == sorted(seen | {"after"})
    assert names(history.known(keys(spark, ["shared", "k2-8", "after", "absent"]))) == ["after", "k2-8", "shared"]


def test_a_lookup_opens_only_files_that_may_hold_its_keys(spark, history):
    for batch in range(5):
        history.add(keys(spark, [f"{batch}:{i}" for i in range(400)]), batch)
    total = files_read(history.keys())
    assert total == 5 * 16
    held = spark.read.schema("key string").parquet(*history.files_for(keys(spark, ["3:17", "1:5"])))
    assert 2 <= files_read(held) <= 4
    assert len(history.files_for(keys(spark, [f"none{i}" for i in range(50)]))) <= 10  # false positives of 250 tests
    assert history.compact(most_files=4) == 16
    assert len(history.files_for(keys(spark, ["3:17", "1:5"]))) <= 3


def test_large_buckets_have_several_files(spark, tmp_path):
    history = KeyedHistory(spark, str(tmp_path / "h"), buckets=2, file_keys=100)
    history.add(keys(spark, [f"x{i}" for i in range(1000)]), 0)
    assert len(history.files_for(keys(spark, [f"x{i}" for i in range(1000)]))) >= 10
    assert names(history.known(keys(spark, ["x5", "y5"]))) == ["x5"]


def test_a_batch_that_failed_half_way_is_run_again(spark, history):
    history.add(keys(spark, ["a"]), 0)
    keys(spark, ["lost"]).withColumns({"bucket": F.lit(0), "part": F.lit(0)}).write.partitionBy("bucket", "part").parquet(f"{history.path}/keys/batch=1")
    assert names(history.keys()) == ["a"]  # no filters, no files
    history.add(keys(spark, ["b"]), 1)
    history.add(keys(spark, ["b"]), 1)
    assert names(history.keys()) == ["a", "b"]
    assert names(history.known(keys(spark, ["a", "b"]), skip=1)) == ["a"]


def test_nothing_stored_and_nothing_asked(spark, history):
    assert history.known(keys(spark, ["a"])).count() == 0 and history.keys().count() == 0 and history.compact() == 0
    history.add(keys(spark, []), 0)
    history.add(keys(spark, ["a"]), 1)
    assert history.known(keys(spark, [])).count() == 0 and names(history.known(keys(spark, ["a"]))) == ["a"]


SCHEMA = "id string, url string, content string, embedding array<double>, published_at timestamp, created_at timestamp"


def item(i, url, content, minute, vec=None):
    return (i, url, content, vec, NOW + dt.timedelta(minutes=minute), NOW)


def test_null_and_repeated_ids_get_their_own_verdicts(spark):
    rows = [
        item(None, "https://a.org/1", "one", 0), item(None, "https://a.org/2", "two", 1), item(None, "https://a.org/1", "three", 2),
        item("x", "https://a.org/3", "four", 3), item("x", "https://a.org/4", "two", 4), item("x", "https://a.org/5", "five", 5),
        item("y", None, "six", 6), item("z", None, "six", 7), item("n", None, None, 8), item("n", None, None, 8), item("w", "https://a.org/9", None, 9),
        item("c", "https://a.org/c", "copy", 10), item("c", "https://a.org/c", "copy", 10), item("c", "https://a.org/c", "copy", 10),
    ]
    known = spark.createDataFrame([item("old", "https://a.org/5/", "nothing else", 0)], SCHEMA)
    got = dd.dedup_items(spark.createDataFrame(rows, SCHEMA).repartition(3), known, as_of=as_of())
    want = [
        (None, "one", None), (None, "two", None), (None, "three", "url_hash"), ("x", "four", None), ("x", "two", "content_fingerprint"), ("x", "five", "url_hash"),
        ("y", "six", None), ("z", "six", "content_fingerprint"), ("n", None, None), ("n", None, None), ("w", None, None),
        ("c", "copy", None), ("c", "copy", "url_hash"), ("c", "copy", "url_hash"),
    ]
    assert sorted(((r["id"], r["content"], r["reason"]) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_short_stored_hashes_are_not_trusted(spark):
    known = spark.createDataFrame([item("old", "https://a.org/1", "same text", 0)], SCHEMA).withColumn("content_hash", F.lit("0123456789abcdef"))
    batch = spark.createDataFrame([item("new", "https://a.org/2", "same text", 1)], SCHEMA)
    assert dd.dedup_items(batch, known, as_of=as_of(), vectors=False).first()["reason"] == "content_fingerprint"


def test_history_gives_the_verdicts_of_the_known_items(spark, history):
    rng = random.Random(4)
    rows = [item(f"i{k}", f"https://a.org/{rng.randint(0, 60)}", rng.choice([None, f"text {rng.randint(0, 60)}"]), k) for k in range(120)]
    old, new = spark.createDataFrame(rows[:60], SCHEMA), spark.createDataFrame(rows[60:], SCHEMA)
    history.add(dd.history_keys(old), 0)
    want = {(r["id"], r["reason"]) for r in dd.dedup_items(new, old, as_of=as_of(), vectors=False).collect()}
    assert {(r["id"], r["reason"]) for r in dd.dedup_items(new, old.where("false"), as_of=as_of(), vectors=False, history=history).collect()} == want
    assert {r for _, r in want} == {None, "url_hash", "content_fingerprint"}


def test_rows_without_url_or_id_are_unseen(spark):
    rows = [(None, None), (None, "https://a.org/1"), ("b", "https://a.org/1#x"), ("c", None), ("d", "https://a.org/2")]
    batch = spark.createDataFrame([(i, u, NOW) for i, u in rows], "id string, url string, published_at timestamp")
    known = spark.createDataFrame([("https://a.org/2",), (None,)], "url string")
    got = sorted(((r["id"], r["url"]) for r in jn.unseen_by_url(batch, known).collect()), key=repr)
    assert got == sorted([(None, None), ("c", None), (None, "https://a.org/1")], key=repr)
