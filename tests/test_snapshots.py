"""Merges of keyed tables: what is rewritten, repeats, and a stop between write and commit."""

import pytest

from feedloom.sources.snapshots import KeyedTable

SCHEMA = "k string, v int"


def rows(spark, pairs):
    return spark.createDataFrame(pairs, SCHEMA)


@pytest.fixture()
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "t"), ("k",), buckets=8)


def held(table, version=None):
    return sorted(((r["k"], r["v"]) for r in table.read(SCHEMA, version).collect()), key=repr)


def test_merges_replace_add_and_delete(spark, table):
    assert held(table) == []
    first = [(f"k{i}", i) for i in range(40)] + [(None, 0)]
    assert table.merge(rows(spark, first), 0) == 8 and held(table) == sorted(first, key=repr)
    assert table.merge(rows(spark, [("k3", 33), (None, 1), ("new", 5)]), 1) <= 3
    want = dict(first) | {"k3": 33, None: 1, "new": 5}
    assert held(table) == sorted(want.items(), key=repr) and held(table, 0) == sorted(first, key=repr)
    gone = spark.createDataFrame([("k3", 0, True), ("k4", 44, False), ("absent", 0, True), (None, 0, True)], SCHEMA + ", gone boolean")
    table.merge(gone, 2, deleted="gone")
    want = {k: v for k, v in want.items() if k not in ("k3", None)} | {"k4": 44}
    assert held(table) == sorted(want.items(), key=repr)
    table.merge(rows(spark, []), 3)
    assert held(table) == sorted(want.items(), key=repr) and table.versions() == [0, 1, 2, 3]
    assert table.forget() > 0 and held(table) == sorted(want.items(), key=repr) and table.versions() == [3]


def test_only_touched_buckets_are_written(spark, table):
    table.merge(rows(spark, [(f"k{i}", i) for i in range(200)]), 0)
    table.merge(rows(spark, [("k7", -7)]), 1)
    written = table._manifest(None)
    assert sorted(written.values()) == [0] * 7 + [1]


def test_a_bucket_that_loses_all_rows(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ("k",), buckets=1)
    table.merge(rows(spark, [("a", 1)]), 0)
    table.merge(spark.createDataFrame([("a", 1, True)], SCHEMA + ", gone boolean"), 1, deleted="gone")
    assert held(table) == [] and held(table, 0) == [("a", 1)]


def test_a_stop_between_write_and_commit(spark, table, monkeypatch):
    table.merge(rows(spark, [(f"k{i}", i) for i in range(20)]), 0)
    before = held(table)

    def stop(self, held, version):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", stop)
        with pytest.raises(KeyboardInterrupt):
            table.merge(rows(spark, [("k1", 100), ("lost", 1)]), 1)
    assert held(table) == before and table.versions() == [0]
    for _ in range(2):  # the merge is run again, and once more
        table.merge(rows(spark, [("k1", 100)]), 1)
        assert dict(held(table)) == dict(before) | {"k1": 100}


def test_the_last_change_of_a_key_counts(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ("k",), buckets=4)
    table.merge(rows(spark, [("a", 3), ("a", 9), ("a", 5), ("b", 1)]), 0, order=["v"])
    assert held(table) == [("a", 9), ("b", 1)]
