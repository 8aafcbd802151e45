"""Ordered computations where one key holds most rows, against plain Python."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedloom.operators import cooldown as cd
from feedloom.operators import skew as sk
from feedloom.operators.cooldown import greedy_cooldown


@pytest.fixture(scope="module")
def data():
    r = random.Random(3)
    return [("hot" if r.random() < 0.6 else f"k{r.randrange(5)}", r.randrange(0, 5000), i, r.randrange(1, 9)) for i in range(600)]


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data, "k string, t int, i int, v int").repartition(5)


def ordered(data):
    by = {}
    for row in sorted(data, key=lambda x: (x[1], x[2])):
        by.setdefault(row[0], []).append(row)
    return by


# with at most 20 rows per slice the hot key's buckets are crowded and the rows are cut by range instead
@pytest.mark.parametrize("max_rows", [None, 20])
def test_running_totals(df, data, max_rows):
    run = sk.running_totals(df, ["k"], F.floor(F.col("t") / 700), [F.asc("t"), F.asc("i")], {"run": F.col("v"), "n": F.lit(1)}, max_rows)
    got = {r.i: (r.run, r.n) for r in run.collect()}
    for rows in ordered(data).values():
        total = 0
        for n, (_, _, i, v) in enumerate(rows, 1):
            total += v
            assert got[i] == (total, n)


@pytest.mark.parametrize("max_rows", [None, 5])
def test_previous_across_empty_buckets(df, data, max_rows):
    got = {r.i: r.prev_v for r in sk.previous_in_bucketed_order(df, ["k"], F.floor(F.col("t") / 90), ["t", "i"], ["v"], max_rows).collect()}
    for rows in ordered(data).values():
        for before, row in zip([None, *rows], rows):
            assert got[row[2]] == (before[3] if before else None)


@pytest.mark.parametrize("max_rows", [None, 30])
def test_global_row_number(df, data, max_rows):
    got = {r.i: r.n for r in sk.global_row_number(df, [F.asc("t"), F.asc("i")], F.floor(F.col("t") / 400), "n", max_rows).collect()}
    assert [got[x[2]] for x in sorted(data, key=lambda x: (x[1], x[2]))] == list(range(1, len(data) + 1))


@pytest.mark.parametrize("cooldown,base", [(1, 1_700_000_000), (7, 1_700_000_000), (5_000, 32_700), (40_000, 1)])
def test_greedy_cooldown(spark, data, cooldown, base):
    # the last cases straddle the bitmap borders
    step = 50 if cooldown > 100 else 1
    rows = [(k, base + t * step, i) for k, t, i, _ in data]
    d = spark.createDataFrame(rows, "key string, s long, i int").select(
        "key", F.timestamp_seconds("s").alias("ts"), F.col("i").alias("id"), F.lit(cooldown).alias("cooldown_seconds")
    )
    want = set()
    by = {}
    for k, s, i in sorted(rows, key=lambda x: (x[1], x[2])):
        if s >= by.get(k, -1):
            want.add((k, s, i))
            by[k] = s + cooldown
    got = {(r.key, r.second, r.id) for r in greedy_cooldown(d).collect()}
    assert got == want


def test_cooldown_over_batches_and_with_long_waits():
    rng, want, rows = random.Random(5), [], []
    for key in ["a", "b", "c", "d", "é"]:
        wait, ready = rng.choice([1, 3, 90, 2**40]), -(2**62)
        held = {}
        for s in sorted(rng.sample(range(-300, 900), 200)):
            held[s // 64 * 64] = held.get(s // 64 * 64, 0) | 1 << s % 64
            if s >= ready:
                want.append((key, s))
                ready = s + wait
        rows += [(key, base, bits - (bits >> 63 << 64), wait) for base, bits in held.items()]
    for size in (1, 2, 5, 7, len(rows)):
        parts = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[k : k + size])], ["key", "base", "bits", "cooldown_seconds"]) for k in range(0, len(rows), size)]
        assert [tuple(r.values()) for b in cd._fires(iter(parts)) for r in b.to_pylist()] == want


def test_a_lone_second_is_no_bitmap(spark):
    """Keys with few events cost by their events: no group of Python and no page of bits for each."""
    d = spark.range(50).select(F.concat(F.lit("k"), F.col("id") % 10).alias("key"), F.timestamp_seconds(F.col("id") * 86400).alias("ts"), "id", F.lit(60).alias("cooldown_seconds"))
    out = greedy_cooldown(d)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 50 and "bitmap_construct_agg" not in plan and "FlatMapGroups" not in plan


def test_one_second_holding_everything_is_split(spark):
    d = spark.range(500).select(F.lit("k").alias("k"), F.lit(1).alias("t"), F.col("id").alias("i")).repartition(7)
    run = sk.running_totals(d, ["k"], F.col("t"), [F.asc("t"), F.asc("i")], {"n": F.lit(1)}, 50)
    assert sorted((r.i, r.n) for r in run.collect()) == [(i, i + 1) for i in range(500)]
    cut, _ = sk.slices(d, ["k"], F.col("t"), [F.asc("t"), F.asc("i")], [F.max("i")], 50)
    assert max(r["count"] for r in cut.groupBy("_bucket").count().collect()) <= 100


@pytest.mark.parametrize("rows", [5])
def test_small_buckets_make_no_more_tasks(spark, rows):
    d = spark.range(20000).select(F.lit("k").alias("k"), F.col("id").alias("t"), F.pmod(F.col("id") * 7919, F.lit(20000)).alias("i"))
    cut, _ = sk.slices(d, ["k"], F.lit(1), [F.asc("i")], [F.max("i")], rows)
    assert cut.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert max(r["count"] for r in cut.groupBy("_bucket").count().collect()) <= rows
    run = sk.running_totals(d, ["k"], F.lit(1), [F.asc("i")], {"n": F.lit(1)}, rows)
    assert run.where("n <> i + 1").isEmpty()
