"""List operations against plain Python, whatever the order the rows arrive in."""

import random
from itertools import zip_longest

import pytest
from pyspark.sql import functions as F

from feedloom.operators import rank as rk


def rows(seed, n=40):
    r = random.Random(seed)
    out = []
    for i in range(n):
        out.append({
            "id": f"i{i:02d}", "pos": i + 1, "cluster_id": r.choice([None, "a", "b", "c"]), "relevance_score": round(r.random(), 2),
            "url": f"https://x.org/p{r.randrange(15)}" + r.choice(["", "#f", "?q=1"]), "source_type": r.choice(["rss", "hn", None, "npm"]),
            "size": r.randrange(1, 30),
        })
    return out


def frame(spark, data, seed=0):
    data = list(data)
    random.Random(seed).shuffle(data)
    schema = "id string, pos int, cluster_id string, relevance_score double, url string, source_type string, size int"
    return spark.createDataFrame([tuple(d[k] for k in ("id", "pos", "cluster_id", "relevance_score", "url", "source_type", "size")) for d in data], schema)


def collapse(data):
    best, count = {}, {}
    for d in data:
        k = d["cluster_id"]
        if k is not None:
            count[k] = count.get(k, 0) + 1
            if k not in best or d["relevance_score"] > best[k]["relevance_score"]:
                best[k] = d
    return [(d["id"], count.get(d["cluster_id"], 1)) for d in data if d["cluster_id"] is None or best[d["cluster_id"]] is d]


@pytest.mark.parametrize("seed", [1, 2])
def test_collapse_clusters(spark, seed):
    data = rows(seed)
    for shuffle in (0, 5):
        got = rk.collapse_clusters(frame(spark, data, shuffle)).orderBy("pos").collect()
        assert [(r.id, r.cluster_count) for r in got] == collapse(data)


@pytest.mark.parametrize("seed", [1, 2])
def test_diversify(spark, seed):
    data = rows(seed)
    groups = {}
    for d in data:
        groups.setdefault(d["source_type"] or "unknown", []).append(d["id"])
    want = [x for slot in zip_longest(*[g[:5] for g in groups.values()]) for x in slot if x]
    got = rk.diversify(frame(spark, data, 3)).orderBy("pos").collect()
    assert [r.id for r in got] == want
    assert [r.pos for r in got] == list(range(1, len(want) + 1))


def test_dedup_base_url(spark):
    data = rows(4)
    seen, want = set(), []
    for d in data:
        base = d["url"].split("#")[0]
        if base not in seen:
            seen.add(base)
            want.append(d["id"])
    assert [r.id for r in rk.dedup_base_url(frame(spark, data, 1)).orderBy("pos").collect()] == want


def test_dedup_briefing_takes_best_row_at_first_place(spark):
    data = [
        {"id": "a", "pos": 1, "cluster_id": None, "relevance_score": 0.2, "url": "https://x.org/p?1", "source_type": "rss", "size": 1},
        {"id": "b", "pos": 2, "cluster_id": None, "relevance_score": 0.5, "url": "https://x.org/q", "source_type": "rss", "size": 1},
        {"id": "c", "pos": 3, "cluster_id": None, "relevance_score": 0.9, "url": "https://x.org/p#z", "source_type": "rss", "size": 1},
        {"id": "d", "pos": 4, "cluster_id": "k", "relevance_score": 0.3, "url": "https://x.org/r", "source_type": "rss", "size": 1},
        {"id": "e", "pos": 5, "cluster_id": "k", "relevance_score": 0.4, "url": "https://x.org/s", "source_type": "rss", "size": 1},
    ]
    got = rk.dedup_briefing(frame(spark, data, 2)).orderBy("pos").collect()
    assert [r.id for r in got] == ["c", "b", "e"]


@pytest.mark.parametrize("budget", [1, 40, 100, 10_000])
def test_pack_budget(spark, budget):
    data = rows(6)
    want, used = [], 0
    for d in data:
        if used + d["size"] > budget and want:
            break
        want.append(d["id"])
        used += d["size"]
    got = rk.pack_budget(frame(spark, data, 9), F.col("size"), budget).orderBy("pos").collect()
    assert [r.id for r in got] == want


def test_merge_in_order_and_fusion(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, pos int")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "id string, pos int")
    assert [r.id for r in rk.merge_in_order(a, b, "id").orderBy("pos").collect()] == ["x", "y", "z"]
    lists = [(f.withColumnRenamed("pos", "rn"), w) for f, w in ((a, 0.25), (b, 0.75))]
    got = {r.id: r.rank_score for r in rk.reciprocal_rank_merge(lists).collect()}
    assert got["y"] == pytest.approx(0.25 / 62 + 0.75 / 61)
