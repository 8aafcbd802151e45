"""The stored vector index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.operators.vector_index import VectorIndex
from tests.conftest import files_read
from tests.test_vector_join import brute, frame, vectors  # noqa: F401


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):  # noqa: F811
    ix = VectorIndex(spark, str(tmp_path_factory.mktemp("v") / "ix"), tops=4, leaves=4).create(frame(spark, vectors))
    for k in range(3):
        ix.append(frame(spark, vectors[k::3]), k)
    return ix


@pytest.mark.parametrize("k,radius,inclusive", [(1, 0.15, False), (4, 0.4, True), (3, 2.0, False)])
def test_three_appends_answer_as_brute_force(spark, vectors, index, k, radius, inclusive):  # noqa: F811
    got = index.nearest(frame(spark, vectors), k=k, radius=radius, inclusive=inclusive, block_rows=16).collect()
    want = brute([(i, v.astype(float), radius) for i, v in vectors], [(i, v.astype(float)) for i, v in vectors], k, radius, True, inclusive)
    assert {(r.query_id, r.id, r.distance, r.rn) for r in got} == want


def test_a_query_visits_few_leaves_and_opens_few_folders(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 24))
    rows = [(f"v{i:04d}", (centres[i % 40] + 0.1 * rng.normal(size=24)).astype("float32")) for i in range(2000)]
    ix = VectorIndex(spark, str(tmp_path / "ix"), tops=16, leaves=16).create(frame(spark, rows)).append(frame(spark, rows), 0)
    asked = frame(spark, rows[:200]).select("vec", F.lit(0.05).alias("radius"))
    leaves = ix.rings().count()
    assert leaves > 60 and ix.visits(asked).count() <= 200 * leaves / 8
    tops = [r["top"] for r in ix.visits(asked.limit(1)).select("top").distinct().collect()]
    assert files_read(ix.stored().where(F.col("top").isin(tops))) < files_read(ix.stored()) / 2


def test_rings_hold_all_vectors(spark, vectors, index):  # noqa: F811
    pivots, _, _ = index.pivots()
    ring = {r["leaf"]: r for r in index.rings().collect()}
    assert sum(r["n"] for r in ring.values()) == len(vectors)
    for r in index.stored().collect():
        v = np.array(r["vec"]) / np.linalg.norm(r["vec"])
        d = np.linalg.norm(v - pivots[r["leaf"]])
        assert ring[r["leaf"]]["near"] - 1e-6 <= d <= ring[r["leaf"]]["far"] + 1e-6


def test_repeated_append_zero_and_null_vectors(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("z", [0.0, 0.0]), ("n", None)], "id string, vec array<float>")
    ix = VectorIndex(spark, str(tmp_path / "ix"), tops=2, leaves=2).create(rows)
    assert ix.nearest(rows).count() == 0
    ix.append(rows, 0).append(rows, 0)
    got = {(r.query_id, r.id, r.distance) for r in ix.nearest(rows, k=5, radius=1.0, inclusive=True).collect()}
    assert got == {(a, b, 1.0) for a in "abz" for b in "abz" if a != b}
    assert ix.nearest(rows.where("id = 'n'")).count() == 0
    with pytest.raises(ValueError):
        VectorIndex(spark, str(tmp_path / "none")).create(rows.where("id = 'z'")).append(rows, 0)
