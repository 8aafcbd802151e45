"""Whitening against exact integers and the plain eigenvectors of the covariance."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import whitening
from feedloom.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, component string, n string, whitened string, explained string, deviation string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "clash", "clash", "clash", "clash", "clash") for i, v in enumerate(vectors)], SCHEMA).repartition(4)


def brute(vectors, scale=256):
    """{row: (deviation, whitened values)}, variances, trace; numpy's eigenvectors of the covariance of distinct rows."""
    good = {i: v for i, v in enumerate(vectors) if v and all(c is not None and math.isfinite(c) for c in v)}
    x = {i: tuple(math.floor(np.float64(np.float32(c)) * scale) for c in v) for i, v in good.items()}
    fit = sorted(set(x.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    a = np.array(fit, float) - np.array(sums, float) / n
    e, v = np.linalg.eigh(a.T @ a / n)
    e, v = e[::-1], v[:, ::-1]
    dev = {i: sum((n * c - s) ** 2 for c, s in zip(row, sums)) for i, row in x.items()}
    white = {i: (np.array(row, float) - np.array(sums, float) / n) @ v[:, :4] / np.sqrt(np.maximum(e[:4], 1e-300)) for i, row in x.items()}
    return n, dev, white, e


def check(rows, vectors, components=4):
    n, dev, white, e = brute(vectors)
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(got) == set(dev) and all(set(g) == set(range(1, components + 1)) for g in got.values())
    for k in range(1, components + 1):
        mine = np.array([got[i][k]["whitened"] for i in sorted(got)])
        other = np.array([white[i][k - 1] for i in sorted(got)])
        assert min(np.abs(mine - other).max(), np.abs(mine + other).max()) < 1e-7
    for i, g in got.items():
        for k, r in g.items():
            assert r["n"] == n and r["deviation"] == dev[i] and r["identity_error"] < 1e-9
            assert math.isclose(r["explained"], e[k - 1] / e.sum(), rel_tol=1e-9)


def test_whitening_of_spread_and_copied_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 9)) * np.array([8, 5, 3, 2, 1, 1, 0.5, 0.3, 0.2])
    vectors = [v.tolist() for v in base]
    vectors += [vectors[0]] * 150 + [None, [], [None] + vectors[1][1:], [float("nan")] + vectors[1][1:], [float("inf")] + vectors[1][1:], [1.0, 2.0]]
    docs = frame(spark, vectors)
    check(whitening.whiten(docs).collect(), vectors[:-1])


def test_dependent_columns_have_fewer_components(spark):
    rng = np.random.default_rng(6)
    few = rng.integers(-400, 400, (50, 2))
    vectors = [[float(a), float(b), float(a + b), 7.0, float(a)] for a, b in few]
    check(whitening.whiten(frame(spark, vectors)).collect(), vectors, components=2)


def test_large_entries_stay_exact(spark):
    vectors = [[float(2**k), float(-(2**40) * k), 1.0] for k in range(30)]
    rows = whitening.whiten(frame(spark, vectors)).where("component = 1").collect()
    _, dev, _, _ = brute(vectors)
    assert {r["vec_id"]: r["deviation"] for r in rows} == {i: d if d < 2**63 else None for i, d in dev.items()}
    top = [[3e38, 1.0], [-3e38, 2.0], [0.0, 3.0]]
    rows = whitening.whiten(frame(spark, top)).where("component = 1").collect()
    assert {r["vec_id"]: r["deviation"] is None for r in rows} == {0: True, 1: True, 2: False}


@pytest.mark.parametrize("vectors", [[], [None, []], [[1.0, 2.0]], [[1.0, 2.0]] * 5])
def test_no_variance_no_components(spark, vectors):
    out = whitening.whiten(frame(spark, vectors))
    assert out.collect() == [] and out.columns[-5:] == ["n", "deviation", "whitened", "explained", "identity_error"]


def test_shifted_passes_reach_orthogonality_where_one_does_not():
    rng = np.random.default_rng(7)
    q = np.linalg.qr(rng.standard_normal((400, 6)))[0]
    a = q * np.logspace(0, -7, 6) @ np.linalg.qr(rng.standard_normal((6, 6)))[0]
    whole, now, steps = np.eye(6), a, []
    for k in range(4):
        r = whitening.shifted_factor(now.T @ now, 400, not k)
        whole, now = r @ whole, whitening.solved(now, r)
        steps.append(np.abs(now.T @ now - np.eye(6)).max())
    assert steps[0] > 1e-3 and steps[-1] < 1e-13
    assert np.allclose(np.linalg.svd(whole)[1], np.logspace(0, -7, 6), rtol=1e-8)


def test_query_on_the_given_vectors(spark):
    sf = "/root/testdata/sf0.001"
    vectors = [r["embedding"] for r in table(spark, sf, "embeddings").orderBy("vec_id").collect()]
    check(whitening.op12_whitening(spark, sf).collect(), vectors)
    assert whitening.op12_whitening(spark, sf).where(F.col("identity_error") > 1e-10).count() == 0
