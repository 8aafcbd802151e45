"""Exact quantiles against sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.operators import order_stats as os_


def frame(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double").repartition(4)


CASES = {
    "one hot hour": [3600.0 + k / 7919 for k in range(6000)] + list(range(100)) + [1e6],
    "one value": [5.0] * 7000 + [1.0, 9.0],
    "two": [1.0, 2.0],
    "one": [3.5],
    "wide": [(-1) ** k * 10.0 ** (k % 300) for k in range(9000)],
    "extremes": [-1.7e308, 1.7e308, 0.0, 5e-324, None, float("nan")],
}


@pytest.mark.parametrize("name", CASES)
def test_quantiles_equal_those_of_the_sorted_values(spark, name, monkeypatch):
    monkeypatch.setattr(os_, "SMALL", 50)
    monkeypatch.setattr(os_, "CELLS", 64)
    values = [v for v in CASES[name] if v is not None and v == v]
    quantiles = [0.0, 0.01, 0.5, 0.95, 0.99, 1.0]
    got = os_.exact_quantiles(frame(spark, CASES[name]), F.col("v"), quantiles)
    with np.errstate(over="ignore"):
        want = np.quantile(np.array(values), quantiles) if name != "extremes" else None
    if want is not None:
        assert np.allclose(got, want, rtol=1e-12, atol=0)
    else:
        assert got[0] == -1.7e308 and got[-1] == 1.7e308


def test_no_values(spark):
    assert os_.exact_quantiles(frame(spark, [None, float("nan")]), F.col("v"), [0.5, 0.9]) == [None, None]


def test_no_task_meets_the_rows_of_a_hot_hour(spark):
    rows = spark.range(200_000).select((F.lit(3600.0) + F.rand(1) * 1e-3).alias("v")).repartition(8)
    n, by = os_.ranked_values(rows, F.col("v"), lambda n: [n // 2])
    assert n == 200_000 and 3600.0 < by[100_000] < 3600.001
