"""Near-copies inside one batch, against storing its rows one by one."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.plans import dedup as dd
from workload.adapter import as_of

NOW = dt.datetime(2024, 1, 31)


@pytest.mark.parametrize("threshold", [0.08, 0.3])
def test_near_copies_inside_a_batch(spark, threshold):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, 6))
    rows = []
    for i in range(60):
        v = centres[i % 5] + (0.35 * rng.normal(size=6) if i % 4 else 0)
        published = None if i % 13 == 0 else NOW - dt.timedelta(minutes=int(rng.integers(0, 40)))
        rows.append((f"i{i:02d}", f"https://a.org/{i}", f"text {i}", [float(x) for x in v], published, NOW - dt.timedelta(days=30 if i % 9 == 0 else 1)))
    batch = spark.createDataFrame(rows, "id string, url string, content string, embedding array<double>, published_at timestamp, created_at timestamp")
    none = batch.where(F.lit(False))
    stored, kept = [], set()
    for i, _, _, v, published, created in sorted(rows, key=lambda r: (r[4] or dt.datetime.min, r[0])):
        v = np.array(v)
        if any(round(1 - float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 6) < threshold for w in stored):
            continue
        kept.add(i)
        if created >= NOW - dt.timedelta(days=7):
            stored.append(v)
    got = dd.keep_new(batch, none, as_of=as_of(), threshold=threshold)
    assert {r.id for r in got.collect()} == kept and len(kept) < 60
