"""A stored index of vectors: a pivot tree of two levels over partitioned files, extended batch by batch.

``create`` draws the pivots from a bounded sample: top pivots, and leaf pivots inside each top cell. ``append`` sends each
vector down the tree (nearest top pivot, then the nearest leaf pivot below it) and writes it into the folder of its top
cell, sorted by leaf; with it goes one row for each leaf: its vectors and how near and how far the nearest and the
farthest of them are from its pivot. A search visits a leaf only if the query's ball meets that ring (triangle
inequality), so any pivots give exact answers, and it opens only the folders of top cells that are visited.

The number of leaves is a parameter of the index (4,096 by default), so pivots and rings are bounded tables; vectors never
reach the driver. A batch counts once its rings are committed, the last step of an append; run again under its number,
it overwrites what a failure left. Ids are distinct across batches. Null vectors are not stored; a zero vector has
distance 1 to every vector.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedloom.operators.vector_join import BLOCK_ROWS, EPS, answers, copies, unit_rows, vector_key

ROWS = 1024  # queries whose distances to all leaves are held at a time
SAMPLE = 2  # sampled vectors for each leaf


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean; pivots are unit vectors, a zero row of ``x`` is at distance 1."""
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + 1.0 - 2.0 * (x @ pivots.T), 0.0))


def _rows(batch: pa.RecordBatch, column: str) -> np.ndarray:
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return unit_rows(flat.reshape(batch.num_rows, -1))


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    tops: int = 64
    leaves: int = 64  # of each top cell

    # ---- writing ----

    def create(self, sample: DataFrame) -> VectorIndex:
        """Choose the pivots from a bounded number of the vectors (``vec``), picked by hash."""
        s = sample.where(F.col("vec").isNotNull()).select("vec", vector_key(F.col("vec")).alias("vkey"))
        rows = s.groupBy("vkey").agg(F.any_value("vec").alias("vec")).orderBy("vkey").limit(SAMPLE * self.tops * self.leaves).collect()
        x = unit_rows([r["vec"] for r in rows])
        x = x[(x != 0).any(axis=1)] if len(x) else x
        tops = x[: self.tops]
        out = []
        home = _distances(x, tops).argmin(axis=1) if len(x) else np.zeros(0, int)
        for t in range(len(tops)):
            out += [(t, tops[t].tolist(), p.tolist()) for p in x[home == t][: self.leaves]]
        self.spark.createDataFrame([(leaf, *row) for leaf, row in enumerate(out)], "leaf int, top int, top_pivot array<double>, pivot array<double>").write.mode("overwrite").parquet(f"{self.path}/pivots")
        return self

    def pivots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf pivots, top of each leaf, top pivots)."""
        rows = self.spark.read.parquet(f"{self.path}/pivots").orderBy("leaf").collect()
        top = np.array([r["top"] for r in rows], int)
        first = np.unique(top, return_index=True)[1] if len(rows) else []
        return np.array([r["pivot"] for r in rows]), top, np.array([rows[i]["top_pivot"] for i in first])

    def append(self, vectors: DataFrame, batch: int) -> VectorIndex:
        """Add (id string, vec array)."""
        pivots, top_of, tops = self.pivots()
        if not len(pivots):
            raise ValueError("the index has no pivots: create it from vectors that are not all zero")
        children = [np.flatnonzero(top_of == t) for t in range(len(tops))]

        def descend(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                x = _rows(b, "vec")
                home = _distances(x, tops).argmin(axis=1)
                leaf, far = np.zeros(len(x), np.int32), np.zeros(len(x))
                for t in np.unique(home):
                    at = np.flatnonzero(home == t)
                    d = _distances(x[at], pivots[children[t]])
                    leaf[at], far[at] = children[t][d.argmin(axis=1)], d.min(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf), pa.array(far), pa.array(home.astype(np.int32))], [*b.schema.names, "leaf", "far", "top"])

        v = vectors.where(F.col("vec").isNotNull()).select("id", "vec")
        schema = ", ".join(f"{c} {t}" for c, t in v.dtypes) + ", leaf int, far double, top int"
        placed = v.mapInArrow(descend, schema)
        # a leaf with most vectors is spread over files by its ids
        data = f"{self.path}/data/batch={batch}"
        placed.repartition(F.col("top"), F.col("leaf"), F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("top", "leaf").write.mode("overwrite").partitionBy("top").parquet(data)
        rings = self.spark.read.schema(schema).parquet(data).groupBy("top", "leaf").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("near"), F.max("far").alias("far"))
        rings.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/rings/batch={batch}")
        return self

    # ---- reading ----

    def _batches(self) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rings")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        done = [s.getPath() for s in fs.listStatus(root)]
        return sorted(int(p.getName().split("=")[1]) for p in done if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def rings(self) -> DataFrame:
        """(top, leaf, n, near, far) over all committed batches: at most one row per leaf."""
        rows = self.spark.read.schema("top int, leaf int, n long, near double, far double").parquet(*[f"{self.path}/rings/batch={b}" for b in self._batches()])
        return rows.groupBy("top", "leaf").agg(F.sum("n").alias("n"), F.min("near").alias("near"), F.max("far").alias("far"))

    def visits(self, asked: DataFrame) -> DataFrame:
        """``asked`` (vec, radius) with ``cell``, one row for each leaf that its ball meets."""
        pivots, top_of, _ = self.pivots()
        near, far = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
        for r in self.rings().collect():
            near[r["leaf"]], far[r["leaf"]] = r["near"], r["far"]
        held = np.flatnonzero(far >= 0)

        def meet(batches):
            for whole in batches:
                for a in range(0, whole.num_rows, ROWS):
                    b = whole.slice(a, ROWS)
                    x, reach = _rows(b, "vec"), np.sqrt(2.0 * np.maximum(b.column("radius").to_numpy(zero_copy_only=False), 0.0))[:, None] + EPS
                    d = _distances(x, pivots[held])
                    row, cell = np.nonzero((d <= far[held] + reach) & (d >= near[held] - reach))
                    b = b.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(held[cell].astype(np.int32)), pa.array(top_of[held[cell]].astype(np.int32))], [*b.schema.names, "cell", "top"])

        return asked.mapInArrow(meet, ", ".join(f"{c} {t}" for c, t in asked.dtypes) + ", cell int, top int")

    def nearest(self, queries: DataFrame, *, k: int = 1, radius: float | Column = 2.0, exclude_self: bool = True, inclusive: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
        """As ``vector_join.nearest_within`` with the stored vectors as base: (query_id, id, distance, rn)."""
        r = radius if isinstance(radius, Column) else F.lit(float(radius))
        q = queries.where(F.col("vec").isNotNull()).select(F.col("id").alias("query_id"), vector_key(F.col("vec")).alias("vkey"), r.cast("double").alias("radius"), "vec")
        batches = self._batches()
        if not batches:
            return q.where(F.lit(False)).select("query_id", F.col("query_id").alias("id"), F.lit(0.0).alias("distance"), F.lit(1).alias("rn"))
        asked = q.groupBy("vkey", "radius").agg(F.any_value("vec").alias("vec"))
        met = self.visits(asked)
        tops = sorted(r["top"] for r in met.select("top").distinct().collect())  # at most ``tops`` numbers
        base = self.stored(batches).where(F.col("top").isin(tops) if tops else F.lit(False))
        heads = copies(base.select("id", vector_key(F.col("vec")).alias("vkey"), "vec", F.col("leaf").alias("cell")), k, ["cell"])
        return answers(q, heads, met.drop("top"), k=k, exclude_self=exclude_self, inclusive=inclusive, block_rows=block_rows)

    def stored(self, batches: list[int] | None = None) -> DataFrame:
        """(id, vec, leaf, far, top) of all committed batches."""
        folders = [f"{self.path}/data/batch={b}" for b in (self._batches() if batches is None else batches)]
        return self.spark.read.option("basePath", f"{self.path}/data").parquet(*folders).drop("batch")
