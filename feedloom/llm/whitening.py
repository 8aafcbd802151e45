"""Whitening components of vectors by shifted Cholesky QR.

The centred fit rows A are orthogonalised by repeated distributed Gram passes: a pass solves the triangular systems of the
factors found so far (A R1^-1 R2^-1 ...), adds up its d x d Gram matrix over all tasks, and the matrix's Cholesky factor
R_k joins the product R = ... R2 R1. The first pass is shifted so that its factor exists whatever the condition; later
ones are not, unless a factor does not exist (dependent columns; a shift then scales the spectrum by 1 + 1e-9 or so and
leaves the components as they are). When the Gram matrix is the identity to rounding, A = QR with orthogonal Q, and the
singular values and right vectors of R alone are those of A: components and variances to double precision, where the
eigenvectors of the covariance itself would lose half of the digits of a weak component.

Entries are fixed-point numbers (``floor(scale * c)``), so sums and deviations are exact integers and equal vectors
are one fit row. The driver holds d x d matrices, never rows.

Edge cases: vectors that are null, empty or hold null or non-finite entries are dropped; so are those of another length
than the most common one (of equally common lengths the longest). Repeated rows weigh once in the fit and are all
returned. A component without variance (below 1e-13 of the largest) does not exist: one distinct vector, or none, gives
no rows. Components of equal variance are any orthonormal set; signs make the entry of largest magnitude positive. A
deviation beyond 64 bits is null. An extra column that clashes with a result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import released, stored, table, with_columns

PASSES = 6
EXACT = 2**62


def fixed_point(vector: Column, scale: int = 256) -> Column:
    """The entries as whole numbers; null where an entry is null or not finite."""
    good = F.size(vector) > 0
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return F.when(good & finite, F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + F.lit(0).cast("long")))


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """``rows @ inv(factor)`` for an upper triangular factor, column by column."""
    out = np.empty_like(rows)
    for j in range(factor.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def scaled_rows(flat: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S`` of whole vectors (rows), as 64-bit integers where they fit, else as Python integers."""
    x = flat.reshape(-1, len(sums))
    most = max(int(np.abs(x).max(initial=0)), abs(int(x.min(initial=0))))
    if n * most + max(map(abs, sums)) < EXACT:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(flat: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (scaled_rows(flat, n, sums) / n).astype(np.float64)


def deviations(flat: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of squares of ``n * x - S``."""
    y = scaled_rows(flat, n, sums)
    if y.dtype != object and len(sums) * int(np.abs(y).max(initial=0)) ** 2 >= EXACT:
        y = y.astype(object)
    total = (y * y).sum(axis=1)
    return [int(v) if v < 2**63 else None for v in total]


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def gram(fit: DataFrame, n: int, sums: list[int], factors: list[np.ndarray], project: np.ndarray | None = None) -> np.ndarray:
    """Gram matrix of the centred rows after the triangular solves (or a projection). Every batch gives its matrix; those
    are added by position."""
    size = len(sums) if project is None else project.shape[1]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in released(batches):
            rows = centred(_flat(batch.column(0)), n, sums)
            for f in factors:
                rows = solved(rows, f)
            if project is not None:
                rows = rows @ project
            total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.ravel())], ["at", "v"])

    sums_ = fit.select("x").mapInArrow(part, "at long, v double").groupBy("at").agg(F.sum("v").alias("v"))
    out = np.zeros(size * size)
    for r in sums_.collect():  # one row for each entry of the matrix
        out[r["at"]] = r["v"]
    return out.reshape(size, size)


def shifted_factor(g: np.ndarray, n: int, first: bool) -> np.ndarray:
    """Upper Cholesky factor of ``g``, shifted in the first pass and where there is none."""
    d = len(g)
    shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * max(np.linalg.norm(g, 2), np.finfo(float).tiny)
    if not first:
        try:
            return np.linalg.cholesky(g).T
        except np.linalg.LinAlgError:
            pass
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 10


def orthogonal_factor(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the QR decomposition of the centred fit rows."""
    factors: list[np.ndarray] = []
    whole = np.eye(len(sums))
    for k in range(PASSES):
        g = gram(fit, n, sums, factors)
        if k and np.abs(g - np.eye(len(g))).max() < 1e-14 * max(len(g), 64):
            break
        factors.append(shifted_factor(g, n, not k))
        whole = factors[-1] @ whole
    return whole


def components_of(factor: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(variances, falling; unit components as columns) of rows whose QR factor this is."""
    _, s, vt = np.linalg.svd(factor)
    sign = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)])
    return s**2 / n, (vt * sign[:, None]).T


def whiten(df: DataFrame, vector: str = "embedding", most: int = 4, scale: int = 256) -> DataFrame:
    """``df`` without its vector, one row for each remaining row and component (at most ``most``): ``component`` from 1 by
    falling variance, ``n`` fit rows, ``deviation``, ``whitened``, ``explained`` and ``identity_error``."""
    rows = with_columns(df, {"__x": fixed_point(df[vector], scale)}).drop(vector)
    rows = rows.drop("component", "n", "deviation", "whitened", "explained", "identity_error").where("__x is not null")
    rows = stored(rows, "vectors")
    common = rows.groupBy(F.size("__x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = common[0]["d"] if common else 0
    rows = rows.where(F.size("__x") == d)
    fit = stored(rows.select(F.col("__x").alias("x")).distinct(), "fit")
    sums = [0] * d
    total = fit.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    n = 0
    for r in total.collect():  # one row for each dimension
        sums[r["at"]], n = int(r["s"]), r["n"]
    variance, vectors = components_of(orthogonal_factor(fit, n, sums), n) if n else (np.zeros(0), np.zeros((0, 0)))
    kept = int((variance[:most] > max(variance.max(initial=0) * 1e-13, 0)).sum())
    project = vectors[:, :kept] / np.sqrt(variance[:kept]) if kept else np.zeros((d, 0))
    explained = (variance[:kept] / variance.sum()).tolist() if kept else []
    error = 0.0
    if kept:
        measured = gram(fit, n, sums, [], project) / n
        scale_ = np.sqrt(np.diag(measured))  # takes back what later shifts have added
        project = project / scale_
        error = float(np.abs(measured / np.outer(scale_, scale_) - np.eye(kept)).max())

    def projected(x: pa.Array) -> pa.Array:
        flat = _flat(x)
        scores = centred(flat, n, sums) @ project
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * kept), pa.array(scores.ravel()))
        return pa.StructArray.from_arrays([pa.array(deviations(flat, n, sums), pa.int64()), lists], ["deviation", "whitened"])

    projected.__annotations__ = {"x": pa.Array, "return": pa.Array}
    if not kept:
        out = rows.where(F.lit(False)).withColumn("__p", F.lit(None).cast("struct<deviation:long,whitened:array<double>>"))
    else:
        out = rows.withColumn("__p", F.arrow_udf(projected, "struct<deviation:long,whitened:array<double>>")("__x"))
    out = out.select(*[c for c in rows.columns if c != "__x"], "__p.deviation", F.posexplode("__p.whitened").alias("__k", "whitened"))
    share = F.get(F.array(*map(F.lit, explained)).cast("array<double>"), F.col("__k"))
    return out.select(
        *[c for c in rows.columns if c != "__x"], (F.col("__k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        share.alias("explained"), F.lit(error).alias("identity_error"),
    )


def op12_whitening(spark, sf_dir) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
