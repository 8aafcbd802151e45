"""Exact nearest neighbours within a cosine radius, for any number of queries and base vectors.

On unit vectors the squared euclidean distance is twice the cosine distance, so a cosine radius is a euclidean one and
the triangle inequality holds. Each base vector lives in the cell of its nearest pivot; a query visits every cell that
can hold a vector within its radius (the distance to the bisecting plane between two pivots is a lower bound), so no
neighbour is missed. Cells are cut into blocks of bounded size by a hash of the vector, and a block pair is a sequence of
small matrix products (``block_rows`` on a side) that emits at most k + 1 rows per query. The blocks of a nearest-neighbour
join hold SHIPPED_ROWS at least, so that small tiles do not multiply what is shuffled.

Copies: equal vectors are one base row (with the k + 1 smallest ids) and one query row, whatever their number. A vector
held by a third of all rows therefore costs one row here; its members get the shared answer in the last join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom.operators.rank import top_per_group

BLOCK_ROWS = 4096
SHIPPED_ROWS = 16_384
NEAR_ROWS = 256
ROWS_PER_CELL = 20_000
MAX_PIVOTS = 1024
EPS = 1e-6


def vector_key(vec: Column) -> Column:
    """128-bit key of a vector's value."""
    return F.concat(F.hex(F.xxhash64(F.lit(1), vec)), F.hex(F.xxhash64(F.lit(2), vec)))


def unit_rows(vectors) -> np.ndarray:
    m = np.array(list(vectors), dtype=np.float64)
    if m.size == 0:
        return m.reshape(0, 0)
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def cosine_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.round(1.0 - a @ b.T, 6) + 0.0


def choose_pivots(base: DataFrame, pivots: int | None) -> np.ndarray | None:
    """A bounded set of base vectors, fixed by their hash so that a retry picks the same ones.

    Any choice gives the same answer; this one reads the base once and shuffles only a thin, hash-selected share of it.
    """
    wanted = pivots
    stride = 1
    if wanted is None:
        n = base.agg(F.approx_count_distinct("vkey")).first()[0]
        wanted = min(MAX_PIVOTS, n // ROWS_PER_CELL)
        stride = max(1, n // (8 * max(wanted, 1)))
    if wanted <= 1:
        return None
    thin = base.where(F.pmod(F.xxhash64(F.lit(3), "vec"), F.lit(stride)) == 0)
    rows = thin.groupBy("vkey").agg(F.any_value("vec").alias("vec")).orderBy("vkey").limit(wanted).collect()
    return unit_rows([r["vec"] for r in rows])


def _cells(df: DataFrame, pivots: np.ndarray | None, visit: bool) -> DataFrame:
    """Adds ``cell``: the home cell of a base row, or one row per cell a query has to visit."""
    if pivots is None:
        # computed, because a literal key would turn the joins on it into cross joins
        return df.withColumn("cell", F.pmod(F.xxhash64("vkey"), F.lit(1)).cast("int"))
    gap = np.sqrt(np.maximum(2.0 - 2.0 * (pivots @ pivots.T), 0.0))

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False)
            x = unit_rows(flat.reshape(batch.num_rows, -1))
            sq = np.maximum(2.0 - 2.0 * (x @ pivots.T), 0.0)
            cell = sq.argmin(axis=1)
            if visit:
                radius = batch.column("radius").to_numpy(zero_copy_only=False)
                reach = np.sqrt(2.0 * np.maximum(radius, 0.0)) + EPS
                spread = gap[cell]
                with np.errstate(divide="ignore", invalid="ignore"):
                    bound = (sq - sq[np.arange(len(x)), cell][:, None]) / (2.0 * spread)
                row, cell = np.nonzero((spread < EPS) | (bound <= reach[:, None]))
                batch = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype("int32"))], names=[*batch.schema.names, "cell"])

    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", cell int"
    return df.mapInArrow(assign, schema)


def _blocks(base: DataFrame, queries: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Number the blocks of every cell on both sides and send each row to the block pairs it takes part in."""
    nb = base.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("nb"))
    nq = queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("nq"))
    sizes = F.broadcast(nb.join(nq, "cell"))  # one row per cell: at most MAX_PIVOTS, or the leaves of an index
    slot = F.xxhash64("vkey")
    b = base.join(sizes, "cell").withColumn("bs", F.pmod(slot, "nb")).withColumn("qs", _slots("nq"))
    q = queries.join(sizes, "cell").withColumn("qs", F.pmod(slot, "nq")).withColumn("bs", _slots("nb"))
    return b.drop("nb", "nq"), q.drop("nb", "nq")


def _slots(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))


def _tiles(n: int, rows: int):
    return (slice(a, a + rows) for a in range(0, n, rows))


def _nearest_of_tile(q: np.ndarray, radius: np.ndarray, b: np.ndarray, k: int, inclusive: bool, rows: int):
    """(row of q, row of b, distance) of the k + 1 nearest rows of ``b`` within the radius, ties by row of ``b``. What is
    farther than the k + 1 found so far is left out before it is rounded or sorted."""
    row, col, dist = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    reach = radius.copy()
    for part in _tiles(len(b), rows):
        s = q @ b[part].T
        if part.start == 0 and s.shape[1] > k + 1:
            reach = np.minimum(reach, 1.0 - np.partition(s, s.shape[1] - k - 1, axis=1)[:, -k - 1] + EPS)
        i, j = np.nonzero(s >= (1.0 - reach - 2 * EPS)[:, None])
        d = np.round(1.0 - s[i, j], 6) + 0.0
        ok = d <= radius[i] if inclusive else d < radius[i]
        if not ok.any():
            continue
        row, col, dist = np.r_[row, i[ok]], np.r_[col, j[ok] + part.start], np.r_[dist, d[ok]]
        order = np.lexsort((col, dist, row))
        row, col, dist = row[order], col[order], dist[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        full = nth == k
        reach[row[full]] = np.minimum(reach[row[full]], dist[full] + EPS)
        row, col, dist = row[nth <= k], col[nth <= k], dist[nth <= k]
    return row, col, dist


def _block_pairs(k: int, inclusive: bool, tile_rows: int):
    def run(bdf: pd.DataFrame, qdf: pd.DataFrame) -> pd.DataFrame:
        out = {"vkey": [], "radius": [], "id": [], "distance": []}
        if len(bdf) and len(qdf):
            bdf = bdf.assign(first=[v[0] for v in bdf["ids"]]).sort_values("first", kind="stable")
            b, radius = unit_rows(bdf["vec"]), qdf["radius"].to_numpy(dtype=float)
            ids = bdf["ids"].to_numpy()
            sizes = np.fromiter((len(x) for x in ids), np.int64, len(ids))
            for part in _tiles(len(qdf), tile_rows):
                row, col, dist = _nearest_of_tile(unit_rows(qdf["vec"].iloc[part]), radius[part], b, k, inclusive, tile_rows)
                row, size = row + part.start, sizes[col]
                out["vkey"].append(np.repeat(qdf["vkey"].to_numpy()[row], size))
                out["radius"].append(np.repeat(radius[row], size))
                out["id"] += [x for j in col for x in ids[j]]
                out["distance"].append(np.repeat(dist, size))
            out = {c: v if c == "id" else np.concatenate(v) for c, v in out.items()}
        return pd.DataFrame(out).astype({"vkey": object, "radius": float, "id": object, "distance": float})

    return run


def nearest_within(
    queries: DataFrame, base: DataFrame, *, k: int = 1, radius: float | Column = 2.0, exclude_self: bool = True,
    inclusive: bool = False, pivots: int | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, id, distance, rn): the k nearest base rows of every query, ties by id.

    ``queries`` and ``base`` carry (id string, vec array); ``radius`` may be a column of ``queries``. Distances are
    compared after rounding to six digits. ``queries`` is read twice and must hold the same bits both times: store
    vectors that are computed by sums first.
    """
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    q = queries.where(F.col("vec").isNotNull()).select(
        F.col("id").alias("query_id"), vector_key(F.col("vec")).alias("vkey"), r.cast("double").alias("radius"), "vec"
    )
    b = base.where(F.col("vec").isNotNull()).select("id", vector_key(F.col("vec")).alias("vkey"), "vec")
    groups = copies(b, k)
    asked = q.groupBy("vkey", "radius").agg(F.any_value("vec").alias("vec"))
    centres = None
    if pivots is not None or not _fits_one_cell(b):
        centres = choose_pivots(b, pivots)
    return answers(q, _cells(groups, centres, False), _cells(asked, centres, True), k=k, exclude_self=exclude_self, inclusive=inclusive, block_rows=block_rows)


def copies(base: DataFrame, k: int, more: list[str] | None = None) -> DataFrame:
    """Equal vectors as one row: the k + 1 smallest ids each, cut inside the map tasks."""
    heads = top_per_group(base, ["vkey"], [F.asc("id")], k + 1)
    return heads.groupBy("vkey").agg(
        F.array_sort(F.collect_list("id")).alias("ids"), F.any_value("vec").alias("vec"), *[F.any_value(c).alias(c) for c in more or ()]
    )


def answers(q: DataFrame, base: DataFrame, asked: DataFrame, *, k: int, exclude_self: bool, inclusive: bool, block_rows: int) -> DataFrame:
    """Neighbours of the queries ``q`` from base rows and query rows that were sent to their cells."""
    # a row is sent once for each block of the other side: few large ones, which the task takes tile by tile
    bb, qq = _blocks(base, asked, max(block_rows, SHIPPED_ROWS))
    keys = ["cell", "bs", "qs"]
    hits = bb.groupBy(*keys).cogroup(qq.groupBy(*keys)).applyInPandas(
        _block_pairs(k, inclusive, block_rows), "vkey string, radius double, id string, distance double"
    )
    best = top_per_group(hits, ["vkey", "radius"], [F.asc("distance"), F.asc("id")], k + 1).drop("rn")
    out = q.drop("vec").join(best, ["vkey", "radius"])
    if exclude_self:
        out = out.where(F.col("id") != F.col("query_id"))
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return out.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select("query_id", "id", "distance", "rn")


def _near(bdf: pd.DataFrame, qdf: pd.DataFrame):
    """(first row, which base rows are within the radius) for few queries at a time: a block pair is no matrix of doubles."""
    b, radius = unit_rows(bdf["vec"]), qdf["radius"].to_numpy(dtype=float)[:, None]
    for part in _tiles(len(qdf), NEAR_ROWS):
        yield part.start, cosine_distances(unit_rows(qdf["vec"].iloc[part]), b) < radius[part]


def _block_first(bdf: pd.DataFrame, qdf: pd.DataFrame) -> pd.DataFrame:
    if not len(bdf) or not len(qdf):
        return pd.DataFrame({"vkey": [], "id": []}, dtype=object)
    bdf = bdf.sort_values("id", kind="stable")
    row, col = [], []
    for start, near in _near(bdf, qdf):
        some = np.flatnonzero(near.any(axis=1))
        row.append(start + some)
        col.append(near.argmax(axis=1)[some])
    return pd.DataFrame({"vkey": qdf["vkey"].to_numpy()[np.concatenate(row)], "id": bdf["id"].to_numpy()[np.concatenate(col)]})


def first_within(
    queries: DataFrame, base: DataFrame, *, radius: float, pivots: int | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(query_id, first): the smallest base id, not the closest, within the radius of every query that has one."""
    q = queries.where(F.col("vec").isNotNull()).select(
        F.col("id").alias("query_id"), vector_key(F.col("vec")).alias("vkey"), F.lit(float(radius)).alias("radius"), "vec"
    )
    b = base.where(F.col("vec").isNotNull()).select("id", vector_key(F.col("vec")).alias("vkey"), "vec")
    groups = b.groupBy("vkey").agg(F.min("id").alias("id"), F.any_value("vec").alias("vec"))
    asked = q.groupBy("vkey").agg(F.any_value("radius").alias("radius"), F.any_value("vec").alias("vec"))
    centres = None
    if pivots is not None or not _fits_one_cell(b):
        centres = choose_pivots(b, pivots)
    bb, qq = _blocks(_cells(groups, centres, False), _cells(asked, centres, True), block_rows)
    keys = ["cell", "bs", "qs"]
    hits = bb.groupBy(*keys).cogroup(qq.groupBy(*keys)).applyInPandas(_block_first, "vkey string, id string")
    return q.select("query_id", "vkey").join(hits.groupBy("vkey").agg(F.min("id").alias("first")), "vkey").drop("vkey")


def _block_all(bdf: pd.DataFrame, qdf: pd.DataFrame) -> pd.DataFrame:
    if not len(bdf) or not len(qdf):
        return pd.DataFrame({"vkey": [], "other": []}, dtype=object)
    row, col = [], []
    for start, near in _near(bdf, qdf):
        i, j = np.nonzero(near)
        row.append(start + i)
        col.append(j)
    i, j = np.concatenate(row), np.concatenate(col)
    return pd.DataFrame({"vkey": qdf["vkey"].to_numpy()[i], "other": bdf["vkey"].to_numpy()[j]})


def pairs_within(queries: DataFrame, base: DataFrame, *, radius: float, pivots: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, id): all base rows within the radius of each query. Its size is the number of links, so it is for rows
    whose dense groups were settled before."""
    def keyed(df):
        return df.where(F.col("vec").isNotNull()).select("id", vector_key(F.col("vec")).alias("vkey"), "vec")

    q, b = keyed(queries), keyed(base)
    centres = choose_pivots(b, pivots) if pivots is not None or not _fits_one_cell(b) else None
    groups, asked = (df.groupBy("vkey").agg(F.any_value("vec").alias("vec")) for df in (b, q))
    bb, qq = _blocks(_cells(groups, centres, False), _cells(asked.withColumn("radius", F.lit(float(radius))), centres, True), block_rows)
    keys = ["cell", "bs", "qs"]
    links = bb.groupBy(*keys).cogroup(qq.groupBy(*keys)).applyInPandas(_block_all, "vkey string, other string").distinct()
    out = links.join(q.select(F.col("id").alias("query_id"), "vkey"), "vkey")
    return out.join(b.select("id", F.col("vkey").alias("other")), "other").select("query_id", "id")


def _fits_one_cell(base: DataFrame) -> bool:
    """True when there are at most ROWS_PER_CELL base rows (stops counting just beyond that)."""
    return base.select("id").limit(ROWS_PER_CELL + 1).count() <= ROWS_PER_CELL
