"""Exact ordered computations on keys that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom.session import cut_lineage


SLICE_ROWS = 2_000_000


def slices(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], aggs: list[Column], max_rows: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows with ``_bucket``, one row of ``aggs`` per key and bucket).

    Buckets are pieces of a key that follow each other in ``order``, none of them crowded. The caller's bucket (a month,
    an hour, a slice of an id ...) is used where no (key, bucket) holds more than ``max_rows``; the counts come with the
    summaries the caller needs anyway, which are written once. Otherwise the rows are dealt by range on (keys, order) to
    tasks of up to SLICE_ROWS rows, and every ``max_rows`` rows of a sorted task are a bucket, so that even rows of one
    second are split and small buckets make no more tasks; the cut is checkpointed, because a retry could sample other
    bounds.
    """
    max_rows = SLICE_ROWS if max_rows is None else max_rows
    b = df.withColumn("_bucket", bucket)
    summary = cut_lineage(b.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"), *aggs))
    if summary.where(F.col("_rows") > max_rows).isEmpty():
        return b, summary.drop("_rows")
    total = summary.agg(F.sum("_rows")).first()[0]
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-2 * total // max(max_rows, SLICE_ROWS)))
    by = [*[F.col(k) for k in keys], *order]
    # numbered in order: the task in the upper bits, the row's place in it in the lower 33
    place = F.monotonically_increasing_id()
    cut = df.repartitionByRange(int(parts), *by).sortWithinPartitions(*by).withColumn("_bucket", place)
    cut = cut_lineage(cut.withColumn("_bucket", F.expr(f"_bucket - (_bucket & {2**33 - 1}) + (_bucket & {2**33 - 1}) div {max_rows}")))
    return cut, cut.groupBy(*keys, "_bucket").agg(*aggs)


def running_totals(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], values: dict[str, Column], max_rows: int | None = None
) -> DataFrame:
    """Inclusive running sums per key in order, without one task per key.

    ``bucket`` must be monotone in ``order``. Bucket totals are summed first; the running sum of those few rows gives
    each bucket its start, and the detailed window only ever sees one (key, bucket) at a time.
    """
    for name, value in values.items():
        df = df.withColumn(name, value)
    b, totals = slices(df, keys, bucket, order, [F.sum(n).alias(n) for n in values], max_rows)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *keys, "_bucket", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_start_{n}") for n in values]
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = b.join(starts, [*keys, "_bucket"])
    for n in values:
        joined = joined.withColumn(n, F.col(f"_start_{n}") + F.sum(n).over(inside))
    return joined.drop("_bucket", *[f"_start_{n}" for n in values])


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key; aggregates before the shuffle."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def previous_in_bucketed_order(
    df: DataFrame, keys: list[str], bucket: Column, order: list[str], columns: list[str], max_rows: int | None = None
) -> DataFrame:
    """Adds ``prev_<column>``: lag within the key, computed bucket by bucket.

    The first row of a bucket takes its predecessor from the last row of the nearest earlier bucket that has rows.
    """
    tail = F.max_by(F.struct(*columns), F.struct(*order)).alias("_tail")
    b, lasts = slices(df, keys, bucket, [F.asc(o) for o in order], [tail], max_rows)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_bucket")
    carried = lasts.select(*keys, "_bucket", F.lag("_tail").over(across).alias("_carry"))
    out = b.withColumn("_rn", F.row_number().over(inside))
    for c in columns:
        out = out.withColumn(f"prev_{c}", F.lag(c).over(inside))
    out = out.join(carried, [*keys, "_bucket"])
    for c in columns:
        out = out.withColumn(
            f"prev_{c}", F.when(F.col("_rn") == 1, F.col("_carry")[c]).otherwise(F.col(f"prev_{c}"))
        )
    return out.drop("_bucket", "_rn", "_carry")


def global_row_number(df: DataFrame, order: list[Column], bucket: Column, name: str, max_rows: int | None = None) -> DataFrame:
    """Row number over a whole frame without an unpartitioned window; ``bucket`` must be monotone in ``order``."""
    b, sizes = slices(df, [], bucket, order, [F.count(F.lit(1)).alias("_n")], max_rows)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_bucket").orderBy(*order)
    return b.join(starts, "_bucket").withColumn(name, F.col("_start") + F.row_number().over(inside)).drop("_bucket", "_start")
