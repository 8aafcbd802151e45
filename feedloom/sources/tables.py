"""Canonical tables on files, and append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

c = F.col


def write_items(items: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Items by creation day: a recency filter reads only the days it needs. Rows are spread by id inside a day."""
    days = items.withColumn("day", F.to_date("created_at"))
    days.write.mode(mode).partitionBy("day").parquet(path)


def read_items(spark: SparkSession, path: str, since_day: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(c("day") >= F.lit(since_day).cast("date")) if since_day else df


def append_log(rows: DataFrame, path: str) -> None:
    """Query log, feedback and delivery rows: append only, one folder per day."""
    rows.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def append_stream(rows: DataFrame, path: str, checkpoint: str):
    """The same for a stream; the file sink's log makes every batch appear once."""
    return (
        rows.withColumn("day", F.to_date("created_at"))
        .writeStream.format("parquet").outputMode("append").partitionBy("day")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
