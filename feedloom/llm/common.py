"""Shared helpers: reading tables, folds, stored intermediate results."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.session import ensure_checkpoint_dir

T = TypeVar("T")
#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``.
WHITE = " \t\n\x0b\x0c\r"


#: Rows of an Arrow batch: texts are kilobytes long, and a worker holds a batch several times over.
BATCH_ROWS = 1000


def released(batches: Iterator[T]) -> Iterator[T]:
    """``batches``; after the last one the worker gives its free memory back, so that idle workers, which Spark keeps for
    later stages, stay small."""
    import ctypes
    import gc

    import pyarrow as pa

    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows in this session; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key falls into fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % F.lit(parts), F.lit(0)).cast("int")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back: lineage ends there, and every later
    reader scans files that outlive any executor."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """All columns of ``df`` but those that ``new`` replaces, then ``new``; every expression sees the old columns."""
    return df.select(*[df[c] for c in df.columns if c not in new], *[c.alias(n) for n, c in new.items()])


def text_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
