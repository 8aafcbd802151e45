"""Token counts through a digest cache.

A stored table maps (content digest, tokenizer version) to a count. Documents are reduced to digests of their normalised
content (null as empty, outer spaces dropped, neither of which this tokenizer counts); digests missing from the cache are
made unique, only one document for each of them is encoded, and the new counts are appended. The tokenizer's version is
the digest of its file, so a changed file never meets old counts.

Edge cases: null and empty texts count zero tokens; texts of any length are counted whole; rows with null ids are rows of their own; repeated rows and copies share one encoding; an empty table appends nothing;
columns named like a result are replaced. Words are remembered inside a worker (bounded), which changes no count:
white space ends every match of this tokenizer's pattern.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import released, stored, table, with_columns
from feedloom.llm.vocab import MEMO, json_tokenizer, vocabulary_path
from feedloom.session import ensure_checkpoint_dir

CACHE_SCHEMA = "digest binary, version string, n_tokens long"
_KNOWN: dict[str, dict[str, int]] = {}


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:32]


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.btrim(F.coalesce(text, F.lit(""))).cast("binary"), 256))


def counter(path: str):
    """pandas UDF: tokens of each text."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = json_tokenizer(path).encode_batch_fast
        known = _KNOWN.setdefault(path, {})
        for texts in released(batches):
            totals = []
            for start in range(0, len(texts), 200):
                rows = [(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts[start : start + 200]]
                new = list({w for r in rows for w in r if w not in known})
                if len(known) + len(new) > MEMO:
                    known.clear()
                    new = list({w for r in rows for w in r})
                for i in range(0, len(new), 5000):
                    some = new[i : i + 5000]
                    known.update(zip(some, map(len, encode(some, add_special_tokens=False))))
                totals += [sum(map(known.__getitem__, r)) for r in rows]
            yield pd.Series(totals, dtype="int64")

    return count


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame | None:
    """Counts stored for this version, one row per digest also where a job that failed after its append, or two jobs at once,
    have stored a digest twice (equal counts); None where the folder has no table yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    rows = spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("version") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, cache: str, id_col: str = "doc_id", text: str = "text", vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """``docs`` without its text, with ``n_bytes`` and ``n_tokens``. ``cache``: folder of the stored counts."""
    spark = docs.sparkSession
    path = vocabulary_path(vocabulary)
    version = tokenizer_version(path)
    narrow = with_columns(docs, {"n_bytes": F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long"), "__d": content_digest(F.col(text))})
    narrow = stored(narrow.drop(text, "n_tokens"), "digests")
    have = read_cache(spark, cache, version)
    wanted = narrow.select(F.col("__d").alias("digest"), F.coalesce(F.xxhash64(id_col), F.lit(0)).alias("__k")).groupBy("digest").agg(F.min("__k").alias("__k"))
    if have is not None:
        wanted = wanted.join(have, "digest", "left_anti")
    # one document per missing digest; the wide side is neither sorted nor aggregated
    chosen = docs.select(content_digest(F.col(text)).alias("digest"), F.coalesce(F.xxhash64(id_col), F.lit(0)).alias("__k"), F.col(text).alias("__t"))
    misses = chosen.join(wanted.hint("shuffle_hash"), ["digest", "__k"])
    counted = misses.select("digest", F.lit(version).alias("version"), counter(path)("__t").alias("n_tokens"))
    counted.dropDuplicates(["digest"]).select("digest", "version", "n_tokens").write.mode("append").parquet(cache)
    counts = read_cache(spark, cache, version).withColumnRenamed("digest", "__d")
    return narrow.join(counts, "__d").drop("__d")


def op7_token_counts(spark, sf_dir) -> DataFrame:
    cache = f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-counts-{uuid.uuid4().hex}"
    counts = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), cache)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
