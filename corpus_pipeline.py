"""The corpus pipeline: quality rules, toxicity, SimHash near-duplicates, repeated passages, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all documents that the stage before kept; its result is
written as Parquet and read again. All but the last return the columns of ``documents``. Edge cases are those of the
operators: null texts have no words and fail the quality rules; the near-duplicate stage goes by texts, whatever the ids:
rows of different groups stay also with equal or null ids; a document whose whole text repeats stays with an empty text and packs its end id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import packing, quality, simhash, suffixes, toxicity
from feedloom.llm.common import fold, stored, table, with_columns
from feedloom.session import ensure_checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a risk-controlled cutoff rejects go."""
    return quality.quality_rules(docs, table(spark, sf_dir, "labels")).where("kept").select(docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go. The lexicon is learned from the stage's input."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return toxicity.toxicity(docs, lexicon).where("predicted = 0").select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts (five-word shingles, Jaccard 0.8 or more) one row stays, that with the smallest id."""
    parts = simhash.similar_texts(docs)
    keyed = with_columns(docs, {"__node": simhash.text_key(F.col("text")), "__row": F.xxhash64(*docs.columns)})
    # a row without an id is last; rows of one __row are equal in every column
    each = keyed.groupBy("__node", "__row").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"))
    low = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row", "__node", "n")).alias("low")
    nodes = each.groupBy("__node").agg(low).join(parts, F.col("__node") == F.col("node"), "left")
    first = nodes.groupBy(F.coalesce("component", "__node")).agg(F.min("low").alias("low")).select("low.__node", "low.__row", "low.n")
    first = stored(first, "kept")
    kept = [keyed.join(first.where(one).hint("shuffle_hash"), ["__node", "__row"], "left_semi") for one in ("n = 1", "n > 1")]
    return kept[0].unionByName(kept[1].dropDuplicates(["__node", "__row"])).select(docs.columns)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that occur more than once go; characters that a cut has split go with them."""
    cut = suffixes.drop_repeats(docs, whole_characters=True)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_bytes").cast("string"))
    return with_columns(cut, {"text": text, "n_chars": F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length(text).cast("long"))}).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its sequence and offset."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near-duplicates", near_dedup_stage),
    ("repeated passages", passages_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    home = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{k}")
        docs = spark.read.parquet(f"{home}/{k}")
    return docs
