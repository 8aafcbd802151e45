"""Passages that two sets of texts share, by joins of word n-grams.

A text's words are runs of letters and digits, lower-cased; its n-grams are hashed inside the row that holds it. Coverage
of an item needs to know only whether a gram occurs in the other set at all: distinct grams meet distinct grams, so a gram
that stands in a third of all texts is one row. Runs need the pairs: copies of a text are one text there, hits that follow
each other in both texts (one diagonal) are merged into runs, and skewed grams are split by the adaptive join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom.functions import text as tx

c = F.col
WORDS = 8


def gram_hashes(tokens: Column, n: int) -> Column:
    """128-bit keys of the n-grams, by place; none for fewer than n words. The words are taken from the text once: as the
    variable of an outer lambda, for an expression inside the inner one is evaluated again at every place."""
    def keys(t: Column) -> Column:
        def key(i: Column) -> Column:
            text = F.array_join(F.slice(t, i + 1, n), " ")
            return F.struct(F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"))

        places = F.when(F.size(t) >= n, F.sequence(F.lit(0), F.size(t) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, key)

    return F.flatten(F.transform(F.array(tokens), keys))


def _grams(rows: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, words, place, gram)."""
    words = tx.tokens(c(text))
    return rows.select(key, F.size(words).alias("words"), F.posexplode(gram_hashes(words, n)).alias("place", "gram"))


def passage_coverage(items: DataFrame, docs: DataFrame, *, key: str = "item_id", text: str = "text", doc_text: str = "text", n: int = WORDS) -> DataFrame:
    """(key, words, grams, hits, covered, coverage): for each item how many of its n-grams stand in ``docs`` and how many of
    its words lie in such a gram. Items of fewer words have no grams and coverage 0; null texts have no words. Rows of one
    key count together."""
    # array_distinct would compare each gram of a text with each other one; distinct() combines them by hash inside the map task
    held = docs.select(F.explode(gram_hashes(tx.tokens(c(doc_text)), n)).alias("gram")).distinct()
    mine = _grams(items.withColumn("_id", F.struct(F.xxhash64(text), c(key))), "_id", text, n)
    found = mine.select("gram").distinct().join(held, "gram", "left_semi").withColumn("hit", F.lit(True))
    marked = mine.join(found, "gram", "left").where("hit")
    # words that a hit adds: up to n, fewer where the hit before it reaches into them; a text's hits stay with the text
    before = F.lag("place").over(Window.partitionBy("_id").orderBy("place"))
    new = F.least(F.lit(n), F.coalesce(c("place") - before, F.lit(n)))
    per = marked.dropDuplicates(["_id", "place"]).select("_id", new.alias("new")).groupBy("_id").agg(F.count(F.lit(1)).alias("hits"), F.sum("new").alias("covered"))
    sizes = items.select(F.struct(F.xxhash64(text), c(key)).alias("_id"), c(key), F.size(tx.tokens(c(text))).alias("words")).distinct()
    rows = sizes.join(per, "_id", "left")
    out = rows.groupBy(key).agg(
        F.sum("words").alias("words"), F.sum(F.greatest(c("words") - (n - 1), F.lit(0))).alias("grams"), F.sum(F.coalesce("hits", F.lit(0))).alias("hits"),
        F.sum(F.coalesce("covered", F.lit(0))).alias("covered"),
    )
    return out.withColumn("coverage", F.when(c("words") > 0, F.round(c("covered") / c("words"), 6)).otherwise(F.lit(0.0)))


def passage_runs(items: DataFrame, docs: DataFrame, *, key: str = "item_id", doc_key: str = "doc_id", text: str = "text", n: int = WORDS, least: int = WORDS) -> DataFrame:
    """(key, doc_key, item_from, doc_from, words): maximal runs of at least ``least`` words that an item and a document share.
    Of documents with the same text the smallest key stands for all."""
    one = docs.groupBy(F.sha2(text, 256).alias("_copy")).agg(F.min(doc_key).alias(doc_key), F.any_value(text).alias(text))
    mine = _grams(items, key, text, n).select(key, c("place").alias("item_place"), "gram")
    # only grams of items travel, and only those of documents that an item has
    wanted = mine.select("gram").distinct()
    theirs = _grams(one, doc_key, text, n).select(doc_key, c("place").alias("doc_place"), "gram").join(wanted, "gram", "left_semi")
    pairs = mine.join(theirs, "gram").select(key, doc_key, "item_place", "doc_place").distinct()
    lane = Window.partitionBy(key, doc_key, c("doc_place") - c("item_place")).orderBy("item_place")
    run = pairs.withColumn("_start", c("item_place") - F.row_number().over(lane))
    out = run.groupBy(key, doc_key, (c("doc_place") - c("item_place")).alias("_lane"), "_start").agg(
        F.min("item_place").alias("item_from"), F.min("doc_place").alias("doc_from"), (F.count(F.lit(1)) + (n - 1)).alias("words")
    )
    return out.where(c("words") >= least).drop("_lane", "_start")
