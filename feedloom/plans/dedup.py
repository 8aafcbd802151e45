"""Three-layer de-duplication of a new batch against known items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom.functions import text as tx
from feedloom.functions import urls as ux
from feedloom.operators import filters as fl
from feedloom.operators.vector_join import first_within, pairs_within
from feedloom.plans.similar import near_duplicates
from feedloom.session import cut_lineage
from feedloom.sources.history import KeyedHistory

c = F.col


def _keys(df: DataFrame) -> dict[str, Column]:
    """Key columns of the url and the text; the stored hashes where the table has them in the form of these keys."""
    made = {"url_key": ("url_hash", ux.url_hash(c("url"))), "text_key": ("content_hash", tx.content_fingerprint(c("content")))}
    form = "^[0-9a-f]{64}$"
    return {k: F.coalesce(F.when(c(stored).rlike(form), c(stored)), new) if stored in df.columns else new for k, (stored, new) in made.items()}


def _row_key(*columns: Column) -> Column:
    """128 bits of a row, never null."""
    return F.struct(F.xxhash64(*columns).alias("h"), F.xxhash64(F.lit(1), *columns).alias("g"))


def _layer(rows: DataFrame, known: DataFrame, key: str, reason: str) -> DataFrame:
    """Adds the reason to rows whose key is in ``known`` (column ``key``), or held by an earlier row (published, id) of the batch.

    Keys are reduced to one row each before they meet the batch again, so the joins are many-to-one; a key shared by a
    third of the batch is split by the adaptive skew join.
    """
    first = rows.where(c("reason").isNull() & c(key).isNotNull()).groupBy(key).agg(F.min(F.struct("published_at", "id", "_row")).alias("_first"))
    seen = known.select(c("key").alias(key)).where(c(key).isNotNull()).distinct().withColumn("_known", F.lit(True))
    facts = first.join(seen, key, "left")
    j = rows.join(facts, key, "left")
    duplicate = c("reason").isNull() & F.coalesce(c("_known") | (c("_first._row") != c("_row")), c("_first._row") != c("_row"), F.lit(False))
    return j.withColumn("reason", F.when(duplicate, F.lit(reason)).otherwise(c("reason"))).select(*rows.columns)


def inside_batch_copies(rows: DataFrame, *, as_of: Column, threshold: float, days: int, **tuning) -> DataFrame:
    """(_row) of the rows (``_row``, id, published_at, created_at, embedding) that would be refused if they were stored one by
    one by (published, id).

    A row is refused when an earlier row that was stored itself, and is recent, is closer than the threshold. A first
    vector join finds each row's earliest neighbour: rows without one are stored. A second one refuses the rows near
    those. What is left open are chains of near copies, whose links are found once, as an edge table; the rest are rounds
    over ids: an open row without an open earlier neighbour is stored, and refuses its later neighbours.
    """
    order = F.concat(
        F.coalesce(F.lpad((F.unix_micros("published_at") + F.lit(2**62)).cast("string"), 19, "0"), F.lit("")), F.lit(" "), F.coalesce("id", F.lit("")),
        F.lit(" "), F.hex(c("_row.h")), F.hex(c("_row.g")),
    )  # null first
    with_vec = rows.where(c("embedding").isNotNull())
    all_ = cut_lineage(with_vec.select(order.alias("id"), "_row", c("embedding").alias("vec"), F.coalesce(fl.recent(as_of, days, c("created_at")), F.lit(False)).alias("_recent")))
    first = first_within(all_, all_.where("_recent"), radius=threshold, **tuning)
    marked = all_.join(first.withColumnRenamed("query_id", "id"), "id", "left")
    marked = cut_lineage(marked.withColumn("_stored", F.coalesce(c("first") >= c("id"), F.lit(True))).drop("first"))
    rest = marked.where(~c("_stored")).drop("_stored")
    near = first_within(rest, marked.where("_stored AND _recent"), radius=threshold, **tuning)
    rest = cut_lineage(rest.join(near.withColumnRenamed("query_id", "id"), "id", "left").withColumn("_refused", F.coalesce(c("first") < c("id"), F.lit(False))).drop("first"))
    refused = rest.where("_refused").select("_row")
    open_ = rest.where(~c("_refused"))
    if not open_.isEmpty():
        links = pairs_within(open_, open_.where("_recent"), radius=threshold, **tuning)
        edges = cut_lineage(links.where(c("id") < c("query_id")).select(c("id").alias("a"), c("query_id").alias("b")))
        nodes = open_.select("id", "_row")
        gone = independent_rounds(edges)
        refused = refused.unionByName(nodes.join(gone, "id", "left_semi").select("_row"))
    return refused


def independent_rounds(edges: DataFrame) -> DataFrame:
    """(id) of the nodes that are refused when nodes are taken in their order: edges (a, b), a before b. A node is taken
    unless an earlier neighbour was taken. Each round settles every node without an open earlier neighbour."""
    refused = None
    while True:
        later = edges.select(c("b").alias("id")).distinct()
        taken = edges.select(c("a").alias("id")).distinct().join(later, "id", "left_anti")
        hit = cut_lineage(edges.join(taken.withColumnRenamed("id", "a"), "a", "left_semi").select(c("b").alias("id")).distinct())
        refused = hit if refused is None else refused.unionByName(hit)
        left = edges.join(taken.withColumnRenamed("id", "a"), "a", "left_anti")
        for end in ("a", "b"):
            left = left.join(hit.withColumnRenamed("id", end), end, "left_anti")
        edges = cut_lineage(left)
        if edges.isEmpty():
            return refused.distinct()


def history_keys(rows: DataFrame) -> DataFrame:
    """(key): the keys that the kept rows add to a ``KeyedHistory``."""
    k = rows.select(*[v.alias(n) for n, v in _keys(rows).items()])
    both = F.array_compact(F.array(F.concat(F.lit("u:"), "url_key"), F.concat(F.lit("t:"), "text_key")))
    return k.select(F.explode(both).alias("key")).distinct()


def _seen(rows: DataFrame, known: DataFrame, history: KeyedHistory | None, skip: int | None) -> tuple[DataFrame, DataFrame]:
    """Known url keys and text keys (column ``key``): of the known items, or looked up in the history."""
    if history is None:
        old = known.select(*[v.alias(k) for k, v in _keys(known).items()])
        return old.select(c("url_key").alias("key")), old.select(c("text_key").alias("key"))
    found = cut_lineage(history.known(history_keys(rows.withColumnsRenamed({"url_key": "url_hash", "text_key": "content_hash"}).withColumns({"url": F.lit(None).cast("string"), "content": F.lit(None).cast("string")})), skip))
    return tuple(found.where(c("key").startswith(p)).select(F.expr("substring(key, 3)").alias("key")) for p in ("u:", "t:"))


def dedup_items(
    batch: DataFrame, known: DataFrame, *, as_of: Column, threshold: float = 0.08, days: int = 7, vectors: bool = True,
    inside_batch: bool = True, history: KeyedHistory | None = None, skip: int | None = None,
) -> DataFrame:
    """Every batch row with ``reason``: url_hash, content_fingerprint, embedding_similarity or null (keep it).

    Cheapest layer first, on narrow rows; a later layer only looks at rows the earlier ones let through. The vector layer
    compares with known items of the last days and with the batch's own rows, as they are stored one by one
    (``inside_batch``). Known items bring their stored hashes (url_hash, content_hash) where they have them; with a
    ``history`` the keys are looked up there (without batch ``skip``) and only vectors are read from ``known``.

    Rows are told apart by all their key columns, so rows with a null or repeated id get verdicts of their own; of rows
    that agree in id, time, url and content one is judged and the others are its copies. A null url or text repeats nothing.
    """
    # the raw columns name a row, so that only the narrow rows compute fingerprints
    keyed = batch.withColumn("_row", _row_key(c("id"), c("published_at"), c("url"), c("content")))
    narrow = keyed.select("_row", "id", "published_at", *[v.alias(k) for k, v in _keys(batch).items()])
    each = narrow.groupBy("_row").agg(F.count(F.lit(1)).alias("_n"), *[F.first(x).alias(x) for x in ("id", "published_at", "url_key", "text_key")])
    rows = cut_lineage(each.withColumn("reason", F.lit(None).cast("string")))
    urls, texts = _seen(rows, known, history, skip)
    rows = _layer(_layer(rows, urls, "url_key", "url_hash"), texts, "text_key", "content_fingerprint")
    copy = F.when(c("url_key").isNotNull(), F.lit("url_hash")).when(c("text_key").isNotNull(), F.lit("content_fingerprint"))
    rows = rows.select("_row", "_n", "id", "published_at", "reason", F.when(c("_n") > 1, copy).alias("_copy"))
    if vectors:
        rows = cut_lineage(rows)  # the vector join reads it several times
        name = F.concat(F.hex(c("_row.h")), F.lit("-"), F.hex(c("_row.g")))
        left = keyed.join(rows.where(c("reason").isNull()).select("_row"), "_row", "left_semi").dropDuplicates(["_row"])
        # the second nearest where the nearest is the stored version of the row itself
        near = near_duplicates(left.withColumn("id", name), known, as_of=as_of, threshold=threshold, days=days, k=2)
        near = near.select(c("query_id").alias("_name"), c("id").alias("_other"))
        near = rows.select("_row", "id", name.alias("_name")).join(near, "_name").where(~c("id").eqNullSafe(c("_other")))
        near = near.select("_row", F.lit("embedding_similarity").alias("_near")).distinct()
        rows = rows.join(near, "_row", "left").withColumn("reason", F.coalesce("reason", "_near")).drop("_near")
        if inside_batch:
            rows = cut_lineage(rows)
            left = left.join(rows.where(c("reason").isNull()).select("_row"), "_row", "left_semi")
            copies = inside_batch_copies(left, as_of=as_of, threshold=threshold, days=days).withColumn("_near", F.lit("embedding_similarity"))
            rows = rows.join(copies, "_row", "left").withColumn("reason", F.coalesce("reason", "_near")).drop("_near")
    verdict = cut_lineage(rows.select("_row", "_n", "reason", "_copy"))
    alone = keyed.join(verdict.where("_n = 1").drop("_n", "_copy"), "_row")
    if verdict.where("_n > 1").isEmpty():
        return alone.drop("_row")
    many = keyed.join(verdict.where("_n > 1").drop("_n"), "_row").withColumn("_nth", F.row_number().over(Window.partitionBy("_row").orderBy("id")))
    many = many.withColumn("reason", F.when(c("_nth") > 1, F.coalesce("_copy", "reason")).otherwise(c("reason"))).drop("_nth", "_copy")
    return alone.unionByName(many).drop("_row")


def keep_new(batch: DataFrame, known: DataFrame, **kwargs) -> DataFrame:
    return dedup_items(batch, known, **kwargs).where(c("reason").isNull()).drop("reason")
