"""Canonical tables derived from the generated parquet tables (test data only; the engine never imports this).

``SQL`` holds the same derivations for the oracle; both sides are kept next to each other on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedloom.session import configure

AS_OF_TEXT = "2024-01-31 00:00:00"
TYPES = "array('skill','tool','update','practice','docs')"
TAGS = "array('mcp','testing','security','claude-code','docker','sql','agents','rag')"


#: Files of a table that one micro-batch takes.
STREAM_FILES = 8
TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def as_of():
    return F.lit(AS_OF_TEXT).cast("timestamp")


class Tables:
    """Lazy access to the raw tables of one scale factor and to the canonical tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = configure(spark), sf_dir

    def raw(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        key = TEXT_KEYS.get(name)
        cores = self.spark.sparkContext.defaultParallelism
        if key and df.rdd.getNumPartitions() < cores:
            # one small file is one task: spread the text work; by key, so that later joins on it need no shuffle
            df = df.repartition(cores, key)
        # zone-less timestamps become UTC instants once, here
        return df.select(
            *[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes]
        )

    def count_of(self, name: str):
        return self.raw(name).agg(F.count(F.lit(1)).alias("n")).scalar()

    def stream(self, name: str) -> DataFrame:
        """The same table as a file stream."""
        path = f"{self.dir}/{name}.parquet"
        reader = self.spark.readStream.schema(self.spark.read.parquet(path).schema).option("maxFilesPerTrigger", STREAM_FILES)
        # a glob names a table of one file as well as a folder of files; streams take no path of a single file
        df = reader.parquet(f"{self.dir}/{name}.[p]arquet")
        return df.select(
            *[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes]
        )

    def items(self, vectors: bool = False, docs: DataFrame | None = None) -> DataFrame:
        d = self.raw("documents") if docs is None else docs
        quality = self.raw("labels").select("doc_id", F.col("quality").alias("label_quality"))
        df = d.join(quality, "doc_id", "left")
        if vectors:
            v = self.raw("embeddings").select(F.col("vec_id"), "embedding")
            df = df.withColumn("vec_id", F.col("doc_id") % self.count_of("embeddings")).join(v, "vec_id", "left")
        created = "timestamp_micros(unix_micros(timestamp'%s') - ((doc_id * 7919) %% 129600) * 60000000)" % AS_OF_TEXT
        df = df.withColumn("created_at", F.expr(created))
        cols = [
            "concat('d', doc_id) AS id",
            "source AS source_id",
            "concat('Source ', substr(source, 4)) AS source_name",
            "cast(doc_id AS string) AS external_id",
            "concat('https://example.org/p/', CASE WHEN doc_id % 20 = 1 THEN concat(doc_id - 1, '#dup') "
            "ELSE cast(doc_id AS string) END) AS url",
            "translate(substr(text, 1, 80), '\n', ' ') AS title",
            "text AS content",
            "substr(text, 1, 500) AS excerpt",
            "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE substr(text, 1, 160) END AS summary",
            f"get({TYPES}, cast(doc_id % 5 AS int)) AS primary_type",
            "CASE WHEN doc_id % 20 = 0 THEN 'breaking' WHEN doc_id % 20 <= 3 THEN 'major' "
            "WHEN doc_id % 20 <= 11 THEN 'minor' ELSE 'informational' END AS significance",
            f"array(lang, get({TAGS}, cast(doc_id % 8 AS int))) AS tags",
            "CASE label_quality WHEN 1 THEN 0.8D WHEN 0 THEN 0.2D ELSE 0.5D END + (doc_id % 10) / 100.0D "
            "AS quality_score",
            "0.5D + (doc_id % 50) / 100.0D AS confidence_score",
            "round(0.4D + 0.6D * ((doc_id * 37) % 101) / 101.0D, 4) AS relevance_score",
            "created_at",
            "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE timestamp_micros(unix_micros(created_at) "
            "- (doc_id % 48) * 3600000000) END AS published_at",
            "timestamp_micros(unix_micros(created_at) + (doc_id % 30) * 60000000) AS updated_at",
            "CASE doc_id % 25 WHEN 0 THEN 'raw' WHEN 1 THEN 'queued' WHEN 2 THEN 'filtered' WHEN 3 THEN 'failed' "
            "ELSE 'processed' END AS status",
            "CASE WHEN doc_id % 7 = 0 THEN concat('c', (doc_id div 7) % 20) END AS cluster_id",
        ]
        return df.selectExpr(*cols, *(["embedding"] if vectors else []))

    def landed(self, vectors: bool = False) -> DataFrame:
        """The whole corpus as it looks right after landing."""
        out = self.items(vectors).withColumn("status", F.lit("raw"))
        return out.withColumn("relevance_score", F.lit(None).cast("double")).withColumn(
            "quality_score", F.lit(None).cast("double")
        )

    def sources(self) -> DataFrame:
        k = self.raw("documents").select("source").distinct().withColumn("k", F.expr("cast(substr(source, 4) AS int)"))
        return k.selectExpr(
            "source AS id", "concat('Source ', k) AS name",
            "get(array('rss','github','hn','reddit','npm'), k % 5) AS type",
            "concat('https://src', k, '.example.org/feed') AS url",
            "k % 10 <> 9 AS is_active", "concat('tier', 1 + k % 3) AS tier", "k % 6 AS consecutive_errors",
            "k % 4 AS recovery_attempts",
            f"CASE WHEN k % 7 = 3 THEN NULL ELSE timestamp_micros(unix_micros(timestamp'{AS_OF_TEXT}') "
            "- k * 36000000000) END AS last_successful_poll",
            f"timestamp_micros(unix_micros(timestamp'{AS_OF_TEXT}') - k * 18000000000) AS last_fetched_at",
            f"timestamp_micros(unix_micros(timestamp'{AS_OF_TEXT}') - k * 7200000000) AS created_at",
            "CASE WHEN k % 5 = 0 THEN '{\"relevance_threshold\": 0.3}' ELSE '{}' END AS config",
        )

    def signal_log(self) -> DataFrame:
        nd = self.count_of("documents")
        return self.raw("events").withColumn("span", F.greatest(F.floor(nd / 10), F.lit(1))).selectExpr(
            "event_id", "concat('d', (event_id * 13) % span) AS item_id", "user_id AS api_key_id",
            "CASE event_type WHEN 'purchase' THEN 'upvote' WHEN 'click' THEN 'bookmark' WHEN 'error' THEN 'dismiss' "
            "WHEN 'view' THEN 'read' ELSE 'acted_on' END AS action", "ts AS created_at",
        )

    def signals(self) -> DataFrame:
        from feedloom.plans.signals import upsert_signals

        return upsert_signals(self.signal_log())

    def profiles(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey AS user_id",
            "named_struct("
            f"'tech_stack', array(get({TAGS}, cast(c_custkey % 8 AS int))),"
            "'skills', CASE WHEN c_custkey % 3 = 0 THEN array('devops','unlisted') ELSE cast(array() AS array<string>) END,"
            "'tools', CASE WHEN c_custkey % 4 = 1 THEN array('cursor') ELSE cast(array() AS array<string>) END,"
            "'providers', CASE WHEN c_custkey % 5 = 2 THEN array('meta') ELSE cast(array() AS array<string>) END"
            ") AS profile",
        )

    def users(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey AS id",
            "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE concat('user', c_custkey, '@example.org') END AS email",
            "c_custkey % 6 <> 0 AS is_active",
            f"timestamp_micros(unix_micros(timestamp'{AS_OF_TEXT}') - (c_custkey % 40) * 21600000000) AS created_at",
        )

    def api_keys(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS id", "o_custkey AS user_id", "o_orderstatus <> 'F' AS is_active",
            "cast(o_totalprice AS long) AS usage_count",
            f"timestamp_micros(unix_micros(timestamp'{AS_OF_TEXT}') - (o_orderkey % 72) * 3600000000) AS last_used_at",
        )

    def query_logs(self) -> DataFrame:
        return self.raw("conversations").where("role = 'user'").selectExpr(
            "conv_id * 1000 + turn AS id", "conv_id % 50 AS api_key_id",
            "get(array('feed','search','similar','library'), cast(turn % 4 AS int)) AS query_type",
            "text AS query_text", "length(text) % 25 AS result_count",
            f"timestamp_micros(unix_micros(timestamp'{AS_OF_TEXT}') - (conv_id * 24 + turn) * 3600000000) AS created_at",
        )

    def feedback(self) -> DataFrame:
        return self.raw("events").where("event_type = 'error'").selectExpr(
            "event_id AS id", "'auto_miss' AS report_type", "user_id AS api_key_id", "ts AS created_at",
            "CASE WHEN event_id % 3 = 0 THEN concat(' K', get_json_object(props, '$.k'), ' ') "
            "ELSE concat('{\"query\": \"k', get_json_object(props, '$.k'), '\"}') END AS notes",
        )

    def centroids(self, extra: str = "0") -> DataFrame:
        """Mean vector per (label, extra): small query sides that still read the whole table."""
        e = self.raw("embeddings").selectExpr("label", f"{extra} AS part", "posexplode(embedding) AS (pos, x)")
        means = e.groupBy("label", "part", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
        return means.groupBy("label", "part").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("embedding")
        )

    def watchlists(self) -> DataFrame:
        return self.centroids().selectExpr(
            "concat('w', label) AS id", "label % 3 AS user_id", "embedding AS concept_embedding",
            "0.25D + (label % 3) / 20.0D AS similarity_threshold", "label % 5 <> 4 AS is_active",
        )

    def reference_items(self) -> DataFrame:
        return self.centroids("vec_id % 5").selectExpr(
            "concat('r', label, '-', part) AS id", "embedding", "label % 2 = 0 AS is_positive"
        )

    def alert_rules(self) -> DataFrame:
        """One rule per nation: a name fragment as keyword, some with a significance trigger."""
        return self.raw("nation").selectExpr(
            "concat('a', n_nationkey) AS id", "n_nationkey % 4 AS user_id",
            "array(lower(n_name), get(array('mcp','security','deprecated','eol','rag'), n_nationkey % 5)) AS keywords",
            "CASE WHEN n_nationkey % 6 = 0 THEN array('breaking') WHEN n_nationkey % 6 = 1 THEN array('breaking','major')"
            " END AS significance_trigger",
            "60 * (1 + n_nationkey % 12) AS cooldown_minutes", "n_nationkey % 8 <> 7 AS is_active",
        )

    def library(self, vectors: bool = False) -> DataFrame:
        p = self.raw("part")
        v1 = p.withColumn("version", F.lit(1))
        v2 = p.where("p_partkey % 4 = 0").withColumn("version", F.lit(2))
        df = v1.unionByName(v2)
        df = df.withColumn("nd", self.count_of("documents"))
        if vectors:
            e = self.raw("embeddings").select("vec_id", "embedding")
            df = df.withColumn("vec_id", F.col("p_partkey") % self.count_of("embeddings")).join(e, "vec_id", "left")
        base = f"timestamp'{AS_OF_TEXT}'"
        cols = [
            "concat('l', p_partkey, '-', version) AS id",
            "concat('entry-', p_partkey) AS slug",
            "p_name AS title",
            "CASE WHEN p_partkey % 10 = 3 THEN NULL ELSE concat('Use ', p_name, ' from ', p_brand) END AS tldr",
            "concat(p_name, ' is made as ', p_type, ' by ', p_brand, ', version ', version) AS body",
            "array(p_brand, p_type) AS key_points",
            "CASE WHEN p_partkey % 3 = 0 THEN array(named_struct('title', p_brand, 'detail', p_type)) END AS gotchas",
            "lower(p_type) AS topic_path",
            f"array(lower(p_brand), get({TAGS}, cast(p_partkey % 8 AS int))) AS tags",
            "get(array('guide','reference','pattern'), cast(p_partkey % 3 AS int)) AS entry_type",
            "CASE p_partkey % 12 WHEN 0 THEN 'candidate' WHEN 1 THEN 'review_needed' ELSE 'active' END AS status",
            "cast(p_partkey % 37 AS double) AS graduation_score",
            "CASE WHEN p_partkey % 2 = 0 THEN 'synthesis' ELSE 'signal' END AS graduation_method",
            f"timestamp_micros(unix_micros({base}) - (p_partkey % 300) * 86400000000) AS graduated_at",
            f"CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE timestamp_micros(unix_micros({base}) "
            "- (p_partkey % 260) * 86400000000) END AS last_confirmed_at",
            f"timestamp_micros(unix_micros({base}) - (p_partkey % 60) * 86400000000) AS updated_at",
            f"timestamp_micros(unix_micros({base}) - (400 - version) * 86400000000) AS created_at",
            "array(concat('d', (p_partkey * 3) % greatest(nd div 3, 1)), concat('d', (p_partkey * 5 + 1) % greatest(nd div 3, 1))) AS source_item_ids",
            "p_size AS source_item_count", "p_size % 5 AS source_count", "p_size AS helpful_count", "version",
            "version = CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 1 END AS is_current",
        ]
        return df.selectExpr(*cols, *(["embedding"] if vectors else []))

    def repo_snapshots(self) -> DataFrame:
        """Per customer and order day: running order count x 40 as stars, that day's priority text as description."""
        day = self.raw("orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(
            F.count(F.lit(1)).alias("n"), F.min("o_orderpriority").alias("description"),
            F.max("o_orderstatus").alias("file_text"),
        )
        from pyspark.sql import Window

        w = Window.partitionBy("o_custkey").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
        return day.select(
            F.concat(F.lit("owner"), F.col("o_custkey") % 7, F.lit("/repo"), F.col("o_custkey")).alias("repo"),
            F.col("day").cast("timestamp").alias("ts"),
            (F.sum("n").over(w) * 40).alias("stars"),
            (F.col("n") * 15).alias("commits"),
            "description", "file_text",
        )

    def spend(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_orderkey * 10 + l_linenumber AS call_id", "l_shipdate AS ts", "l_suppkey AS user_id",
            "CASE WHEN l_linenumber % 2 = 0 THEN 'haiku' ELSE 'gpt-4o-mini' END AS model",
            "cast(l_quantity AS long) * 100 AS in_tokens", "cast(l_quantity AS long) * 10 AS out_tokens",
        )
