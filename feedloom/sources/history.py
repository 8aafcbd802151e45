"""Keys seen so far, in hash buckets with a Bloom filter for each file.

A batch appends one file of new keys per bucket (more where a bucket has very many), and the file's Bloom filter: pages of
32,768 bits, a key's bits all in one page. A lookup meets the pages of its keys' buckets, and only the files whose filter
may hold a key are opened. ``compact`` writes a bucket's files anew as one generation.

The filters are the manifest: a file counts once the filters of its batch are committed, which is the last step of an
append, and a lookup for batch n does not see batch n itself. A batch that failed half way is run again under its number
and overwrites what it left. Key files and filters are plain Parquet in the given folder; only the list of files to open
reaches the driver, as for every scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

c = F.col
PAGE = 32768  # bits of a bitmap of Spark's bitmap functions
PROBES = 5
BITS_PER_KEY = 12
FILTER = "part int, page int, bits binary, n long, covers long, batch long, bucket int"


def _bit(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1))


@dataclass(frozen=True)
class KeyedHistory:
    spark: SparkSession
    path: str
    buckets: int = 64
    file_keys: int = 200_000

    # ---- placement ----

    @property
    def pages(self) -> int:
        return -(-self.file_keys * BITS_PER_KEY // PAGE)

    def _placed(self, keys: DataFrame) -> DataFrame:
        probes = F.array(*[F.pmod(F.xxhash64("key", F.lit(k)), F.lit(PAGE)).cast("int") for k in range(1, PROBES + 1)])
        return keys.withColumns({
            "bucket": F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"), "page": F.pmod(F.xxhash64("key", F.lit(0)), F.lit(self.pages)).cast("int"), "probes": probes,
        })

    # ---- files ----

    def _folder(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _fs(self):
        return self._folder().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """Numbers of the committed batches (negative: compactions)."""
        fs, root = self._fs(), self._folder("filters")
        if not fs.exists(root):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(root)]
        done = [n for n in found if n.startswith("batch=") and fs.exists(self._folder("filters", n, "_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in done)

    def _filters(self, skip: int | None = None) -> DataFrame | None:
        """Filter pages of the files that count: of each bucket the latest compaction and the batches it does not cover."""
        wanted = [b for b in self.batches() if b != skip]
        if not wanted:
            return None
        root = f"{self.path}/filters"
        rows = self.spark.read.option("basePath", root).schema(FILTER).parquet(*[f"{root}/batch={b}" for b in wanted])
        if wanted[0] >= 0:
            return rows
        last = rows.where("batch < 0").groupBy(c("bucket").alias("_bucket")).agg(F.max(F.struct("covers", (-c("batch")).alias("age"))).alias("last"))
        rows = rows.join(last, c("bucket") == c("_bucket"), "left")
        return rows.where((c("batch") == -c("last.age")) | ((c("batch") >= 0) & (c("batch") > F.coalesce("last.covers", F.lit(-1))))).drop("_bucket", "last")

    # ---- reading ----

    def files_for(self, keys: DataFrame, skip: int | None = None) -> list[str]:
        """Folders of the files whose filter may hold one of ``keys`` (column ``key``)."""
        pages = self._filters(skip)
        if pages is None:
            return []
        asked = self._placed(keys.select("key").distinct()).select("bucket", "page", "probes")
        met = asked.join(pages, ["bucket", "page"]).where(F.forall("probes", lambda p: _bit(c("bits"), p) == 1))
        files = met.select("batch", "bucket", "part").distinct().collect()
        return sorted(f"{self.path}/keys/batch={r['batch']}/bucket={r['bucket']}/part={r['part']}" for r in files)

    def known(self, keys: DataFrame, skip: int | None = None) -> DataFrame:
        """The distinct ones of ``keys`` (column ``key``) that the history holds, without batch ``skip``."""
        files = self.files_for(keys, skip)
        asked = keys.select("key").distinct()
        if not files:
            return asked.where(F.lit(False))
        held = self.spark.read.schema("key string").parquet(*files)
        return asked.join(held, "key", "left_semi")

    def keys(self) -> DataFrame:
        """All keys."""
        pages = self._filters()
        if pages is None:
            return self.spark.createDataFrame([], "key string")
        files = pages.select("batch", "bucket", "part").distinct().collect()
        return self.spark.read.schema("key string").parquet(*[f"{self.path}/keys/batch={r['batch']}/bucket={r['bucket']}/part={r['part']}" for r in files])

    # ---- writing ----

    def _write(self, keys: DataFrame, batch: int, covers: int | None) -> None:
        placed = self._placed(keys.select("key").distinct())
        parts = placed.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / self.file_keys).cast("int").alias("parts"))
        rows = placed.join(parts, "bucket").withColumn("part", F.pmod(F.xxhash64("key", F.lit(-1)), c("parts")).cast("int"))
        root = f"{self.path}/keys/batch={batch}"
        rows.select("key", "bucket", "part").repartition("bucket", "part").write.mode("overwrite").partitionBy("bucket", "part").parquet(root)
        # the filters are those of the files just written
        written = self.spark.read.schema("key string, bucket int, part int").parquet(root)
        probes = self._placed(written).select("bucket", "part", "page", F.posexplode("probes").alias("nth", "at"))
        bits = probes.groupBy("bucket", "part", "page").agg(F.bitmap_construct_agg(c("at").cast("long")).alias("bits"), F.count_if(c("nth") == 0).alias("n"))
        out = bits.withColumn("covers", F.lit(covers).cast("long")).select("part", "page", "bits", "n", "covers", "bucket")
        out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/filters/batch={batch}")

    def add(self, keys: DataFrame, batch: int) -> None:
        """Append the keys of a batch (a number from 0 up, growing from batch to batch)."""
        self._write(keys, batch, None)

    def compact(self, most_files: int = 8) -> int:
        """Rewrite the buckets with more than ``most_files`` files; returns how many. Not while a batch is being added."""
        pages = self._filters()
        if pages is None:
            return 0
        crowded = [r["bucket"] for r in pages.select("bucket", "batch", "part").distinct().groupBy("bucket").count().where(c("count") > most_files).collect()]
        if crowded:
            files = pages.where(c("bucket").isin(crowded)).select("batch", "bucket", "part").distinct().collect()
            rows = self.spark.read.schema("key string").parquet(*[f"{self.path}/keys/batch={r['batch']}/bucket={r['bucket']}/part={r['part']}" for r in files])
            done = self.batches()
            self._write(rows, min(done[0], 0) - 1, done[-1])
        return len(crowded)
