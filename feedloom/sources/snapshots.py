"""Keyed tables that are changed by merges: hash buckets, copy on write, a manifest as commit.

A merge rewrites only the buckets that hold a changed key; the others keep their files. The manifest of a version names the
folder of every bucket; it is written last, so a reader sees the table before the merge or after it, never between. A merge
that failed is run again under its version: it starts from the version before and overwrites what was left. Old versions
stay readable until ``forget`` removes the folders that no kept version names.

Keys may be null (nulls are one key). Of several changes of a key the last by ``order`` counts. Empty changes make a new
version with the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedloom.operators.skew import latest_per_key
from feedloom.session import cut_lineage

c = F.col


@dataclass(frozen=True)
class KeyedTable:
    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    buckets: int = 64

    def _fs(self, *parts: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def versions(self) -> list[int]:
        """Committed versions."""
        fs, root = self._fs("manifest")
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("v=") and fs.exists(self._fs("manifest", n, "_SUCCESS")[1]))

    def _manifest(self, version: int | None) -> dict[int, int]:
        """Version that wrote each bucket; at most ``buckets`` entries."""
        done = [v for v in self.versions() if version is None or v <= version]
        if not done:
            return {}
        rows = self.spark.read.schema("bucket int, written int").parquet(f"{self.path}/manifest/v={done[-1]}").collect()
        return {r["bucket"]: r["written"] for r in rows}

    def _rows(self, held: dict[int, int], schema) -> DataFrame:
        if not held:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(held.items())])

    def read(self, schema, version: int | None = None) -> DataFrame:
        """The rows of a version, by default of the last one."""
        return self._rows(self._manifest(version), schema)

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def merge(self, changes: DataFrame, version: int, *, order: list[str] | None = None, deleted: str | None = None) -> int:
        """Replace or add the rows of ``changes`` by key; rows with ``deleted`` true take their key away. ``version`` grows
        from merge to merge. Returns the number of buckets written."""
        schema = changes.drop(deleted).schema if deleted else changes.schema
        last = latest_per_key(changes, list(self.keys), order) if order else changes
        new = cut_lineage(last.withColumn("bucket", self._bucket()))
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most ``buckets`` numbers
        before = self._manifest(version - 1)
        old = self._rows({b: before[b] for b in touched if b in before}, schema)
        marked = new.select(*[c(k).alias(f"_{k}") for k in self.keys])
        same = F.lit(True)
        for k in self.keys:
            same = same & c(k).eqNullSafe(c(f"_{k}"))
        kept = old.join(marked, same, "left_anti").withColumn("bucket", self._bucket())
        fresh = new.where(~F.coalesce(c(deleted), F.lit(False))).drop(deleted) if deleted else new
        target = f"{self.path}/data/v={version}"
        out = kept.unionByName(fresh.select(*kept.columns))
        out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        fs, root = self._fs("data", f"v={version}")
        filled = {int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(root) if s.getPath().getName().startswith("bucket=")}
        after = {b: v for b, v in before.items() if b not in touched} | {b: version for b in filled}
        self._commit(after, version)
        return len(touched)

    def _commit(self, held: dict[int, int], version: int) -> None:
        rows = self.spark.createDataFrame(sorted(held.items()), "bucket int, written int")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={version}")

    def forget(self, keep: int = 1) -> int:
        """Remove all but the last ``keep`` versions; returns how many bucket folders went. Not while others read them."""
        done = self.versions()
        named = {(v, b) for x in done[-keep:] for b, v in self._manifest(x).items()}
        gone = 0
        for v in done[:-keep]:
            fs, root = self._fs("data", f"v={v}")
            for s in fs.listStatus(root):
                name = s.getPath().getName()
                if name.startswith("bucket=") and (v, int(name.split("=")[1])) not in named:
                    fs.delete(s.getPath(), True)
                    gone += 1
            fs.delete(self._fs("manifest", f"v={v}")[1], True)
        return gone
