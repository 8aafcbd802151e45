"""Embedding near-duplicates by p-stable (Gaussian) hashing.

Each vector is normalised; a table quantises ``PROJECTIONS`` Gaussian projections into cells of width ``WIDTH`` and the
cells together name a bucket. On unit vectors cosine 0.93 is the Euclidean distance 0.374, at which one projection keeps
a pair together with probability 0.851 and a table with 0.104; ``TABLES`` tables miss such a pair with probability
0.5 %, one of cosine 0.97 with 2e-6, while unrelated vectors meet with 4e-5 per table. All vectors of a bucket are compared by
exact cosine in double precision. Equal vectors are one class beforehand; a pair that shares several buckets counts in
the first of them; large buckets are dealt into pairs of blocks.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors with a null label, link
with nothing and are their own component; vectors of different lengths never link; repeated ids are rows of their own; an
empty table gives an empty result; result columns replace input columns of the same name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import stored, table
from feedloom.llm.graph import blocked, by_group, components, forest, pairs_in

TABLES, PROJECTIONS, WIDTH = 48, 14, 2.0
BLOCK = 512
SEED = 20240607


def bucket_codes(tables: int, projections: int, width: float):
    """pandas UDF: one 32-bit code per table, from the vector, its label and its length."""

    @F.pandas_udf("array<int>")
    def codes(vectors: pd.Series, labels: pd.Series) -> pd.Series:
        out = np.empty(len(vectors), object)
        lengths = np.fromiter(map(len, vectors), np.int64, len(vectors))
        for dim in np.unique(lengths):
            at = np.flatnonzero(lengths == dim)
            rng = np.random.default_rng([SEED, int(dim)])
            plane = rng.standard_normal((int(dim), tables * projections))
            shift = rng.uniform(0, width, tables * projections)
            mix = rng.integers(1, 2**63, projections, dtype=np.uint64) | np.uint64(1)
            x = np.stack([vectors.iloc[i] for i in at]).astype(np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            cell = np.floor((x @ plane + shift) / width).astype(np.int64).view(np.uint64).reshape(len(at), tables, projections)
            label = pd.util.hash_array(labels.iloc[at].astype(str).to_numpy(object)) + np.uint64(dim)
            h = (cell * mix).sum(axis=2, dtype=np.uint64) ^ label[:, None]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out[at] = list((h >> np.uint64(32)).astype(np.uint32).view(np.int32))
        return pd.Series(out)

    return codes


def _compare(threshold: float):
    def work(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        n = len(frame)
        rid, side, t, weight = (frame[c].to_numpy() for c in ("rid", "side", "t", "weight"))
        label = frame["label"].to_numpy()
        lengths = np.fromiter(map(len, frame["v"]), np.int64, n)
        x = np.zeros((n, int(lengths.max())))
        for k, v in enumerate(frame["v"]):
            x[k, : len(v)] = v
        norm = np.sqrt((x * x).sum(axis=1))
        codes = np.stack(frame["codes"].to_list())
        links = np.zeros(n, np.int64)
        a, b = [], []
        for i, j in pairs_in(starts, n, side, 200_000):
            # norms lose to rounding only in the last digits; the cosine is formed as in the definition
            near = np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j]) >= threshold
            near &= (label[i] == label[j]) & (lengths[i] == lengths[j])
            i, j = i[near], j[near]
            x_, y_ = forest(rid[i], rid[j])
            a.append(x_)
            b.append(y_)
            first = (codes[i] == codes[j]).argmax(axis=1) == t[i]
            np.add.at(links, i[first], weight[j[first]])
            np.add.at(links, j[first], weight[i[first]])
        u, w = forest(np.concatenate(a), np.concatenate(b)) if a else (rid[:0], rid[:0])
        has = links > 0
        return pd.DataFrame({
            "a": np.concatenate([u, rid[has]]), "b": np.concatenate([w, rid[has]]),
            "n": np.concatenate([np.zeros(len(u), np.int64), links[has]]),
        })

    return work


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93,
                 tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, block: int = BLOCK) -> DataFrame:
    """One row per vector: (id, n_links, component_id, kept)."""
    v, lab = F.col(vector), F.col(label)
    sound = lab.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    keyed = vectors.select(F.col(id_col).alias("id"), lab.alias("label"), v.alias("v"), F.coalesce(sound, F.lit(False)).alias("sound"))
    key = [F.xxhash64("label", "v").alias("h1"), F.xxhash64(F.lit(1), "v", "label").alias("h2")]
    rows = stored(keyed.select("id", "sound", *key), "vector-keys")
    classes = keyed.where("sound").groupBy("label", "v").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("low"))
    coded = classes.withColumn("codes", bucket_codes(tables, projections, width)("v", "label")).withColumn("rid", F.monotonically_increasing_id())
    classes = stored(coded.select("*", *key), "vector-classes")
    posted = classes.select("rid", F.posexplode("codes").alias("t", "code"))
    posted = posted.select("rid", "t", (F.shiftleft(F.col("t").cast("long"), 32) + F.col("code") + F.lit(1 << 31)).alias("key"))
    met = blocked(posted, "key", "rid", block).join(classes.select("rid", "label", "v", "codes", "weight"), "rid")
    found = stored(by_group(met, _compare(threshold), "a long, b long, n long"), "vector-links")
    parts = components(found.where("n = 0").select("a", "b")).withColumnRenamed("node", "rid")
    links = found.where("n > 0").groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("n"))
    whole = classes.select("rid", "h1", "h2", "low", "weight").join(parts, "rid", "left").join(links, "rid", "left")
    whole = stored(whole.withColumn("root", F.coalesce("component", "rid")), "vector-parts")
    lowest = stored(whole.groupBy("root").agg(F.min("low").alias("component_id")), "vector-lowest")
    named = stored(whole.join(lowest, "root").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"), "vector-named")
    out = rows.where("sound").join(named, ["h1", "h2"]).select("id", "n_links", "component_id")
    out = out.unionByName(rows.where("not sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op3_near_vectors(spark, sf_dir) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
