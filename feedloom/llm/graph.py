"""Connected components of link tables by alternating star contractions, and the block-wise verification of buckets.

Links point from a larger id to a smaller one. A small star hooks every parent of a node, and the node itself, to the
smallest of them; a large star hooks children to their parent's parent. Rounds go on until every node has one parent that
is a root. Each round's links are stored in the shared folder. Children of one parent are split over salts, so a hub
with a third of all nodes does not meet in one task; only counters reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import released, stored

SALTS = 16


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: ids of one orderable type, null-free; loops are ignored).
    ``component`` is the smallest id reachable. Nodes without a link do not appear. The links are stored before the first
    round, so every round reads the same ones even where two evaluations of ``links`` differ."""
    pairs = stored(links.select(F.greatest("a", "b").alias("c"), F.least("a", "b").alias("p")).where("c <> p").distinct(), "links")
    before = None
    while True:
        low = pairs.groupBy("c").agg(F.min("p").alias("m"))
        # every parent and the node itself point at the smallest parent
        hooked = pairs.join(low, "c").where("p <> m").select(F.col("p").alias("c"), F.col("m").alias("p")).distinct()
        pairs = stored(hooked.unionByName(low.select("c", F.col("m").alias("p"))).distinct(), "stars")
        # parents that have a parent themselves: few, and fewer each round
        up = pairs.groupBy("c").agg(F.min("p").alias("m")).join(pairs.select(F.col("p").alias("c")).distinct(), "c", "left_semi")
        up = up.select(F.col("c").alias("p"), "m", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("s"))
        salted = pairs.withColumn("s", F.pmod(F.hash("c"), F.lit(SALTS)))
        pairs = salted.join(up, ["p", "s"], "left").select("c", F.coalesce("m", "p").alias("p"), F.col("m").isNotNull().alias("moved"))
        pairs = stored(pairs.groupBy("c", "p").agg(F.max("moved").alias("moved")), "stars")
        state = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if("moved").alias("moved"), F.bit_xor(F.xxhash64("c", "p")).alias("print")).first()
        pairs = pairs.select("c", "p")
        if state == before:
            raise RuntimeError("components: a round has changed nothing and the links are no stars")
        before = state
        if not state["moved"] and not pairs.groupBy("c").count().where("count > 1").limit(1).count():
            return pairs.select(F.col("c").alias("node"), F.col("p").alias("component"))


def blocked(rows: DataFrame, key: str, spread: str, block: int) -> DataFrame:
    """``rows`` of keys that occur at least twice, as (group, side, …): a key with up to ``block`` rows is one group; a
    larger one is dealt into parts by ``spread`` and every pair of its parts is a group, so that each two rows of a key
    meet in a group and none grows with the key. ``side``: 0 both, 1 and 2 the two parts."""
    sizes = stored(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").withColumn("__n", F.ceil(F.col("__n") / block).cast("int")), "sizes")
    sized = rows.join(sizes, key).withColumn("__b", F.pmod(F.xxhash64(F.lit(key), spread), F.col("__n")).cast("int"))
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("__n") - 1), lambda j: F.struct(
        F.least("__b", j).alias("i"), F.greatest("__b", j).alias("j"),
        F.when(F.col("__b") == j, 0).when(F.col("__b") < j, 1).otherwise(2).alias("side"))))
    out = sized.withColumn("__m", meets)
    return out.withColumn("group", F.struct(F.col(key), F.col("__m.i"), F.col("__m.j"))).withColumn("side", F.col("__m.side")).drop("__n", "__b", "__m", key)


def by_group(rows: DataFrame, work: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, order: list[str] | None = None) -> DataFrame:
    """``work(frame, starts)`` over whole groups: rows are shuffled and sorted by ``group`` (and ``order``, so that a result
    that depends on it repeats); every call gets consecutive groups (``starts``: where each begins) of at least one Arrow
    batch, the last group of a batch waits for the next. With ``order`` lone rows go before they reach Python."""
    dealt = rows.withColumn("__g", F.xxhash64("group")).repartition("group")
    if order:
        whole = Window.partitionBy("group").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        dealt = dealt.withColumn("__n", F.count(F.lit(1)).over(whole)).where("__n > 1").drop("__n")
    dealt = dealt.sortWithinPartitions("group", *(order or []))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for batch in released(batches):
            if not len(batch):
                continue
            if kept and (batch["__g"].to_numpy() == kept[0]["__g"].iloc[-1]).all():
                kept.append(batch)
                continue
            whole = pd.concat([*kept, batch], ignore_index=True)
            g = whole["__g"].to_numpy()
            last = int(np.flatnonzero(g != g[-1])[-1]) + 1 if (g != g[-1]).any() else 0
            if last:
                yield work(whole.iloc[:last], np.flatnonzero(np.r_[True, g[1:last] != g[: last - 1]]))
            kept = [whole.iloc[last:]]
        if kept:
            whole = pd.concat(kept, ignore_index=True)
            g = whole["__g"].to_numpy()
            yield work(whole, np.flatnonzero(np.r_[True, g[1:] != g[:-1]]))

    return dealt.drop("group").mapInPandas(run, schema)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) with the same components as the links (a, b): at most one per node."""
    if not len(a):
        return a[:0], b[:0]
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        root = root[root]
        if (root == before).all():
            break
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


def pairs_in(starts: np.ndarray, n: int, side: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j), i < j, of all pairs inside the groups that begin at ``starts``, about ``most`` at a time.
    Rows of the same part (side 1 or 2) are no pair: they meet in that part's own group."""
    ends = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n]))
    count = ends - np.arange(n) - 1
    total = np.cumsum(count)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        c = count[at:stop]
        i = np.repeat(np.arange(at, stop), c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        use = (side[i] == 0) | (side[i] != side[j])
        yield i[use], j[use]
        at = stop
