"""Merkle manifest of a table as a tree of SHA-256 midstates.

A node is the hex SHA-256 of its children's hex digests. A hex digest is exactly one 64-byte block of the hash, so the
state of a parent's hash before each child slot is eight words: before the first child it is the initial state, before
the second one the state after the first. Parents retain these states. To fold a changed leaf, each parent resumes the
state before the leaf's slot with the replacement and the right sibling only; left siblings are not hashed again.

Rows are sorted by (tree, order) over range partitions and numbered by partition starts, so a tree with most rows is
shared by all tasks. ``FAN`` consecutive nodes are a block, a subtree of ``LEVELS`` levels built in one task; the blocks'
roots are the nodes of the next layer, and so on; the trees' roots are the leaves of one last tree. A second pass goes
down: every block learns the steps from its root to the root of all (one row for each block), and the leaves are folded
block by block. Nothing but the number of the largest tree reaches the driver.

Edge cases: a null field counts as ``-``; null trees are a tree of their own, ordered first, null ids come first in it;
equal rows and rows of one id are ordered by their digests (equal leaves are interchangeable); a lone leaf is the root of
its tree; an empty table gives an empty result; texts of any length are hashed by the JVM; input columns are read under
names of their own, so extra columns do not clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import stored, table

LEVELS = 8
FAN = 1 << LEVELS
DIGEST = 32
SLICE = 8192  # digests hashed as one vector


def _root_bits(power: int, count: int) -> np.ndarray:
    """First 32 bits of the fractional parts of the square or cube roots of the first primes: the hash's constants."""
    primes = [p for p in range(2, 400) if all(p % q for q in range(2, isqrt(p) + 1))][:count]

    def root(n: int) -> int:
        lo, hi = 0, 1 << (n.bit_length() // power + 1)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if mid**power <= n else (lo, mid - 1)
        return lo

    return np.array([root(p << 32 * power) % 2**32 for p in primes], np.uint32)


START, ROUND = _root_bits(2, 8), _root_bits(3, 64)
_HEX = np.frombuffer(b"".join(b"%02x" % i for i in range(256)), np.uint8).reshape(256, 2)


def _turned(x: np.ndarray, *by: int) -> np.ndarray:
    out = (x >> np.uint32(by[0])) | (x << np.uint32(32 - by[0]))
    for n in by[1:]:
        out ^= (x >> np.uint32(n)) | (x << np.uint32(32 - n))
    return out


def absorb(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """SHA-256 states (n, 8) after one more block (n, 16) of big-endian words each."""
    w = [np.ascontiguousarray(blocks[:, k]) for k in range(16)]
    for k in range(16, 64):
        x, y = w[k - 15], w[k - 2]
        w.append(w[k - 16] + (_turned(x, 7, 18) ^ (x >> np.uint32(3))) + w[k - 7] + (_turned(y, 17, 19) ^ (y >> np.uint32(10))))
    a, b, c, d, e, f, g, h = (np.ascontiguousarray(states[:, k]) for k in range(8))
    for k in range(64):
        t = h + _turned(e, 6, 11, 25) + (g ^ (e & (f ^ g))) + ROUND[k] + w[k]
        u = _turned(a, 2, 13, 22) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = t + u, a, b, c, d + t, e, f, g
    return states + np.stack([a, b, c, d, e, f, g, h], axis=1)


def hex_block(digests: np.ndarray) -> np.ndarray:
    """Hex text of digests (n, 32 bytes) as hash blocks (n, 16)."""
    return _HEX[digests].reshape(len(digests), 64).view(">u4").astype(np.uint32)


def fresh(n: int) -> np.ndarray:
    return np.tile(START, (n, 1))


def finished(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests (n, 32) of hashes that have absorbed ``blocks`` whole blocks each."""
    tail = np.zeros((len(states), 16), np.uint32)
    tail[:, 0] = 0x80000000
    bits = np.asarray(blocks, np.uint64) * np.uint64(512)
    tail[:, 14], tail[:, 15] = bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)
    return absorb(states, tail).astype(">u4").view(np.uint8).reshape(-1, DIGEST)


def packed(states: np.ndarray) -> np.ndarray:
    return states.astype(">u4").view(np.uint8).reshape(-1, DIGEST)


def unpacked(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw).view(">u4").astype(np.uint32).reshape(-1, 8)


def _in_slices(n: int):
    return ((a, min(a + SLICE, n)) for a in range(0, n, SLICE))


def parents(nodes: np.ndarray, first: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digests, states before the second slot) of parents whose first child is ``nodes[first]`` and whose second, where
    ``pair``, is the node after it."""
    out, held = np.empty((len(first), DIGEST), np.uint8), np.empty((len(first), DIGEST), np.uint8)
    for a, b in _in_slices(len(first)):
        left, two = first[a:b], pair[a:b]
        state = absorb(fresh(b - a), hex_block(nodes[left]))
        held[a:b] = packed(state)
        state[two] = absorb(state[two], hex_block(nodes[left[two] + 1]))
        out[a:b] = finished(state, np.where(two, 2, 1))
    return out, held


def resumed(digests: np.ndarray, before: np.ndarray, right: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Parents' digests with one child replaced by ``digests``: the state before its slot resumes with the replacement and
    the right sibling. ``kind``: 0 lone child, 1 first of two, 2 second of two."""
    state = absorb(before, hex_block(digests))
    first = kind == 1
    if first.any():
        state[first] = absorb(state[first], hex_block(right[first]))
    return finished(state, np.where(kind == 0, 1, 2))


def level_sizes(size: int, levels: int) -> list[int]:
    return [-(-size // (1 << k)) for k in range(levels + 1)]


def _bytes(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint8).reshape(-1, DIGEST) for x in column.to_pylist()]


def _grown(leaves: list[np.ndarray], levels: list[int]) -> tuple[list[bytes], list[bytes]]:
    """All nodes, level by level, and all retained states of each block; the blocks of a level are one vector."""
    now = list(leaves)
    nodes, states = [[x] for x in leaves], [[] for _ in leaves]
    for k in range(max(levels, default=0)):
        use = [b for b, n in enumerate(levels) if n > k]
        size = np.array([len(now[b]) for b in use])
        start = np.cumsum(size) - size
        count = -(-size // 2)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        made, held = parents(np.concatenate([now[b] for b in use]), np.repeat(start, count) + 2 * at, 2 * at + 1 < np.repeat(size, count))
        for b, x, s in zip(use, np.split(made, np.cumsum(count)[:-1]), np.split(held, np.cumsum(count)[:-1])):
            now[b] = x
            nodes[b].append(x)
            states[b].append(s)
    return [b"".join(x.tobytes() for x in n) for n in nodes], [b"".join(x.tobytes() for x in s) for s in states]


def _steps(size: int, levels: int, nodes: np.ndarray, states: np.ndarray, leaf: np.ndarray):
    """For each level: kind, sibling and state before the slot, of the ancestors of the leaves with these numbers."""
    sizes = level_sizes(size, levels)
    at = held = 0
    initial = packed(START[None, :])
    for k in range(levels):
        i = leaf >> k
        kind = np.where(i % 2 == 1, 2, np.where(i + 1 < sizes[k], 1, 0))
        sibling = nodes[at + np.where(kind == 0, i, i ^ 1)]
        yield kind, sibling, np.where((kind == 2)[:, None], states[held + (i >> 1)], initial)
        at += sizes[k]
        held += sizes[k + 1]


def _grow(leaves: pa.Array, levels: pa.Array) -> pa.Array:
    nodes, states = _grown(_bytes(leaves), levels.to_pylist())
    return pa.StructArray.from_arrays([pa.array(nodes, pa.binary()), pa.array(states, pa.binary())], ["nodes", "states"])


def _routes(size: pa.Array, levels: pa.Array, nodes: pa.Array, states: pa.Array, kinds: pa.Array, siblings: pa.Array, before: pa.Array) -> pa.Array:
    """The steps of every node of a block to the root of all: those inside the block, then those above it."""
    out = []
    for n, up, nod, sta, k, s, b in zip(size.to_pylist(), levels.to_pylist(), _bytes(nodes), _bytes(states), kinds.to_pylist(), siblings.to_pylist(), before.to_pylist()):
        steps = list(_steps(n, up, nod, sta, np.arange(n)))
        out.append([
            {
                "kinds": bytes(int(x[0][i]) for x in steps) + k,
                "siblings": b"".join(x[1][i].tobytes() for x in steps) + s,
                "before": b"".join(x[2][i].tobytes() for x in steps) + b,
            }
            for i in range(n)
        ])
    return pa.array(out, pa.list_(pa.struct([("kinds", pa.binary()), ("siblings", pa.binary()), ("before", pa.binary())])))


def _folded(leaves: list[np.ndarray], blocks: list[tuple], above: list[tuple]) -> np.ndarray:
    """(proof, folded root) of all leaves of some blocks: at every step all leaves of all blocks are one vector."""
    count = [len(x) for x in leaves]
    ends = np.cumsum(count)
    now = np.concatenate(leaves)
    proof, used = fresh(len(now)), np.zeros(len(now), np.int64)
    inside = [_steps(*b, np.arange(n)) for b, n in zip(blocks, count)]
    for t in range(max(b[1] + len(a[0]) for b, a in zip(blocks, above))):
        kinds, siblings, before, rows = [], [], [], []
        for b, (n, end) in enumerate(zip(count, ends)):
            up = t - blocks[b][1]
            if up < 0:
                step = next(inside[b])
            elif up < len(above[b][0]):
                step = tuple(np.repeat(x[up : up + 1], n, axis=0) for x in above[b])
            else:
                continue
            for x, y in zip((kinds, siblings, before), step):
                x.append(y)
            rows.append(np.arange(end - n, end))
        kind, sibling, rows = np.concatenate(kinds), np.concatenate(siblings), np.concatenate(rows)
        now[rows] = resumed(now[rows], unpacked(np.concatenate(before)), sibling, kind)
        two = kind > 0
        proof[rows[two]] = absorb(proof[rows[two]], hex_block(sibling[two]))
        used[rows[two]] += 1
    return np.concatenate([finished(proof, used), now], axis=1)


def _fold(leaves: pa.Array, size: pa.Array, levels: pa.Array, nodes: pa.Array, states: pa.Array, kinds: pa.Array, siblings: pa.Array, before: pa.Array) -> pa.Array:
    """For each leaf of a block 32 bytes of its proof and 32 of its folded root."""
    new = _bytes(leaves)
    blocks = list(zip(size.to_pylist(), levels.to_pylist(), _bytes(nodes), _bytes(states)))
    above = list(zip([np.frombuffer(k, np.uint8).astype(np.int64) for k in kinds.to_pylist()], _bytes(siblings), _bytes(before)))
    out, at = [], 0
    while at < len(new):
        end, rows = at, 0
        while end < len(new) and (end == at or rows + len(new[end]) <= SLICE):
            rows += len(new[end])
            end += 1
        cells = _folded(new[at:end], blocks[at:end], above[at:end])
        out += [x.tobytes() for x in np.split(cells, np.cumsum([len(x) for x in new[at : end - 1]]))]
        at = end
    return pa.array(out, pa.binary())


def _routed() -> Column:
    cells = F.arrow_udf(_routes, "array<struct<kinds:binary,siblings:binary,before:binary>>")
    return cells("size", "levels", "nodes", "states", "kinds", "siblings", "before")


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 (binary) of the fields, each ``-`` if null, else its UTF-8 length, a colon and the value."""
    parts = []
    for f in fields:
        text = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` (stored) with ``i``, the number inside the tree by ``order``, and ``n``, the tree's rows. Rows are range
    partitioned and sorted, and numbered from the starts of the (partition, tree) runs: partitions + trees small rows."""
    ranged = rows.repartitionByRange(F.col(tree).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order])
    ranged = ranged.sortWithinPartitions(F.col(tree).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order])
    held = stored(ranged.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    held = held.withColumn("__part", F.shiftright("__at", 33))
    runs = held.groupBy("__part", F.col(tree).alias("__tree")).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__low"))
    mine = Window.partitionBy("__tree")
    before = F.sum("__n").over(mine.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("__n").over(mine)
    runs = runs.select("__part", "__tree", (F.coalesce(before, F.lit(0)) - F.col("__low")).alias("__shift"), total.alias("n"))
    runs = runs.withColumnRenamed("__part", "__run")
    out = held.join(runs, (F.col("__part") == F.col("__run")) & F.col(tree).eqNullSafe(F.col("__tree")))
    return out.withColumn("i", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__run", "__tree", "__shift")


@dataclass
class Forest:
    """Layers of blocks, lowest first: (tree, block, size, levels, nodes, states and, in the lowest, members)."""

    layers: list[DataFrame]
    roots: DataFrame  # tree, root


def _height(n: Column) -> Column:
    """Levels above ``n`` nodes: the least k with n <= 2^k."""
    return F.length(F.bin(n - 1)) - F.when(n == 1, 1).otherwise(0)


def grow(rows: DataFrame, tree: str, leaf: str) -> Forest:
    """The trees over numbered rows (``tree``, ``i``, ``n``, ``leaf``; other columns are kept as members)."""
    others = [c for c in rows.columns if c not in (tree, "i", "n")]
    nodes = rows.select(F.col(tree).alias("tree"), "i", "n", F.struct(*others).alias("member"), F.hex(leaf).alias("hex"))
    layers, roots = [], None
    while True:
        cell = F.sort_array(F.collect_list(F.struct("i", "hex", *(["member"] if not layers else []))))
        blocks = nodes.groupBy("tree", F.shiftright("i", LEVELS).alias("block")).agg(cell.alias("cells"), F.max("n").alias("n"))
        blocks = blocks.withColumn("size", F.size("cells")).withColumn("levels", F.when(F.col("n") > FAN, LEVELS).otherwise(_height(F.col("n"))).cast("int"))
        blocks = blocks.withColumn("grown", F.arrow_udf(_grow, "struct<nodes:binary,states:binary>")(F.unhex(F.array_join("cells.hex", "")), "levels"))
        members = [] if layers else [F.col("cells.member").alias("members")]
        blocks = stored(blocks.select("tree", "block", "n", "size", "levels", "grown.nodes", "grown.states", *members), "blocks")
        layers.append(blocks)
        tops = blocks.select("tree", F.col("block").alias("i"), "n", F.substring("nodes", -DIGEST, DIGEST).alias("root"))
        ended = tops.where(F.col("n") <= FAN).select("tree", "root")
        roots = ended if roots is None else roots.unionByName(ended)
        more = tops.where(F.col("n") > FAN)
        if not (blocks.agg(F.max("n")).first()[0] or 0) > FAN:
            return Forest(layers, roots)
        nodes = more.select("tree", "i", F.ceil(F.col("n") / FAN).alias("n"), F.hex("root").alias("hex"))


def descend(forest: Forest, above: DataFrame) -> DataFrame:
    """The lowest layer with the steps of each block's root to the root of all (``kinds``, ``siblings``, ``before``).
    ``above``: (tree, kinds, siblings, before and columns to carry) of the trees' roots."""
    carried = [c for c in above.columns if c != "tree"]
    extra = [c for c in carried if c not in ("kinds", "siblings", "before")]
    above = above.withColumnRenamed("tree", "__tree")
    routes = None
    for depth in range(len(forest.layers) - 1, -1, -1):
        layer = forest.layers[depth]
        here = layer.where(F.col("n") <= FAN).join(above, F.col("tree").eqNullSafe(F.col("__tree"))).drop("__tree")
        if routes is not None:
            lower = layer.where(F.col("n") > FAN).join(routes, F.col("tree").eqNullSafe(F.col("__tree")) & (F.col("block") == F.col("__block")))
            here = here.unionByName(lower.drop("__tree", "__block"))
        if not depth:
            return here
        routes = here.select(F.col("tree").alias("__tree"), "block", *extra, F.posexplode(_routed()).alias("slot", "route"))
        routes = stored(routes.select("__tree", (F.col("block") * FAN + F.col("slot")).alias("__block"), *extra, "route.*"), "routes")


def merkle(df: DataFrame, fields: list[str], tree: str = "lang", order: str = "doc_id", replaced: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``df``: ``order``, ``tree``, ``leaf``, ``subroot``, ``root``, ``proof`` (SHA-256 of its siblings),
    ``folded_root`` (all binary) and ``verified``. ``replaced`` gives new values of some fields: ``folded_root`` is folded
    from the leaf of these values and the siblings of the stored tree."""
    new = leaf_digest([(replaced or {}).get(c, df[c]) for c in fields]) if replaced else leaf_digest([df[c] for c in fields])
    rows = df.select(df[tree].alias("tree"), df[order].alias("id"), leaf_digest([df[c] for c in fields]).alias("leaf"), new.alias("new"), F.rand(11).alias("tie"))
    rows = numbered(stored(rows, "leaves"), "tree", ["id", "leaf", "tie"]).drop("tie")
    trees = grow(rows, "tree", "leaf")
    tops = stored(trees.roots.select(F.lit(0).alias("all"), F.col("tree").alias("name"), "root"), "subroots")
    whole = grow(numbered(tops, "all", ["name"]), "all", "root")
    none = F.lit(b"").cast("binary")
    root = whole.roots.select("tree", F.col("root").alias("__root"), none.alias("kinds"), none.alias("siblings"), none.alias("before"))
    above = descend(whole, root)
    cells = above.select("__root", F.posexplode(F.arrays_zip("members", _routed().alias("route"))).alias("slot", "cell"))
    above = stored(cells.select(F.col("cell.members.name").alias("tree"), F.col("cell.members.root").alias("__subroot"), "__root", "cell.route.*"), "tops")
    blocks = descend(trees, above)
    put = F.arrow_udf(_fold, "binary")(F.unhex(F.array_join(F.transform("members.new", F.hex), "")), "size", "levels", "nodes", "states", "kinds", "siblings", "before")
    rows = blocks.select("tree", "__subroot", "__root", put.alias("__out"), "members")
    rows = rows.select("tree", "__subroot", "__root", "__out", F.posexplode("members").alias("slot", "m"))
    part = [F.substring(F.col("__out"), F.col("slot") * 2 * DIGEST + 1 + DIGEST * k, F.lit(DIGEST)) for k in (0, 1)]
    return rows.select(
        F.col("m.id").alias(order), F.col("tree").alias(tree), F.col("m.leaf").alias("leaf"), F.col("__subroot").alias("subroot"), F.col("__root").alias("root"),
        part[0].alias("proof"), part[1].alias("folded_root"), (part[1] == F.col("__root")).alias("verified"),
    )


def op11_merkle(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = F.when(hit, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))
    rows = merkle(docs, ["doc_id", "source", "lang", "n_chars", "text"], replaced={"n_chars": tampered})
    text = {"leaf": "leaf", "subroot": "subroot", "root": "root", "proof": "proof_sha256", "folded_root": "folded_root"}
    return rows.select("doc_id", *[F.lower(F.hex(a)).alias(b) for a, b in text.items()], "verified")
