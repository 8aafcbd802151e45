"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits agree in at least 5 of their 8 byte positions. The index posts a
fingerprint under sets of 4 positional bytes; the 4-sets are a covering design: each 5 positions contain one of them, so
every pair to be found shares a posting list. In a list the shared positional bytes of a pair are tallied, pairs with at
least 5 are retained, and their bits are counted. Copies are one fingerprint beforehand; long lists are dealt into pairs
of blocks; a task returns a spanning forest of its links, never all pairs.

Edge cases: a text without words (null, empty, white space) has fingerprint zero and links like any other; one or two
words are one shingle; repeated rows share a fingerprint; an empty table gives an empty result; a result column replaces
an input column of the same name.

``similar_texts`` is the same index for word shingles of any width and a Jaccard similarity that 3 of 64 bits do not reach
(0.8 is 9.7 of 64 on average): 256 bits over the set of shingles, 32 byte positions, postings under pairs of positions (a
covering design: each 5 positions contain one of the pairs) and the size class of the set, bits counted on 128, then the
exact similarity of the shingle sets of candidates. Nothing below the similarity is linked; what is missed is a pair
without a common posting or with more than ``TALLY`` bits (at 0.8 about 1.1 % and 0.1 % by binomial estimate, less above
it). Texts and shingles are told apart by 64-bit hashes; all texts without words are one. Near copies that share most
lists do not meet in all pairs: in crowded lists and components they are linked through one text, in linear time. Texts of
any length are hashed whole; a component's shingle sets are held by one task for at most ``NODES`` texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import released, stored, table, text_bytes, with_columns
from feedloom.llm.graph import blocked, by_group, components, forest, pairs_in

BYTES, DISTANCE, WIDTH = 8, 3, 4
BLOCK = 1024
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def covering(n: int = BYTES, matching: int = BYTES - DISTANCE, width: int = WIDTH) -> list[tuple[int, ...]]:
    """``width``-sets of which every ``matching``-set of positions contains at least one, chosen greedily."""
    open_ = set(combinations(range(n), matching))
    sets = list(combinations(range(n), width))
    out = []
    while open_:
        best = max(sets, key=lambda s: (sum(set(s) <= set(m) for m in open_), [-x for x in s]))
        out.append(best)
        open_ = {m for m in open_ if not set(best) <= set(m)}
    return out


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash over XXH64 of the word shingles."""
    from xxhash import xxh64_intdigest

    words = text_bytes(text).lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxh64_intdigest(joined, seed)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(size)
        starts = (ends - size)[: len(words) - width + 1].tolist()
        hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]
    each = np.array(hashes, "<u8").view(np.uint8).reshape(-1, BYTES)
    votes = np.concatenate([np.bincount(each[:, k], minlength=256) @ _BITS for k in range(BYTES)])
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", name: str = "__fp") -> DataFrame:
    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in released(batches):
            yield pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return with_columns(docs, {name: hashed(F.col(text))})


def _links(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
    fp, side = frame["fp"].to_numpy(), frame["side"].to_numpy()
    found_a, found_b = [], []
    for i, j in pairs_in(starts, len(fp), side):
        differ = fp[i] ^ fp[j]
        tally = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
        near = tally >= BYTES - DISTANCE
        near[near] = np.bitwise_count(differ[near].view(np.uint64)) <= DISTANCE
        a, b = forest(fp[i[near]], fp[j[near]])
        found_a.append(a)
        found_b.append(b)
    a, b = forest(np.concatenate(found_a), np.concatenate(found_b)) if found_a else (fp[:0], fp[:0])
    return pd.DataFrame({"a": a, "b": b})


def near_links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect all fingerprints of the column ``fp`` (distinct values) within the distance."""
    byte = [F.shiftrightunsigned("fp", 8 * k).bitwiseAND(F.lit(255)) for k in range(BYTES)]
    keys = []
    for n, chosen in enumerate(covering()):
        key = F.lit(n).cast("long")
        for k in chosen:
            key = F.shiftleft(key, 8).bitwiseOR(byte[k])
        keys.append(key)
    posted = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    return by_group(blocked(posted, "key", "fp", block).select("group", "side", "fp"), _links, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``docs`` without its text, with ``fingerprint`` (16 hex digits) and ``component_id`` (smallest id reachable)."""
    printed = stored(fingerprints(docs, text).drop(text), "fingerprints")
    prints = stored(printed.groupBy(F.col("__fp").alias("fp")).agg(F.min(id_col).alias("low")), "prints")
    parts = components(near_links(prints.select("fp"), block)).withColumnRenamed("node", "fp")
    rooted = stored(prints.join(parts, "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("root")), "roots")
    lowest = stored(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    named = stored(rooted.join(lowest, "root").select(F.col("fp").alias("__fp"), "component_id"), "named")
    out = printed.drop("fingerprint", "component_id").join(named, "__fp")
    return out.withColumn("fingerprint", F.lower(F.lpad(F.hex("__fp"), 16, "0"))).drop("__fp")


def op6_simhash(spark, sf_dir) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", "fingerprint", "component_id")


WIDE, GROUPS, TALLY, NODES = 32, 4, 32, 256
SIZE = 4  # ratio of the classes of set sizes


def pairs_of_positions(n: int = WIDE, groups: int = GROUPS) -> list[tuple[int, int]]:
    """2-sets of which each ``groups`` + 1 positions contain at least one: all pairs inside ``groups`` equal classes."""
    return [p for p in combinations(range(n), 2) if p[0] % groups == p[1] % groups]


def text_key(text: Column) -> Column:
    """64-bit key of a text; texts of nothing but white space and null are one."""
    return F.xxhash64(F.when(text.rlike(r"[^\x20\x09-\x0D]"), text).otherwise(F.lit("")))


def shingle_set(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles; a text of fewer words is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest

    words = text_bytes(text).lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-1]][: max(len(words) - width, 0) + 1].tolist()
    return np.unique(np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, (ends[min(width, len(words)) - 1 :] - 1).tolist())], "<u8"))


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """SimHash of 4 x 64 bits; the words beyond the first are mixed from the same hashes (SplitMix64)."""
    votes = []
    for k in range(4):
        x = shingles + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
        votes.append(np.unpackbits(x.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little").sum(axis=0, dtype=np.int64))
    return np.packbits(np.concatenate(votes) * 2 > len(shingles), bitorder="little").view("<i8")


def size_classes(size: Column, similarity: float) -> Column:
    """The classes a set of ``size`` is posted in: its own, and the next if a set of that class may be similar enough."""
    own = F.floor(F.log(float(SIZE), F.greatest(size, F.lit(1)).cast("double")) + 1e-12)
    edge = F.pow(F.lit(float(SIZE)), own + 1)
    return F.when(size + 1e-6 >= edge * similarity, F.array(own, own + 1)).otherwise(F.array(own))


def _bits(prefix: str) -> Column:
    """Bits in which the first 128 of two fingerprints differ."""
    return F.bit_count(F.col("f0").bitwiseXOR(F.col(f"{prefix}.f0"))) + F.bit_count(F.col("f1").bitwiseXOR(F.col(f"{prefix}.f1")))


def _dealt(rows: DataFrame, crowded: DataFrame, key: str, spread: str) -> DataFrame:
    """Rows in groups, ``group`` and ``side`` (0: all pairs count, 1 and 2: pairs of two parts). A key that ``crowded`` (key,
    majors, minors: parts of each) does not name is one group. The majors of a crowded key (column ``major``) are linked
    already, so pairs of two majors are left out: each part of majors meets every part of minors, and minors meet minors."""
    sized = rows.join(crowded, key, "left").withColumns({"majors": F.coalesce("majors", F.lit(0)), "minors": F.coalesce("minors", F.lit(1))})
    h = F.xxhash64(F.lit(key), spread)
    sized = sized.withColumn("__b", F.when(F.col("major"), F.pmod(h, F.col("majors"))).otherwise(F.col("majors") + F.pmod(h, F.greatest("minors", F.lit(1)))).cast("int"))
    last = F.col("majors") + F.col("minors") - 1
    partners = F.when(F.col("minors") == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.when(F.col("major"), F.col("majors")).otherwise(F.lit(0)), last))
    meets = F.explode(F.transform(partners, lambda j: F.struct(
        F.xxhash64(key, F.least("__b", j), F.greatest("__b", j)).alias("group"),
        F.when(F.col("__b") == j, 0).when(F.col("__b") < j, 1).otherwise(2).cast("byte").alias("side"))))
    return sized.withColumn("__m", meets).withColumn("group", F.col("__m.group")).withColumn("side", F.col("__m.side")).drop("majors", "minors", "__b", "__m", key)


def _parts(rows: DataFrame, key: str, block: int) -> DataFrame:
    """Numbers of parts of the majors and minors of each key of ``rows``."""
    counts = rows.groupBy(key).agg(F.count_if("major").alias("majors"), F.count_if(~F.col("major")).alias("minors"))
    return counts.select(key, *[F.ceil(F.col(c) / block).cast("int").alias(c) for c in ("majors", "minors")])


def _near_pairs(frame: pd.DataFrame, starts: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    f = [frame[c].to_numpy().view(np.uint64) for c in ("f0", "f1")]
    for i, j in pairs_in(starts, len(frame), frame["side"].to_numpy(), 500_000):
        bits = np.bitwise_count(f[0][i] ^ f[0][j]).astype(np.int64)
        bits += np.bitwise_count(f[1][i] ^ f[1][j])
        near = bits <= most
        yield i[near], j[near], bits[near]


def _candidates(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
    """Links of all near pairs of the lists (a spanning forest, without bits) and each row's nearest partner with its bits."""
    node = frame["node"].to_numpy()
    best = np.full(len(node), 1 << 62)
    found_a, found_b = [node[:0]], [node[:0]]
    for i, j, bits in _near_pairs(frame, starts, TALLY):
        a, b = forest(node[i], node[j])
        found_a.append(a)
        found_b.append(b)
        np.minimum.at(best, i, bits << 40 | j)
        np.minimum.at(best, j, bits << 40 | i)
    a, b = forest(np.concatenate(found_a), np.concatenate(found_b))
    has = np.flatnonzero(best < 1 << 62)
    bits = np.r_[np.full(len(a), 255), best[has] >> 40]
    link = np.r_[np.ones(len(a), bool), np.zeros(len(has), bool)]
    return pd.DataFrame({"a": np.r_[a, node[has]], "b": np.r_[b, node[best[has] & (1 << 40) - 1]], "bits": bits.astype(np.int16), "link": link})


def _similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _verified(similarity: float):
    def work(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        node, sets = frame["node"].to_numpy(), [np.frombuffer(x, "<u8") for x in frame["shingles"]]
        root, links = np.arange(len(frame)), []
        for a, b in zip(starts, np.r_[starts[1:], len(frame)]):
            linked = a + np.flatnonzero(frame["major"].to_numpy()[a:b])  # through their hub
            root[linked] = linked[:1]
        for i, j, bits in _near_pairs(frame, starts, TALLY):
            order = np.argsort(bits, kind="stable")
            for x, y in zip(i[order].tolist(), j[order].tolist()):
                if root[x] != root[y] and _similar(sets[x], sets[y], similarity):
                    links.append((node[x], node[y]))
                    root[root == root[y]] = root[x]
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return work


def candidate_links(prints: DataFrame, similarity: float, block: int) -> DataFrame:
    """(a, b, bits, link): pairs of texts that share a posting list and differ in at most ``TALLY`` of 128 bits. Those with
    ``link`` connect all such pairs (a spanning forest of each list); the others are each text's nearest partner in a list. In a list of more than ``block`` texts those near to its first one are
    linked through that one; only the others are compared with all."""
    byte = [F.shiftrightunsigned(f"f{k // BYTES}", 8 * (k % BYTES)).bitwiseAND(F.lit(255)) for k in range(WIDE)]
    chosen = pairs_of_positions()
    keys = F.array(*[(F.lit(n * 65536) + byte[x] * 256 + byte[y]).cast("int") for n, (x, y) in enumerate(chosen)])
    keys = F.flatten(F.transform(size_classes(F.col("size"), similarity), lambda c: F.transform(keys, lambda k: (c * len(chosen) * 65536 + k).cast("int"))))
    posted = prints.select(F.explode(keys).alias("key"), "node", "f0", "f1")
    many = stored(posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("key"), "crowded")
    held = posted.join(many, "key")
    first = stored(held.groupBy("key").agg(F.min(F.struct("node", "f0", "f1")).alias("hub")), "hubs")
    starred = stored(held.join(first, "key").withColumn("bits", _bits("hub")).select("key", "node", "f0", "f1", F.col("hub.node").alias("hub"), "bits", (F.col("bits") <= TALLY).alias("major")), "starred")
    stars = starred.where("major and node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"), F.col("bits").cast("short"))
    stars = stars.groupBy("a", "b").agg(F.min("bits").alias("bits")).withColumn("link", F.lit(True))
    light = posted.join(many, "key", "left_anti").withColumn("major", F.lit(False))
    dealt = _dealt(light.unionByName(starred.drop("hub", "bits")), _parts(starred, "key", block), "key", "node")
    return by_group(dealt.drop("major"), _candidates, "a long, b long, bits short, link boolean", ["node"]).unionByName(stars)


def similar_texts(docs: DataFrame, text: str = "text", width: int = 5, similarity: float = 0.8, block: int = BLOCK, nodes: int = NODES) -> DataFrame:
    """(node, component) of every text (by ``text_key``) that is linked to another one by shingle sets of Jaccard similarity
    ``similarity`` or more; ``component`` is one of the group's own keys. A text without links may be absent.

    Candidates are verified inside their component: all pairs of up to ``nodes`` texts in one task; in a larger component
    those similar to its hub (the text that is most often the nearest of another) are linked through it, and only the
    others are compared with all, part by part."""
    texts = docs.select(text_key(F.col(text)).alias("node"), F.col(text).alias("text"))

    @F.pandas_udf("array<long>")
    def printed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in released(batches):
            out = []
            for t in batch:
                found = shingle_set(t, width)
                out.append(np.r_[wide_fingerprint(found), len(found)])
            yield pd.Series(out)

    @F.pandas_udf("binary")
    def shingled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in released(batches):
            yield pd.Series([shingle_set(t, width).tobytes() for t in batch])

    @F.pandas_udf("boolean")
    def alike(ones: pd.Series, others: pd.Series) -> pd.Series:
        return pd.Series([_similar(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8"), similarity) for a, b in zip(ones, others)], dtype=bool)

    def sets(of: DataFrame) -> DataFrame:
        """The nodes of ``of`` with their shingle sets, each text read once."""
        return texts.join(of, "node").groupBy("node").agg(F.any_value("text").alias("text"), *[F.any_value(c).alias(c) for c in of.columns if c != "node"]).withColumn("shingles", shingled("text")).drop("text")

    prints = texts.select("node", printed("text").alias("f")).groupBy("node").agg(F.any_value("f").alias("f"))
    prints = stored(prints.select("node", *[F.col("f")[k].alias(f"f{k}") for k in range(4)], F.col("f")[4].alias("size")), "wide")
    near = stored(candidate_links(prints, similarity, block), "near")
    found = components(near.where("link").select("a", "b"))
    # a root is not listed: it is a member too
    found = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
    found = stored(found.join(prints.select("node", "f0", "f1"), "node"), "candidates")
    large = stored(found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > nodes).select("component"), "large")
    small = sets(found.join(large, "component", "left_anti")).withColumns({"group": F.col("component"), "side": F.lit(0).cast("byte"), "major": F.lit(False)}).drop("component")
    links = by_group(small, _verified(similarity), "a long, b long", ["node"])

    crowd = stored(sets(found.join(large, "component")), "sets")
    nearest = near.where("bits < 255").groupBy("a").agg(F.min(F.struct("bits", "b")).alias("m")).select(F.col("m.b").alias("node"))
    votes = nearest.groupBy("node").agg(F.count(F.lit(1)).alias("votes"))
    hubs = found.join(large, "component").join(votes, "node", "left").groupBy("component").agg(F.max(F.struct(F.coalesce("votes", F.lit(0)), "node")).alias("m"))
    hubs = stored(hubs.select("component", F.col("m.node").alias("hub")), "hubs")
    hub_sets = hubs.join(crowd.select(F.col("node").alias("hub"), F.col("shingles").alias("model")), "hub")
    tested = stored(crowd.select("node", "component", "shingles").join(hub_sets, "component").select("node", "component", "hub", alike("shingles", "model").alias("major")), "tested")
    stars = tested.where("major and node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    rest = crowd.join(tested.select("node", "major"), "node")
    dealt = _dealt(rest, _parts(tested, "component", nodes), "component", "node")
    links = links.unionByName(stars).unionByName(by_group(dealt, _verified(similarity), "a long, b long", ["node"]))
    return components(links)
