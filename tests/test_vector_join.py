import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.operators.vector_index import VectorIndex
from feedloom.operators.vector_join import nearest_within
from feedloom.plans import similar as sm
from feedloom.plans import stages as st


def brute(queries, base, k, radius, exclude_self=True, inclusive=False):
    out = set()
    for qid, q, r in queries:
        cand = []
        for bid, b in base:
            if exclude_self and bid == qid:
                continue
            d = round(1 - float(np.dot(q, b) / (np.linalg.norm(q) * np.linalg.norm(b))), 6) + 0.0
            if d < r or (inclusive and d == r):
                cand.append((d, bid))
        for rn, (d, bid) in enumerate(sorted(cand)[:k], 1):
            out.add((qid, bid, d, rn))
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8))
    rows = [(f"v{i:03d}", (centres[i % 6] + 0.4 * rng.normal(size=8)).astype("float32")) for i in range(150)]
    hot = rows[0][1]
    rows += [(f"h{i:03d}", hot) for i in range(75)]  # a third of all rows are copies of one vector
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id string, vec array<float>")


@pytest.mark.parametrize("pivots,block_rows,k,radius", [(None, 4096, 1, 0.15), (9, 16, 1, 0.15), (9, 16, 4, 0.4), (25, 7, 3, 2.0), (1, 10, 5, 0.3)])
def test_matches_brute_force(spark, vectors, pivots, block_rows, k, radius):
    df = frame(spark, vectors)
    got = nearest_within(df, df, k=k, radius=radius, pivots=pivots, block_rows=block_rows).collect()
    want = brute([(i, v.astype(float), radius) for i, v in vectors], [(i, v.astype(float)) for i, v in vectors], k, radius)
    assert {(r.query_id, r.id, r.distance, r.rn) for r in got} == want


def test_radius_per_query_and_inclusive(spark, vectors):
    q = [(f"q{i}", vectors[i * 10][1], 0.05 * (i + 1)) for i in range(8)]
    qdf = spark.createDataFrame([(i, [float(x) for x in v], r) for i, v, r in q], "id string, vec array<float>, r double")
    got = nearest_within(qdf, frame(spark, vectors), k=6, radius=F.col("r"), exclude_self=False, inclusive=True, pivots=5, block_rows=20).collect()
    want = brute([(i, v.astype(float), r) for i, v, r in q], [(i, v.astype(float)) for i, v in vectors], 6, None, False, True)
    assert {(r.query_id, r.id, r.distance, r.rn) for r in got} == want


def item_frame(spark, rows):
    data = [(i, [float(x) for x in v], "processed", c, "2024-01-30 00:00:00") for i, v, c in rows]
    df = spark.createDataFrame(data, "id string, embedding array<float>, status string, cluster_id string, t string")
    return df.withColumn("created_at", F.col("t").cast("timestamp")).drop("t")


def test_cluster_chain_pair_and_inheritance(spark):
    def at(deg):
        return (np.cos(np.radians(deg)), np.sin(np.radians(deg)))

    rows = [
        ("a", at(0), None), ("b", at(2), None), ("c", at(5), None), ("d", at(9), None),  # chain ending in the pair a, b
        ("m", at(90), None), ("n", at(91), "old"),  # m inherits
        ("x", at(200), None),  # alone
    ]
    as_of = F.lit("2024-01-31").cast("timestamp")
    for order in (rows, rows[::-1]):
        got = {r.id: r.cluster_id for r in sm.cluster_items(item_frame(spark, order), as_of=as_of, threshold=0.01).collect()}
        assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "m": "old"}


def test_cluster_copies(spark, vectors):
    as_of = F.lit("2024-01-31").cast("timestamp")
    rows = [(i, v, None) for i, v in vectors if i.startswith("h")]
    got = {r.cluster_id for r in sm.cluster_items(item_frame(spark, rows), as_of=as_of).collect()}
    assert got == {"h000"}


def test_gate_paths_agree_and_limit_matters(spark):
    refs = spark.createDataFrame(
        [("p1", [1.0, 0.0], True), ("n1", [0.9, 0.1], False), ("p2", [0.0, 1.0], True)], "id string, embedding array<float>, is_positive boolean"
    )
    items = spark.createDataFrame([("i", [1.0, 0.0]), ("j", [0.0, 1.0]), ("k", None)], "id string, embedding array<float>")
    near = round(1 - round(1 - 0.9 / np.hypot(0.9, 0.1), 6), 6)
    for cap in (10, 1):
        got = {r.id: r.gate_score for r in st.gate_scores(items, refs, k=2, max_shipped=cap).collect()}
        assert got["i"] == pytest.approx(1 - 0.5 * near)
        assert got["j"] == pytest.approx(1 - 0.5 * (1 - round(1 - 0.1 / np.hypot(0.9, 0.1), 6)))
        assert got["k"] is None
    one = {r.id: r.gate_score for r in st.gate_scores(items, refs, k=1, max_shipped=10).collect()}
    assert one["i"] == pytest.approx(1.0)  # the negative is beyond the first neighbour
    none = st.gate_scores(items, refs.where("false")).collect()
    assert all(r.gate_score == 0.0 for r in none)


def test_tiles_of_a_task_do_not_multiply_the_shuffle(spark, vectors, monkeypatch):
    from feedloom.operators import vector_join as vj

    sent = []
    blocks = vj._blocks
    monkeypatch.setattr(vj, "_blocks", lambda *a: sent.append(blocks(*a)) or sent[-1])
    df = frame(spark, vectors)
    want = {(r.query_id, r.id, r.distance) for r in nearest_within(df, df, k=3, radius=2.0, block_rows=4096).collect()}
    got = {(r.query_id, r.id, r.distance) for r in nearest_within(df, df, k=3, radius=2.0, block_rows=4).collect()}
    assert got == want and len({b.count() for b, _ in sent}) == 1
    # and with blocks that are cut on both sides
    monkeypatch.setattr(vj, "SHIPPED_ROWS", 10)
    assert {(r.query_id, r.id, r.distance) for r in nearest_within(df, df, k=3, radius=2.0, block_rows=4).collect()} == want
    assert sent[-1][0].count() > sent[0][0].count()


@pytest.mark.parametrize("way", ["plain", "pivots", "index"])
def test_watchlists_whose_last_bits_differ_between_evaluations(spark, vectors, way, tmp_path):
    """Means are summed in the order in which the parts arrive."""

    def means(batches):
        rng = np.random.default_rng()
        for b in batches:
            b["concept_embedding"] = [v + 1e-13 * rng.normal(size=len(v)) for v in b["concept_embedding"]]
            yield b

    asked = [(f"w{k}", [float(x) for x in vectors[10 * k][1]], 0.5, True) for k in range(6)]
    schema = "id string, concept_embedding array<double>, similarity_threshold double, is_active boolean"
    lists = spark.createDataFrame(asked, schema)
    items = item_frame(spark, [(i, v, None) for i, v in vectors])
    how = {"plain": {}, "pivots": {"pivots": 9, "block_rows": 16}, "index": {}}[way]
    if way == "index":
        stored = frame(spark, vectors)
        how["index"] = VectorIndex(spark, str(tmp_path / "index"), tops=2, leaves=4).create(stored).append(stored, 0)
    got = sm.watchlist_matches(items, lists.mapInPandas(means, schema), limit=5, **how).collect()
    want = brute([(i, np.array(v), 0.5) for i, v, *_ in asked], [(i, v.astype(float)) for i, v in vectors], 5, None, False, True)
    assert {(r.watchlist_id, r.id, r.match_score, r.rn) for r in got} == {(q, i, round(1 - d, 6), n) for q, i, d, n in want} and len(want) == 30
