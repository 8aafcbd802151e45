"""Shared passages against a plain search."""

import random

from feedloom.plans import overlap as ov

N = 4


def plain(items, docs):
    grams = {tuple(w[i : i + N]) for _, t in docs for w in [(t or "").split()] for i in range(len(w) - N + 1)}
    out = {}
    for k, t in items:
        w = (t or "").split()
        hit = [i for i in range(len(w) - N + 1) if tuple(w[i : i + N]) in grams]
        covered = {j for i in hit for j in range(i, i + N)}
        out[k] = (len(w), max(len(w) - N + 1, 0), len(hit), len(covered), round(len(covered) / len(w), 6) if w else 0.0)
    return out


def plain_runs(items, docs, least):
    out = set()
    for k, t in items:
        a = (t or "").split()
        for d, u in docs:
            b = (u or "").split()
            for i in range(len(a)):
                for j in range(len(b)):
                    if a[i] == b[j] and not (i and j and a[i - 1] == b[j - 1]):
                        n = 0
                        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                            n += 1
                        if n >= max(N, least):
                            out.add((k, d, i, j, n))
    return out


def test_coverage_and_runs(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice("abc") + rng.choice("xy") for _ in range(n))
    items = [(k, text(rng.randint(0, 25))) for k in range(30)] + [(100, None), (101, ""), (102, "ax bx")]
    hot = text(12)
    docs = [(k, text(rng.randint(0, 20)) + " " + hot) for k in range(40)] + [(900, items[3][1]), (901, items[3][1]), (902, None)]
    i = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["item_id"]: tuple(r)[1:] for r in ov.passage_coverage(i, d, n=N).collect()}
    assert got == plain(items, docs)
    runs = {tuple(r) for r in ov.passage_runs(i, d, n=N, least=6).collect()}
    assert runs == plain_runs(items, [x for x in docs if x[0] != 901], 6) and runs
    assert ov.passage_coverage(i.where("false"), d, n=N).count() == 0 and ov.passage_runs(i, d.where("false"), n=N).count() == 0


def test_long_texts_take_time_in_proportion(spark):
    """A text's words are taken once, not once for each of its grams, and its grams are not compared with each other."""
    import time

    text = " ".join(f"w{i}" for i in range(20_000))
    items = spark.createDataFrame([(1, text)], "item_id int, text string")
    start = time.time()
    got = ov.passage_coverage(items, items.select("text"), n=8).first()
    assert (got.words, got.grams, got.hits, got.covered) == (20_000, 19_993, 19_993, 20_000)
    assert time.time() - start < 20
