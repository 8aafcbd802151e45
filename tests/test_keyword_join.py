"""Keywords joined with texts against plain containment."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from feedloom.operators.keyword_join import contained_keywords, posted_keywords
from feedloom.plans import alerts as al
from workload.adapter import Tables


def test_pairs_equal_containment(spark):
    rng = random.Random(5)
    letters = "abcé日 #"
    texts = [(f"t{k}", "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))) for k in range(120)] + [("none", None), ("empty", ""), ("long", "xyz" * 40_000 + "needle")]
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(300)} | {"needle", "zx", "", "absent!", "é", "日"}
    rows = spark.createDataFrame(texts, "id string, text string").repartition(3)
    keywords = spark.createDataFrame([(w,) for w in words] * 2, "keyword string")
    for sample in (5, 2000):
        got = {(r["id"], r["keyword"]) for r in contained_keywords(rows, keywords, sample=sample).collect()}
        assert got == {(i, w) for i, t in texts for w in words if t and w and w in t}
    assert contained_keywords(rows, keywords.where("false")).count() == 0
    posted = posted_keywords(keywords, rows)
    assert posted.count() == posted.select("keyword").distinct().count() == len(words - {""})


def test_rules_match_alike_by_automaton_and_join(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    items, rules = t.items(), t.alert_rules()
    cols = ["rule_id", "item_id", "keyword", "by_significance"]
    want = sorted(map(str, al.match_rules(items, rules).select(*cols).collect()))
    assert sorted(map(str, al.match_rules(items, rules, most_keywords=0).select(*cols).collect())) == want
    twice = rules.withColumn("keywords", F.concat("keywords", F.array(F.lit("THE"), F.lit("e"))))
    assert sorted(map(str, al.match_rules(items, twice).select(*cols).collect())) == sorted(map(str, al.match_rules(items, twice, most_keywords=1).select(*cols).collect()))


def test_batches_of_long_texts_are_small(spark):
    from feedloom.plans.alerts import keyword_finder

    texts = spark.range(0, 60, 1, 1).select(F.col("id"), F.when(F.col("id") > 0, F.concat(F.repeat(F.lit("x"), 1_000_000), F.lit(" ünd mcp"))).alias("text"))
    sizes = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"id": [b.nbytes]}) for b in batches), "id long")
    assert max(r["id"] for r in sizes.collect()) <= 20_000_000
    find = keyword_finder(["mcp", "ünd", "no"])
    found = texts.select("id", find("text").alias("k")).collect()
    assert [r["k"] for r in found] == [[]] + [["mcp", "ünd"]] * 59
