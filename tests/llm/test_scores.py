"""Language, toxicity, language model, quality rules and the pipeline."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feedloom.llm import language, ppm, quality, queries, toxicity
from feedloom.llm.common import fold
from feedloom.llm.vocab import vocabulary_path

SF = "/root/testdata/sf0.001"


def test_forward_sums_all_segmentations():
    v = language.pieces(vocabulary_path("piece_bpe_32k.model"))
    rng = np.random.default_rng(1)
    prob = language.normalised(rng.uniform(0.1, 1, (v.size, 2)))
    known = [dict(zip(h.tolist(), n.tolist())) for h, n in zip(v.hashes, v.numbers)]

    def number(s):
        h = 0
        for ch in s:
            h = (h * int(language._BASE) + ord(ch)) % 2**64
        n = known[len(s) - 1].get(h, -1)
        return v.size - 1 if n < 0 and len(s) == 1 else n

    def total(s, k):
        if not s:
            return 1.0
        return sum(prob[number(s[:n]), k] * total(s[n:], k) for n in range(1, min(language.LONGEST, len(s)) + 1) if number(s[:n]) >= 0)

    words = ["the", "a", "nation", "größe", "日本", "zzz"]
    for rows, chars in language.by_length(words):
        logs = language.forward(language.lattice(chars, v), prob)
        for r, got in zip(rows, logs):
            assert np.allclose(got, [math.log(total(language.MARK + words[r], k)) for k in (0, 1)])


def test_expected_uses_add_up_to_characters():
    v = language.pieces(vocabulary_path("piece_bpe_32k.model"))
    prob = language.normalised(np.ones((v.size, 1)))
    size = np.zeros(v.size)
    for n, numbers in enumerate(v.numbers, 1):
        size[numbers] = n
    size[-1] = 1
    words = ["hello", "世界", "abc"]
    uses = language.expected(words, np.array([[2.0], [1.0], [3.0]]), v, prob)
    assert math.isclose((uses[:, 0] * size).sum(), 2 * 6 + 1 * 3 + 3 * 4, rel_tol=1e-9)


def test_language(spark, docs, nothing):
    rng = random.Random(4)
    en, de = "the of and to in is that".split(), "der die und das nicht ist größe".split()
    rows = [(i, " ".join(rng.choice(en if i % 2 else de) for _ in range(40)), "en" if i % 2 else "de") for i in range(60)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fold(F.col("doc_id"), 5) != 0)
    assert model.languages == ("de", "en")
    odd = [(1, "The nation and that is", "x"), (2, "DIE GRÖSSE UND DAS", "x"), (3, None, "x"), (4, "12 !!", "x"), (5, "", "x"), (6, "and" * 20000, "x")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(spark.createDataFrame(odd, "doc_id long, text string, score string"), model).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[3] == got[4] == got[5] == ("und", 0.0) and 0 <= got[6][1] <= 1
    assert language.predict(docs, model).count() == docs.count() and language.predict(nothing, model).count() == 0
    none = language.fit(nothing, F.lit(True))
    assert {r["lang_pred"] for r in language.predict(docs, none).collect()} == {"und"}


def test_folding():
    assert toxicity.folded("IDI0T, ıdі​ot; l1|r") == ["idiot", "idiot", "ii", "r"]
    assert toxicity.folded(None) == []


def test_toxicity(spark, docs, nothing):
    rng = random.Random(8)
    plain = [f"word{chr(97 + k)}{chr(97 + k // 3)}" for k in range(20)]
    texts, labels = [], []
    for i in range(240):
        w = [rng.choice(plain) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(30), rng.choice(["grumble", "snarling", "snarled"]))
        elif i % 4 == 1:
            w[5:5] = ["friendly", "grumble"]
        texts.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [labels[0], (None, 1), (7, None)], "doc_id long, toxic int")
    lexicon = toxicity.fit(frame, marks, fold(F.col("doc_id"), 3) != 1)
    assert any("snar" in t for t in lexicon.weights)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(frame, lexicon).collect()}
    assert sum(got[i] == t for i, t in labels) >= 0.95 * len(labels)
    assert "snar1ing" not in plain and toxicity.toxicity(spark.createDataFrame([(1, "oh SNАR1ING so snarled")], "doc_id long, text string"), lexicon).first()["predicted"] == 1
    out = toxicity.toxicity(docs, lexicon).select("score").collect()
    assert all(0 <= r["score"] <= 1 for r in out) and toxicity.toxicity(nothing, lexicon).count() == 0
    empty = toxicity.fit(frame, marks.where("toxic > 5"), F.lit(True))
    assert {r["predicted"] for r in toxicity.toxicity(frame, empty).collect()} == {0}


def test_exception_phrases():
    lexicon = toxicity.Lexicon({" badx": 2.0, " sad ": 1.0}, frozenset([" very badx "]), (0.0, 0.0, 0.0))
    a = lexicon.automaton()
    assert [m[2] for m in toxicity.matches("a badxy sad sadly".split(), a)] == [2.0, 1.0]
    assert toxicity.matches("not very badx".split(), a) == []


def slow_ppm(train, texts, order):
    tables = [defaultdict(Counter) for _ in range(order + 1)]
    for s in train:
        s = ppm.END * order + s
        for i in range(order, len(s)):
            for j in range(order + 1):
                tables[j][s[i - j : i]][s[i]] += 1
    out = []
    for s in texts:
        s, total = ppm.END * order + s, 0.0
        for i in range(order, len(s)):
            excluded: set = set()
            for j in range(order, -1, -1):
                seen = tables[j].get(s[i - j : i])
                if not seen:
                    continue
                live = {k: c for k, c in seen.items() if k not in excluded}
                if not live:
                    continue
                n, d = sum(live.values()), len(live)
                if s[i] in live:
                    total += math.log10(live[s[i]] / (n + d))
                    break
                total += math.log10(d / (n + d))
                excluded |= set(seen)
            else:
                total -= math.log10(256 - len(excluded))
        out.append(total)
    return out


@pytest.mark.parametrize("order", [2, 5])
def test_ppm(docs, corpus, order):
    held = {i: (0 if i is None else __import__("zlib").crc32(str(i).encode()) % 7) == 2 for i, _ in corpus}
    got = ppm.score_texts(docs.select("doc_id", "text", "score"), fold(F.col("doc_id"), 7) != 2, order=order, batch_bytes=2000, alike=F.col("doc_id") % 3).collect()
    seqs = [ppm.sequence(t) for _, t in corpus]
    train = [s for s, (i, _) in zip(seqs, corpus) if not held[i]]
    counts = Counter()
    for s in train:
        counts.update(s.split())
        counts["END"] += 1
    total, types = sum(counts.values()), len(counts)
    expected = Counter()
    for (i, t), s, score in zip(corpus, seqs, slow_ppm(train, seqs, order)):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        c = [counts[w.encode()] for w in words] + [counts["END"]]
        base = sum(math.log10((x + 1) / (total + types + 1)) for x in c)
        expected[(i, len(c), sum(x > 0 for x in c), total, f"{base:.5f}", f"{score:.3f}")] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], f"{r['base_score']:.5f}", f"{r['score']:.3f}") for r in got) == expected


def test_ppm_edges(docs, nothing):
    assert ppm.score_texts(nothing.select("doc_id", "text"), F.lit(True)).count() == 0
    untaught = ppm.score_texts(docs.select("doc_id", "text"), F.lit(False)).where("doc_id = 3").first()
    assert math.isclose(untaught["score"], -5 * math.log10(256), rel_tol=1e-6) and untaught["train_tokens"] == 0 and untaught["n_known"] == 0


def test_next_byte_probabilities_add_up(spark):
    """The model is a distribution: over all next bytes the probabilities of a seen and an unseen context sum to one."""
    order = 2
    train = [b"abab ac \n", b"ba \n"]
    counts = Counter()
    for s in train:
        w, _ = ppm.windows([s], order)
        counts.update(w.tolist())
    for context in (b"ab", b"zz", b"za"):
        base = int.from_bytes(context, "big") << 8
        rows = [(k, n) for k, n in counts.items()] + [(base | b, 0) for b in range(256) if base | b not in counts]
        scores = ppm.window_scores(spark.createDataFrame(rows, "key long, n long"), order).where((F.shiftright("key", 8) == base >> 8)).collect()
        assert len(scores) == 256 and math.isclose(sum(10 ** r["value"] for r in scores), 1.0, rel_tol=1e-9)


def plain_metrics(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {k + j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered)


def test_quality_metrics(docs, corpus, nothing):
    extra = ["a b c d e f g h " * 3, "x\nx\n\n x\nx", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8", "# <b>|$5%&* é€"]
    for t in [t for _, t in corpus] + extra:
        assert quality.metrics_of(t) == plain_metrics(t)
    got = quality.measure(docs.withColumn("n_words", F.lit("clash"))).collect()
    assert Counter((r["doc_id"], *[r[c] for c in quality.COUNTS]) for r in got) == Counter((i, *plain_metrics(t)) for i, t in corpus)
    assert quality.measure(nothing).count() == 0


@pytest.mark.parametrize("k,n,error", [(0, 10, 0.05), (3, 50, 0.01), (40, 1000, 0.001), (0, 1, 0.5)])
def test_binomial_bound(k, n, error):
    p = quality.binomial_upper(k, n, error)
    assert math.isclose(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), error, rel_tol=1e-6)
    assert quality.binomial_upper(n, n, error) == quality.binomial_upper(0, 0, error) == 1.0


def test_cutoffs_limit_false_rejection(spark, nothing):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(4000):
        good = i % 5 != 0
        w = [rng.choice("abcdefghijk") * rng.randint(2, 6) for _ in range(40)]
        if not good:
            w = [x + "%%" for x in w]
        elif i % 500 == 1:
            w[0] += "%"
        rows.append((i, " ".join(w)))
        labels.append((i, int(good)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(frame, marks).collect()}
    assert sum(not kept[i] for i, q in labels if q) <= 0.02 * 3200 and not any(kept[i] for i, q in labels if not q)
    alone = quality.quality_rules(frame, marks.where("doc_id < 0"))
    assert alone.where("kept <> (not base_failed)").count() == 0
    assert quality.quality_rules(nothing, marks).count() == 0


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r[0] for r in out.select("doc_id").distinct().collect()}
    assert ids < {r[0] for r in docs.select("doc_id").collect()} and len(ids) > 50
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, SF)
        assert step.columns == docs.columns and step.dtypes == docs.dtypes


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))
