import random

import pytest

SCHEMA = "doc_id long, text string, lang string, n_tokens string, score string, ids string"


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): nulls, empty and white texts, copies, near copies, a shared passage, odd white space, long words,
    repeated rows and a null id."""
    rng = random.Random(7)
    passage = words(rng, 70)
    texts = [None, "", "   \n\t ", "one", "Two words", "a  b c \x1c d\x85e", "don't  STOP\n\nnow!! it's 12345 naïve Größe", "x" * 5000, "ab" * 700]
    texts += [words(rng, 120) for _ in range(20)]
    texts += [texts[10]] * 5 + [texts[11] + " tail"] + [texts[12].replace("a", "b", 1)]
    texts += [words(rng, 30) + " " + passage + " " + words(rng, 40) for _ in range(4)]
    texts += ["äöü ßç " * 60, "<|endoftext|> inside <|startoftext|> x", "日本語のテキスト 🙂 emoji", words(rng, 3000)]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [rows[15], rows[15], (None, "no id here at all")]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "xx", "clash", "clash", "clash") for i, t in corpus], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
