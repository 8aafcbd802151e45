"""Which of very many keywords occur in which texts, as a join: no task and no driver holds the keywords.

Every keyword is posted under one gram of its bytes (three; all of a shorter one), the one that is rarest in a sample of
the texts. A bitmap over all grams (2 MB whatever the number of keywords) tells a task which grams of a text are posted at
all; those meet the keyword table, and a pair is kept if the text contains the keyword. The sample only decides which gram
is taken, never a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

GRAM = 3
SPACE = (1 << 24) + (1 << 16) + (1 << 8)  # codes of three, two and one byte
SAMPLE = 2000


def _codes(raw: bytes, size: int) -> np.ndarray:
    """Codes of all grams of ``size`` bytes."""
    b = np.frombuffer(raw, np.uint8).astype(np.int64)
    n = len(b) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    code = sum(b[k : k + n] << (8 * (size - 1 - k)) for k in range(size))
    return code + (0, (1 << 24) + (1 << 16), 1 << 24, 0)[size]


def keyword_grams(keyword: Column) -> Column:
    """Codes under which a keyword may be posted."""
    def run(words: pa.Array) -> pa.Array:
        raw = [w.encode("utf-8", "surrogatepass") for w in words.to_pylist()]
        return pa.array([np.unique(_codes(r, min(GRAM, len(r)))) for r in raw], pa.list_(pa.int64()))

    run.__annotations__ = {"words": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<long>")(keyword)


def text_grams(text: Column, posted: np.ndarray | None = None) -> Column:
    """Codes of a text's grams, of all three sizes; with ``posted`` (bytes of a bitmap) only those that are set in it."""
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            raw = b"" if t is None else t.encode("utf-8", "surrogatepass")
            code = np.unique(np.concatenate([_codes(raw, size) for size in (1, 2, 3)]))
            out.append(code if posted is None else code[posted[code >> 3] >> (code & 7) & 1 > 0])
        return pa.array(out, pa.list_(pa.int64()))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<long>")(text)


def posted_keywords(keywords: DataFrame, texts: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(keyword, gram): each distinct keyword with the gram of its own that is rarest in a sample of ``texts`` (``text``)."""
    some = texts.select("text").orderBy(F.xxhash64("text")).limit(sample)
    seen = some.select(F.explode(text_grams(F.col("text"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    each = keywords.select("keyword").where("keyword <> ''").distinct().select("keyword", F.explode(keyword_grams(F.col("keyword"))).alias("gram"))
    rare = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m")
    return each.join(seen, "gram", "left").groupBy("keyword").agg(rare).select("keyword", "m.gram")


def gram_bitmap(posted: DataFrame) -> np.ndarray:
    """Bitmap of the grams in use, by pages of the bitmap functions: at most 515 rows of 4 kB."""
    at = F.col("gram") + 1  # the functions count from 1
    pages = posted.groupBy(F.bitmap_bucket_number(at).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(SPACE // 8 + 4096 + 1, np.uint8)
    for r in pages:
        start = (r["page"] - 1) * 4096
        part = np.frombuffer(r["bits"], np.uint8)[: len(out) - start]
        out[start : start + len(part)] = part
    return out


def contained_keywords(rows: DataFrame, keywords: DataFrame, key: str = "id", sample: int = SAMPLE) -> DataFrame:
    """(key, keyword): the keywords (``keyword``) contained in the texts (``text``) of ``rows``; a null text contains none."""
    from feedloom.session import cut_lineage

    posted = cut_lineage(posted_keywords(keywords, rows, sample))
    bits = gram_bitmap(posted)
    grams = rows.select(key, F.explode(text_grams(F.col("text"), bits)).alias("gram"))
    pairs = grams.join(posted, "gram").select(F.col(key).alias("_key"), "keyword").distinct()
    return rows.join(pairs, F.col(key) == F.col("_key")).where(F.contains("text", "keyword")).select(key, "keyword").distinct()
