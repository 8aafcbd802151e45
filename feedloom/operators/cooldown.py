"""Greedy cooldown: per key the first event fires, then the first one at least ``cooldown`` seconds after the last fire.

This is inherently sequential per key, so what reaches one task per key is made small first: events are reduced to one
per (key, second), and the seconds of a key to words of 64 bits: a lone second costs one row, and a key with a year of
events, however many, is half a million rows, which pass a task in order. After deliveries, which have few keys (rules),
the seconds are bitmaps of 4 kB per 32,768 seconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BITS = 32768


def fire_seconds(seconds: np.ndarray, cooldown: int, ready_at: int) -> tuple[list[int], int]:
    """Fires within one sorted run of seconds, given the first second allowed to fire."""
    out, cooldown = [], max(cooldown, 1)
    i = int(np.searchsorted(seconds, ready_at))
    while i < len(seconds):
        out.append(int(seconds[i]))
        ready_at = int(seconds[i]) + cooldown
        i = int(np.searchsorted(seconds, ready_at))
    return out, ready_at


def attempt_seconds(seconds: np.ndarray, delivered: np.ndarray, cooldown: int, ready_at: int) -> tuple[list[np.ndarray], int]:
    """Attempts within one sorted run of seconds where only a delivery (``delivered``: those seconds with one) starts the
    cooldown: all seconds from the first allowed one up to the next delivery, then those after its cooldown."""
    out, cooldown = [], max(cooldown, 1)
    while True:
        a = int(np.searchsorted(seconds, ready_at))
        d = int(np.searchsorted(delivered, ready_at))
        if d == len(delivered):
            out.append(seconds[a:])
            return out, ready_at
        out.append(seconds[a : int(np.searchsorted(seconds, delivered[d], "right"))])
        ready_at = int(delivered[d]) + cooldown


def _set_bits(bits: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, dtype=np.uint8), bitorder="little"))


def _fold_attempts(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("bucket")
    ready, tried = -(2**62), []
    for bucket, bits, good, cooldown in zip(pdf["bucket"], pdf["bits"], pdf["delivered"], pdf["cooldown_seconds"]):
        base = (int(bucket) - 1) * BITS + 1
        got, ready = attempt_seconds(base + _set_bits(bits), base + _set_bits(good), int(cooldown), ready)
        tried += got
    return pd.DataFrame({"key": pdf["key"].iloc[0], "second": np.concatenate(tried).astype("int64")})


def _fires(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fires of words of 64 seconds (key, base, bits, cooldown_seconds), sorted by key and base, all keys of a batch in one pass.

    A second's successor is the first one of its key after the cooldown, or else the first of the next key, which always
    fires; so the fires of a batch are one chain. What a key carries over to the next batch is when it is ready again.
    """
    last, ready = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(0)
        code = keys.dictionary_encode().indices.to_numpy()
        base, bits, wait = (b.column(k).to_numpy() for k in (1, 2, 3))
        row, bit = np.nonzero(np.unpackbits(bits.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        second, low = base[row] + bit, int(base.min())
        span = int(base.max()) + 64 - low
        rank = np.cumsum(np.r_[0, np.diff(code) != 0])[row] * (2 * span + 2)
        place = rank + (second - low)
        then = np.searchsorted(place, place + np.minimum(wait, span)[row]).tolist()
        at = int(np.searchsorted(place, min(max(ready - low, 0), span))) if keys[0].as_py() == last else 0
        fired = []
        while at < len(then):
            fired.append(at)
            at = then[at]
        if fired and code[row[fired[-1]]] == code[-1]:
            ready = int(second[fired[-1]]) + int(wait[row[fired[-1]]])
        last = keys[len(base) - 1].as_py()
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(row[fired])), pa.array(second[fired])], ["key", "second"])


def one_per_second(events: DataFrame) -> DataFrame:
    """(key, ts, id[, cooldown_seconds]) -> first (ts, id) of each (key, second)."""
    extra = [F.max("cooldown_seconds").alias("cooldown_seconds")] if "cooldown_seconds" in events.columns else []
    first = F.min(F.struct("ts", "id"))
    g = events.groupBy("key", F.unix_seconds("ts").alias("second")).agg(first.alias("f"), *extra)
    return g.select("key", "second", "f.ts", "f.id", *(["cooldown_seconds"] if extra else []))


def greedy_cooldown(events: DataFrame) -> DataFrame:
    """(key string, ts, id, cooldown_seconds) -> the events that fire. Ties within a second go to the smaller (ts, id).

    A cooldown below one second lets every second fire once.
    """
    e = one_per_second(events.withColumn("cooldown_seconds", F.greatest("cooldown_seconds", F.lit(1))))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("second", F.lit(64)).cast("int"))
    words = e.where("key IS NOT NULL").groupBy("key", (F.col("second") - F.pmod("second", F.lit(64))).alias("base")).agg(
        F.bit_or(bit).alias("bits"), F.max(F.col("cooldown_seconds").cast("long")).alias("cooldown_seconds")
    )
    fires = words.repartition("key").sortWithinPartitions("key", "base").mapInArrow(_fires, "key string, second long")
    return e.join(fires, ["key", "second"])


def cooldown_after_delivery(events: DataFrame) -> DataFrame:
    """(key string, ts, id, cooldown_seconds, delivered) -> the events that are tried, in order of (ts, id).

    A failed delivery starts no cooldown, so the next event of the key is tried at once; after a delivery nothing is tried
    for ``cooldown_seconds`` (one at least). Seconds with events and seconds with deliveries are bitmaps of a key's time;
    inside a second everything up to its first delivery is tried.
    """
    e = events.select("key", "ts", "id", "delivered", F.greatest("cooldown_seconds", F.lit(1)).alias("cooldown_seconds"), F.unix_seconds("ts").alias("second"))
    good = F.min(F.when(F.col("delivered"), F.struct("ts", "id"))).alias("_good")
    seconds = e.groupBy("key", "second").agg(good, F.max("cooldown_seconds").alias("cooldown_seconds"))
    place = F.bitmap_bit_position("second")
    maps = seconds.groupBy("key", F.bitmap_bucket_number("second").alias("bucket")).agg(
        F.bitmap_construct_agg(place).alias("bits"), F.bitmap_construct_agg(F.when(F.col("_good").isNotNull(), place)).alias("delivered"),
        F.max("cooldown_seconds").alias("cooldown_seconds"),
    )
    tried = maps.groupBy("key").applyInPandas(_fold_attempts, "key string, second long").join(seconds.select("key", "second", "_good"), ["key", "second"])
    out = e.join(tried, ["key", "second"]).where(F.col("_good").isNull() | (F.struct("ts", "id") <= F.col("_good")))
    return out.select("key", "ts", "id", "delivered")
