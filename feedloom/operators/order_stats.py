"""Exact order statistics by repeated histograms.

A round counts the values of each open interval in ``CELLS`` cells, with the smallest and the largest value of each cell;
every wanted rank then lies in one cell, whose ends are its next interval. Cells are combined inside the map tasks, so no
value, hour or key with most of the rows meets in one task. A rank is settled when its cell holds one distinct value, or
few enough values to look at. All ranks of all quantiles share the rounds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

CELLS = 1024
SMALL = 4096  # values of a cell that may be looked at one by one


def _cell(v: Column, lo: float, hi: float) -> Column:
    # halves, because the difference of two doubles may overflow
    share = (v / 2 - lo / 2) / (hi / 2 - lo / 2) if hi / 2 > lo / 2 else F.lit(0.0)
    return F.least(F.floor(share * CELLS), F.lit(CELLS - 1)).cast("int")


def ranked_values(rows: DataFrame, value: Column, ranks_of) -> tuple[int, dict[int, float]]:
    """(number of values, value by rank from 0) for the ranks that ``ranks_of`` gives for that number. Nulls and NaN are no
    values."""
    v = F.col("_v")
    values = rows.select(value.cast("double").alias("_v")).where(v.isNotNull() & ~F.isnan(v))
    whole = values.agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).first()
    if not whole["n"]:
        return 0, {}
    done: dict[int, float] = {}
    open_ = {r: (whole["lo"], whole["hi"], 0, whole["n"]) for r in ranks_of(whole["n"])}  # ends, values before, values inside
    while True:
        for r, (lo, hi, _, _) in list(open_.items()):
            if lo == hi:
                done[r] = lo
                del open_[r]
        wide = sorted({(lo, hi) for lo, hi, _, n in open_.values() if n > SMALL})
        if not wide:
            break
        cell = F.coalesce(*[F.when(v.between(lo, hi), F.struct(F.lit(k).alias("k"), _cell(v, lo, hi).alias("cell"))) for k, (lo, hi) in enumerate(wide)])
        counted = values.select(cell.alias("c"), "_v").where("c is not null").groupBy("c.k", "c.cell").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).collect()
        for r, (lo, hi, before, n) in list(open_.items()):
            if n <= SMALL:
                continue
            for c in sorted((c for c in counted if c["k"] == wide.index((lo, hi))), key=lambda c: c["cell"]):
                if r < before + c["n"]:
                    open_[r] = (c["lo"], c["hi"], before, c["n"])
                    break
                before += c["n"]
    if open_:
        ends = sorted({(lo, hi) for lo, hi, _, _ in open_.values()})
        inside = values.where(F.coalesce(*[F.when(v.between(lo, hi), F.lit(True)) for lo, hi in ends]))
        found = sorted(tuple(x) for x in inside.groupBy("_v").count().collect())  # at most SMALL values for each rank
        for r, (lo, hi, before, _) in open_.items():
            for x, n in found:
                if lo <= x <= hi:
                    before += n
                    if r < before:
                        done[r] = x
                        break
    return whole["n"], done


def exact_quantiles(rows: DataFrame, value: Column, quantiles: list[float]) -> list[float | None]:
    """Continuous quantiles (linear between the two nearest ranks); None where there are no values."""
    def places(n: int) -> list[int]:
        return sorted({r for q in quantiles for r in (math.floor((n - 1) * q), math.ceil((n - 1) * q))})

    n, by = ranked_values(rows, value, places)
    if not n:
        return [None] * len(quantiles)
    out = []
    for q in quantiles:
        at = (n - 1) * q
        lo, hi = by[math.floor(at)], by[math.ceil(at)]
        out.append(lo if lo == hi else lo + (hi - lo) * (at - math.floor(at)))
    return out
