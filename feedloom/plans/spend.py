"""Token spend: ledger sums, limits, remaining budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedloom import vocab
from feedloom.functions import scores as sc
from feedloom.operators.skew import running_totals


def price_table(spark: SparkSession, prices: dict = vocab.TOKEN_PRICES_PER_MILLION) -> DataFrame:
    rows = [(model, float(i), float(o)) for model, (i, o) in prices.items()]
    return spark.createDataFrame(rows, "model string, in_price double, out_price double")


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls with their model's prices. The price list is small and goes to every task: dealt by model, all calls would
    land in as many tasks as there are models."""
    return calls.join(F.broadcast(prices), "model")


def ledger(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls with their charge in whole cents."""
    cost = sc.token_cost(F.col("in_tokens"), F.col("out_tokens"), F.col("in_price"), F.col("out_price"))
    return priced(calls, prices).withColumn("cents", sc.to_cents(cost)).withColumn("day", F.to_date("ts"))


def spend_by_day(entries: DataFrame, *, limit_cents: int) -> DataFrame:
    """Global day totals against the limit."""
    d = entries.groupBy("day").agg(F.sum("cents").alias("spent_cents"), F.count(F.lit(1)).alias("calls"))
    return d.select(
        "day", "spent_cents", "calls", F.greatest(F.lit(0), F.lit(limit_cents) - F.col("spent_cents")).alias("remaining_cents"),
        (F.col("spent_cents") >= limit_cents).alias("limit_reached"),
    )


def spend_by_user(entries: DataFrame) -> DataFrame:
    return entries.groupBy("day", "user_id").agg(F.sum("cents").alias("spent_cents"), F.count(F.lit(1)).alias("calls"))


def first_breach(entries: DataFrame, *, limit_cents: int, bucket: Column) -> DataFrame:
    """Per day the first call whose running total passes the limit. ``bucket`` slices a day in call order."""
    run = running_totals(entries, ["day"], bucket, [F.col("call_id")], {"running_cents": F.col("cents")})
    over = run.where(F.col("running_cents") > limit_cents)
    return over.groupBy("day").agg(
        F.min("call_id").alias("call_id"), F.min_by("running_cents", "call_id").alias("running_cents")
    )
