"""Usage metering: cost of calls and its rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.functions.patterns import PRICES


def price_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRICES), "model_no long, model_id int, model_name string, p_in double, p_cached double, p_out double").select("model_no", "model_id", "model_name", *[F.col(c).cast("decimal(12,6)").alias(c) for c in ("p_in", "p_cached", "p_out")])


#: What an amount of 1 has of the whole units that are summed: prices have six digits and are per million tokens.
UNITS = 10**12


def units(inputs: Column, cached: Column, outputs: Column) -> Column:
    """Cost in whole units, exact, as decimal(18,0), from whole prices in millionths. Cached tokens cost as input where a model has no price for them.

    A call of over a million in the prices' currency is an overflow, which Spark reports."""
    total = (inputs - cached) * F.col("_in") + cached * F.coalesce("_cached", "_in") + outputs * F.col("_out")
    return total.cast("decimal(18,0)")


def amount(of: Column) -> Column:
    """Units as an exact amount."""
    return of * F.lit("0.000000000001").cast("decimal(13,12)")


def billed(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """``usage`` (model_no, input_tokens, cached_tokens, output_tokens, ...) with model, units and amount."""
    whole = prices.withColumns({f"_{n}": (F.col(f"p_{n}") * 1_000_000).cast("long") for n in ("in", "cached", "out")})
    rows = usage.join(F.broadcast(whole), "model_no").withColumn("units", units(F.col("input_tokens"), F.col("cached_tokens"), F.col("output_tokens")))
    return rows.withColumn("amount", amount(F.col("units"))).drop("_in", "_cached", "_out")


def rollup(rows: DataFrame, *by: str) -> DataFrame:
    return rows.rollup(*by).agg(F.count("*").alias("calls"), F.round(amount(F.sum("units")), 4).cast("double").alias("amount"), F.sum("input_tokens").alias("input_tokens"))


def detail() -> Column:
    """Billing row details as JSON."""
    return F.to_json(F.struct("model_id", "model_name", "input_tokens", "cached_tokens", "output_tokens", F.round("amount", 9).cast("double").alias("amount")))
