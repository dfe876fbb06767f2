"""Cost of model calls. Prices come from the caller: model, input_price, output_price per million tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import call_cost, call_cost_units, dollars


def usage_pricing_join(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage rows with ``cost_usd``; a model without a price costs nothing. Spark picks the join by the table's size."""
    zero = F.lit(0)
    return usage.join(prices, "model", "left").withColumn(
        "cost_usd",
        call_cost(
            F.col("input_price"),
            F.col("output_price"),
            F.coalesce("input_tokens", zero),
            F.coalesce("output_tokens", zero),
            F.coalesce("cache_write_tokens", zero),
            F.coalesce("cache_read_tokens", zero),
        ),
    )


def _units() -> Column:
    return call_cost_units(*[F.col(c) for c in ("input_price", "output_price", "input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens")])


def cost_totals(priced: DataFrame, digits: int | None = None) -> DataFrame:
    """(model, calls, cost_usd), and the total with model NULL. Sums and the rounding to ``digits`` are exact."""
    total = dollars(F.sum(_units()))
    total = total if digits is None else F.round(total, digits)
    return priced.rollup("model").agg(F.count(F.lit(1)).alias("calls"), total.cast("double").alias("cost_usd"))


def over_cap(priced: DataFrame, cap: float | str) -> DataFrame:
    """(turn_id, cost_usd) of turns whose calls cost more than the cap, compared exactly in decimals."""
    sums = priced.groupBy("turn_id").agg(dollars(F.sum(_units())).alias("_cost"))
    return sums.filter(F.col("_cost") > F.lit(str(cap)).cast("decimal(32,14)")).select("turn_id", F.col("_cost").cast("double").alias("cost_usd"))
