"""Confidence, relevance, disposition and cost expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the disposition model.
FLOOR_PER_SKEPTICISM = 0.6
MENTIONS_PER_SKEPTICISM = 4
BOOST_PER_LITERALISM = 2
# Fixed values of the cost model.
CACHE_WRITE_RATE = 1.25
CACHE_READ_RATE = 0.1


def clamp01(value: Column) -> Column:
    """Clamp to [0, 1]; a value that is not finite counts as 0."""
    infinite = value.isin(float("inf"), float("-inf"))
    return F.when(value.isNull() | F.isnan(value) | infinite, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))
    )


def confidence_floor(skepticism: Column) -> Column:
    return clamp01(skepticism) * FLOOR_PER_SKEPTICISM


def mentions_required(skepticism: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(clamp01(skepticism) * MENTIONS_PER_SKEPTICISM).cast("int"))


def world_boost(literalism: Column) -> Column:
    return 1 + clamp01(literalism) * BOOST_PER_LITERALISM


def clamp01_value(value: float | None) -> float:
    if value is None or not math.isfinite(value):
        return 0.0
    return max(0.0, min(1.0, value))


def gate_floor(skepticism: float) -> float:
    return clamp01_value(skepticism) * FLOOR_PER_SKEPTICISM


def gate_mentions(skepticism: float) -> int:
    return max(1, math.ceil(clamp01_value(skepticism) * MENTIONS_PER_SKEPTICISM))


def boost_factor(literalism: float) -> float:
    return 1 + clamp01_value(literalism) * BOOST_PER_LITERALISM


def confidence_percent(score: Column) -> Column:
    """Half-up rounding, as in ``floor(x + 0.5)``."""
    return F.floor(score * 100 + 0.5).cast("int")


def confidence_band(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")


def add_relevance(relevance: Column, delta: Column) -> Column:
    return F.greatest(F.lit(0), relevance + delta)


def call_cost(
    input_price: Column,
    output_price: Column,
    input_tokens: Column,
    output_tokens: Column,
    cache_write_tokens: Column,
    cache_read_tokens: Column,
) -> Column:
    """US dollars of one call; prices are per million tokens, a missing price costs nothing."""
    total = (
        input_tokens * input_price
        + output_tokens * output_price
        + cache_write_tokens * input_price * CACHE_WRITE_RATE
        + cache_read_tokens * input_price * CACHE_READ_RATE
    )
    return F.coalesce(total / 1_000_000, F.lit(0.0))


def call_cost_units(
    input_price: Column,
    output_price: Column,
    input_tokens: Column,
    output_tokens: Column,
    cache_write_tokens: Column,
    cache_read_tokens: Column,
) -> Column:
    """Millionths of a dollar of one call as DECIMAL(32, 8), so that sums are exact and hang on no order.

    Prices count to the sixth digit, tokens up to twelve digits.
    """

    def part(tokens: Column, price: Column, rate: float) -> Column:
        product = tokens.cast("decimal(12,0)") * price.cast("decimal(12,6)") * F.lit(rate).cast("decimal(3,2)")
        return F.coalesce(product, F.lit(0)).cast("decimal(29,8)")

    return (
        part(input_tokens, input_price, 1)
        + part(output_tokens, output_price, 1)
        + part(cache_write_tokens, input_price, CACHE_WRITE_RATE)
        + part(cache_read_tokens, input_price, CACHE_READ_RATE)
    )


def dollars(units: Column) -> Column:
    """A sum of ``call_cost_units`` in dollars, DECIMAL(32, 14)."""
    return units.cast("decimal(24,8)") * F.lit("0.000001").cast("decimal(7,6)")
