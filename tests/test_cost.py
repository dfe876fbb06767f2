"""Sums of costs are exact, whatever the order and number of parts."""

from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import cost

USAGE = "turn_id long, model string, input_tokens long, output_tokens long, cache_write_tokens long, cache_read_tokens long"


def exact(rows, prices):
    total = Decimal(0)
    for _, model, i, o, w, r in rows:
        if model in prices:
            a, b = (Decimal(str(p)) for p in prices[model])
            total += i * a + o * b + (w or 0) * a * Decimal("1.25") + (r or 0) * a * Decimal("0.1")
    return total / 1_000_000


@pytest.fixture(scope="module")
def usage():
    rows = [(t % 40, ["small", "large", "free"][t % 3], 100 + t * 7 % 999, t * 13 % 501, t % 5 or None, t * 3 % 77 or None) for t in range(3000)]
    # Adds up to half a unit of the sixth digit: 0.0000005 dollars.
    return rows + [(50, "tie", 1, 0, None, None)]


PRICES = {"small": (0.25, 1.25), "large": (3.1, 15.7), "tie": (0.5, 1.0)}


@pytest.mark.parametrize("partitions", [1, 7, 211])
def test_totals_are_exact(spark, usage, partitions):
    prices = spark.createDataFrame([(m, *p) for m, p in PRICES.items()], "model string, input_price double, output_price double")
    priced = cost.usage_pricing_join(spark.createDataFrame(usage, USAGE).repartition(partitions, F.rand(partitions)), prices)
    got = {r.model: (r.calls, r.cost_usd) for r in cost.cost_totals(priced, 6).collect()}
    for model in (None, *PRICES, "free"):
        rows = [r for r in usage if model in (None, r[1])]
        want = exact(rows, PRICES).quantize(Decimal("0.000001"), ROUND_HALF_UP)
        assert got[model] == (len(rows), float(want))
    assert got["tie"][1] == 0.000001


def test_cap_is_compared_exactly(spark):
    """Ten calls of a tenth of the cap reach it and are not above it; a sum of doubles may be."""
    rows = [(1, "m", 1, 0, None, None)] * 10 + [(2, "m", 1, 0, None, None)] * 11
    prices = spark.createDataFrame([("m", 0.1, 0.0)], "model string, input_price double, output_price double")
    priced = cost.usage_pricing_join(spark.createDataFrame(rows, USAGE), prices)
    assert [tuple(r) for r in cost.over_cap(priced, 0.000001).collect()] == [(2, 0.0000011)]
