"""Ordered operations per key that never put a whole key into one task.

A key may hold a large share of all rows. So a running value is computed in
two levels: rows are cut into chunks of their integer order column, chunk
totals are reduced map-side, only those totals are scanned per key, and rows
meet their chunk's offset by an equi-join on (key, chunk).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a chunk in units of the order column; bounds the rows of one (key, chunk).
CHUNK = 1 << 20


def first_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of every key. Spark keeps one row per key and map task before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_per_key(df: DataFrame, keys: Sequence[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every key with their 1-based ``rank``, cut map-side first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Mapping[str, Column] | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Add ``ordinal`` and ``n_rows`` per key, and ``run_<name>`` / ``all_<name>`` for every sum.

    ``order`` is an integer column unique within a key; keys must not be NULL.
    """
    sums = dict(sums or {})
    rows = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    for name, expr in sums.items():
        rows = rows.withColumn(f"_v_{name}", expr)
    totals = rows.groupBy(*keys, "_chunk").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums]
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = totals.select(
        *keys,
        "_chunk",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.sum("_n").over(whole).alias("n_rows"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(whole).alias(f"all_{n}") for n in sums],
    )
    local = Window.partitionBy(*keys, "_chunk").orderBy(order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(offsets, [*keys, "_chunk"]).withColumn("ordinal", F.col("_n0") + F.row_number().over(local))
    for name in sums:
        out = out.withColumn(f"run_{name}", F.col(f"_o_{name}") + F.sum(f"_v_{name}").over(upto))
    return out.drop("_chunk", "_n0", *[f"_v_{n}" for n in sums], *[f"_o_{n}" for n in sums])


def listed(df: DataFrame, keys: Sequence[str], element: Column, name: str = "items") -> DataFrame:
    """Keys and the sorted list ``name`` of all their elements: one row per key at every size.

    A view for callers who want a nested list. The list is as long as the key has elements, so what must hold for a key
    of any size reads the child table ``df`` instead.
    """
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(element)).alias(name))
