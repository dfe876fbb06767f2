"""Vector expressions and the default text embedder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import FNV_OFFSET, FNV_PRIME

EMBED_DIM = 16
EMBED_MODEL = "stub-fnv-v1"


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two vectors of one length, 0 where either is the zero vector; another length is an error."""
    size = norm(left) * norm(right)
    value = F.when(size == 0, F.lit(0.0)).otherwise(dot(left, right) / size)
    return F.when(F.size(left) == F.size(right), value).otherwise(
        F.raise_error(F.lit("embedding dimensionality mismatch")).cast("double")
    )


def _embed_batch(texts: pd.Series, dim: int) -> list[list[float]]:
    """Advance all texts of a batch one code unit at a time."""
    units = [np.frombuffer((t or "").encode("utf-16-le", "surrogatepass"), dtype="<u2") for t in texts]
    lengths = np.array([len(u) for u in units], dtype=np.int64)
    out = np.zeros((len(units), dim))
    if not len(units):
        return []
    order = np.argsort(-lengths, kind="stable")
    flat = np.concatenate([units[i] for i in order]).astype(np.uint64) if lengths.sum() else np.zeros(0, np.uint64)
    starts = np.concatenate([[0], np.cumsum(lengths[order])[:-1]])
    sorted_lengths = lengths[order]
    state = np.full(len(units), FNV_OFFSET, dtype=np.uint64)
    rows = np.arange(len(units))
    alive = len(units)
    for position in range(int(sorted_lengths[0]) if len(units) else 0):
        while alive and sorted_lengths[alive - 1] <= position:
            alive -= 1
        code = flat[starts[:alive] + position]
        h = ((state[:alive] ^ code) * np.uint64(FNV_PRIME)) & np.uint64(0xFFFFFFFF)
        state[:alive] = h
        out[rows[:alive], (h % np.uint64(dim)).astype(np.int64)] += (h & np.uint64(255)).astype(float) / 127.5 - 1
    result = np.empty_like(out)
    result[order] = out
    return result.tolist()


def hash_embedder(dim: int = EMBED_DIM):
    """The default embedder: a Column function that maps a text to ``ARRAY<DOUBLE>`` of ``dim`` numbers.

    Every code unit updates a running hash which picks a slot and an amount.
    The update is sequential within a text, so whole batches advance together.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(_embed_batch(texts, dim), index=texts.index, dtype=object)

    return embed
