"""Near duplicates by SimHash, found by exact comparison of tiles of fingerprints.

Fingerprints are cut into tiles by the population counts of their two halves. Two fingerprints whose counts differ by
more than the radius cannot be within it, so only tiles of neighbouring counts meet; their rows are compared by
exclusive-or and bit counts in numpy. The work left grows with the square of the number of different fingerprints
(about a fifth of all pairs are compared, at some 2 ns each).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, unique_name
from .components import components

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Fingerprints of a tile, about.
TILE = 8192
_ROWS = 1 << 16


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a whole text, as a signed integer; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) > SHINGLE else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _ROWS):
        bits = np.unpackbits(hashes[i : i + _ROWS].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series([fingerprint(t) for t in part], dtype="int64")


def _forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that join what is within ``radius``: fewer than there are rows, however many pairs are near."""
    nodes = left if right is None else np.concatenate([left, right])
    other, shift = (left, 0) if right is None else (right, len(left))
    label = np.arange(len(nodes))
    step = max(1, (1 << 20) // max(1, len(other)))
    for i in range(0, len(left), step):
        near = np.bitwise_count(left[i : i + step, None] ^ other[None, :]) <= radius
        if right is None:
            near[np.arange(near.shape[0]), np.arange(i, i + near.shape[0])] = False
        for row in np.flatnonzero(near.any(axis=1)):
            met = label[np.append(np.flatnonzero(near[row]) + shift, i + row)]
            low = met.min()
            if (met != low).any():
                hit = np.zeros(len(nodes), bool)
                hit[met] = True
                label[hit[label]] = low
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _compare(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for same, a, b in zip(batch["same"], batch["a"], batch["b"]):
                left = np.asarray(a, np.int64).view(np.uint64)
                right = None if same else np.asarray(b, np.int64).view(np.uint64)
                x, y = _forest(left, right, radius)
                if len(x):
                    yield pd.DataFrame({"a": x.view(np.int64), "b": y.view(np.int64)})

    return run


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """From different fingerprints (``fp``) make edges (a, b) whose components are those of all pairs within ``radius``.

    Cells (counts of the upper and lower half) are at most 33 x 33, so the table of their sizes may be broadcast.
    A cell is dealt by hash into tiles of about ``tile`` rows, and pairs of tiles meet by an equi-join on tile ids.
    """
    high = F.bit_count(F.shiftrightunsigned("fp", 32)).cast("int")
    low = F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).cast("int")
    cells = prints.select("fp", high.alias("hi"), low.alias("lo"))
    sizes = cells.groupBy("hi", "lo").agg(F.ceil(F.count("*") / tile).cast("int").alias("n"))
    placed = cells.join(F.broadcast(sizes), ["hi", "lo"]).withColumn("no", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    tiles = settled(placed.groupBy("hi", "lo", "no").agg(F.collect_list("fp").alias("fps")))
    steps = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if abs(i) + abs(j) <= radius and (i, j) >= (0, 0)]
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])).alias("step")
    ids = tiles.select(F.struct("hi", "lo", "no").alias("ka"), step)
    there = sizes.select(F.col("hi").alias("h"), F.col("lo").alias("l"), F.col("n").alias("m"))
    near = (F.col("ka.hi") + F.col("step.i") == F.col("h")) & (F.col("ka.lo") + F.col("step.j") == F.col("l"))
    pairs = ids.join(F.broadcast(there), near).select(
        "ka", "h", "l", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("no")
    )
    pairs = pairs.select("ka", F.struct(F.col("h").alias("hi"), F.col("l").alias("lo"), "no").alias("kb"))
    pairs = pairs.filter("ka <= kb").withColumn("same", F.expr("ka = kb"))
    key = F.struct("hi", "lo", "no")
    with_a = pairs.join(tiles.select(key.alias("ka"), F.col("fps").alias("a")), "ka")
    with_b = with_a.join(tiles.select(key.alias("kb"), F.col("fps").alias("b")), "kb")
    rows = with_b.select("same", "a", F.when(~F.col("same"), F.col("b")).alias("b"))
    return rows.mapInPandas(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile: int = TILE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row: its SimHash and the smallest id reachable by links of ``radius`` bits.

    Equal fingerprints are one node from the start, so copies are never paired. A NULL text has no words, and texts
    without words share fingerprint 0 and one component. Repeated rows get the same answer. A NULL id is no candidate for
    ``component_id``, which is NULL where a component has no id at all. Other columns are not read.
    """
    prints = settled(docs.select(F.col(id_col).alias("doc_id"), F.pandas_udf(_fingerprints, "long")(F.col(text)).alias("fp")))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = settled(components(links(nodes.select("fp"), radius, tile)))
    linked = roots.join(nodes, roots["node"] == nodes["fp"]).select("node", "root", "least_id")
    best = linked.groupBy("root").agg(F.min("least_id").alias("joint_id"))
    of = linked.join(best, "root").select(F.col("node").alias("fp"), "joint_id")
    named = nodes.join(of, "fp", "left").select("fp", F.coalesce("joint_id", "least_id").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """The rows of ``docs`` with the smallest ``doc_id`` of each component, columns unchanged.

    Of repeated rows with that id one stays (the one with the smallest text hash). Rows without an id stay, as they
    cannot be named.
    """
    known = near_duplicates(docs.filter("doc_id IS NOT NULL"), radius, tile)
    keep = known.filter("doc_id = component_id").select("doc_id").distinct()
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    place = unique_name(docs.columns, "place")
    kept = docs.join(keep, "doc_id", "left_semi").withColumn(place, rank).filter(F.col(place) == 1).drop(place)
    return kept.unionByName(docs.filter("doc_id IS NULL"))
