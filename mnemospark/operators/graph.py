"""The graph of entities that are named together.

Mentions are (asset_id, entity_id, content), one row per entity an asset names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import listed

#: Entities of one asset that are paired in one task.
BLOCK = 1_000


def asset_mentions(assets: DataFrame) -> DataFrame:
    return assets.select(F.col("id").alias("asset_id"), F.explode("entity_ids").alias("entity_id"), "content")


def cooccurrence_join(mentions: DataFrame, cards: DataFrame, block: int = BLOCK) -> DataFrame:
    """(src, dst, asset_id, content): pairs of known entities within one asset, src before dst.

    The entities of an asset are brought together and each pairs with those
    after it. An asset that names very many is first cut into blocks, and every two
    blocks, and each with itself, are paired by themselves.
    """
    known = mentions.join(cards.select("entity_id").distinct(), "entity_id", "left_semi")
    # Counted where an asset's mentions are: as a table of its own, the counts would read and deal out all mentions once more.
    placed = known.withColumn("_blocks", F.ceil(F.count(F.lit(1)).over(Window.partitionBy("asset_id")) / block).cast("int"))
    own = F.pmod(F.xxhash64("entity_id"), F.col("_blocks")).cast("int")
    cells = placed.select(
        "asset_id", "content", "entity_id", own.alias("_b"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_o")
    ).select("asset_id", "content", "entity_id", "_b", F.least("_b", "_o").alias("_lo"), F.greatest("_b", "_o").alias("_hi"))
    listed = cells.groupBy("asset_id", "_lo", "_hi").agg(
        F.sort_array(F.collect_set(F.struct("entity_id", "_b"))).alias("_ids"), F.first("content").alias("content")
    )
    each = listed.filter(F.size("_ids") > 1).select(
        "asset_id", "content", "_lo", "_hi", "_ids", F.posexplode("_ids").alias("_i", "_x")
    )
    rest = F.slice("_ids", F.col("_i") + 2, F.size("_ids"))
    pairs = each.select("asset_id", "content", "_lo", "_hi", "_x", F.explode(rest).alias("_y"))
    crossing = (F.col("_lo") == F.col("_hi")) | (F.col("_x._b") != F.col("_y._b"))
    return pairs.filter(crossing).select(
        F.col("_x.entity_id").alias("src"), F.col("_y.entity_id").alias("dst"), "asset_id", "content"
    )


def graph_edges(pairs: DataFrame) -> DataFrame:
    """(src, dst, reasons): one row per undirected edge with the contents of the assets behind it, a view of ``pairs``.

    ``pairs`` is the child table, one row per reason; ``edge_counts`` gives the edges without lists.
    """
    return listed(pairs, ["src", "dst"], F.col("content"), "reasons")


def edge_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_reasons"))


def graph_nodes(cards: DataFrame) -> DataFrame:
    """Every card as a node, joined to others or not."""
    return cards.select(F.col("entity_id").alias("id"), "label", "entity_type")


def graph_neighbors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, neighbor, label, entity_type, reasons): both ends of each edge, the reasons in one line.

    Either end comes from the same row: as a union of two views of the edges, each view would make all edges anew, since the
    join sends a filter of its own down either of them.
    """
    lines = edges.select("src", "dst", F.array_join("reasons", " · ").alias("reasons"))
    end = lambda a, b: F.struct(F.col(a).alias("id"), F.col(b).alias("neighbor"))
    both = lines.select("reasons", F.explode(F.array(end("src", "dst"), end("dst", "src"))).alias("_e")).select("_e.id", "_e.neighbor", "reasons")
    return both.join(nodes.select(F.col("id").alias("neighbor"), "label", "entity_type"), "neighbor")
