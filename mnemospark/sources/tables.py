"""Table reads, keyed writes and the reference tables of a memory store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import first_per_key


def turn_scan(turns: DataFrame, session_id=None) -> DataFrame:
    """Turns in transcript order: of one session, or of all by session."""
    rows = turns if session_id is None else turns.filter(F.col("session_id") == session_id)
    return rows.orderBy("session_id", "turn_index")


def asset_upsert(stored: DataFrame, incoming: DataFrame, key: str = "id", version: str = "seq") -> DataFrame:
    """The table after insert-or-replace by ``key``: the highest ``version`` of each key stays."""
    both = stored.unionByName(incoming, allowMissingColumns=True)
    return first_per_key(both, [key], F.col(version).desc())


def lore_upsert(
    stored: DataFrame, incoming: DataFrame, dim: int | None = None, version: str = "seq"
) -> tuple[DataFrame, DataFrame]:
    """Upsert lore by id. Returns (table, rejected rows with a ``reason``).

    Every embedding must be present and of one length: ``dim`` if given, else
    that of the first row by ``version`` (the stored ones come first).
    """
    size = F.coalesce(F.size("embedding"), F.lit(0))
    if dim is None:
        first = (
            stored.select(F.lit(0).alias("o"), version, size.alias("d"))
            .unionAll(incoming.select(F.lit(1), version, size))
            .filter("d > 0")
            .agg(F.min_by("d", F.struct("o", version)))
        )
        want: Column = first.scalar()
    else:
        want = F.lit(dim)
    reason = (
        F.when(size <= 0, F.concat(F.lit("LoreSnippet "), "id", F.lit(" cannot be upserted without an embedding")))
        .when(
            size != want,
            F.concat(F.lit("embedding dim "), size, F.lit(" does not match store dim "), want),
        )
    )
    judged = incoming.withColumn("reason", reason)
    accepted = judged.filter("reason IS NULL").drop("reason")
    return asset_upsert(stored, accepted, version=version), judged.filter("reason IS NOT NULL")


def entity_refs(assets: DataFrame) -> DataFrame:
    """(asset_id, entity_id): the entities an asset names and, for a card, its own."""
    own = F.when(F.col("entity_id").isNotNull(), F.array("entity_id")).otherwise(F.array().cast("array<string>"))
    named = F.coalesce("entity_ids", F.array().cast("array<string>"))
    return assets.select(F.col("id").alias("asset_id"), F.explode(F.array_distinct(F.array_union(named, own))).alias("entity_id"))


def tag_refs(assets: DataFrame) -> DataFrame:
    return assets.select(F.col("id").alias("asset_id"), F.explode(F.array_distinct("tags")).alias("tag"))


def asset_delete(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not on the delete list; used alike for stores and their reference tables."""
    gone = ids.select(F.col(ids.columns[0]).alias("_gone"))
    return table.join(gone, F.col(key) == F.col("_gone"), "left_anti")


def store_union(structured: DataFrame, lore: DataFrame) -> DataFrame:
    return structured.unionByName(lore, allowMissingColumns=True)


def point_lookup(structured: DataFrame, lore: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Assets by key; the structured store is read first, the vector store second."""
    wanted = keys.select(F.col(keys.columns[0]).alias("_want")).distinct()

    def hit(df: DataFrame, store: str, priority: int) -> DataFrame:
        found = df.join(wanted, F.col(key) == F.col("_want"), "left_semi")
        return found.withColumn("store", F.lit(store)).withColumn("_priority", F.lit(priority))

    both = hit(structured, "structured", 0).unionByName(hit(lore, "vector", 1), allowMissingColumns=True)
    return first_per_key(both, [key], F.col("_priority")).drop("_priority")


def write_routed(routed: DataFrame, path: str, mode: str = "append") -> None:
    """Write assets under one folder per target store and kind, so that reads prune by both."""
    routed.write.mode(mode).partitionBy("target", "kind").parquet(path)


def read_store(spark: SparkSession, path: str, target: str, kinds: Sequence[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path).filter(F.col("target") == target)
    return rows if kinds is None else rows.filter(F.col("kind").isin(*kinds))
