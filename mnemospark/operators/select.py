"""Filters and lookups over the memory tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _members(value: str | Iterable[str] | None) -> list[str] | None:
    if value is None:
        return None
    return [value] if isinstance(value, str) else list(value)


def structured_query(
    assets: DataFrame,
    network: str | Iterable[str] | None = None,
    kind: str | Iterable[str] | None = None,
    entity_id: str | None = None,
    tag: str | None = None,
    viewpoint_holder: str | None = None,
) -> DataFrame:
    """Assets that meet every given condition; without one, all of them.

    An entity condition takes the card itself and all that names it.
    """
    out = assets
    for name, value in (("network", _members(network)), ("kind", _members(kind))):
        if value is not None:
            out = out.filter(F.col(name).isin(value))
    if entity_id is not None:
        out = out.filter(F.coalesce(F.col("entity_id") == entity_id, F.lit(False)) | F.array_contains("entity_ids", entity_id))
    if tag is not None:
        out = out.filter(F.array_contains("tags", tag))
    if viewpoint_holder is not None:
        out = out.filter(F.col("viewpoint_holder") == viewpoint_holder)
    return out


def lore_list(lore: DataFrame, network=None, tag: str | None = None, viewpoint_holder: str | None = None) -> DataFrame:
    """Lore under a scope, without its vectors."""
    rows = structured_query(lore, network=network, tag=tag, viewpoint_holder=viewpoint_holder)
    return rows.drop("embedding")


def entity_ref_filter(assets: DataFrame, refs: DataFrame, entities: DataFrame) -> DataFrame:
    """Assets that are, or name, one of many entities: semi-joins on the reference table."""
    wanted = entities.select(F.col(entities.columns[0]).alias("_e"))
    ids = refs.join(wanted, F.col("entity_id") == F.col("_e"), "left_semi").select(F.col("asset_id").alias("_a"))
    return assets.join(ids, F.col("id") == F.col("_a"), "left_semi")


def entity_ref_join(assets: DataFrame, refs: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, asset): every asset once for each wanted entity that it refers to."""
    wanted = entities.select(F.col(entities.columns[0]).alias("ref_entity_id")).distinct()
    hits = refs.select("asset_id", F.col("entity_id").alias("ref_entity_id")).join(wanted, "ref_entity_id")
    return assets.join(hits, assets["id"] == F.col("asset_id")).drop("asset_id")


def tag_join(assets: DataFrame, tags: DataFrame, wanted: DataFrame) -> DataFrame:
    """Assets with at least one wanted tag."""
    want = wanted.select(F.col(wanted.columns[0]).alias("_t"))
    ids = tags.join(want, F.col("tag") == F.col("_t"), "left_semi").select(F.col("asset_id").alias("_a"))
    return assets.join(ids, F.col("id") == F.col("_a"), "left_semi")


def attribute_lookup(attributes: Column, key: Column | str) -> Column:
    """The first attribute with that key, or NULL."""
    wanted = F.lit(key) if isinstance(key, str) else key
    return F.try_element_at(F.filter(attributes, lambda a: a["key"] == wanted), F.lit(1))


def role_filter(turns: DataFrame, roles: Iterable[str] = ("user", "assistant")) -> DataFrame:
    return turns.filter(F.col("role").isin(list(roles)))


def same_entity_set(left: Column, right: Column) -> Column:
    """Equality of two id lists in any order, repeats counted."""
    return F.array_sort(left) == F.array_sort(right)


def alias_union(known: Column, incoming: Column) -> tuple[Column, Column]:
    """(ordered union without repeats, those newly added)."""
    return F.array_union(known, incoming), F.array_except(incoming, known)


def recalled_except_summaries(recalled: DataFrame, summaries: DataFrame, keys=("query_id", "id")) -> DataFrame:
    return recalled.join(summaries.select(*keys), list(keys), "left_anti")
