"""Why an asset is held: provenance bundles, evidence rows and store counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import confidence_band, confidence_percent
from ..functions.text import display_value, headline


def witness_count(anchors: Column) -> Column:
    return F.greatest(F.size(anchors), F.lit(0))


def store_counts(assets: DataFrame) -> DataFrame:
    """Assets per store, kind and network."""
    return assets.groupBy("store", "kind", "network").agg(F.count(F.lit(1)).alias("n"))


def anchor_sort(anchors: Column, source_turn_id: Column) -> Column:
    """The source turn's anchors first, the rest by turn id; given order within one turn."""
    placed = F.transform(
        anchors,
        lambda a, i: F.struct(F.when(a["turn_id"] == source_turn_id, 0).otherwise(1).alias("o"), a["turn_id"].alias("t"), i.alias("i"), a.alias("a")),
    )

    def order(x: Column, y: Column) -> Column:
        by_turn = F.when(x["o"] == 0, F.lit(0)).when(x["t"] < y["t"], -1).when(x["t"] > y["t"], 1).otherwise(0)
        return (
            F.when(x["o"] < y["o"], -1).when(x["o"] > y["o"], 1).when(by_turn != 0, by_turn)
            .when(x["i"] < y["i"], -1).when(x["i"] > y["i"], 1).otherwise(0)
        )

    return F.transform(F.array_sort(placed, order), lambda x: x["a"])


def _bundle(p: Column) -> list[Column]:
    t = p["temporal_range"]
    return [
        p["confidence_score"].alias("confidence_score"),
        p["confidence_source"].alias("confidence_source"),
        confidence_percent(p["confidence_score"]).alias("confidence_percent"),
        confidence_band(p["confidence_score"]).alias("confidence_band"),
        *[t[n].alias(n) for n in ("turn_start", "turn_end", "narrative_start", "narrative_end", "narrative_always")],
        anchor_sort(p["raw_quote_anchors"], p["source_turn_id"]).alias("anchors"),
        witness_count(p["raw_quote_anchors"]).alias("corroboration"),
    ]


def explain_assets(assets: DataFrame) -> DataFrame:
    """One provenance bundle per asset."""
    for name in ("entity_id", "canonical_name", "entity_type", "title"):
        if name not in assets.columns:
            assets = assets.withColumn(name, F.lit(None).cast("string"))
    return assets.select(
        F.col("id").alias("asset_id"),
        "kind",
        "network",
        headline("kind", "content", "entity_id", "canonical_name", "entity_type", "title").alias("headline"),
        *_bundle(F.col("provenance")),
        "viewpoint_holder",
        "tags",
    )


def explain_attributes(cards: DataFrame, key: str | None = None) -> DataFrame:
    """One bundle per attribute of a card; with ``key`` for that one alone, an error where a card lacks it."""
    if key is None:
        rows = cards.select("*", F.explode("attributes").alias("_a"))
    else:
        found = F.try_element_at(F.filter("attributes", lambda a: a["key"] == key), F.lit(1))
        text = F.concat(F.lit(f'attribute "{key}" not found on entry '), "entity_id")
        rows = cards.withColumn("_a", F.when(found.isNotNull(), found).otherwise(F.raise_error(text)))
    a = F.col("_a")
    return rows.select(
        F.col("id").alias("asset_id"),
        F.lit("entity").alias("kind"),
        "network",
        F.concat("canonical_name", F.lit(": "), a["key"], F.lit(" = "), display_value(a["value_json"])).alias("headline"),
        a["key"].alias("attribute_key"),
        a["value_json"].alias("attribute_value"),
        *_bundle(a["provenance"]),
        "viewpoint_holder",
        "tags",
    )


def evidence_rows(assets: DataFrame, turns: DataFrame) -> DataFrame:
    """(asset_id, anchor, its turn): ``in_place`` tells whether a given span holds the quote."""
    flat = assets.select(F.col("id").alias("asset_id"), F.explode("provenance.raw_quote_anchors").alias("_a")).select(
        "asset_id", "_a.turn_id", "_a.quote", "_a.char_start", "_a.char_end"
    )
    joined = flat.join(turns.select("turn_id", "session_id", "turn_index", "content"), "turn_id", "left")
    # Spans count UTF-16 units, so they cut the UTF-16 bytes.
    cut = F.decode(
        F.substring(F.encode("content", "UTF-16BE"), F.col("char_start") * 2 + 1, (F.col("char_end") - F.col("char_start")) * 2),
        "UTF-16BE",
    )
    in_place = F.when(F.col("char_start").isNotNull(), cut == F.col("quote"))
    return joined.withColumn("in_place", in_place).drop("content")


def validity(p: Column) -> Column:
    """When the asset holds, in words."""
    t = p["temporal_range"]
    return (
        F.when(t["narrative_always"], F.lit("Timeless (world rule)"))
        .when(t["turn_end"].isNotNull(), F.concat(F.lit("Valid "), t["turn_start"], F.lit(" → "), t["turn_end"]))
        .otherwise(F.concat(F.lit("Since "), t["turn_start"]))
    )

