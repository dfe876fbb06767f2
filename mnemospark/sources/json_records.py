"""JSON records: asset round trip, extractor output, explicit remember requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import stable_id, trim_space
from ..schema import ASSET, EXTRACTED_FACT

NOT_OBJECT = "remember_fact expected an object; got something else. Nothing was stored."
NO_CONTENT = "remember_fact requires a non-empty `content` string. Nothing was stored."


def asset_to_json(assets: DataFrame, name: str = "data") -> DataFrame:
    fields = [f for f in ASSET.fieldNames() if f in assets.columns]
    return assets.select("id", F.to_json(F.struct(*fields)).alias(name))


def asset_from_json(rows: DataFrame, name: str = "data") -> DataFrame:
    return rows.select(F.from_json(name, ASSET).alias("a")).select("a.*")


def parse_extraction(rows: DataFrame, key: str, record: str) -> tuple[DataFrame, DataFrame]:
    """Parse ``{"facts": [...]}`` records.

    Returns (facts: key, position and the fact's fields; quarantine: key, record).
    A record that is no JSON or has no fact list is quarantined whole, as is one
    in which a field has another type.
    """
    shape = T.StructType(
        [
            T.StructField("facts", T.ArrayType(EXTRACTED_FACT)),
            T.StructField("_corrupt", T.StringType()),
        ]
    )
    parsed = rows.withColumn(
        "_p", F.from_json(record, shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    )
    bad = F.col("_p").isNull() | F.col("_p._corrupt").isNotNull() | F.col("_p.facts").isNull()
    facts = parsed.filter(~bad).select(key, F.posexplode("_p.facts").alias("position", "fact"))
    return facts.select(key, "position", "fact.*"), parsed.filter(bad).select(key, record)


def _string_items(array_json: Column) -> Column:
    """Non-empty strings of a JSON array text; anything else in it, or around it, is dropped."""
    items = F.from_json(array_json, T.ArrayType(T.StringType()))
    raw = F.from_json(array_json, T.ArrayType(T.VariantType()))
    typed = F.zip_with(
        items, raw, lambda text, v: F.when(F.call_function("schema_of_variant", v) == "STRING", text)
    )
    return F.coalesce(F.filter(typed, lambda t: t.isNotNull() & (t != "")), F.array().cast("array<string>"))


def remember_facts(rows: DataFrame, record: str = "record", turn: str = "turn_id", quote: str = "quote") -> DataFrame:
    """Turn explicit remember requests into fact assets.

    Adds ``error`` (a message, or NULL) and the asset's fields; a row in error has no asset.
    """
    whole = F.try_parse_json(record)
    is_object = F.coalesce(F.call_function("schema_of_variant", whole).startswith("OBJECT"), F.lit(False))
    typed = F.call_function("schema_of_variant", F.call_function("try_variant_get", whole, F.lit("$.content"), F.lit("variant")))
    content = F.when(typed == "STRING", trim_space(F.get_json_object(record, "$.content")))
    rows = rows.withColumn("_content", F.coalesce(content, F.lit("")))
    error = F.when(~is_object, F.lit(NOT_OBJECT)).when(F.col("_content") == "", F.lit(NO_CONTENT))
    ok = error.isNull()
    keep = lambda value: F.when(ok, value)
    return rows.select(
        *[c for c in rows.columns if c != "_content"],
        error.alias("error"),
        keep(stable_id(turn, F.lit("remember"), "_content")).alias("id"),
        keep(F.lit("observation")).alias("network"),
        keep(F.lit("fact")).alias("kind"),
        keep(F.col("_content")).alias("content"),
        keep(_string_items(F.get_json_object(record, "$.entity_ids"))).alias("entity_ids"),
        keep(_string_items(F.get_json_object(record, "$.tags"))).alias("tags"),
        keep(F.lit(0).cast("bigint")).alias("relevance"),
        keep(
            F.struct(
                F.col(turn).alias("source_turn_id"),
                F.lit(1.0).alias("confidence_score"),
                F.lit("user_asserted").alias("confidence_source"),
                F.array(
                    F.struct(
                        F.col(turn).alias("turn_id"),
                        F.col(quote).alias("quote"),
                        F.lit(None).cast("int").alias("char_start"),
                        F.lit(None).cast("int").alias("char_end"),
                    )
                ).alias("raw_quote_anchors"),
                F.struct(
                    F.col(turn).alias("turn_start"),
                    F.lit(None).cast("string").alias("turn_end"),
                    F.lit(None).cast("string").alias("narrative_start"),
                    F.lit(None).cast("string").alias("narrative_end"),
                    F.lit(True).alias("narrative_always"),
                ).alias("temporal_range"),
            )
        ).alias("provenance"),
    )
