"""Facts from turns: patterns, quote guard, materialised assets, the skepticism gate.

Turns carry ``turn_seq``, a unique BIGINT in arrival order. A fact's ``seq`` is
made of it and the fact's place in its turn, and orders all that follows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scoring import gate_floor, gate_mentions
from ..functions.text import NOT_AFTER_WORD, normalize, quote_start, stable_id, utf16_length
from ..functions.vector import EMBED_MODEL
from ..schema import ANCHOR, EXTRACTED_FACT
from .ordering import top_per_key

#: Places of one turn's facts within the arrival order.
FACT_PLACES = 1 << 20

# The sentence patterns and the confidence of a match.
NAME = r"[A-Z][\w'-]*"
ANY = r"[^\n\r\x{2028}\x{2029}]"
PATTERNS = {
    "entity": rf"({NAME}) is a ([a-z][\w ]*?)\.",
    "location": rf"({NAME}) is at ({NAME})\.",
    "possession": rf"({NAME}) has (?:a |an |the )?([a-z][\w ]*?)\.",
    "opinion": rf"({NAME}) (?:thinks|believes) ({ANY}+?)\.",
}
PATTERN_CONFIDENCE = 0.7

FACT_ARRAY = T.ArrayType(EXTRACTED_FACT)
STRINGS = T.ArrayType(T.StringType())


def _fact(values: dict[str, Column]) -> Column:
    return F.struct(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EXTRACTED_FACT.fields]
    )


def _groups(match: Column, pattern: str) -> tuple[Column, Column]:
    whole = f"^{pattern}$"
    return F.regexp_extract(match, whole, 1), F.regexp_extract(match, whole, 2)


def pattern_facts(content: Column, confidence: float = PATTERN_CONFIDENCE) -> Column:
    """``ARRAY`` of extracted facts: entities, then locations, possessions, opinions."""
    score = F.lit(float(confidence))

    def entity(m: Column) -> Column:
        name, word = _groups(m, PATTERNS["entity"])
        attribute = F.struct(
            F.lit("type").alias("key"), F.trim(word).alias("value"), m.alias("quote"), score.alias("confidence")
        )
        return _fact(
            {
                "type": F.lit("entity"),
                "network": F.lit("observation"),
                "content": F.concat(name, F.lit(" is a "), word, F.lit(".")),
                "quote": m,
                "confidence": score,
                "entity_id": F.concat(F.lit("char:"), F.lower(name)),
                "entity_type": F.trim(word),
                "canonical_name": name,
                "attributes": F.array(attribute),
            }
        )

    def atomic(m: Column, kind: str, network: str, content: Column, ids: Column | None, holder: Column | None) -> Column:
        values = {
            "type": F.lit("atomic"),
            "kind": F.lit(kind),
            "network": F.lit(network),
            "content": content,
            "quote": m,
            "confidence": score,
        }
        if ids is not None:
            values["entity_ids"] = ids
        if holder is not None:
            values["viewpoint_holder"] = holder
        return _fact(values)

    def location(m: Column) -> Column:
        name, place = _groups(m, PATTERNS["location"])
        text = F.concat(name, F.lit(" is at "), place, F.lit("."))
        return atomic(m, "fact", "experience", text, F.array(name, place), None)

    def possession(m: Column) -> Column:
        name, thing = _groups(m, PATTERNS["possession"])
        return atomic(m, "fact", "observation", F.concat(name, F.lit(" has "), thing, F.lit(".")), F.array(name), None)

    def opinion(m: Column) -> Column:
        name, claim = _groups(m, PATTERNS["opinion"])
        verb = F.when(F.instr(m, F.lit(" believes ")) > 0, F.lit(" believes ")).otherwise(F.lit(" thinks "))
        return atomic(m, "opinion", "opinion", F.concat(name, verb, claim, F.lit(".")), None, name)

    makers = {"entity": entity, "location": location, "possession": possession, "opinion": opinion}
    found = [
        F.transform(F.regexp_extract_all(content, F.lit(NOT_AFTER_WORD + PATTERNS[name]), F.lit(0)), make)
        for name, make in makers.items()
    ]
    return F.concat(*found)


def pattern_extractor(confidence: float = PATTERN_CONFIDENCE) -> Callable[[DataFrame], DataFrame]:
    """The default extractor. An extractor maps turns to the same turns with a ``facts`` array."""
    return lambda turns: turns.withColumn("facts", pattern_facts(F.col("content"), confidence))


def map_extractor(extract: Callable) -> Callable[[DataFrame], DataFrame]:
    """An extractor from Python code: ``extract(content) -> list of fact dicts``, run over Arrow batches."""

    def run(turns: DataFrame) -> DataFrame:
        schema = T.StructType([*turns.schema.fields, T.StructField("facts", FACT_ARRAY)])

        def batches(parts):
            for pdf in parts:
                yield pdf.assign(
                    facts=[[{f: d.get(f) for f in EXTRACTED_FACT.fieldNames()} for d in extract(c)] for c in pdf["content"]]
                )

        return turns.mapInPandas(batches, schema)

    return run


def extract_once(turns: DataFrame, extractor: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Extract each distinct content once and share the facts among its turns."""
    keyed = turns.withColumn("_h", F.sha2("content", 256))
    texts = keyed.select("_h", "content").dropDuplicates(["_h"])
    return keyed.join(extractor(texts).select("_h", "facts"), "_h").drop("_h")


def explode_facts(turns: DataFrame) -> DataFrame:
    """One row per fact: turn columns, ``position``, ``seq`` and ``fact``."""
    # Outer, as an inner explode makes Spark match all patterns a second time in a filter below it.
    rows = turns.select(*[c for c in turns.columns if c != "facts"], F.posexplode_outer("facts").alias("position", "fact"))
    return rows.filter("fact IS NOT NULL").withColumn("seq", F.col("turn_seq") * FACT_PLACES + F.col("position"))


def anchor_guard(facts: DataFrame, mode: str = "throw") -> DataFrame:
    """Facts whose quotes all stand verbatim in their turn.

    ``throw`` fails the job on a miss, ``skip`` drops the fact; an entity falls
    with any bad attribute quote.
    """
    if mode not in ("throw", "skip"):
        raise ValueError(f"unknown mode {mode!r}")
    content = F.col("content")
    hit = lambda q: quote_start(content, q).isNotNull()
    attributes = F.coalesce(F.forall("fact.attributes", lambda a: hit(a["quote"])), F.lit(True))
    good = hit(F.col("fact.quote")) & (attributes | (F.col("fact.type") != "entity"))
    if mode == "skip":
        return facts.filter(good)
    miss = F.concat(F.lit("extractor returned a quote not found in turn "), "turn_id", F.lit(": "), "fact.quote")
    return facts.filter(F.when(good, F.lit(True)).otherwise(F.raise_error(miss).cast("boolean")))


def _provenance(content: Column, turn_id: Column, quote: Column, confidence: Column, source: str) -> Column:
    start = quote_start(content, quote)
    anchor = F.struct(
        turn_id.alias("turn_id"),
        quote.alias("quote"),
        start.cast("int").alias("char_start"),
        (start + utf16_length(quote)).cast("int").alias("char_end"),
    ).cast(ANCHOR)
    none = F.lit(None).cast("string")
    temporal = F.struct(
        turn_id.alias("turn_start"),
        none.alias("turn_end"),
        none.alias("narrative_start"),
        none.alias("narrative_end"),
        F.lit(False).alias("narrative_always"),
    )
    return F.struct(
        turn_id.alias("source_turn_id"),
        confidence.alias("confidence_score"),
        F.lit(source).alias("confidence_source"),
        F.array(anchor).alias("raw_quote_anchors"),
        temporal.alias("temporal_range"),
    )


def materialize(facts: DataFrame, confidence_source: str = "inferred") -> DataFrame:
    """Guarded facts as assets in arrival order (``seq``)."""
    f, turn, content = F.col("fact"), F.col("turn_id"), F.col("content")
    entity = f["type"] == "entity"
    none = F.array().cast(STRINGS)
    attributes = F.transform(
        f["attributes"],
        lambda a: F.struct(
            a["key"].alias("key"),
            F.get_json_object(F.to_json(F.array(a["value"])), "$").substr(F.lit(2), F.length(F.to_json(F.array(a["value"]))) - 2).alias("value_json"),
            _provenance(content, turn, a["quote"], a["confidence"], confidence_source).alias("provenance"),
        ),
    )
    only = lambda c: F.when(entity, c)
    return facts.select(
        "seq",
        stable_id(turn, "position").alias("id"),
        f["network"].alias("network"),
        F.when(entity, F.lit("entity")).otherwise(f["kind"]).alias("kind"),
        f["content"].alias("content"),
        _provenance(content, turn, f["quote"], f["confidence"], confidence_source).alias("provenance"),
        F.when(entity, none).otherwise(F.coalesce(f["entity_ids"], none)).alias("entity_ids"),
        F.when(entity, none).otherwise(F.coalesce(f["tags"], none)).alias("tags"),
        F.when(~entity & (f["viewpoint_holder"] != ""), f["viewpoint_holder"]).alias("viewpoint_holder"),
        F.lit(None).cast("string").alias("last_updated_turn"),
        F.lit(0).cast("bigint").alias("relevance"),
        only(f["entity_id"]).alias("entity_id"),
        only(f["entity_type"]).alias("entity_type"),
        only(f["canonical_name"]).alias("canonical_name"),
        only(F.coalesce(f["aliases"], none)).alias("aliases"),
        only(F.coalesce(attributes, F.slice(attributes, 1, 0))).alias("attributes"),
        only(f["summary"]).alias("summary"),
    )


def mention_key(assets: DataFrame) -> Column:
    """Signature under which mentions of a fact are counted, taken from ``dedup_key`` where that is stored."""
    if "dedup_key" in assets.columns:
        return assets["dedup_key"]
    c = assets.__getitem__
    return F.md5(
        F.concat_ws(
            "\x1f",
            c("kind"),
            c("network"),
            F.array_join(F.array_sort(c("entity_ids")), "\x1e"),
            F.coalesce(c("viewpoint_holder"), F.lit("")),
            normalize(c("content")),
        )
    )


def skepticism_gate(assets: DataFrame, skepticism: float, confidence: str = "provenance.confidence_score") -> DataFrame:
    """Assets at or above the floor, and weaker ones from their n-th mention on.

    Held back are just the first n - 1 weak mentions per signature. They are
    cut map-side to n - 1 rows per signature, however often one is repeated, and
    taken out by ``seq``, which no two rows share.
    """
    floor, needed = gate_floor(skepticism), gate_mentions(skepticism)
    if needed <= 1:
        return assets
    weak = assets.filter(F.col(confidence) < floor)
    early = top_per_key(weak.select(mention_key(weak).alias("_k"), "seq"), ["_k"], needed - 1, F.col("seq"))
    # Only the held rows' numbers meet the assets again.
    return assets.join(early.select("seq"), "seq", "left_anti")


def embed_lore(assets: DataFrame, embedder: Callable[[Column], Column] | None, model: str = EMBED_MODEL) -> DataFrame:
    """Fill ``embedding`` and ``embedding_model`` of lore that has none; without an embedder that is an error."""
    for name, kind in (("embedding", "array<double>"), ("embedding_model", "string")):
        if name not in assets.columns:
            assets = assets.withColumn(name, F.lit(None).cast(kind))
    lacking = (F.col("kind") == "lore") & (F.coalesce(F.size("embedding"), F.lit(0)) <= 0)
    if embedder is None:
        vector = F.raise_error(F.lit("a LORE fact needs an embedder but none is configured")).cast("array<double>")
    else:
        vector = embedder(F.when(lacking, F.col("content")))
    marked = assets.withColumn("_v", F.when(lacking, vector)).withColumn("_l", lacking)
    return (
        marked.withColumn("embedding", F.when(F.col("_l"), F.col("_v")).otherwise(F.col("embedding")))
        .withColumn("embedding_model", F.when(F.col("_l"), F.lit(model)).otherwise(F.col("embedding_model")))
        .drop("_v", "_l")
    )
