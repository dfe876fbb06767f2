"""Types and fixed rule tables of the memory model.

An asset row carries its provenance as a struct. Where many arrivals share one
asset, its quote anchors live in a separate *evidence* table instead, so that
no row grows with the number of witnesses.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values.
KINDS = ("fact", "entity", "rule", "lore", "summary", "reflection", "opinion")
NETWORKS = ("world", "experience", "observation", "opinion")
CONFIDENCE_SOURCES = ("user_asserted", "narrator_asserted", "inferred", "derived", "external")
ROLES = ("user", "assistant", "narrator", "system")
# The networks in which each kind may live.
ALLOWED_NETWORKS = {
    "rule": ("world",),
    "entity": ("world", "observation"),
    "fact": ("world", "experience", "observation"),
    "opinion": ("opinion",),
    "lore": NETWORKS,
    "summary": NETWORKS,
    "reflection": NETWORKS,
}

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


ANCHOR = _struct(turn_id=S, quote=S, char_start=I, char_end=I)
TEMPORAL = _struct(turn_start=S, turn_end=S, narrative_start=S, narrative_end=S, narrative_always=B)
PROVENANCE = _struct(
    source_turn_id=S,
    confidence_score=D,
    confidence_source=S,
    raw_quote_anchors=T.ArrayType(ANCHOR),
    temporal_range=TEMPORAL,
)
ATTRIBUTE = _struct(key=S, value_json=S, provenance=PROVENANCE)
TURN = _struct(session_id=S, turn_id=S, role=S, content=S, turn_index=I)
ASSET = _struct(
    id=S,
    network=S,
    kind=S,
    content=S,
    provenance=PROVENANCE,
    entity_ids=T.ArrayType(S),
    tags=T.ArrayType(S),
    viewpoint_holder=S,
    last_updated_turn=S,
    relevance=L,
    entity_id=S,
    entity_type=S,
    canonical_name=S,
    aliases=T.ArrayType(S),
    attributes=T.ArrayType(ATTRIBUTE),
    summary=S,
    title=S,
    embedding=T.ArrayType(D),
    embedding_model=S,
)
# What an extractor returns: atomic facts and entity cards in one wide type.
EXTRACTED_ATTRIBUTE = _struct(key=S, value=S, quote=S, confidence=D)
EXTRACTED_FACT = _struct(
    type=S,
    kind=S,
    network=S,
    content=S,
    quote=S,
    confidence=D,
    entity_ids=T.ArrayType(S),
    viewpoint_holder=S,
    tags=T.ArrayType(S),
    entity_id=S,
    entity_type=S,
    canonical_name=S,
    aliases=T.ArrayType(S),
    summary=S,
    attributes=T.ArrayType(EXTRACTED_ATTRIBUTE),
)
FINDING = _struct(
    finding=S,
    primary_id=S,
    supporting_id=S,
    rationale=S,
    confidence=D,
    effect=S,
    delta=D,
)
