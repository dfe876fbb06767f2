"""Turns to memory tables: extract, guard, gate, embed, deduplicate, merge, route."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import EMBED_MODEL
from ..operators import extract, reconcile
from ..operators.validate import checked, route_target


@dataclass
class Ingested:
    """Tables that one ingest yields; ``outcomes`` has one row per stored arrival, ``quarantined`` the arrivals that break a rule."""

    arrivals: DataFrame
    atomic: reconcile.Deduped
    cards: reconcile.MergedCards
    lore: DataFrame
    outcomes: DataFrame
    quarantined: DataFrame | None = None


def arrivals_of(
    turns: DataFrame,
    extractor: Callable[[DataFrame], DataFrame] | None = None,
    on_anchor_miss: str = "throw",
    skepticism: float = 0.0,
    embedder: Callable[[Column], Column] | None = None,
    embedding_model: str = EMBED_MODEL,
    share: bool = False,
    confidence_source: str = "inferred",
) -> DataFrame:
    """Assets in arrival order, verified, gated and embedded. ``share`` extracts equal contents once."""
    extractor = extractor or extract.pattern_extractor()
    read = extract.extract_once(turns, extractor) if share else extractor(turns)
    facts = extract.anchor_guard(extract.explode_facts(read), on_anchor_miss)
    made = extract.materialize(facts, confidence_source)
    made = made.withColumn("dedup_key", extract.mention_key(made))
    assets = extract.skepticism_gate(made, skepticism)
    return extract.embed_lore(assets, embedder, embedding_model).withColumn(
        "target", route_target(F.col("kind"), F.col("entity_id"))
    )


#: A chunk of arrival numbers holds the facts of this many turns.
TURN_CHUNK = reconcile.CHUNK * extract.FACT_PLACES


def reconcile_arrivals(arrivals: DataFrame, chunk: int = TURN_CHUNK) -> Ingested:
    entity = ["entity_type", "canonical_name", "summary"]
    vector = ["embedding", "embedding_model"]
    cards_in = arrivals.filter("target = 'entity'").drop("target", "dedup_key", *vector)
    atomic_in = arrivals.filter("target = 'structured'").drop("target", "entity_id", "aliases", "attributes", *entity, *vector)
    lore = arrivals.filter("target = 'vector'").drop("target", "dedup_key", "entity_id", "aliases", "attributes", *entity)
    atomic = reconcile.dedup_atomic(atomic_in)
    cards = reconcile.merge_entities(cards_in, chunk)
    outcomes = (
        reconcile.atomic_outcomes(atomic_in)
        .unionByName(reconcile.card_outcomes(cards_in, cards.changes, cards.aliases))
        .unionByName(lore.select("seq", "id", F.col("id").alias("arrival_id"), F.lit("created").alias("outcome")))
    )
    return Ingested(arrivals, atomic, cards, lore, outcomes)


def ingest_batch(turns: DataFrame, chunk: int = TURN_CHUNK, dimension: int | None = None, **options) -> Ingested:
    """All of it for many sessions in one job; options as for ``arrivals_of``.

    All results read the arrivals, so those are written once, with what is wrong with them: an arrival that breaks a rule is
    quarantined and touches no store. ``dimension`` is that of the store's embeddings.
    """
    judged = checked(arrivals_of(turns, **options), dimension)
    return replace(reconcile_arrivals(judged.accepted, chunk), quarantined=judged.quarantined)
