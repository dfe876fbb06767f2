"""Validation: each rule set yields an ``ARRAY<STRING>`` of violations, empty where a row is valid."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ALLOWED_NETWORKS, CONFIDENCE_SOURCES, KINDS, NETWORKS
from .lineage import settled


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def _violations(*rules: tuple[Column, str]) -> Column:
    marks = F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(text)) for broken, text in rules])
    return F.filter(marks, lambda m: m.isNotNull())


def anchor_violations(anchors: Column) -> Column:
    """Span given whole or not at all, end after start, no negative offset, quote and turn not empty."""
    def some(test):
        return F.exists(anchors, lambda a: F.coalesce(test(a), F.lit(False)))

    return _violations(
        (some(lambda a: _blank(a["turn_id"])), "anchor turn_id must not be empty"),
        (some(lambda a: _blank(a["quote"])), "anchor quote must not be empty"),
        (some(lambda a: (a["char_start"] < 0) | (a["char_end"] < 0)), "anchor offsets must not be negative"),
        (
            some(lambda a: a["char_start"].isNull() != a["char_end"].isNull()),
            "char_start and char_end must be provided together",
        ),
        (some(lambda a: a["char_end"] <= a["char_start"]), "char_end must be greater than char_start"),
    )


def temporal_violations(t: Column) -> Column:
    bounded = ~_blank(t["narrative_start"]) | ~_blank(t["narrative_end"])
    return _violations(
        (_blank(t["turn_start"]), "turn_start must not be empty"),
        (t["turn_end"] == "", "turn_end must not be empty"),
        (
            F.coalesce(t["narrative_always"], F.lit(False)) & bounded,
            "narrative_always is incompatible with narrative_start/narrative_end",
        ),
    )


def provenance_violations(p: Column) -> Column:
    anchors = p["raw_quote_anchors"]
    score = p["confidence_score"]
    return _violations(
        (_blank(p["source_turn_id"]), "source_turn_id must not be empty"),
        (score.isNull() | F.isnan(score) | (score < 0) | (score > 1), "confidence_score must be in [0, 1]"),
        (
            F.coalesce(~p["confidence_source"].isin(*CONFIDENCE_SOURCES), F.lit(False)),
            "confidence_source is not a known source",
        ),
        (F.coalesce(F.size(anchors), F.lit(0)) < 1, "at least one raw_quote_anchor is required"),
        (
            ~F.coalesce(F.exists(anchors, lambda a: a["turn_id"] == p["source_turn_id"]), F.lit(False)),
            "At least one raw_quote_anchor must reference source_turn_id",
        ),
    )


def viewpoint_violations(network: Column, holder: Column) -> Column:
    opinion, missing = network == "opinion", _blank(holder)
    return _violations(
        (opinion & missing, "viewpoint_holder is required when network === OPINION"),
        (~opinion & ~missing, "viewpoint_holder is only allowed when network === OPINION"),
    )


def asset_violations(a: DataFrame) -> Column:
    c = a.__getitem__
    empty_member = lambda m: F.coalesce(m, F.lit("")) == ""
    return _violations(
        (c("id") == "", "id must not be empty"),
        (~F.coalesce(c("network").isin(*NETWORKS), F.lit(False)), "network is not a known network"),
        (~F.coalesce(c("kind").isin(*KINDS), F.lit(False)), "kind is not a known kind"),
        (_blank(c("content")), "content must not be empty"),
        (F.exists(c("entity_ids"), empty_member), "entity_ids must not hold empty ids"),
        (F.exists(c("tags"), empty_member), "tags must not hold empty tags"),
        (c("viewpoint_holder") == "", "viewpoint_holder must not be empty"),
        (c("relevance") < 0, "relevance must not be negative"),
    )


def with_asset_defaults(assets: DataFrame) -> DataFrame:
    """Fill what may be left out: lists, relevance, the confidence source and the narrative flag."""
    none = F.array().cast("array<string>")
    p = F.col("provenance")
    temporal = p["temporal_range"].withField(
        "narrative_always", F.coalesce(p["temporal_range"]["narrative_always"], F.lit(False))
    )
    return (
        assets.withColumn("entity_ids", F.coalesce("entity_ids", none))
        .withColumn("tags", F.coalesce("tags", none))
        .withColumn("relevance", F.coalesce("relevance", F.lit(0).cast("bigint")))
        .withColumn(
            "provenance",
            p.withField("confidence_source", F.coalesce(p["confidence_source"], F.lit("inferred"))).withField(
                "temporal_range", temporal
            ),
        )
    )


def entity_network_violations(kind: Column, network: Column, entity_id: Column) -> Column:
    card = (kind == "entity") & entity_id.isNotNull()
    return _violations(
        (card & ~network.isin("world", "observation"), "WorldBibleEntry must live in the WORLD or OBSERVATION network")
    )


def rule_table(spark: SparkSession) -> DataFrame:
    """The seven rows of allowed (kind, networks)."""
    rows = ", ".join("('{}', array({}))".format(k, ", ".join(f"'{n}'" for n in v)) for k, v in ALLOWED_NETWORKS.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS rules(kind, permitted)")


def network_matrix(assets: DataFrame) -> DataFrame:
    """Add ``allowed`` and, where it is false, a ``violation`` text."""
    rules = F.broadcast(rule_table(assets.sparkSession))
    allowed = F.coalesce(F.array_contains("permitted", F.col("network")), F.lit(False))
    text = F.concat(
        "kind",
        F.lit(" is not allowed in the "),
        "network",
        F.lit(" network — permitted: "),
        F.array_join("permitted", ", "),
    )
    return (
        assets.join(rules, "kind", "left")
        .withColumn("allowed", allowed)
        .withColumn("violation", F.when(~F.col("allowed"), text))
        .drop("permitted")
    )


def network_violations(kind: Column, network: Column) -> Column:
    """The matrix of allowed (kind, network) pairs as an expression, for rows on their way to a store."""
    permitted = F.create_map(*[c for k, v in ALLOWED_NETWORKS.items() for c in (F.lit(k), F.array(*[F.lit(n) for n in v]))])[kind]
    text = F.concat(kind, F.lit(" is not allowed in the "), network, F.lit(" network — permitted: "), F.array_join(permitted, ", "))
    return F.when(F.array_contains(permitted, network), F.array().cast("array<string>")).otherwise(
        F.array(F.coalesce(text, F.lit("kind or network is not known")))
    )


def write_violations(rows: DataFrame, dimension: int | None = None) -> Column:
    """All rules that a row must meet before a store takes it: its own, its provenance's, those of its network and kind.

    Lore needs an embedding, of ``dimension`` numbers if that is given; a card needs an id, a type and a name, and
    provenance for each attribute. Columns that ``rows`` does not have are not judged.
    """
    c, p = rows.__getitem__, rows["provenance"]
    parts = [
        asset_violations(rows),
        network_violations(c("kind"), c("network")),
        viewpoint_violations(c("network"), c("viewpoint_holder")),
        provenance_violations(p),
        anchor_violations(p["raw_quote_anchors"]),
        temporal_violations(p["temporal_range"]),
    ]
    if "embedding" in rows.columns:
        lore, size = c("kind") == "lore", F.coalesce(F.size(c("embedding")), F.lit(0))
        other = F.lit(False) if dimension is None else (size > 0) & (size != dimension)
        parts.append(
            _violations((lore & (size < 1), "a lore snippet needs an embedding"), (lore & other, f"the embedding must have {dimension} numbers"))
        )
    if "entity_id" in rows.columns:
        card = (c("kind") == "entity") & c("entity_id").isNotNull()
        blank = _blank(c("entity_id")) | _blank(c("entity_type")) | _blank(c("canonical_name"))
        parts += [entity_network_violations(c("kind"), c("network"), c("entity_id")), _violations((card & blank, "entity id, type and name must not be empty"))]
        none = F.array().cast("array<string>")
        claims = F.flatten(F.transform("attributes", lambda a: F.concat(provenance_violations(a["provenance"]), anchor_violations(a["provenance"]["raw_quote_anchors"]))))
        keys = _violations((F.exists("attributes", lambda a: _blank(a["key"])), "attribute key must not be empty"))
        parts.append(F.when(card, F.concat(F.coalesce(claims, none), keys)).otherwise(none))
    return F.array_distinct(F.concat(*[F.coalesce(part, F.array().cast("array<string>")) for part in parts]))


@dataclass
class Checked:
    """Rows that may be stored, and the others with their ``violations``. Both read one written table."""

    accepted: DataFrame
    quarantined: DataFrame


def checked(rows: DataFrame, dimension: int | None = None) -> Checked:
    """Judge rows by ``write_violations`` in one pass."""
    judged = settled(rows.withColumn("violations", write_violations(rows, dimension)))
    clean = F.size("violations") == 0
    return Checked(judged.filter(clean).drop("violations"), judged.filter(~clean))


def refused(rows: DataFrame, dimension: int | None = None) -> DataFrame:
    """The same rows; a row that breaks a rule fails the job with its violations."""
    broken = write_violations(rows, dimension)
    fails = F.raise_error(F.concat(F.coalesce(F.col("id"), F.lit("?")), F.lit(": "), F.array_join(broken, "; "))).cast("boolean")
    return rows.filter(F.when(F.size(broken) == 0, F.lit(True)).otherwise(fails))


def route_target(kind: Column, entity_id: Column) -> Column:
    return (
        F.when(kind == "lore", "vector").when((kind == "entity") & entity_id.isNotNull(), "entity").otherwise("structured")
    )


def extraction_violations(f: DataFrame) -> Column:
    """Constraints on one extracted fact, atomic or entity."""
    c = f.__getitem__
    atomic, entity = c("type") == "atomic", c("type") == "entity"
    bad_score = lambda x: F.coalesce(x.isNull() | F.isnan(x) | (x < 0) | (x > 1), F.lit(True))
    member = lambda a: F.exists(a, lambda m: _blank(m))
    empty = lambda x: x == ""
    known_atomic = [k for k in KINDS if k != "entity"]
    attrs = c("attributes")
    return _violations(
        (~F.coalesce(atomic | entity, F.lit(False)), "type must be atomic or entity"),
        (_blank(c("content")), "content must not be empty"),
        (_blank(c("quote")), "quote must not be empty"),
        (bad_score(c("confidence")), "confidence must be in [0, 1]"),
        (atomic & ~F.coalesce(c("kind").isin(*known_atomic), F.lit(False)), "atomic kind is not permitted"),
        (atomic & ~F.coalesce(c("network").isin(*NETWORKS), F.lit(False)), "network is not a known network"),
        (atomic & (member(c("entity_ids")) | member(c("tags"))), "list members must not be empty"),
        (atomic & empty(c("viewpoint_holder")), "viewpoint_holder must not be empty"),
        (
            atomic & (c("network") == "opinion") & _blank(c("viewpoint_holder")),
            'viewpoint_holder is required when network is "opinion"',
        ),
        (
            atomic & (c("network") != "opinion") & ~_blank(c("viewpoint_holder")),
            'viewpoint_holder is only allowed when network is "opinion"',
        ),
        (
            entity & ~F.coalesce(c("network").isin("world", "observation"), F.lit(False)),
            "entity network must be world or observation",
        ),
        (
            entity & (_blank(c("entity_id")) | _blank(c("entity_type")) | _blank(c("canonical_name"))),
            "entity id, type and name must not be empty",
        ),
        (entity & member(c("aliases")), "list members must not be empty"),
        (
            entity
            & F.exists(attrs, lambda a: _blank(a["key"]) | a["value"].isNull() | _blank(a["quote"]) | bad_score(a["confidence"])),
            "attribute needs key, value, quote and a confidence in [0, 1]",
        ),
    )


def split_extraction(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined with ``violations``)."""
    judged = facts.withColumn("violations", extraction_violations(facts))
    ok = F.size("violations") == 0
    return judged.filter(ok).drop("violations"), judged.filter(~ok)
