"""Extraction, the skepticism gate, deduplication, card merging and whole ingests."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.functions import vector
from mnemospark.operators import extract, reconcile, validate
from mnemospark.plans import ingest
from mnemospark.schema import ANCHOR

from .bindings import base, bind, with_tables
from .registry import query
from .scalars import norm_sql

NAME = "[A-Z][\\w''-]*"
ENTITY = f"\\b({NAME}) is a ([a-z][\\w ]*?)\\."
LOCATION = f"\\b({NAME}) is at ({NAME})\\."
POSSESSION = f"\\b({NAME}) has (?:a |an |the )?([a-z][\\w ]*?)\\."
OPINION = f"\\b({NAME}) (?:thinks|believes) (.+?)\\."


def _part(kind: int, pattern: str) -> str:
    return (
        f"SELECT turn_id, turn_index, content AS turn_text, {kind} AS k, unnest(regexp_extract_all(content, '{pattern}', 0)) AS quote, "
        f"unnest(regexp_extract_all(content, '{pattern}', 1)) AS n, unnest(regexp_extract_all(content, '{pattern}', 2)) AS o FROM story"
    )


#: Facts of all story turns, by the same sentence patterns in SQL.
FACTS = f""", raw AS ({_part(0, ENTITY)} UNION ALL {_part(1, LOCATION)} UNION ALL {_part(2, POSSESSION)} UNION ALL {_part(3, OPINION)}),
facts AS (SELECT turn_id, turn_index, turn_text, quote,
 row_number() OVER (PARTITION BY turn_id ORDER BY k, instr(turn_text, quote)) - 1 AS position,
 CASE k WHEN 0 THEN 'entity' WHEN 3 THEN 'opinion' ELSE 'fact' END AS kind,
 CASE k WHEN 0 THEN 'observation' WHEN 1 THEN 'experience' WHEN 2 THEN 'observation' ELSE 'opinion' END AS network,
 n || CASE k WHEN 0 THEN ' is a ' WHEN 1 THEN ' is at ' WHEN 2 THEN ' has ' ELSE
 CASE WHEN contains(quote, ' believes ') THEN ' believes ' ELSE ' thinks ' END END || o || '.' AS content,
 CASE k WHEN 1 THEN n || ',' || o WHEN 2 THEN n ELSE '' END AS ids, CASE WHEN k = 3 THEN n END AS viewpoint_holder,
 CASE WHEN k = 0 THEN 'char:' || lower(n) END AS entity_id, CASE WHEN k = 0 THEN trim(o) END AS entity_type FROM raw)"""


def story(spark, sf):
    return bind(spark, sf, "story").withColumn("turn_seq", F.col("turn_index").cast("bigint"))


def story_facts(spark, sf):
    return extract.explode_facts(extract.pattern_extractor()(story(spark, sf)))


@query(
    "X1_pattern_extract",
    with_tables("story", FACTS + """ SELECT turn_id, position, CASE WHEN kind = 'entity' THEN 'entity' ELSE 'atomic' END AS type, network, content, quote,
 ids, viewpoint_holder, entity_id, entity_type FROM facts"""),
)
def x1(spark, sf):
    f = story_facts(spark, sf)
    return f.select(
        "turn_id", "position", "fact.type", "fact.network", "fact.content", "fact.quote",
        F.coalesce(F.array_join("fact.entity_ids", ","), F.lit("")).alias("ids"), "fact.viewpoint_holder", "fact.entity_id", "fact.entity_type",
    )


def spoiled(spark, sf):
    """The facts with some quotes that do not stand in their turn."""
    f = story_facts(spark, sf)
    i = F.col("turn_seq")
    bad_attr = F.transform("fact.attributes", lambda a: a.withField("quote", F.concat(a["quote"], F.lit("?"))))
    fact = F.when(i % 5 == 0, F.col("fact").withField("quote", F.lit("never said"))).when(
        i % 7 == 0, F.col("fact").withField("attributes", bad_attr)
    )
    return f.withColumn("fact", fact.otherwise(F.when(i % 11 == 0, F.col("fact").withField("quote", F.lit(""))).otherwise(F.col("fact"))))


@query(
    "X2_anchor_guard",
    with_tables("story", FACTS + """ SELECT turn_id, position, content FROM facts WHERE turn_index % 5 <> 0
 AND (CASE WHEN turn_index % 7 = 0 THEN kind <> 'entity' ELSE turn_index % 11 <> 0 END)"""),
)
def x2(spark, sf):
    return extract.anchor_guard(spoiled(spark, sf), "skip").select("turn_id", "position", "fact.content")


@query(
    "X3_materialize",
    with_tables("story", FACTS + """ SELECT CAST(turn_index AS BIGINT) * 1048576 + position AS seq, md5(turn_id || '|' || position) AS id, network, kind, content,
 ids, viewpoint_holder, entity_id, turn_id AS source_turn_id, 0.7 AS confidence, 'inferred' AS confidence_source, quote,
 CAST(instr(turn_text, quote) - 1 AS INTEGER) AS char_start, CAST(instr(turn_text, quote) - 1 + length(quote) AS INTEGER) AS char_end, turn_id AS turn_start,
 CASE WHEN kind = 'entity' THEN '"' || entity_type || '"' END AS type_json FROM facts""".replace("0.7 AS", "CAST(0.7 AS DOUBLE) AS")),
)
def x3(spark, sf):
    a = extract.materialize(extract.anchor_guard(story_facts(spark, sf)))
    p, first = F.col("provenance"), F.col("provenance.raw_quote_anchors")[0]
    return a.select(
        "seq", "id", "network", "kind", "content", F.array_join("entity_ids", ",").alias("ids"), "viewpoint_holder", "entity_id",
        p["source_turn_id"].alias("source_turn_id"), p["confidence_score"].alias("confidence"),
        p["confidence_source"].alias("confidence_source"), first["quote"].alias("quote"), first["char_start"].alias("char_start"),
        first["char_end"].alias("char_end"), p["temporal_range"]["turn_start"].alias("turn_start"),
        F.get("attributes", F.lit(0))["value_json"].alias("type_json"),
    )


def atomic_assets(spark, sf):
    a = bind(spark, sf, "atomic")
    none = F.lit(None)
    anchor = F.struct(
        F.col("source_turn_id").alias("turn_id"), "quote", none.cast("int").alias("char_start"), none.cast("int").alias("char_end")
    ).cast(ANCHOR)
    temporal = F.struct(
        F.col("source_turn_id").alias("turn_start"), none.cast("string").alias("turn_end"), none.cast("string").alias("narrative_start"),
        none.cast("string").alias("narrative_end"), F.lit(False).alias("narrative_always"),
    )
    provenance = F.struct(
        "source_turn_id", F.col("confidence").alias("confidence_score"), F.lit("inferred").alias("confidence_source"),
        F.array(anchor).alias("raw_quote_anchors"), temporal.alias("temporal_range"),
    )
    return a.select(
        "seq", "id", "network", "kind", "content", provenance.alias("provenance"), F.array("entity").alias("entity_ids"),
        F.array("tag").alias("tags"), "viewpoint_holder", none.cast("string").alias("last_updated_turn"),
        F.lit(0).cast("bigint").alias("relevance"),
    )


ATOMIC_KEY = f"kind, network, entity, coalesce(viewpoint_holder, ''), {norm_sql('content')}"


@query(
    "W1_skepticism_gate",
    with_tables("atomic", f""" SELECT seq, id FROM atomic WHERE confidence >= 0.48 OR seq IN (SELECT seq FROM (
 SELECT seq, row_number() OVER (PARTITION BY {ATOMIC_KEY} ORDER BY seq) AS rn FROM atomic WHERE confidence < 0.48) WHERE rn >= 4)"""),
)
def w1(spark, sf):
    return extract.skepticism_gate(atomic_assets(spark, sf), 0.8).select("seq", "id")


@query(
    "X4_embed_lore",
    with_tables("story", """SELECT turn_id, turn_index % 3 = 0 AS lore, CASE WHEN turn_index % 3 = 0 THEN CASE WHEN turn_index % 2 = 0 THEN 'given' ELSE 'stub-fnv-v1' END END AS model,
 CASE WHEN turn_index % 3 = 0 THEN CASE WHEN turn_index % 2 = 0 THEN 1 ELSE 16 END END AS dim FROM story"""),
)
def x4(spark, sf):
    s = story(spark, sf)
    i = F.col("turn_index")
    rows = s.select(
        "turn_id", "turn_index", "content", F.when(i % 3 == 0, "lore").otherwise("fact").alias("kind"),
        F.when((i % 3 == 0) & (i % 2 == 0), F.array(F.lit(1.0))).alias("embedding"),
        F.when((i % 3 == 0) & (i % 2 == 0), F.lit("given")).alias("embedding_model"),
    )
    out = extract.embed_lore(rows, vector.hash_embedder())
    return out.select("turn_id", (F.col("kind") == "lore").alias("lore"), F.col("embedding_model").alias("model"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dim"))


@query(
    "X5_extract_once",
    with_tables("story", FACTS.replace("FROM story", "FROM (SELECT turn_id || '/' || r AS turn_id, turn_index, content FROM story, range(3) t(r) WHERE r <= turn_index % 3)")
                + " SELECT turn_id, position, content FROM facts"),
)
def x5(spark, sf):
    s = story(spark, sf)
    copies = s.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("turn_index") % 3))).withColumn(
        "turn_id", F.concat("turn_id", F.lit("/"), "r")
    )
    f = extract.explode_facts(extract.extract_once(copies, extract.pattern_extractor()))
    return f.select("turn_id", "position", "fact.content")


@query(
    "A1_dedup_atomic",
    with_tables("atomic", f"""SELECT arg_min(id, seq) AS id, arg_min(content, seq) AS content, min(kind) AS kind, arg_min(source_turn_id, seq) AS source_turn_id,
 max(confidence) AS confidence, count(*) - 1 AS relevance, CASE WHEN count(*) > 1 THEN arg_max(source_turn_id, seq) END AS last_updated_turn,
 count(DISTINCT source_turn_id || quote) AS witness_count FROM atomic GROUP BY {ATOMIC_KEY}"""),
)
def a1(spark, sf):
    d = reconcile.dedup_atomic(atomic_assets(spark, sf)).assets
    return d.select(
        "id", "content", "kind", F.col("provenance.source_turn_id").alias("source_turn_id"),
        F.col("provenance.confidence_score").alias("confidence"), "relevance", "last_updated_turn", "witness_count",
    )


@query(
    "A3_combine_provenance",
    """WITH a AS (SELECT user_id, event_id, 't' || (event_id % 20) AS turn_id, event_type AS quote, (event_id % 9 + 1) / 10.0::DOUBLE AS c FROM events),
w AS (SELECT user_id, min(event_id) AS s FROM a GROUP BY 1),
e AS (SELECT user_id, turn_id, quote, min(event_id) AS s, min(event_id) AS place FROM a GROUP BY 1, 2, 3
 UNION ALL SELECT user_id, turn_id, quote, event_id, event_id + 7 FROM a JOIN w USING (user_id) WHERE event_id = s AND event_id % 3 = 0)
SELECT e.user_id, string_agg(turn_id || ':' || quote || '@' || place, ';' ORDER BY s, place) AS anchors, max(m) AS confidence FROM e
JOIN (SELECT user_id, max(c) AS m FROM a GROUP BY 1) USING (user_id) GROUP BY 1""",
)
def a3(spark, sf):
    e = base(spark, sf, "events")
    anchor = F.struct(
        F.concat(F.lit("t"), F.col("event_id") % 20).alias("turn_id"), F.col("event_type").alias("quote"),
        F.col("event_id").cast("int").alias("char_start"), (F.col("event_id") + 1).cast("int").alias("char_end"),
    )
    # Some witnesses have the same quote twice, at two places.
    again = anchor.withField("char_start", anchor["char_start"] + 7).withField("char_end", anchor["char_end"] + 7)
    anchors = F.when(F.col("event_id") % 3 == 0, F.array(anchor, again)).otherwise(F.array(anchor))
    rows = e.select("user_id", F.col("event_id").alias("seq"), anchors.alias("anchors"), ((F.col("event_id") % 9 + 1) / 10).alias("c"))
    proof = reconcile.evidence(rows, ["user_id"])
    top = rows.groupBy("user_id").agg(F.max("c").alias("confidence"))
    out = reconcile.nest_anchors(top, proof, ["user_id"])
    text = F.transform("anchors", lambda a: F.concat(a["turn_id"], F.lit(":"), a["quote"], F.lit("@"), a["char_start"]))
    return out.select("user_id", F.array_join(text, ";").alias("anchors"), "confidence")


#: The reference fold, one arrival per step and key.
FOLD = """, num AS (SELECT *, row_number() OVER (PARTITION BY entity_id, key ORDER BY seq, place) AS i FROM kept),
fold AS (SELECT entity_id, key, i, seq, place, 'added' AS change, CAST(NULL AS VARCHAR) AS previous_value, value_json AS v, confidence AS c, turn_start AS t, seq AS ss, place AS sp
 FROM num WHERE i = 1
 UNION ALL SELECT n.entity_id, n.key, n.i, n.seq, n.place,
 CASE WHEN n.value_json = f.v THEN 'corroborated' WHEN n.confidence > f.c OR (n.confidence = f.c AND n.turn_start > f.t) THEN 'state_changed' ELSE 'ignored' END,
 CASE WHEN n.value_json = f.v THEN NULL WHEN n.confidence > f.c OR (n.confidence = f.c AND n.turn_start > f.t) THEN f.v ELSE n.value_json END,
 CASE WHEN n.value_json <> f.v AND (n.confidence > f.c OR (n.confidence = f.c AND n.turn_start > f.t)) THEN n.value_json ELSE f.v END,
 greatest(n.confidence, f.c),
 CASE WHEN n.value_json <> f.v AND (n.confidence > f.c OR (n.confidence = f.c AND n.turn_start > f.t)) THEN n.turn_start ELSE f.t END,
 CASE WHEN n.value_json <> f.v AND (n.confidence > f.c OR (n.confidence = f.c AND n.turn_start > f.t)) THEN n.seq ELSE f.ss END,
 CASE WHEN n.value_json <> f.v AND (n.confidence > f.c OR (n.confidence = f.c AND n.turn_start > f.t)) THEN n.place ELSE f.sp END
 FROM fold f JOIN num n ON n.entity_id = f.entity_id AND n.key = f.key AND n.i = f.i + 1)"""


@query(
    "A4_fold_attributes",
    with_tables("claims", ", kept AS (SELECT * FROM claims)" + FOLD
                + " SELECT entity_id, key, seq, place, change, previous_value, v AS new_value, c AS level, ss AS state_seq, sp AS state_place FROM fold", recursive=True),
)
def a4(spark, sf):
    out = reconcile.fold_attributes(bind(spark, sf, "claims"))
    return out.select("entity_id", "key", "seq", "place", "change", "previous_value", "new_value", "level", "state_seq", "state_place")


def user_cards(spark, sf):
    """A card per event, with one or (at times) two attributes of one key."""
    c = bind(spark, sf, "cards_in").join(
        base(spark, sf, "events").select(F.col("event_id").alias("seq"), "event_type", "value"), "seq"
    )
    none = F.lit(None)

    def provenance(quote, confidence):
        anchor = F.struct(
            F.col("source_turn_id").alias("turn_id"), quote.alias("quote"), none.cast("int").alias("char_start"), none.cast("int").alias("char_end")
        ).cast(ANCHOR)
        temporal = F.struct(
            F.col("source_turn_id").alias("turn_start"), none.cast("string").alias("turn_end"), none.cast("string").alias("narrative_start"),
            none.cast("string").alias("narrative_end"), F.lit(False).alias("narrative_always"),
        )
        return F.struct(
            "source_turn_id", confidence.cast("double").alias("confidence_score"), F.lit("inferred").alias("confidence_source"),
            F.array(anchor).alias("raw_quote_anchors"), temporal.alias("temporal_range"),
        )

    def attribute(value, quote, confidence):
        return F.struct(
            F.col("event_type").alias("key"), value.cast("string").alias("value_json"), provenance(quote, confidence).alias("provenance")
        )

    i, value = F.col("seq"), F.floor(F.col("value") / 10)
    one = attribute(value, F.concat(F.lit("q"), i % 3), (i % 5 + 5).cast("double") / 10)
    two = attribute(value + 1, F.concat(F.lit("r"), i % 3), (i % 4 + 6).cast("double") / 10)
    return c.select(
        "seq", "id", "network", F.lit("entity").alias("kind"), "content", provenance(F.col("quote"), F.col("confidence")).alias("provenance"),
        F.array().cast("array<string>").alias("entity_ids"), F.array().cast("array<string>").alias("tags"),
        none.cast("string").alias("viewpoint_holder"), none.cast("string").alias("last_updated_turn"), F.lit(0).cast("bigint").alias("relevance"),
        "entity_id", "entity_type", "canonical_name", F.array("alias").alias("aliases"),
        F.when(i % 11 == 0, F.array(one, two)).otherwise(F.array(one)).alias("attributes"), none.cast("string").alias("summary"),
    )


KEPT = """, fc AS (SELECT entity_id, min(seq) AS s FROM cards_in GROUP BY 1),
kept AS (SELECT c.* FROM claims c JOIN fc USING (entity_id) WHERE NOT (place = 1 AND c.seq = fc.s)),
stored AS (SELECT c.* FROM claims c JOIN fc USING (entity_id) WHERE place = 1 AND c.seq = fc.s)"""
LAST_STATE = """, last AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY entity_id, key ORDER BY i DESC) = 1)"""


@query(
    "A2_merge_entities",
    with_tables("cards_in claims", KEPT + FOLD + LAST_STATE + """, al AS (SELECT entity_id, alias, min(seq) AS s FROM cards_in GROUP BY 1, 2),
ev AS (SELECT f.entity_id, f.key, count(DISTINCT k.source_turn_id || k.quote) AS n FROM fold f JOIN last l ON f.entity_id = l.entity_id AND f.key = l.key AND f.ss = l.ss AND f.sp = l.sp
 JOIN claims k ON k.seq = f.seq AND k.place = f.place WHERE f.change <> 'ignored' GROUP BY 1, 2)
SELECT c.entity_id, 'card' AS part, arg_min(id, seq) || '|' || arg_min(entity_type, seq) || '|' || any_value(a.aliases) AS value, max(confidence) AS confidence,
 count(*) - 1 AS relevance, CASE WHEN count(*) > 1 THEN arg_max(source_turn_id, seq) END AS last_updated_turn, count(DISTINCT source_turn_id || quote) AS witnesses
 FROM cards_in c JOIN (SELECT entity_id, string_agg(alias, ',' ORDER BY s) AS aliases FROM al GROUP BY 1) a USING (entity_id) GROUP BY 1
UNION ALL SELECT l.entity_id, l.key, v, c, NULL, 't' || lpad(CAST(ss AS VARCHAR), 12, '0'), n FROM last l JOIN ev USING (entity_id, key)
UNION ALL SELECT entity_id, key, value_json, confidence, NULL, source_turn_id, NULL FROM stored""", recursive=True),
)
def a2(spark, sf):
    m = reconcile.merge_entities(user_cards(spark, sf))
    p = F.col("provenance")
    cards = reconcile.nest_aliases(m.cards, m.aliases).select(
        "entity_id", F.lit("card").alias("part"), F.concat_ws("|", "id", "entity_type", F.array_join("aliases", ",")).alias("value"),
        p["confidence_score"].alias("confidence"), "relevance", "last_updated_turn", F.col("witness_count").alias("witnesses"),
    )
    n = m.attribute_evidence.groupBy("entity_id", "key").agg(F.count(F.lit(1)).alias("n"))
    stored = m.changes.filter("change = 'stored'").select(F.col("seq").alias("state_seq"), F.col("place").alias("state_place"), F.lit(True).alias("st"))
    attributes = m.attributes.join(n, ["entity_id", "key"], "left").join(stored, ["state_seq", "state_place"], "left")
    return cards.unionAll(
        attributes.select(
            "entity_id", "key", "value_json", "confidence", F.lit(None).cast("bigint"), "source_turn_id", F.when(F.col("st").isNull(), F.col("n"))
        )
    )


CARD_OUTCOMES = """, own AS (SELECT entity_id, arg_min(id, seq) AS id FROM cards_in GROUP BY 1),
out AS (SELECT c.seq, o.id, c.id AS arrival_id, CASE WHEN c.seq = fc.s THEN 'created' WHEN bool_or(f.change = 'state_changed') THEN 'state_changed'
 WHEN bool_or(f.change = 'added') OR bool_or(al.s IS NOT NULL) THEN 'merged' ELSE 'bumped' END AS outcome
 FROM cards_in c JOIN fc USING (entity_id) JOIN own o USING (entity_id) LEFT JOIN fold f ON f.seq = c.seq
 LEFT JOIN (SELECT entity_id, alias, min(seq) AS s FROM cards_in GROUP BY 1, 2) al ON al.s = c.seq GROUP BY c.seq, c.id, o.id, fc.s)"""


def outcomes(spark, sf):
    cards = user_cards(spark, sf)
    m = reconcile.merge_entities(cards)
    a = reconcile.atomic_outcomes(atomic_assets(spark, sf))
    lore = bind(spark, sf, "lore").select("seq", "id", F.col("id").alias("arrival_id"), F.lit("created").alias("outcome"))
    return a.unionByName(reconcile.card_outcomes(cards, m.changes, m.aliases)).unionByName(lore)


ALL_OUTCOMES = CARD_OUTCOMES + f""", every_outcome AS (SELECT seq, id, arrival_id, outcome FROM out
 UNION ALL SELECT seq, first_value(id) OVER (PARTITION BY {ATOMIC_KEY} ORDER BY seq), id,
 CASE WHEN row_number() OVER (PARTITION BY {ATOMIC_KEY} ORDER BY seq) = 1 THEN 'created' ELSE 'bumped' END FROM atomic
 UNION ALL SELECT seq, id, id, 'created' FROM lore)"""


@query(
    "A5_ingest_outcomes",
    with_tables("cards_in claims atomic lore", KEPT + FOLD + ALL_OUTCOMES + " SELECT * FROM every_outcome", recursive=True),
)
def a5(spark, sf):
    return outcomes(spark, sf)


@query(
    "A6_tick_summary",
    with_tables("cards_in claims atomic lore turns", KEPT + FOLD + ALL_OUTCOMES
                + " SELECT outcome AS measure, count(*) AS n FROM every_outcome GROUP BY 1 UNION ALL SELECT 'turns_processed', count(*) FROM turns", recursive=True),
)
def a6(spark, sf):
    return reconcile.tick_summary(bind(spark, sf, "turns"), outcomes(spark, sf))


@query(
    "A14_witness_count",
    """SELECT 't' || (event_id % 20) AS turn_id, event_type AS quote, CASE WHEN event_id % 9 = 0 THEN 0 WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS witnesses, event_id FROM events""",
)
def a14(spark, sf):
    from mnemospark.operators.explain import witness_count

    e = base(spark, sf, "events")
    i = F.col("event_id")
    one = F.struct(F.concat(F.lit("t"), i % 20).alias("turn_id"), F.col("event_type").alias("quote"))
    anchors = F.when(i % 9 == 0, F.slice(F.array(one), 1, 0)).when(i % 2 == 0, F.array(one, one)).otherwise(F.array(one))
    return e.select("event_id", one["turn_id"].alias("turn_id"), one["quote"].alias("quote"), witness_count(anchors).alias("witnesses"))


@query(
    "A15_store_counts",
    with_tables("atomic lore cards_in", """SELECT 'structured' AS store, kind, network, count(*) AS n FROM atomic GROUP BY 2, 3
UNION ALL SELECT 'vector', 'lore', network, count(*) FROM lore GROUP BY 3 UNION ALL SELECT 'entity', 'entity', network, count(*) FROM cards_in GROUP BY 3"""),
)
def a15(spark, sf):
    from mnemospark.operators.explain import store_counts

    atomic = bind(spark, sf, "atomic").select(F.lit("structured").alias("store"), "kind", "network")
    lore = bind(spark, sf, "lore").select(F.lit("vector"), F.lit("lore"), "network")
    cards = bind(spark, sf, "cards_in").select(F.lit("entity"), F.lit("entity"), "network")
    return store_counts(atomic.unionAll(lore).unionAll(cards))


#: Facts after the gate at floor 0.3 with two mentions needed, then what they become.
INGEST_SQL = FACTS + f""", g AS (SELECT *, CAST(turn_index AS BIGINT) * 1048576 + position AS seq, row_number() OVER (PARTITION BY kind, network, ids, coalesce(viewpoint_holder, ''),
 {norm_sql('content')} ORDER BY turn_index, position) AS mention FROM facts),
ok AS (SELECT * FROM g WHERE mention >= 2),
ats AS (SELECT *, row_number() OVER (PARTITION BY kind, network, ids, coalesce(viewpoint_holder, ''), {norm_sql('content')} ORDER BY seq) AS rn FROM ok WHERE kind <> 'entity'),
en AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY seq) AS rn, lag(entity_type) OVER (PARTITION BY entity_id ORDER BY seq) AS before FROM ok WHERE kind = 'entity')
SELECT 'outcome' AS part, outcome AS name, count(*) AS n FROM (
 SELECT CASE WHEN rn = 1 THEN 'created' ELSE 'bumped' END AS outcome FROM ats UNION ALL
 SELECT CASE WHEN rn = 1 THEN 'created' WHEN entity_type <> before THEN 'state_changed' ELSE 'bumped' END FROM en) GROUP BY 2
UNION ALL SELECT 'asset', arg_min(content, seq), count(*) FROM ats GROUP BY kind, network, ids, coalesce(viewpoint_holder, ''), {norm_sql('content')}
UNION ALL SELECT 'attribute', entity_id || ' "' || arg_max(entity_type, seq) || '"', NULL FROM en GROUP BY entity_id
UNION ALL SELECT 'card', entity_id || ' ' || arg_min(entity_type, seq), count(*) FROM en GROUP BY entity_id"""


#: Arrivals of which some break a rule of the stores.
CHECKED_SQL = """, a AS (SELECT CASE WHEN seq % 11 = 3 THEN 'opinion' ELSE kind END AS kind, network, content = '' AS empty, seq % 13 = 5 AS score, seq % 17 = 2 AS anchor FROM atomic),
l AS (SELECT seq % 5 = 1 AS bare, seq % 5 <> 1 AND seq % 7 = 2 AS short FROM lore),
v AS (SELECT kind, list_filter([CASE WHEN empty THEN 'content must not be empty' END,
 CASE WHEN kind = 'opinion' AND network <> 'opinion' THEN 'opinion is not allowed in the ' || network || ' network — permitted: opinion' END,
 CASE WHEN score THEN 'confidence_score must be in [0, 1]' END,
 CASE WHEN anchor THEN 'At least one raw_quote_anchor must reference source_turn_id' END], lambda x: x IS NOT NULL) AS v FROM a
 UNION ALL SELECT 'lore', CASE WHEN bare THEN ['a lore snippet needs an embedding'] WHEN short THEN ['the embedding must have 64 numbers'] ELSE [] END FROM l)
SELECT 'accepted' AS part, kind AS name, count(*) AS n FROM v WHERE len(v) = 0 GROUP BY 2
UNION ALL SELECT 'quarantined', kind, count(*) FROM v WHERE len(v) > 0 GROUP BY 2
UNION ALL SELECT 'violation', x, count(*) FROM (SELECT unnest(v) AS x FROM v) GROUP BY 2"""


@query("X14_checked_write", with_tables("atomic lore", CHECKED_SQL))
def x6_checked(spark, sf):
    p, seq = F.col("provenance"), F.col("seq")
    atomic = atomic_assets(spark, sf).withColumn("embedding", F.lit(None).cast("array<double>"))
    spoilt = p.withField("confidence_score", F.when(seq % 13 == 5, 1.5).otherwise(p["confidence_score"]))
    spoilt = spoilt.withField("source_turn_id", F.when(seq % 17 == 2, "elsewhere").otherwise(p["source_turn_id"]))
    atomic = atomic.withColumn("provenance", spoilt).withColumn("kind", F.when(seq % 11 == 3, "opinion").otherwise(F.col("kind")))
    lore = bind(spark, sf, "lore").withColumn("kind", F.lit("lore"))
    turn = F.col("source_turn_id")
    anchor = F.struct(turn.alias("turn_id"), F.col("content").alias("quote"), F.lit(None).cast("int").alias("char_start"), F.lit(None).cast("int").alias("char_end"))
    none = F.lit(None).cast("string")
    temporal = F.struct(turn.alias("turn_start"), none.alias("turn_end"), none.alias("narrative_start"), none.alias("narrative_end"), F.lit(False).alias("narrative_always"))
    provenance = F.struct(
        "source_turn_id", F.lit(0.5).alias("confidence_score"), F.lit("inferred").alias("confidence_source"), F.array(anchor.cast(ANCHOR)).alias("raw_quote_anchors"),
        temporal.alias("temporal_range"),
    )
    whole = F.col("embedding").cast("array<double>")
    cut = F.when(seq % 5 == 1, None).when(seq % 7 == 2, F.slice(whole, 1, 3)).otherwise(whole)
    lore = lore.select(
        "seq", "id", "network", "kind", "content", provenance.alias("provenance"), F.array().cast("array<string>").alias("entity_ids"),
        F.array("tag").alias("tags"), "viewpoint_holder", none.alias("last_updated_turn"), F.lit(0).cast("bigint").alias("relevance"), cut.alias("embedding"),
    )
    judged = validate.checked(atomic.unionByName(lore), dimension=64)
    kinds = lambda df, part: df.groupBy(F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "name", "n")
    told = judged.quarantined.select(F.explode("violations").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return kinds(judged.accepted, "accepted").unionAll(kinds(judged.quarantined, "quarantined")).unionAll(told.select(F.lit("violation"), "name", "n"))


@query("X6_ingest_batch", with_tables("story", INGEST_SQL))
def x6(spark, sf):
    out = ingest.ingest_batch(story(spark, sf), extractor=extract.pattern_extractor(0.2), skepticism=0.5, embedder=vector.hash_embedder())
    counts = out.outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.select(F.lit("outcome").alias("part"), F.col("outcome").alias("name"), "n")
        .unionAll(out.atomic.assets.select(F.lit("asset"), "content", F.col("relevance") + 1))
        .unionAll(out.cards.attributes.select(F.lit("attribute"), F.concat_ws(" ", "entity_id", "value_json"), F.lit(None).cast("bigint")))
        .unionAll(out.cards.cards.select(F.lit("card"), F.concat_ws(" ", "entity_id", "entity_type"), F.col("relevance") + 1))
    )
