"""Sources, validation, filters and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.operators import select, validate
from mnemospark.functions import text
from mnemospark.sources import json_records, tables

from .bindings import base, bind, with_tables
from .registry import query


def nested_assets(spark, sf):
    """The flat test rows as assets, with nested provenance."""
    r = bind(spark, sf, "raw_assets")
    anchor = F.struct(F.col("anchor_turn_id").alias("turn_id"), "quote", "char_start", "char_end")
    return r.select(
        "seq", "id", "network", "kind", "content",
        F.struct(
            "source_turn_id", "confidence_score", "confidence_source",
            F.when(F.col("seq") % 47 == 0, F.array().cast("array<struct<turn_id:string,quote:string,char_start:int,char_end:int>>"))
            .otherwise(F.array(anchor)).alias("raw_quote_anchors"),
            F.struct("turn_start", "turn_end", "narrative_start", "narrative_end", "narrative_always").alias("temporal_range"),
        ).alias("provenance"),
        F.array("entity").alias("entity_ids"), F.array("tag").alias("tags"), "viewpoint_holder", "relevance", "entity_id",
    )


def joined(c):
    return F.array_join(c, "; ")


def marks(*rules: tuple[str, str]) -> str:
    """DuckDB text for a list of violations."""
    items = ", ".join(f"CASE WHEN {cond} THEN '{text}' END" for cond, text in rules)
    return f"array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), '; ')"


@query("S1_turn_scan", with_tables("turns", "SELECT * FROM turns"))
def s1(spark, sf):
    return tables.turn_scan(bind(spark, sf, "turns"))


@query(
    "S2_asset_upsert",
    with_tables(
        "atomic",
        """, v AS (SELECT 'k' || (seq % 700) AS id, seq, content, kind FROM atomic)
SELECT id, seq, content, kind FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM v) WHERE rn = 1""",
    ),
)
def s2(spark, sf):
    v = bind(spark, sf, "atomic").select(F.concat(F.lit("k"), F.col("seq") % 700).alias("id"), "seq", "content", "kind")
    return tables.asset_upsert(v.filter("seq % 2 = 0"), v.filter("seq % 2 = 1"))


@query(
    "S3_lore_upsert",
    """SELECT 'v' || (vec_id % 400) AS id, max(vec_id) AS seq, 'stored' AS state, CAST(64 AS INTEGER) AS dim FROM embeddings
WHERE vec_id % 10 <> 3 GROUP BY 1 UNION ALL
SELECT 'v' || (vec_id % 400), vec_id, CASE WHEN vec_id % 20 = 3 THEN 'LoreSnippet v' || (vec_id % 400) || ' cannot be upserted without an embedding'
ELSE 'embedding dim 32 does not match store dim 64' END, CASE WHEN vec_id % 20 = 3 THEN 0 ELSE 32 END FROM embeddings WHERE vec_id % 10 = 3""",
)
def s3(spark, sf):
    e = base(spark, sf, "embeddings")
    vec = (
        F.when(F.col("vec_id") % 20 == 3, F.array().cast("array<float>"))
        .when(F.col("vec_id") % 20 == 13, F.slice("embedding", 1, 32))
        .otherwise(F.col("embedding"))
    )
    rows = e.select(F.concat(F.lit("v"), F.col("vec_id") % 400).alias("id"), F.col("vec_id").alias("seq"), vec.alias("embedding"))
    table, rejected = tables.lore_upsert(rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1"))
    return table.select("id", "seq", F.lit("stored").alias("state"), F.size("embedding").alias("dim")).unionAll(
        rejected.select("id", "seq", "reason", F.size("embedding"))
    )


@query(
    "S4_ref_tables",
    with_tables(
        "raw_assets",
        """SELECT DISTINCT 'entity' AS ref, id AS asset_id, entity AS value FROM raw_assets UNION
SELECT 'entity', id, entity_id FROM raw_assets WHERE entity_id IS NOT NULL UNION SELECT 'tag', id, tag FROM raw_assets""",
    ),
)
def s4(spark, sf):
    a = nested_assets(spark, sf)
    e = tables.entity_refs(a).select(F.lit("entity").alias("ref"), "asset_id", F.col("entity_id").alias("value"))
    return e.unionAll(tables.tag_refs(a).select(F.lit("tag"), "asset_id", "tag")).distinct()


@query(
    "S5_asset_delete",
    with_tables("atomic lore", "SELECT id, seq FROM atomic WHERE seq % 7 <> 0 UNION ALL SELECT id, seq FROM lore WHERE seq % 3 <> 1"),
)
def s5(spark, sf):
    atomic, lore = bind(spark, sf, "atomic").select("id", "seq"), bind(spark, sf, "lore").select("id", "seq")
    ids = atomic.filter("seq % 7 = 0").select("id").unionAll(lore.filter("seq % 3 = 1").select("id"))
    return tables.asset_delete(atomic, ids).unionAll(tables.asset_delete(lore, ids))


@query(
    "S6_asset_json",
    with_tables(
        "raw_assets",
        """SELECT id, network, kind, content, source_turn_id, confidence_score, turn_end, narrative_always, entity, relevance,
CASE WHEN seq % 47 = 0 THEN NULL ELSE quote END AS quote, CASE WHEN seq % 47 = 0 THEN NULL ELSE char_end END AS char_end FROM raw_assets""",
    ),
)
def s6(spark, sf):
    back = json_records.asset_from_json(json_records.asset_to_json(nested_assets(spark, sf)))
    p = F.col("provenance")
    first = F.try_element_at(p["raw_quote_anchors"], F.lit(1))
    return back.select(
        "id", "network", "kind", "content", p["source_turn_id"].alias("source_turn_id"),
        p["confidence_score"].alias("confidence_score"), p["temporal_range"]["turn_end"].alias("turn_end"),
        p["temporal_range"]["narrative_always"].alias("narrative_always"), F.col("entity_ids")[0].alias("entity"),
        "relevance", first["quote"].alias("quote"), first["char_end"].alias("char_end"),
    )


def extraction_records(spark, sf):
    """Extractor output built from events: atomic facts and cards, some broken in known ways."""
    e = base(spark, sf, "events")
    i = F.col("event_id")
    none = F.lit(None).cast("string")
    fact = F.struct(
        F.lit("atomic").alias("type"),
        F.when(i % 19 == 4, "entity").otherwise("fact").alias("kind"),
        F.when(i % 5 == 0, "opinion").otherwise("world").alias("network"),
        F.when(i % 23 == 6, "").otherwise(F.concat("event_type", F.lit(" happened"))).alias("content"),
        F.col("event_type").alias("quote"),
        ((i % 13) / 10).alias("confidence"),
        F.when(i % 10 != 0, none).otherwise(F.lit("holder")).alias("viewpoint_holder"),
    )
    card = F.struct(
        F.lit("entity").alias("type"), none.alias("kind"),
        F.when(i % 29 == 3, "experience").otherwise("observation").alias("network"),
        F.concat(F.lit("user "), "user_id").alias("content"), F.col("event_type").alias("quote"),
        F.lit(0.5).cast("double").alias("confidence"), none.alias("viewpoint_holder"),
        F.concat(F.lit("user:"), "user_id").alias("entity_id"), F.lit("user").alias("entity_type"),
        F.concat(F.lit("User"), "user_id").alias("canonical_name"),
    )
    text_json = F.concat(F.lit('{"facts":['), F.to_json(fact), F.lit(","), F.to_json(card), F.lit("]}"))
    record = F.when(i % 17 == 0, F.lit('{"facts":[')).when(i % 17 == 1, F.lit('{"items":1}')).otherwise(text_json)
    return e.select(F.col("event_id").alias("event_id"), record.alias("record"))


@query(
    "S7_extraction_json",
    """SELECT event_id, 0 AS position, 'atomic' AS type, CASE WHEN event_id % 23 = 6 THEN '' ELSE event_type || ' happened' END AS content,
CAST(NULL AS VARCHAR) AS entity_id, false AS quarantined FROM events WHERE event_id % 17 > 1 UNION ALL
SELECT event_id, 1, 'entity', 'user ' || user_id, 'user:' || user_id, false FROM events WHERE event_id % 17 > 1 UNION ALL
SELECT event_id, NULL, NULL, NULL, NULL, true FROM events WHERE event_id % 17 <= 1""",
)
def s7(spark, sf):
    facts, bad = json_records.parse_extraction(extraction_records(spark, sf), "event_id", "record")
    none = F.lit(None).cast("string")
    return facts.select("event_id", "position", "type", "content", "entity_id", F.lit(False).alias("quarantined")).unionAll(
        bad.select("event_id", F.lit(None).cast("int"), none, none, none, F.lit(True))
    )


@query(
    "P1_validate_provenance",
    with_tables(
        "raw_assets",
        "SELECT seq, "
        + marks(
            ("source_turn_id = ''", "source_turn_id must not be empty"),
            ("confidence_score > 1", "confidence_score must be in [0, 1]"),
            ("confidence_source = 'guessed'", "confidence_source is not a known source"),
            ("seq % 47 = 0", "at least one raw_quote_anchor is required"),
            ("seq % 47 = 0 OR anchor_turn_id <> source_turn_id", "At least one raw_quote_anchor must reference source_turn_id"),
        )
        + " AS violations FROM raw_assets",
    ),
)
def p1(spark, sf):
    a = nested_assets(spark, sf)
    return a.select("seq", joined(validate.provenance_violations(F.col("provenance"))).alias("violations"))


@query(
    "P2_validate_anchor",
    with_tables(
        "raw_assets",
        "SELECT seq, CASE WHEN seq % 47 = 0 THEN '' ELSE "
        + marks(
            ("quote = ''", "anchor quote must not be empty"),
            ("(char_start IS NULL) <> (char_end IS NULL)", "char_start and char_end must be provided together"),
            ("char_end <= char_start", "char_end must be greater than char_start"),
        )
        + " END AS violations FROM raw_assets",
    ),
)
def p2(spark, sf):
    a = nested_assets(spark, sf)
    return a.select("seq", joined(validate.anchor_violations(F.col("provenance.raw_quote_anchors"))).alias("violations"))


@query(
    "P3_validate_temporal",
    with_tables(
        "raw_assets",
        "SELECT seq, "
        + marks(
            ("turn_start = ''", "turn_start must not be empty"),
            (
                "narrative_always AND (narrative_start IS NOT NULL OR narrative_end IS NOT NULL)",
                "narrative_always is incompatible with narrative_start/narrative_end",
            ),
        )
        + " AS violations FROM raw_assets",
    ),
)
def p3(spark, sf):
    a = nested_assets(spark, sf)
    return a.select("seq", joined(validate.temporal_violations(F.col("provenance.temporal_range"))).alias("violations"))


@query(
    "P4_validate_asset",
    with_tables(
        "raw_assets",
        "SELECT seq, CASE WHEN seq % 3 = 0 THEN 0 ELSE relevance END AS relevance, "
        + marks(
            ("id = ''", "id must not be empty"),
            ("content = ''", "content must not be empty"),
            ("entity = ''", "entity_ids must not hold empty ids"),
            ("tag = '' AND seq % 5 <> 0", "tags must not hold empty tags"),
            ("viewpoint_holder = ''", "viewpoint_holder must not be empty"),
            ("relevance < 0 AND seq % 3 <> 0", "relevance must not be negative"),
        )
        + " AS violations FROM raw_assets",
    ),
)
def p4(spark, sf):
    a = (
        nested_assets(spark, sf)
        .withColumn("relevance", F.when(F.col("seq") % 3 != 0, F.col("relevance")))
        .withColumn("tags", F.when(F.col("seq") % 5 != 0, F.col("tags")))
    )
    a = validate.with_asset_defaults(a)
    return a.select("seq", "relevance", joined(validate.asset_violations(a)).alias("violations"))


@query(
    "P5_opinion_viewpoint_rule",
    with_tables(
        "raw_assets",
        "SELECT seq, "
        + marks(
            (
                "network = 'opinion' AND coalesce(viewpoint_holder, '') = ''",
                "viewpoint_holder is required when network === OPINION",
            ),
            (
                "network <> 'opinion' AND coalesce(viewpoint_holder, '') <> ''",
                "viewpoint_holder is only allowed when network === OPINION",
            ),
        )
        + " AS violations FROM raw_assets",
    ),
)
def p5(spark, sf):
    a = bind(spark, sf, "raw_assets")
    return a.select("seq", joined(validate.viewpoint_violations(a["network"], a["viewpoint_holder"])).alias("violations"))


@query(
    "P6_validate_extraction",
    """WITH f AS (SELECT *, event_id % 5 = 0 AS op, event_id % 10 = 0 AS held, event_id % 17 > 1 AS parsed FROM events)
SELECT event_id, 0 AS position, """
    + marks(
        ("event_id % 23 = 6", "content must not be empty"),
        ("event_id % 13 > 10", "confidence must be in [0, 1]"),
        ("event_id % 19 = 4", "atomic kind is not permitted"),
        ("op AND NOT held", 'viewpoint_holder is required when network is "opinion"'),
    )
    + " AS violations FROM f WHERE parsed UNION ALL SELECT event_id, 1, "
    + marks(("event_id % 29 = 3", "entity network must be world or observation"))
    + " FROM f WHERE parsed",
)
def p6(spark, sf):
    facts, _ = json_records.parse_extraction(extraction_records(spark, sf), "event_id", "record")
    accepted, quarantined = validate.split_extraction(facts)
    return accepted.select("event_id", "position", F.lit("").alias("violations")).unionAll(
        quarantined.select("event_id", "position", joined("violations"))
    )


@query(
    "P7_entity_network_rule",
    with_tables(
        "raw_assets",
        "SELECT seq, CASE WHEN kind = 'entity' AND entity_id IS NOT NULL AND network NOT IN ('world', 'observation') THEN "
        "'WorldBibleEntry must live in the WORLD or OBSERVATION network' ELSE '' END AS violations FROM raw_assets",
    ),
)
def p7(spark, sf):
    a = bind(spark, sf, "raw_assets")
    return a.select("seq", joined(validate.entity_network_violations(a["kind"], a["network"], a["entity_id"])).alias("violations"))


ALLOWED_SQL = """(kind = 'rule' AND network = 'world') OR (kind = 'entity' AND network IN ('world', 'observation'))
 OR (kind = 'fact' AND network <> 'opinion') OR (kind = 'opinion' AND network = 'opinion')
 OR kind IN ('lore', 'summary', 'reflection')"""


@query(
    "P8_network_matrix",
    with_tables(
        "raw_assets",
        f"""SELECT seq, {ALLOWED_SQL} AS allowed, CASE WHEN NOT ({ALLOWED_SQL}) THEN kind || ' is not allowed in the ' || network ||
 ' network — permitted: ' || CASE kind WHEN 'rule' THEN 'world' WHEN 'entity' THEN 'world, observation'
 WHEN 'fact' THEN 'world, experience, observation' WHEN 'opinion' THEN 'opinion' END END AS violation FROM raw_assets""",
    ),
)
def p8(spark, sf):
    return validate.network_matrix(bind(spark, sf, "raw_assets")).select("seq", "allowed", "violation")


@query(
    "P9_route_assets",
    with_tables(
        "raw_assets",
        "SELECT seq, CASE WHEN kind = 'lore' THEN 'vector' WHEN kind = 'entity' AND entity_id IS NOT NULL THEN 'entity' "
        "ELSE 'structured' END AS target FROM raw_assets",
    ),
)
def p9(spark, sf):
    a = bind(spark, sf, "raw_assets")
    return a.select("seq", validate.route_target(a["kind"], a["entity_id"]).alias("target"))


@query(
    "P10_remember_fact",
    f"""SELECT event_id, CASE WHEN event_id % 17 = 0 OR event_id % 17 = 5 THEN '{json_records.NOT_OBJECT}'
 WHEN event_id % 17 IN (1, 2, 3) THEN '{json_records.NO_CONTENT}' END AS error,
 CASE WHEN event_id % 17 NOT IN (0, 1, 2, 3, 5) THEN event_type || ' by ' || user_id END AS content,
 CASE WHEN event_id % 17 NOT IN (0, 1, 2, 3, 5) THEN CASE WHEN event_id % 17 = 4 THEN '' ELSE event_type END END AS tags,
 CASE WHEN event_id % 17 NOT IN (0, 1, 2, 3, 5) THEN 'user:' || user_id END AS entity_ids,
 CASE WHEN event_id % 17 NOT IN (0, 1, 2, 3, 5) THEN 'user_asserted' END AS confidence_source FROM events""",
)
def p10(spark, sf):
    e = base(spark, sf, "events")
    m = F.col("event_id") % 17
    content = (
        F.when(m == 1, F.lit('"  "')).when(m == 2, F.lit("12")).when(m == 3, F.lit("null"))
        .otherwise(F.concat(F.lit('"  '), "event_type", F.lit(" by "), "user_id", F.lit(' "')))
    )
    tags = F.when(m == 4, F.lit('"x"')).otherwise(F.concat(F.lit('["", 3, "'), "event_type", F.lit('", null]')))
    record = F.concat(
        F.lit('{"content":'), content, F.lit(',"tags":'), tags, F.lit(',"entity_ids":["user:'), "user_id", F.lit('",{"a":1}]}')
    )
    record = F.when(m == 0, F.lit("[1]")).when(m == 5, F.lit("nonsense{")).otherwise(record)
    rows = e.select(
        "event_id", record.alias("record"), F.concat(F.lit("t"), "event_id").alias("turn_id"), F.col("event_type").alias("quote")
    )
    out = json_records.remember_facts(rows)
    return out.select(
        "event_id", "error", "content", joined("tags").alias("tags"), joined("entity_ids").alias("entity_ids"),
        F.col("provenance.confidence_source").alias("confidence_source"),
    )


@query(
    "P11_structured_query",
    with_tables(
        "raw_assets",
        """SELECT 'network+kind' AS filter, seq FROM raw_assets WHERE network IN ('world', 'observation') AND kind = 'fact'
UNION ALL SELECT 'entity', seq FROM raw_assets WHERE entity = 'en' OR entity_id = 'en'
UNION ALL SELECT 'tag+view', seq FROM raw_assets WHERE tag = (SELECT min(source) FROM documents) AND viewpoint_holder = 'narrator'
UNION ALL SELECT 'all', seq FROM raw_assets""",
    ),
)
def p11(spark, sf):
    a = nested_assets(spark, sf)
    first = base(spark, sf, "documents").agg(F.min("source")).scalar()
    parts = {
        "network+kind": select.structured_query(a, network=["world", "observation"], kind="fact"),
        "entity": select.structured_query(a, entity_id="en"),
        "tag+view": select.structured_query(a, tag=first, viewpoint_holder="narrator"),
        "all": select.structured_query(a),
    }
    out = None
    for name, df in parts.items():
        rows = df.select(F.lit(name).alias("filter"), "seq")
        out = rows if out is None else out.unionAll(rows)
    return out


@query(
    "P12_entity_ref_filter",
    with_tables(
        "raw_assets",
        """, e AS (SELECT DISTINCT 'ent:' || (doc_id % 30) AS e FROM labels UNION SELECT 'fr')
SELECT seq FROM raw_assets WHERE id <> '' AND (entity IN (SELECT e FROM e) OR entity_id IN (SELECT e FROM e))""",
    ),
)
def p12(spark, sf):
    a = nested_assets(spark, sf).filter("id <> ''")
    wanted = base(spark, sf, "labels").select(F.concat(F.lit("ent:"), F.col("doc_id") % 30).alias("e"))
    wanted = wanted.unionAll(base(spark, sf, "documents").filter("lang = 'fr'").select("lang"))
    return select.entity_ref_filter(a, tables.entity_refs(a), wanted).select("seq")


@query(
    "P13_lore_list",
    with_tables(
        "lore",
        "SELECT id, tag FROM lore WHERE network IN ('world', 'opinion') AND tag = 'label:3' AND viewpoint_holder = 'holder3'",
    ),
)
def p13(spark, sf):
    lore = bind(spark, sf, "lore").withColumn("tags", F.array("tag"))
    return select.lore_list(lore, network=["world", "opinion"], tag="label:3", viewpoint_holder="holder3").select("id", "tag")


@query(
    "P14_point_lookup",
    with_tables(
        "atomic lore",
        """, both_ AS (SELECT 'k' || seq AS id, content, 'structured' AS store, 0 AS p FROM atomic UNION ALL SELECT 'k' || (seq * 3), content, 'vector', 1 FROM lore)
SELECT id, content, store FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) AS rn FROM both_
 WHERE id IN (SELECT 'k' || (doc_id * 2) FROM labels)) WHERE rn = 1""",
    ),
)
def p14(spark, sf):
    atomic = bind(spark, sf, "atomic").select(F.concat(F.lit("k"), "seq").alias("id"), "content")
    lore = bind(spark, sf, "lore").select(F.concat(F.lit("k"), F.col("seq") * 3).alias("id"), "content")
    keys = base(spark, sf, "labels").select(F.concat(F.lit("k"), F.col("doc_id") * 2))
    return tables.point_lookup(atomic, lore, keys).select("id", "content", "store")


@query(
    "P16_attribute_lookup",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)
WHEN event_id % 2 = 0 THEN props END AS view_value FROM events""",
)
def p16(spark, sf):
    e = base(spark, sf, "events")
    pair = lambda key, value: F.struct(key.alias("key"), value.alias("value_json"))
    second = F.when(F.col("event_id") % 2 == 0, F.lit("view")).otherwise(F.lit("other"))
    e = e.withColumn("attributes", F.array(pair(F.col("event_type"), F.floor("value").cast("string")), pair(second, F.col("props"))))
    value = select.attribute_lookup(F.col("attributes"), "view")["value_json"]
    return e.select("event_id", value.alias("view_value"))


@query("P17_role_filter", with_tables("turns", "SELECT turn_id, role FROM turns WHERE role IN ('user', 'assistant')"))
def p17(spark, sf):
    return select.role_filter(bind(spark, sf, "turns")).select("turn_id", "role")


def card_rows(spark, sf):
    c = bind(spark, sf, "cards_in")
    value = F.when(F.col("seq") % 3 == 0, F.lit("null")).when(F.col("seq") % 3 == 1, F.to_json(F.struct("alias"))).otherwise(
        F.concat(F.lit('"'), "quote", F.lit('"'))
    )
    return c.select(
        "*", F.lit("entity").alias("kind"), F.array("alias").alias("aliases"),
        F.when(F.col("seq") % 2 == 0, F.col("quote")).alias("summary"),
        F.array(F.struct(F.lit("k").alias("key"), value.alias("value_json"))).alias("attributes"),
    )


@query(
    "P18_indexable_text",
    with_tables(
        "cards_in atomic",
        """SELECT id, canonical_name || chr(10) || alias || chr(10) || entity_type || chr(10) || content ||
CASE WHEN seq % 2 = 0 THEN chr(10) || quote ELSE '' END || chr(10) || 'k: ' || CASE seq % 3 WHEN 0 THEN '' WHEN 1 THEN
'{"alias":"' || alias || '"}' ELSE quote END AS body FROM cards_in UNION ALL SELECT id, content FROM atomic""",
    ),
)
def p18(spark, sf):
    cards = card_rows(spark, sf)
    atomic = bind(spark, sf, "atomic").select("id", "kind", "content")
    both = cards.unionByName(atomic, allowMissingColumns=True)
    c = both.__getitem__
    body = text.indexable_text(
        c("kind"), c("content"), c("entity_id"), c("canonical_name"), c("aliases"), c("entity_type"), c("summary"), c("attributes")
    )
    return both.select("id", body.alias("body"))


@query(
    "J1_entity_ref_join",
    with_tables(
        "raw_assets",
        """, refs AS (SELECT id AS asset_id, entity AS e FROM raw_assets UNION SELECT id, entity_id FROM raw_assets WHERE entity_id IS NOT NULL)
SELECT a.seq, r.e AS ref_entity_id FROM raw_assets a JOIN refs r ON a.id = r.asset_id
WHERE a.id <> '' AND r.e IN (SELECT 'ent:' || doc_id FROM documents UNION SELECT lang FROM documents)""",
    ),
)
def j1(spark, sf):
    a = nested_assets(spark, sf).filter("id <> ''")
    d = base(spark, sf, "documents")
    wanted = d.select(F.concat(F.lit("ent:"), "doc_id").alias("e")).unionAll(d.select("lang"))
    return select.entity_ref_join(a, tables.entity_refs(a), wanted).select("seq", "ref_entity_id")


@query(
    "J2_tag_join",
    with_tables(
        "lore raw_assets",
        """SELECT id FROM lore WHERE tag IN (SELECT 'label:' || (doc_id % 4) FROM labels) UNION ALL
SELECT id FROM raw_assets WHERE id <> '' AND tag IN (SELECT source FROM documents WHERE lang = 'de')""",
    ),
)
def j2(spark, sf):
    lore = bind(spark, sf, "lore").withColumn("tags", F.array("tag"))
    assets = nested_assets(spark, sf).filter("id <> ''")
    w1 = base(spark, sf, "labels").select(F.concat(F.lit("label:"), F.col("doc_id") % 4).alias("t"))
    w2 = base(spark, sf, "documents").filter("lang = 'de'").select("source")
    return (
        select.tag_join(lore, tables.tag_refs(lore), w1).select("id")
        .unionAll(select.tag_join(assets, tables.tag_refs(assets), w2).select("id"))
    )


@query(
    "U1_store_union",
    with_tables("atomic lore", "SELECT id, kind, content FROM atomic UNION ALL SELECT id, 'lore', content FROM lore"),
)
def u1(spark, sf):
    lore = bind(spark, sf, "lore").withColumn("kind", F.lit("lore"))
    return tables.store_union(bind(spark, sf, "atomic"), lore).select("id", "kind", "content")


@query(
    "U2_alias_union",
    """WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS a, [p_type, split_part(p_name, ' ', 2), p_brand] AS b FROM part)
SELECT p_partkey, array_to_string(list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))), '|') AS aliases,
array_to_string(list_filter(b, lambda x: NOT list_contains(a, x)), '|') AS added FROM t""",
)
def u2(spark, sf):
    p = base(spark, sf, "part")
    known = F.split("p_name", " ")
    union, added = select.alias_union(known, F.array("p_type", F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_brand")))
    return p.select("p_partkey", F.array_join(union, "|").alias("aliases"), F.array_join(added, "|").alias("added"))


@query(
    "U4_same_entity_set",
    "SELECT l_orderkey, l_linenumber, list_sort([l_returnflag, l_linestatus, 'N']) = list_sort(['N', 'O', l_returnflag]) AS same FROM lineitem",
)
def u4(spark, sf):
    line = base(spark, sf, "lineitem")
    same = select.same_entity_set(
        F.array("l_returnflag", "l_linestatus", F.lit("N")), F.array(F.lit("N"), F.lit("O"), F.col("l_returnflag"))
    )
    return line.select("l_orderkey", "l_linenumber", same.alias("same"))
