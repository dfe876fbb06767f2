"""Reflection over opinions, explanations and the entity graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.operators import explain, extract, graph, reconcile, reflect
from mnemospark.operators import transcript as tr
from mnemospark.schema import ANCHOR

from .bindings import bind, with_tables
from .ingest import FACTS, atomic_assets, story, story_facts, user_cards
from .registry import query
from .scalars import DUCK_NEGATORS, norm_sql, tokens_sql
from .transcripts import THRESHOLD, WINDOW


def opinion_assets(spark, sf):
    o = bind(spark, sf, "opinions")
    none = F.lit(None)
    anchor = F.struct(
        F.col("source_turn_id").alias("turn_id"), F.col("content").alias("quote"), none.cast("int").alias("char_start"),
        none.cast("int").alias("char_end"),
    ).cast(ANCHOR)
    temporal = F.struct(
        F.col("source_turn_id").alias("turn_start"), none.cast("string").alias("turn_end"), none.cast("string").alias("narrative_start"),
        none.cast("string").alias("narrative_end"), F.lit(False).alias("narrative_always"),
    )
    return o.select(
        "id", "seq", F.lit("opinion").alias("network"), F.lit("opinion").alias("kind"), "content", "viewpoint_holder",
        F.filter(F.array("entity"), lambda e: e != "").alias("entity_ids"), "relevance",
        F.struct(
            "source_turn_id", F.col("confidence").alias("confidence_score"), F.lit("inferred").alias("confidence_source"),
            F.array(anchor).alias("raw_quote_anchors"), temporal.alias("temporal_range"),
        ).alias("provenance"),
    )


def memory_assets(spark, sf):
    facts = bind(spark, sf, "opinion_facts").select("id", "seq", F.lit("world").alias("network"), F.lit("fact").alias("kind"), "content")
    return opinion_assets(spark, sf).unionByName(facts, allowMissingColumns=True)


CLASH = f""", ot AS (SELECT *, {tokens_sql('content')} AS t FROM opinions),
os AS (SELECT id, seq, viewpoint_holder, entity, list_has_any(t, {DUCK_NEGATORS}) AS neg,
 list_distinct(list_filter(t, lambda x: NOT list_contains({DUCK_NEGATORS}, x))) AS s FROM ot),
clash AS (SELECT a.id AS primary_id, b.id AS supporting_id, a.viewpoint_holder AS va, b.viewpoint_holder AS vb, a.seq AS sa, b.seq AS sb
 FROM os a JOIN os b ON a.seq < b.seq AND a.neg <> b.neg AND a.viewpoint_holder <> b.viewpoint_holder AND (a.entity = '' OR b.entity = '' OR a.entity = b.entity)
 WHERE len(list_intersect(a.s, b.s)) >= 0.6 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))))"""
CORR = f""", lf AS (SELECT {norm_sql('content')} AS k, arg_max(id, seq) AS fid, max(seq) AS fseq FROM opinion_facts GROUP BY 1),
corr AS (SELECT o.id AS primary_id, fid AS supporting_id, o.seq AS sa, fseq AS sb FROM opinions o JOIN lf ON {norm_sql('o.content')} = lf.k)"""
FINDINGS = CLASH + CORR + """, findings AS (SELECT 'contradiction' AS finding, primary_id, supporting_id, va || ' and ' || vb || ' disagree on the same claim.' AS rationale,
 CAST(0.6 AS DOUBLE) AS confidence, CAST(-0.1 AS DOUBLE) AS delta, 0 AS phase, sa, sb FROM clash
 UNION ALL SELECT 'corroboration', primary_id, supporting_id, 'Opinion confirmed by recorded fact.', 0.75, 0.1, 1, sa, sb FROM corr)"""
BOTH = "opinions opinion_facts"


@query("J6_contradiction_join", with_tables("opinions", CLASH + " SELECT primary_id, supporting_id, va AS primary_holder, vb AS supporting_holder FROM clash"))
def j6(spark, sf):
    out = reflect.contradiction_join(opinion_assets(spark, sf))
    return out.select("primary_id", "supporting_id", "primary_holder", "supporting_holder")


@query("J7_corroboration_join", with_tables(BOTH, CORR + " SELECT primary_id, supporting_id FROM corr"))
def j7(spark, sf):
    out = reflect.corroboration_join(opinion_assets(spark, sf), bind(spark, sf, "opinion_facts"))
    return out.select("primary_id", "supporting_id")


@query("X9_reflect", with_tables(BOTH, FINDINGS + " SELECT finding, primary_id, supporting_id, rationale, confidence, delta FROM findings"))
def x9(spark, sf):
    f = reflect.default_reflector(*reflect.reflection_inputs(memory_assets(spark, sf)))
    return f.select("finding", "primary_id", "supporting_id", "rationale", "confidence", "delta")


@query(
    "X10_reflection_assets",
    with_tables(BOTH, FINDINGS + """, ra AS (SELECT f.*, '[' || finding || '] ' || rationale AS content, o.entity, o.source_turn_id, substring(o.content, 1, 80) AS quote
 FROM findings f JOIN opinions o ON o.id = f.primary_id)
SELECT arg_min(content, {'p': phase, 'a': sa, 'b': sb}) AS content, entity, arg_min(source_turn_id, {'p': phase, 'a': sa, 'b': sb}) AS source_turn_id, max(confidence) AS confidence,
 count(*) - 1 AS relevance, count(DISTINCT source_turn_id || quote) AS witnesses FROM ra GROUP BY lower(content), entity"""),
)
def x10(spark, sf):
    assets = memory_assets(spark, sf)
    made = reflect.reflection_assets(reflect.reflect(assets, written=False, alike="rationale"), assets)
    # A reflection has one anchor.
    out = reconcile.dedup_atomic(made, written=False, repeating=False).assets
    return out.select(
        "content", F.array_join("entity_ids", ",").alias("entity"), F.col("provenance.source_turn_id").alias("source_turn_id"),
        F.col("provenance.confidence_score").alias("confidence"), "relevance", F.col("witness_count").alias("witnesses"),
    )


@query(
    "X11_apply_effects",
    with_tables(BOTH, FINDINGS + """, k AS (SELECT primary_id, count(*) FILTER (WHERE phase = 0) AS k, count(*) FILTER (WHERE phase = 1) AS c FROM findings GROUP BY 1),
r AS (SELECT o.id, o.confidence AS s, coalesce(k, 0) AS k, coalesce(c, 0) AS c FROM opinions o LEFT JOIN k ON k.primary_id = o.id),
v AS (SELECT *, CASE WHEN k = 0 THEN s ELSE greatest(0.05, least(0.99, s - 0.1 * k)) END AS v1 FROM r)
SELECT id, round(CASE WHEN c > 0 THEN least(0.99, v1 + 0.1) ELSE v1 END, 6) AS confidence, CASE WHEN k + c > 0 THEN 'derived' ELSE 'inferred' END AS source,
 CAST(least(k, ceil((s - 0.05) / 0.1)) + c AS BIGINT) AS changed FROM v"""),
)
def x11(spark, sf):
    assets = memory_assets(spark, sf)
    opinions, _ = reflect.reflection_inputs(assets)
    out = reflect.apply_effects(opinions, reflect.reflect(assets, written=False, alike="effect"))
    p = F.col("provenance")
    return out.select(
        "id", F.round(p["confidence_score"], 6).alias("confidence"), p["confidence_source"].alias("source"), "changed"
    )


@query(
    "E4_reflector",
    with_tables("opinions", """ SELECT id, relevance + CASE WHEN seq % 3 = 0 THEN 2 WHEN seq % 3 = 1 THEN -relevance ELSE 0 END AS relevance,
 CASE WHEN seq % 3 = 2 THEN 0 ELSE 1 END AS changed FROM opinions"""),
)
def e4(spark, sf):
    def own(opinions, facts):
        m = F.col("seq") % 3
        return opinions.select(
            F.lit(0).alias("phase"), F.col("seq").alias("primary_seq"), F.col("seq").alias("supporting_seq"), F.lit("note").alias("finding"),
            F.col("id").alias("primary_id"), F.col("id").alias("supporting_id"), F.lit("own").alias("rationale"), F.lit(0.5).alias("confidence"),
            F.when(m == 2, "note_only").otherwise("bump_relevance").alias("effect"), F.when(m == 0, F.lit(2.0)).otherwise(F.lit(-5.0)).alias("delta"),
        )

    assets = memory_assets(spark, sf)
    opinions, _ = reflect.reflection_inputs(assets)
    out = reflect.apply_effects(opinions, reflect.reflect(assets, own))
    return out.select("id", "relevance", "changed")


# --- explanations -------------------------------------------------------------


def summary_rows(spark, sf):
    return tr.summary_assets(tr.rolling_summary_windows(bind(spark, sf, "log"), THRESHOLD, WINDOW))


@query(
    "R12_anchor_sort",
    with_tables("turns", """ SELECT session_id, turn_index // 4 AS block, string_agg(turn_id, ',' ORDER BY CASE WHEN turn_index % 4 = 2 THEN 0 ELSE 1 END, turn_id) AS anchors FROM turns GROUP BY 1, 2"""),
)
def r12(spark, sf):
    turns = bind(spark, sf, "turns").withColumn("block", F.floor(F.col("turn_index") / 4).cast("int"))
    t = turns.groupBy("session_id", "block").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("turn_index")).alias("o"), "turn_id", "turn_index"))).alias("a")
    )
    source = F.filter("a", lambda x: x["turn_index"] % 4 == 2)
    src = F.coalesce(F.get(source, F.lit(0))["turn_id"], F.lit(""))
    ordered = F.transform(explain.anchor_sort(F.col("a"), src), lambda x: x["turn_id"])
    return t.select("session_id", "block", F.array_join(ordered, ",").alias("anchors"))


@query(
    "J13_anchor_turn_join",
    with_tables("story", FACTS + """ SELECT md5(turn_id || '|' || position) AS asset_id, CASE WHEN turn_index % 9 = 4 THEN 'gone' ELSE turn_id END AS turn_id, quote,
 CASE WHEN turn_index % 9 <> 4 THEN turn_index END AS turn_index, CASE WHEN turn_index % 9 <> 4 THEN turn_index % 5 <> 1 END AS in_place FROM facts"""),
)
def j13(spark, sf):
    a = extract.materialize(extract.anchor_guard(story_facts(spark, sf)))
    i = F.floor(F.col("seq") / extract.FACT_PLACES)
    p = F.col("provenance")
    moved = F.transform(
        p["raw_quote_anchors"],
        lambda x: x.withField("turn_id", F.when(i % 9 == 4, F.lit("gone")).otherwise(x["turn_id"])).withField(
            "char_end", F.when(i % 5 == 1, x["char_end"] - 1).otherwise(x["char_end"])
        ),
    )
    rows = explain.evidence_rows(a.withColumn("provenance", p.withField("raw_quote_anchors", moved)), story(spark, sf))
    return rows.select("asset_id", "turn_id", "quote", "turn_index", "in_place")


@query(
    "X12_explain_assets",
    with_tables("atomic cards_in log", """ SELECT id AS asset_id, CASE WHEN length(content) <= 80 THEN content ELSE substring(content, 1, 79) || '…' END AS headline,
 CAST(floor(confidence * 100 + 0.5) AS INTEGER) AS percent, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band,
 source_turn_id || ':' || quote AS anchors, 1 AS corroboration, 'Since ' || source_turn_id AS validity, tag AS tags FROM atomic
UNION ALL SELECT id, canonical_name || ' — ' || entity_type, CAST(floor(confidence * 100 + 0.5) AS INTEGER),
 CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END, source_turn_id || ':' || quote, 1, 'Since ' || source_turn_id, '' FROM cards_in"""),
)
def x12(spark, sf):
    rows = atomic_assets(spark, sf).unionByName(user_cards(spark, sf).drop("attributes"), allowMissingColumns=True)
    out = explain.explain_assets(rows).join(rows.select(F.col("id").alias("asset_id"), explain.validity(F.col("provenance")).alias("validity")), "asset_id")
    anchors = F.transform("anchors", lambda a: F.concat(a["turn_id"], F.lit(":"), a["quote"]))
    return out.select(
        "asset_id", "headline", F.col("confidence_percent").alias("percent"), F.col("confidence_band").alias("band"),
        F.array_join(anchors, "|").alias("anchors"), "corroboration", "validity", F.array_join("tags", ",").alias("tags"),
    )


@query(
    "X13_explain_attributes",
    with_tables("cards_in claims", """ SELECT c.id AS asset_id, k.key AS attribute_key, c.canonical_name || ': ' || k.key || ' = ' || k.value_json AS headline, k.confidence, k.quote
 FROM claims k JOIN cards_in c ON c.seq = k.seq"""),
)
def x13(spark, sf):
    out = explain.explain_attributes(user_cards(spark, sf))
    return out.select("asset_id", "attribute_key", "headline", F.col("confidence_score").alias("confidence"), F.col("anchors")[0]["quote"].alias("quote"))


# --- graph --------------------------------------------------------------------

PAIRS = """, known AS (SELECT * FROM graph_mentions WHERE entity_id IN (SELECT entity_id FROM cards)),
pairs AS (SELECT a.entity_id AS src, b.entity_id AS dst, a.asset_id, a.content FROM known a JOIN known b ON a.asset_id = b.asset_id AND a.entity_id < b.entity_id)"""


def pairs(spark, sf):
    return graph.cooccurrence_join(bind(spark, sf, "graph_mentions"), bind(spark, sf, "cards"))


@query("J8_cooccurrence_join", with_tables("graph_mentions cards", PAIRS + " SELECT src, dst, asset_id FROM pairs"))
def j8(spark, sf):
    return pairs(spark, sf).select("src", "dst", "asset_id")


@query(
    "A11_graph_edges",
    with_tables("graph_mentions cards", PAIRS + " SELECT src, dst, string_agg(content, '|' ORDER BY content) AS reasons FROM pairs GROUP BY 1, 2"),
)
def a11(spark, sf):
    return graph.graph_edges(pairs(spark, sf)).withColumn("reasons", F.array_join("reasons", "|"))


@query("A12_graph_nodes", with_tables("cards", " SELECT entity_id AS id, label, entity_type FROM cards"))
def a12(spark, sf):
    return graph.graph_nodes(bind(spark, sf, "cards"))


@query(
    "A13_graph_neighbors",
    with_tables("graph_mentions cards", PAIRS + """, e AS (SELECT src, dst, string_agg(content, ' · ' ORDER BY content) AS reasons FROM pairs GROUP BY 1, 2)
SELECT id, neighbor, c.label, c.entity_type, reasons FROM (SELECT src AS id, dst AS neighbor, reasons FROM e UNION ALL SELECT dst, src, reasons FROM e)
JOIN cards c ON c.entity_id = neighbor"""),
)
def a13(spark, sf):
    out = graph.graph_neighbors(graph.graph_edges(pairs(spark, sf)), graph.graph_nodes(bind(spark, sf, "cards")))
    return out.select("id", "neighbor", "label", "entity_type", "reasons")


# --- extension points ---------------------------------------------------------


@query(
    "E1_extractor",
    with_tables("story", """ SELECT turn_id, CAST(i - 1 AS INTEGER) AS position, s || '.' AS content FROM (
 SELECT turn_id, unnest(string_split(rtrim(content, '.'), '. ')) AS s, generate_subscripts(string_split(rtrim(content, '.'), '. '), 1) AS i FROM story)"""),
)
def e1(spark, sf):
    def sentences(content):
        return [
            {"type": "atomic", "kind": "fact", "network": "observation", "content": s + ".", "quote": s + ".", "confidence": 0.5}
            for s in content.rstrip(".").split(". ")
        ]

    facts = extract.explode_facts(extract.map_extractor(sentences)(story(spark, sf)))
    return extract.anchor_guard(facts).select("turn_id", "position", "fact.content")


@query(
    "E2_embedder",
    with_tables("turns", f" SELECT turn_id, 'own' AS model, round(length(content) / 10.0, 6) AS x, round(len({tokens_sql('content')}) / 1.0, 6) AS y FROM turns"
                .replace("/ 10.0", "/ CAST(10 AS DOUBLE)").replace("/ 1.0", "/ CAST(1 AS DOUBLE)")),
)
def e2(spark, sf):
    from mnemospark.functions.text import tokenize

    own = lambda c: F.array(F.length(c) / 10, F.size(tokenize(c)).cast("double"))
    t = bind(spark, sf, "turns").withColumn("kind", F.lit("lore"))
    out = extract.embed_lore(t, own, "own")
    return out.select("turn_id", F.col("embedding_model").alias("model"), F.round(F.col("embedding")[0], 6).alias("x"), F.round(F.col("embedding")[1], 6).alias("y"))

