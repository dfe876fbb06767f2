"""Column expressions over conversation turns and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.functions import scoring, text, vector

from .bindings import base, bind, with_tables
from .registry import query

# The white space class again, as RE2 text in a SQL literal.
WS = text.WHITE_SPACE
DUCK_NORM = f"regexp_replace(lower(regexp_replace({{0}}, '^{WS}+|{WS}+$', '', 'g')), '{WS}+', ' ', 'g')"
DUCK_TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9'']+'), lambda t: t <> '')"
DUCK_EST = "CAST(ceil(length({0}) / 4.0) AS BIGINT)"
DUCK_NEGATORS = "['not', 'isn''t', 'doesn''t', 'never', 'no', 'wasn''t']"
DUCK_UNITS = "list_transform(regexp_extract_all({0}, '(?s).'), lambda c: CAST(unicode(c) AS BIGINT))"
DUCK_FNV = (
    "list_reduce({units}, lambda h, x: (xor(h, x) * 16777619) % 4294967296, CAST(2166136261 AS BIGINT))"
).replace("{units}", DUCK_UNITS)


def norm_sql(expr: str) -> str:
    return DUCK_NORM.replace("{0}", expr)


def tokens_sql(expr: str) -> str:
    return DUCK_TOKENS.replace("{0}", expr)


def est_sql(expr: str) -> str:
    return DUCK_EST.replace("{0}", expr)


def fnv_sql(expr: str) -> str:
    return DUCK_FNV.replace("{0}", expr)


@query(
    "F1_tokenize",
    f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, '|')) AS tokens_md5 "
    f"FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)",
)
def f1(spark, sf):
    t = base(spark, sf, "documents").select("doc_id", text.tokenize("text").alias("t"))
    return t.select(
        "doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", "|")).alias("tokens_md5")
    )


@query("F2_normalize", f"SELECT doc_id, {norm_sql('text')} AS norm FROM documents")
def f2(spark, sf):
    return base(spark, sf, "documents").select("doc_id", text.normalize("text").alias("norm"))


@query("F3_estimate_tokens", f"SELECT doc_id, {est_sql('text')} AS tokens FROM documents")
def f3(spark, sf):
    return base(spark, sf, "documents").select("doc_id", text.estimate_tokens("text").alias("tokens"))


@query(
    "F4_fnv1a",
    with_tables(
        "turns",
        f"SELECT turn_id, h AS hash, lower(printf('%x', h)) AS content_key FROM "
        f"(SELECT turn_id, {fnv_sql('content')} AS h FROM turns)",
    ),
)
def f4(spark, sf):
    t = bind(spark, sf, "turns")
    return t.select("turn_id", text.fnv1a("content").alias("hash"), text.content_key("content").alias("content_key"))


@query(
    "F5_hash_embed",
    with_tables(
        "turns",
        """, chars AS (SELECT turn_id, unnest(u) AS unit, generate_subscripts(u, 1) AS pos FROM (
  SELECT turn_id, list_transform(regexp_extract_all(content, '(?s).'), lambda c: CAST(unicode(c) AS BIGINT)) AS u
  FROM turns)), steps AS (
  SELECT turn_id, 0 AS pos, CAST(2166136261 AS BIGINT) AS h FROM turns
  UNION ALL SELECT s.turn_id, s.pos + 1, (xor(s.h, c.unit) * 16777619) % 4294967296
  FROM steps s JOIN chars c ON c.turn_id = s.turn_id AND c.pos = s.pos + 1)
SELECT turn_id, CAST(h % 16 AS INTEGER) AS slot, round(sum((h & 255) / 127.5 - 1), 6) AS amount
FROM steps WHERE pos > 0 GROUP BY 1, 2""",
        recursive=True,
    ),
)
def f5(spark, sf):
    embed = vector.hash_embedder()
    t = bind(spark, sf, "turns").select("turn_id", F.posexplode(embed("content")).alias("slot", "amount"))
    return t.filter("amount <> 0").select("turn_id", "slot", F.round("amount", 6).alias("amount"))


@query(
    "F6_cosine",
    """SELECT a.vec_id, round(CASE WHEN list_sum(list_transform(a.embedding, lambda x: x * x)) = 0 THEN 0
 ELSE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) END, 6) AS score
 FROM embeddings a JOIN embeddings b ON b.vec_id = a.label""",
)
def f6(spark, sf):
    e = base(spark, sf, "embeddings")
    other = e.select(F.col("vec_id").alias("label_id"), F.col("embedding").alias("other"))
    return e.join(other, e["label"] == F.col("label_id")).select(
        "vec_id", F.round(vector.cosine(F.col("embedding"), F.col("other")), 6).alias("score")
    )


@query(
    "F7_jaccard",
    with_tables(
        "turns",
        f""", t AS (SELECT session_id, turn_index, turn_id, {tokens_sql('content')} AS t FROM turns)
SELECT a.turn_id, round(CASE WHEN len(list_distinct(list_concat(a.t, b.t))) = 0 THEN 0
 ELSE len(list_intersect(list_distinct(a.t), list_distinct(b.t))) / CAST(len(list_distinct(list_concat(a.t, b.t)))
 AS DOUBLE) END, 6) AS score
FROM t a JOIN t b ON a.session_id = b.session_id AND b.turn_index = a.turn_index + 1""",
    ),
)
def f7(spark, sf):
    t = bind(spark, sf, "turns").select("session_id", "turn_index", "turn_id", text.tokenize("content").alias("t"))
    nxt = t.select("session_id", (F.col("turn_index") - 1).alias("turn_index"), F.col("t").alias("n"))
    return t.join(nxt, ["session_id", "turn_index"]).select(
        "turn_id", F.round(text.jaccard(F.col("t"), F.col("n")), 6).alias("score")
    )


@query(
    "F8_is_negated",
    with_tables(
        "opinions",
        f"SELECT id, list_has_any({tokens_sql('content')}, {DUCK_NEGATORS}) AS negated FROM opinions "
        f"UNION ALL SELECT 'doc' || doc_id, list_has_any({tokens_sql('text')}, {DUCK_NEGATORS}) FROM documents",
    ),
)
def f8(spark, sf):
    o = bind(spark, sf, "opinions").select("id", "content")
    d = base(spark, sf, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("id"), F.col("text").alias("content"))
    return o.unionAll(d).select("id", text.is_negated(text.tokenize("content")).alias("negated"))


@query(
    "F9_quote_span",
    with_tables(
        "anchored",
        "SELECT doc_id, CASE WHEN quote <> '' AND instr(content, quote) > 0 THEN "
        "CAST(instr(content, quote) - 1 AS INTEGER) END AS char_start, "
        "CASE WHEN quote <> '' AND instr(content, quote) > 0 THEN "
        "CAST(instr(content, quote) - 1 + length(quote) AS INTEGER) END AS char_end FROM anchored",
    ),
)
def f9(spark, sf):
    a = bind(spark, sf, "anchored").withColumn("span", text.quote_span("content", "quote"))
    return a.select("doc_id", "span.char_start", "span.char_end")


@query(
    "F10_stub_summary",
    with_tables(
        "turns",
        f""", h AS (SELECT *, regexp_extract(regexp_replace(content, '^{WS}+|{WS}+$', '', 'g'), '^[a-zA-Z0-9_'']+', 0) AS w
FROM turns)
SELECT session_id, turn_index // 6 AS block, '[' || min_by(turn_id, turn_index) || '..' || max_by(turn_id, turn_index) || '] ' || count(*) ||
 CASE WHEN count(*) = 1 THEN ' turn: ' ELSE ' turns: ' END ||
 coalesce(string_agg(w, ', ' ORDER BY turn_index) FILTER (WHERE w <> ''), '') AS summary
FROM h GROUP BY session_id, turn_index // 6""",
    ),
)
def f10(spark, sf):
    t = bind(spark, sf, "turns").withColumn("block", F.floor(F.col("turn_index") / 6).cast("int"))
    window = F.array_sort(F.collect_list(F.struct("turn_index", "turn_id", "content")))
    return t.groupBy("session_id", "block").agg(text.stub_summary(window).alias("summary"))


@query(
    "F11_capitalized_tokens",
    "SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\b[A-Z][a-zA-Z''-]*\\b'))), '|')"
    " AS names FROM documents",
)
def f11(spark, sf):
    d = base(spark, sf, "documents")
    return d.select("doc_id", F.array_join(F.sort_array(text.capitalized_tokens("text")), "|").alias("names"))


@query(
    "F12_headline",
    with_tables(
        "atomic cards_in lore",
        "SELECT id, CASE WHEN length(content) <= 80 THEN content ELSE substring(content, 1, 79) || '…' END AS headline "
        "FROM atomic UNION ALL SELECT id, canonical_name || ' — ' || entity_type FROM cards_in "
        "UNION ALL SELECT id, CASE WHEN seq % 2 = 0 THEN tag ELSE content END FROM lore",
    ),
)
def f12(spark, sf):
    missing = F.lit(None).cast("string")
    atomic = bind(spark, sf, "atomic").select(
        "id", "kind", "content", missing.alias("e"), missing.alias("n"), missing.alias("y"), missing.alias("t")
    )
    cards = bind(spark, sf, "cards_in").select(
        "id", F.lit("entity"), "content", "entity_id", "canonical_name", "entity_type", missing
    )
    title = F.when(F.col("seq") % 2 == 0, F.col("tag"))
    lore = bind(spark, sf, "lore").select("id", F.lit("lore"), "content", missing, missing, missing, title)
    return atomic.unionAll(cards).unionAll(lore).select("id", text.headline("kind", "content", "e", "n", "y", "t").alias("headline"))


@query(
    "F13_display_value",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '—' WHEN 1 THEN event_type WHEN 2 THEN
 CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) ELSE props END AS shown FROM events""",
)
def f13(spark, sf):
    e = base(spark, sf, "events")
    m = F.col("event_id") % 4
    value = (
        F.when(m == 0, F.lit("null"))
        .when(m == 1, F.concat(F.lit('"'), "event_type", F.lit('"')))
        .when(m == 2, F.floor("value").cast("string"))
        .otherwise(F.col("props"))
    )
    return e.select("event_id", text.display_value(value).alias("shown"))


@query(
    "F14_disposition",
    """SELECT c_custkey, round(0.6 * s, 6) AS floor, greatest(1, CAST(ceil(4 * s) AS INTEGER)) AS mentions,
 round(1 + 2 * s, 6) AS boost
 FROM (SELECT c_custkey, least(1.0, greatest(0.0, c_acctbal / 9000)) AS s FROM customer)""",
)
def f14(spark, sf):
    s = F.col("c_acctbal") / 9000
    return base(spark, sf, "customer").select(
        "c_custkey",
        F.round(scoring.confidence_floor(s), 6).alias("floor"),
        scoring.mentions_required(s).alias("mentions"),
        F.round(scoring.world_boost(s), 6).alias("boost"),
    )


@query(
    "F15_confidence_band",
    with_tables(
        "atomic",
        "SELECT id, CAST(floor(confidence * 100 + 0.5) AS INTEGER) AS percent, CASE WHEN confidence >= 0.8 THEN 'high' "
        "WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM atomic",
    ),
)
def f15(spark, sf):
    c = F.col("confidence")
    return bind(spark, sf, "atomic").select(
        "id", scoring.confidence_percent(c).alias("percent"), scoring.confidence_band(c).alias("band")
    )


@query(
    "F16_relevance_delta",
    with_tables("opinions", "SELECT id, greatest(0, relevance + (seq % 5) - 3) AS relevance FROM opinions"),
)
def f16(spark, sf):
    return bind(spark, sf, "opinions").select(
        "id", scoring.add_relevance(F.col("relevance"), F.col("seq") % 5 - 3).alias("relevance")
    )


@query("F17_stable_id", with_tables("turns", "SELECT turn_id, md5(session_id || '|' || turn_id) AS id FROM turns"))
def f17(spark, sf):
    return bind(spark, sf, "turns").select("turn_id", text.stable_id("session_id", "turn_id").alias("id"))
