"""Ranking channels, fusion, recall and the memory context."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.operators import mentions as names_of
from mnemospark.operators import retrieve, select
from mnemospark.plans import recall

from .bindings import base, bind, with_tables
from .registry import query
from .scalars import est_sql, tokens_sql

BUDGET = 400


def bm25_ctes(docs: str, body: str = "content", k: int = 50) -> str:
    return f""", toks AS MATERIALIZED (SELECT id, {tokens_sql(body)} AS t FROM {docs}),
post AS (SELECT term, id, dl, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY 1, 2, 3),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
tot AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({tokens_sql('query')}) AS term FROM queries) GROUP BY 1, 2),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM (
 SELECT query_id, id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
 FROM post JOIN dfs USING (term) JOIN qt USING (term), tot GROUP BY 1, 2)) WHERE rank < {k})"""


VECTOR_CTES = """, vk AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank
 FROM (SELECT query_id, id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(vector AS DOUBLE[])), 12) AS score
 FROM query_vectors, lore {where})) WHERE rank < 50)"""


def mention_ctes(texts: str, id: str, body: str) -> str:
    """Every name at every place it stands in a text, then claims in order."""
    return f""", nm AS (SELECT lower(name) AS name, min(reg_seq) AS reg FROM names WHERE name <> '' GROUP BY 1),
tx AS (SELECT {id} AS tid, lower({body}) AS low FROM {texts}),
pr AS (SELECT tid, name, reg, low FROM tx JOIN nm ON contains(low, name)),
cut AS (SELECT tid, name, reg, low, unnest(p) AS part, generate_subscripts(p, 1) AS k, len(p) AS np FROM (
 SELECT *, string_split(low, name) AS p FROM pr)),
oc AS (SELECT tid, name, reg, low, k, np, CAST(sum(length(part)) OVER (PARTITION BY tid, name ORDER BY k) AS BIGINT) + (k - 1) * length(name) + 1 AS pos FROM cut),
hit AS (SELECT tid, name, reg, pos AS s, pos + length(name) AS e FROM oc WHERE k < np
 AND NOT regexp_matches(CASE WHEN pos = 1 THEN '' ELSE substring(low, pos - 1, 1) END, '[a-z0-9''-]')
 AND NOT regexp_matches(substring(low, pos + length(name), 1), '[a-z0-9''-]')),
ord AS (SELECT tid, list({{'name': name, 'reg': reg, 's': s, 'e': e}} ORDER BY e - s DESC, reg, s) AS l FROM hit GROUP BY tid),
cl AS (SELECT tid, list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda c: c.s < x[1].e AND x[1].s < c.e)) > 0
 THEN acc ELSE list_concat(acc, x) END, l[1:1]) AS c FROM (SELECT tid, list_transform(l, lambda x: [x]) AS l0, l FROM ord)),
sp AS (SELECT tid, unnest(c, recursive := true) FROM cl),
men AS (SELECT tid, entity_id, row_number() OVER (PARTITION BY tid ORDER BY o, entity_id) - 1 AS mention_rank FROM (
 SELECT tid, entity_id, min([s0.s - s0.e, s0.reg, s0.s, n.reg_seq]) AS o FROM sp s0 JOIN names n ON lower(n.name) = s0.name GROUP BY 1, 2))""".replace(
        "list_reduce(l, lambda acc, x:", "list_reduce(l0, lambda acc, x:"
    )


RECENT_CTE = """, rec AS (SELECT id, row_number() OVER (ORDER BY recency_key DESC, id) - 1 AS rank FROM corpus QUALIFY rank < 50),
chron AS (SELECT query_id, id, rank FROM queries, rec)"""
ENTITY_CTE = """, ent AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY m, id) - 1 AS rank FROM (
 SELECT tid AS query_id, c.id, min(mention_rank) AS m FROM men JOIN corpus c ON c.entity = men.entity_id GROUP BY 1, 2)) WHERE rank < 50)"""


def fused_ctes(where: str = "", channels=("vector", "bm25", "entity", "chronological")) -> str:
    source = {"vector": "vk", "bm25": "bm", "entity": "ent", "chronological": "chron"}
    rows = " UNION ALL ".join(f"SELECT query_id, id, rank, '{c}' AS channel FROM {source[c]}" for c in channels)
    return (
        bm25_ctes("corpus") + VECTOR_CTES.replace("{where}", where) + mention_ctes("queries", "query_id", "query")
        + ENTITY_CTE + RECENT_CTE
        + f""", fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank + 1)), 12) AS score,
 array_to_string(list_sort(list(channel)), ',') AS channels FROM ({rows}) GROUP BY 1, 2)"""
    )


def budget_ctes(hits: str, budget: int, k: int) -> str:
    """Greedy skip-and-go-on over (query_id, id, score, tokens) of ``hits``."""
    return f""", ranked AS (SELECT query_id, list({{'id': id, 'tokens': tokens, 'spent': CAST(0 AS BIGINT), 'n': 0, 'took': false}}
 ORDER BY score DESC, id) AS l FROM {hits} GROUP BY 1),
walk AS (SELECT r.query_id, 0 AS i, CAST(0 AS BIGINT) AS spent, 0 AS n, false AS took, CAST(NULL AS VARCHAR) AS id FROM ranked r
 UNION ALL SELECT w.query_id, w.i + 1, w.spent + CASE WHEN w.n < {k} AND w.spent + r.l[w.i + 1].tokens <= {budget} THEN r.l[w.i + 1].tokens ELSE 0 END,
 w.n + CASE WHEN w.n < {k} AND w.spent + r.l[w.i + 1].tokens <= {budget} THEN 1 ELSE 0 END,
 w.n < {k} AND w.spent + r.l[w.i + 1].tokens <= {budget}, r.l[w.i + 1].id
 FROM walk w JOIN ranked r USING (query_id) WHERE w.i < len(r.l)),
taken AS (SELECT query_id, id, n AS position FROM walk WHERE took)"""


def corpus_docs(spark, sf):
    return bind(spark, sf, "corpus").withColumn("body", F.col("content"))


def memory(spark, sf):
    c = corpus_docs(spark, sf)
    refs = c.filter("entity IS NOT NULL").select(F.col("id").alias("asset_id"), F.col("entity").alias("entity_id"))
    return recall.MemoryTables(c.drop("entity"), refs, bind(spark, sf, "names").filter("name <> ''"), bind(spark, sf, "lore"))


def full_queries(spark, sf):
    return bind(spark, sf, "queries").join(bind(spark, sf, "query_vectors"), "query_id", "left")


@query(
    "A7_bm25_stats",
    with_tables("corpus queries", bm25_ctes("corpus") + """
SELECT 'term' AS what, term AS key, CAST(df AS BIGINT) AS n, CAST(sum(tf) AS BIGINT) AS total FROM dfs JOIN post USING (term) GROUP BY 1, 2, 3
UNION ALL SELECT 'docs', 'corpus', n, CAST(round(avgdl * n) AS BIGINT) FROM tot UNION ALL SELECT 'doc', id, len(t), len(list_distinct(t)) FROM toks"""),
)
def a7(spark, sf):
    docs = corpus_docs(spark, sf)
    postings, df, totals = retrieve.bm25_stats(docs, text="body")
    terms = postings.groupBy("term").agg(F.sum("tf").alias("total")).join(df, "term")
    per_doc = retrieve.bm25_docs(docs, text="body").join(
        postings.groupBy("id").agg(F.count(F.lit(1)).alias("u")), "id", "left"
    )
    return (
        terms.select(F.lit("term").alias("what"), F.col("term").alias("key"), F.col("df").alias("n"), "total")
        .unionAll(totals.select(F.lit("docs"), F.lit("corpus"), "n_docs", "total_len"))
        .unionAll(per_doc.select(F.lit("doc"), "id", "doc_len", F.coalesce("u", F.lit(0))))
    )


@query(
    "R1_bm25_search",
    with_tables("corpus queries", bm25_ctes("(SELECT doc_id AS id, text AS content FROM documents)")
                + " SELECT query_id, id, round(score, 6) AS score, rank FROM bm"),
)
def r1(spark, sf):
    docs = base(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    hits = retrieve.bm25_search(docs, bind(spark, sf, "queries"))
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(
    "R2_vector_topk",
    with_tables("lore all_vectors", VECTOR_CTES.replace("query_vectors", "all_vectors").replace("{where}", "WHERE network IN ('world', 'opinion')")
                + " SELECT query_id, id, round(score, 6) AS score, rank FROM vk"),
)
def r2(spark, sf):
    lore = retrieve.scope_filter(bind(spark, sf, "lore"), ["world", "opinion"])
    hits = retrieve.vector_topk(lore, bind(spark, sf, "all_vectors"))
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(
    "J4_mention_join",
    with_tables("names", mention_ctes("documents", "doc_id", "text") + " SELECT tid AS id, entity_id, mention_rank FROM men"),
)
def j4(spark, sf):
    docs = base(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return names_of.mentions(docs, bind(spark, sf, "names").filter("name <> ''"))


@query(
    "J5_name_lookup",
    with_tables("cards_in", """, last AS (SELECT * FROM cards_in QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY seq DESC) = 1),
nm AS (SELECT lower(canonical_name) AS name, entity_id FROM last UNION SELECT lower(alias), entity_id FROM last)
SELECT w.lookup, entity_id FROM (SELECT DISTINCT upper('user' || (user_id * 3)) AS lookup FROM events UNION SELECT DISTINCT 'U' || (event_id % 9) FROM events) w
JOIN nm ON nm.name = lower(w.lookup)"""),
)
def j5(spark, sf):
    cards = bind(spark, sf, "cards_in").withColumn("aliases", F.array("alias"))
    e = base(spark, sf, "events")
    wanted = e.select(F.upper(F.concat(F.lit("user"), F.col("user_id") * 3)).alias("lookup")).union(
        e.select(F.concat(F.lit("U"), F.col("event_id") % 9))
    )
    return names_of.name_lookup(names_of.name_index(cards), wanted.distinct())


@query(
    "R3_entity_channel",
    with_tables("queries names corpus", mention_ctes("queries", "query_id", "query") + ENTITY_CTE + " SELECT * FROM ent"),
)
def r3(spark, sf):
    m = memory(spark, sf)
    said = names_of.mentions(bind(spark, sf, "queries"), m.names, id="query_id", text="query")
    return retrieve.entity_channel(said.withColumnRenamed("id", "query_id"), m.refs)


@query("R4_recency_channel", with_tables("queries corpus", RECENT_CTE + " SELECT * FROM chron"))
def r4(spark, sf):
    return retrieve.recency_channel(bind(spark, sf, "queries"), corpus_docs(spark, sf))


ALL_TABLES = "corpus queries query_vectors lore names"


def fuse_parts(spark, sf):
    m, q = memory(spark, sf), full_queries(spark, sf)
    said = names_of.mentions(q, m.names, id="query_id", text="query").withColumnRenamed("id", "query_id")
    return {
        "vector": retrieve.vector_topk(m.lore, q.filter("vector IS NOT NULL").select("query_id", "vector")),
        "bm25": retrieve.bm25_search(m.assets, q, text="body"),
        "entity": retrieve.entity_channel(said, m.refs),
        "chronological": retrieve.recency_channel(q, m.assets),
    }


@query(
    "R5_rrf_fuse",
    with_tables(ALL_TABLES, fused_ctes() + " SELECT query_id, id, round(score, 6) AS score, channels FROM fused"),
)
def r5(spark, sf):
    fused = retrieve.rrf_fuse(fuse_parts(spark, sf))
    return fused.select("query_id", "id", F.round("score", 6).alias("score"), F.array_join("channels", ",").alias("channels"))


@query(
    "J3_recall_hydrate",
    with_tables("corpus queries", bm25_ctes("corpus") + """
SELECT query_id, id, kind, network, md5(content) AS content_md5 FROM bm JOIN corpus USING (id) WHERE NOT (kind = 'lore' AND network = 'world')"""),
)
def j3(spark, sf):
    c = corpus_docs(spark, sf)
    structured = c.filter("kind <> 'lore'")
    lore = c.filter("kind = 'lore' AND network <> 'world'")
    hits = retrieve.bm25_search(c, bind(spark, sf, "queries"), text="body").select("query_id", "id")
    found = retrieve.hydrate(hits, structured.unionByName(lore, allowMissingColumns=True))
    return found.select("query_id", "id", "kind", "network", F.md5("content").alias("content_md5"))


@query(
    "R6_scope_filter",
    with_tables(ALL_TABLES, fused_ctes() + """ SELECT 'network' AS scope, query_id, id FROM fused JOIN corpus USING (id) WHERE network IN ('world', 'experience')
UNION ALL SELECT 'holder', query_id, id FROM fused JOIN corpus USING (id) WHERE viewpoint_holder = 'holder7'"""),
)
def r6(spark, sf):
    hits = retrieve.hydrate(retrieve.rrf_fuse(fuse_parts(spark, sf)), corpus_docs(spark, sf))
    a = retrieve.scope_filter(hits, network=["world", "experience"])
    b = retrieve.scope_filter(hits, viewpoint_holder="holder7")
    return a.select(F.lit("network").alias("scope"), "query_id", "id").unionAll(b.select(F.lit("holder"), "query_id", "id"))


@query(
    "R7_literalism_boost",
    with_tables(ALL_TABLES, fused_ctes() + """ SELECT query_id, id, round(score * CASE WHEN network = 'world' THEN
 CASE WHEN query_id % 2 = 0 THEN 2.0 ELSE 1.5 END ELSE 1 END, 6) AS score FROM fused JOIN corpus USING (id)"""),
)
def r7(spark, sf):
    hits = retrieve.hydrate(retrieve.rrf_fuse(fuse_parts(spark, sf)), corpus_docs(spark, sf))
    hits = hits.withColumn("own", F.when(F.col("query_id") % 2 == 0, F.lit(0.5)))
    out = retrieve.literalism_boost(hits, 0.25, override="own")
    return out.select("query_id", "id", F.round("score", 6).alias("score"))


@query(
    "R8_token_budget",
    with_tables("corpus queries", bm25_ctes("corpus")
                + f", hits AS (SELECT query_id, id, score, {est_sql('content')} AS tokens FROM bm JOIN corpus USING (id))"
                + budget_ctes("hits", BUDGET, 5) + " SELECT query_id, id, position FROM taken", recursive=True),
)
def r8(spark, sf):
    c = corpus_docs(spark, sf)
    hits = retrieve.bm25_search(c, bind(spark, sf, "queries"), text="body").drop("rank")
    hits = retrieve.hydrate(hits, retrieve.with_tokens(c).select("id", "tokens"))
    return retrieve.token_budget(hits, BUDGET, 5).select("query_id", "id", "position")


@query(
    "R9_channel_toggles",
    with_tables(ALL_TABLES, fused_ctes(channels=("bm25", "entity"))
                + " SELECT query_id, id, round(score, 6) AS score, channels FROM fused JOIN corpus USING (id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20"),
)
def r9(spark, sf):
    q = bind(spark, sf, "queries")
    out = recall.fusion_recall(memory(spark, sf), q, k=20, channels=("bm25", "entity"))
    return out.select("query_id", "id", F.round("score", 6).alias("score"), F.array_join("channels", ",").alias("channels"))


RECALL_HITS = f""", hits AS (SELECT query_id, id, CASE WHEN network = 'world' THEN round(score * 1.5, 12) ELSE score END AS score, channels, kind, content,
 {est_sql('content')} AS tokens FROM fused JOIN corpus USING (id) WHERE network IN ('world', 'observation'))"""


@query(
    "R10_fusion_recall",
    with_tables(ALL_TABLES, fused_ctes("WHERE network IN ('world', 'observation')") + RECALL_HITS + budget_ctes("hits", BUDGET, 10)
                + " SELECT query_id, id, round(score, 6) AS score, channels, tokens, position FROM taken JOIN hits USING (query_id, id)", recursive=True),
)
def r10(spark, sf):
    out = recall.fusion_recall(
        memory(spark, sf), full_queries(spark, sf), k=10, budget=BUDGET, network=["world", "observation"], literalism=0.25
    )
    return out.select(
        "query_id", "id", F.round("score", 6).alias("score"), F.array_join("channels", ",").alias("channels"), "tokens", "position"
    )


def context_inputs(spark, sf):
    """A summary per turn, and one query per benchmark text in some session."""
    t = bind(spark, sf, "turns")
    summaries = t.select(
        F.concat(F.lit("sum:"), "turn_id").alias("id"),
        F.when(F.col("turn_index") % 2 == 1, F.col("turn_id")).alias("turn_end"),
        F.when(F.col("session_id") % 10 == 3, F.lit("gone")).otherwise(F.col("turn_id")).alias("source_turn_id"),
        F.concat(F.lit(" so far "), F.col("content")).alias("content"),
    )
    q = full_queries(spark, sf).withColumn("session_id", F.col("query_id") % 50)
    q = q.withColumn("query", F.when(F.col("query_id") % 9 == 4, F.lit("  ")).otherwise(F.col("query")))
    return summaries, t, q


SUMMARY_CTES = """, sm AS (SELECT 'sum:' || turn_id AS id, CASE WHEN turn_index % 2 = 1 THEN turn_id
 WHEN session_id % 10 = 3 THEN 'gone' ELSE turn_id END AS at, ' so far ' || content AS content FROM turns),
pl AS (SELECT sm.id, sm.content, t.session_id, t.turn_index AS pos FROM sm JOIN turns t ON t.turn_id = sm.at),
last3 AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos, id) AS place FROM (
 SELECT * FROM pl QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY pos DESC, id DESC) <= 3))"""


@query("J12_summary_position_join", with_tables("turns", SUMMARY_CTES + " SELECT id, session_id, pos FROM pl"))
def j12(spark, sf):
    summaries, turns, _ = context_inputs(spark, sf)
    return recall.summary_positions(summaries, turns).select("id", "session_id", "pos")


@query("W12_recent_summaries", with_tables("turns", SUMMARY_CTES + " SELECT session_id, id, pos, place FROM last3"))
def w12(spark, sf):
    summaries, turns, _ = context_inputs(spark, sf)
    return recall.recent_summaries(recall.summary_positions(summaries, turns)).select("session_id", "id", "pos", "place")


CONTEXT_SQL = (
    fused_ctes().replace("FROM queries)", "FROM asked)").replace("FROM queries, rec", "FROM asked, rec")
    .replace("FROM query_vectors, lore", "FROM query_vectors JOIN asked USING (query_id), lore")
    .replace("FROM queries)", "FROM asked)")
)


@query(
    "R13_memory_context",
    with_tables(ALL_TABLES + " turns", SUMMARY_CTES + """, asked AS (SELECT * FROM queries WHERE query_id % 9 <> 4 AND trim(query) <> '')"""
                + CONTEXT_SQL.replace("tx AS (SELECT query_id AS tid, lower(query) AS low FROM queries)", "tx AS (SELECT query_id AS tid, lower(query) AS low FROM asked)")
                + f", hits AS (SELECT query_id, id, score, content, {est_sql('content')} AS tokens FROM fused JOIN corpus USING (id))"
                + budget_ctes("hits", 2000, 10)
                + """, story AS (SELECT query_id, '## Story so far' || chr(10) || chr(10) || string_agg(trim(content), chr(10) || chr(10) ORDER BY place) AS story
 FROM queries JOIN last3 ON session_id = query_id % 50 GROUP BY 1),
bul AS (SELECT query_id, '## Relevant memories' || chr(10) || chr(10) || string_agg('- ' || trim(content, chr(10) || ' ' || chr(9) || chr(13)), chr(10) ORDER BY position) AS bullets FROM taken JOIN hits USING (query_id, id) GROUP BY 1),
blk AS (SELECT q.query_id, '# Memory context' || chr(10) || chr(10) || concat_ws(chr(10) || chr(10), story, bullets) AS block, story IS NULL AND bullets IS NULL AS nothing
 FROM queries q LEFT JOIN story USING (query_id) LEFT JOIN bul USING (query_id)),
ln AS (SELECT query_id, nothing, block, string_split(block, chr(10)) AS l FROM blk),
fit AS (SELECT *, coalesce(list_max(list_filter(range(1, len(l) + 1), lambda k: ceil(length(array_to_string(l[1:k], chr(10))) / 4.0) <= 2000)), 1) AS keep FROM ln)
SELECT query_id, CASE WHEN NOT nothing THEN array_to_string(l[1:keep], chr(10)) END AS block FROM fit""", recursive=True),
)
def r13(spark, sf):
    summaries, turns, q = context_inputs(spark, sf)
    return recall.memory_context(memory(spark, sf), summaries, turns, q)


@query(
    "R14_trim_lines",
    """WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents), n AS (SELECT *,
list_filter(range(1, len(l) + 1), lambda k: ceil((list_sum(list_transform(l[1:k], lambda x: length(x))) + k - 1) / 4.0) <= 100) AS fit FROM l)
SELECT doc_id, CASE WHEN ceil(length(text) / 4.0) <= 100 THEN text ELSE array_to_string(l[1:greatest(1, len(fit))], chr(10)) END AS trimmed FROM n""",
)
def r14(spark, sf):
    return base(spark, sf, "documents").select("doc_id", recall.trim_lines(F.col("text"), 100).alias("trimmed"))


@query(
    "U3_recalled_except_summaries",
    with_tables("corpus queries turns", SUMMARY_CTES + bm25_ctes("corpus") + """ SELECT query_id, id FROM bm
WHERE NOT EXISTS (SELECT 1 FROM last3 WHERE session_id = query_id AND 'd' || lpad(CAST(pos * 100 + session_id AS VARCHAR), 12, '0') = bm.id)"""),
)
def u3(spark, sf):
    summaries, turns, _ = context_inputs(spark, sf)
    told = recall.recent_summaries(recall.summary_positions(summaries, turns))
    doc = F.concat(F.lit("d"), F.lpad((F.col("pos") * 100 + F.col("session_id")).cast("string"), 12, "0"))
    shown = told.select(F.col("session_id").alias("query_id"), doc.alias("id"))
    hits = retrieve.bm25_search(corpus_docs(spark, sf), bind(spark, sf, "queries"), text="body")
    return select.recalled_except_summaries(hits.select("query_id", "id"), shown)
