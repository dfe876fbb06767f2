"""Streaming queries, run to their end over tables cut into several files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.functions import vector
from mnemospark.operators import extract, retrieve
from mnemospark.operators import transcript as tr
from mnemospark.operators.lineage import shared_folder
from mnemospark.streaming import sinks, turns
from mnemospark.streaming.deltas import DeltaLog

from .bindings import bind, with_tables
from .ingest import ATOMIC_KEY, INGEST_SQL, atomic_assets, story
from .registry import query
from .retrieval import bm25_ctes
from .scalars import est_sql
from .transcripts import WINDOW


def new_folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def in_parts(df, part, n: int, folder: str, start):
    """Write the rows of part 0, 1, .. one after the other, in as many files as there are tasks.

    After each, the query that ``start`` makes of the stream goes on from its checkpoint and takes all of the part as one batch.
    """
    for i in range(n):
        df.filter(part == i).write.mode("append").parquet(f"{folder}/in")
        finished(start(turns.turn_source(df.sparkSession, f"{folder}/in", df.schema, None)))


def third(column: str, cut1: int, cut2: int):
    return F.when(F.col(column) < cut1, 0).when(F.col(column) < cut2, 1).otherwise(2)


def finished(q):
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


@query("T1_stream_ingest", with_tables("story", INGEST_SQL))
def t1(spark, sf):
    folder = new_folder(spark)
    s = story(spark, sf)
    sink = sinks.DedupSink(spark, folder)
    options = {"extractor": extract.pattern_extractor(0.2), "embedder": vector.hash_embedder()}
    start = lambda stream: turns.stream_ingest(stream, folder, sink, 0.5, **options)
    in_parts(s, third("turn_seq", 500, 1_000_000_000), 3, folder, start)
    counts = sink.outcomes.read().groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.select(F.lit("outcome").alias("part"), F.col("outcome").alias("name"), "n")
        .unionAll(sink.current_assets().select(F.lit("asset"), "content", F.col("relevance") + 1))
        .unionAll(sink.current_attributes().select(F.lit("attribute"), F.concat_ws(" ", "entity_id", "value_json"), F.lit(None).cast("bigint")))
        .unionAll(sink.current_cards().select(F.lit("card"), F.concat_ws(" ", "entity_id", "entity_type"), F.col("relevance") + 1))
    )


@query(
    "T2_stream_gate",
    with_tables("atomic", f""" SELECT seq, id FROM atomic WHERE confidence >= 0.48 OR seq IN (SELECT seq FROM (
 SELECT seq, row_number() OVER (PARTITION BY {ATOMIC_KEY} ORDER BY seq) AS rn FROM atomic WHERE confidence < 0.48) WHERE rn >= 4)"""),
)
def t2(spark, sf):
    folder = new_folder(spark)
    passed = DeltaLog(spark, f"{folder}/passed", T.StructType([T.StructField("seq", T.LongType()), T.StructField("id", T.StringType())]))
    gate = turns.StreamGate(spark, folder, 0.8)
    start = lambda stream: turns.stream_assets(stream, passed.write, f"{folder}/checkpoint", gate)
    in_parts(atomic_assets(spark, sf), third("seq", 300, 600), 3, folder, start)
    return passed.read().select("seq", "id")


@query(
    "T3_stream_dedup",
    with_tables("atomic", f"""SELECT arg_min(id, seq) AS id, arg_min(content, seq) AS content, min(kind) AS kind, arg_min(source_turn_id, seq) AS source_turn_id,
 max(confidence) AS confidence, count(*) - 1 AS relevance, CASE WHEN count(*) > 1 THEN arg_max(source_turn_id, seq) END AS last_updated_turn,
 count(DISTINCT source_turn_id || quote) AS witness_count FROM atomic GROUP BY {ATOMIC_KEY}"""),
)
def t3(spark, sf):
    folder = new_folder(spark)
    none = F.lit(None)
    rows = atomic_assets(spark, sf).withColumn("target", F.lit("structured"))
    for name in ("entity_id", "entity_type", "canonical_name", "summary", "embedding_model"):
        rows = rows.withColumn(name, none.cast("string"))
    rows = rows.withColumn("aliases", none.cast("array<string>")).withColumn("embedding", none.cast("array<double>"))
    rows = rows.withColumn("attributes", none.cast(T.ArrayType(sinks.ATTRIBUTE)))
    sink = sinks.DedupSink(spark, folder)
    in_parts(rows, third("seq", 300, 600), 3, folder, lambda stream: turns.stream_assets(stream, sink, f"{folder}/checkpoint"))
    return sink.current_assets().select(
        "id", "content", "kind", F.col("provenance.source_turn_id").alias("source_turn_id"),
        F.col("provenance.confidence_score").alias("confidence"), "relevance", "last_updated_turn", "witness_count",
    )


#: A tick after turns 0-1, after turns 2-4, and after the rest.
TICKS = f""", live AS (SELECT session_id, turn_id, {est_sql('content')} AS tok, row_number() OVER (PARTITION BY session_id ORDER BY turn_index) - 1 AS i,
 CASE WHEN turn_index < 2 THEN 0 WHEN turn_index < 5 THEN 1 ELSE 2 END AS part FROM turns),
av AS (SELECT session_id, p AS part, count(*) FILTER (WHERE part <= p) AS n FROM live, range(3) r(p) GROUP BY 1, 2),
walk AS (SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS part, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS block, false AS took FROM live
 UNION ALL SELECT w.session_id, CASE WHEN due THEN w.part ELSE w.part + 1 END, CASE WHEN due THEN least(w.used + {WINDOW}, n) ELSE w.used END,
 CASE WHEN due THEN w.block + 1 ELSE w.block END, due FROM (
 SELECT w.*, av.n, coalesce((SELECT sum(tok) FROM live l WHERE l.session_id = w.session_id AND l.i >= w.used AND l.i < av.n), 0) >= 200 AS due
 FROM walk w JOIN av ON av.session_id = w.session_id AND av.part = w.part) w),
took AS (SELECT session_id, block - 1 AS block, used FROM walk WHERE took),
span AS (SELECT *, coalesce(lag(used) OVER (PARTITION BY session_id ORDER BY block), 0) AS from_ FROM took)
SELECT s.session_id, s.block, string_agg(turn_id, ',' ORDER BY i) AS turns FROM span s JOIN live l ON l.session_id = s.session_id AND l.i >= from_ AND l.i < used GROUP BY 1, 2"""


@query("T4_stream_summaries", with_tables("turns", TICKS, recursive=True))
def t4(spark, sf):
    folder = new_folder(spark)
    log = DeltaLog(
        spark, f"{folder}/summaries",
        T.StructType([T.StructField("session_id", T.LongType()), T.StructField("block", T.LongType()), T.StructField("turns", T.StringType())]),
    )

    def write(batch, batch_id):
        made = tr.summary_assets(batch)
        anchors = F.transform("provenance.raw_quote_anchors", lambda a: a["turn_id"])
        log.write(made.select("session_id", "block", F.array_join(anchors, ",").alias("turns")), batch_id)

    start = lambda stream: turns.run_batches(turns.stream_windows(stream, 200, WINDOW), write, f"{folder}/checkpoint")
    # One file a part: the place of turns without an index hangs on the order in which a tick meets them.
    in_parts(bind(spark, sf, "turns").coalesce(1), third("turn_index", 2, 5), 3, folder, start)
    return log.read().select("session_id", "block", "turns")


@query(
    "T5_stream_index",
    with_tables("queries", """, versions AS (SELECT doc_id AS id, text AS content, 0 AS v FROM documents UNION ALL
 SELECT doc_id, source || ' ' || text, 1 FROM documents WHERE doc_id % 3 = 0),
final AS (SELECT 'k' || id AS id, arg_max(content, v) AS content FROM versions WHERE id % 10 <> 7 GROUP BY 1)"""
                + bm25_ctes("final") + " SELECT query_id, id, round(score, 6) AS score, rank FROM bm"),
)
def t5(spark, sf):
    from .bindings import base

    folder = new_folder(spark)
    d = base(spark, sf, "documents")
    row = lambda text, part: d.select(F.concat(F.lit("k"), "doc_id").alias("id"), text.alias("body"), F.lit("t").alias("recency_key"), part.alias("part"))
    first = row(F.col("text"), F.when(F.col("doc_id") % 2 == 0, 0).otherwise(1))
    again = row(F.concat("source", F.lit(" "), "text"), F.when(F.col("doc_id") % 3 == 0, 2).otherwise(9))
    gone = row(F.lit(None).cast("string"), F.when(F.col("doc_id") % 10 == 7, 2).otherwise(9))
    rows = first.unionAll(again).unionAll(gone)
    index = sinks.SearchIndex(spark, folder)

    def write(batch, batch_id):
        deleted = batch.filter("body IS NULL").select("id")
        kept = batch.filter("body IS NOT NULL").join(deleted, "id", "left_anti")
        index.add(kept.select("id", "recency_key"), kept.select("id", F.col("body").alias("text")), batch_id, deleted=deleted)

    in_parts(rows, F.col("part"), 3, folder, lambda stream: turns.run_batches(stream, write, f"{folder}/checkpoint"))
    hits = index.search(bind(spark, sf, "queries"))
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(
    "E6_ingest_sink",
    with_tables("atomic queries", """, d AS (SELECT arg_min(id, seq) AS id, arg_min(content, seq) AS content FROM atomic GROUP BY """ + ATOMIC_KEY + """)
, plain AS (SELECT count(*) AS n FROM atomic)""" + bm25_ctes("d") + """ SELECT 'plain' AS sink, 'created' AS name, (SELECT n FROM plain) AS n
UNION ALL SELECT 'dedup', CASE WHEN rn = 1 THEN 'created' ELSE 'bumped' END, count(*) FROM (SELECT row_number() OVER (PARTITION BY """ + ATOMIC_KEY + """ ORDER BY seq) AS rn FROM atomic) GROUP BY 2
UNION ALL SELECT 'index', CAST(query_id AS VARCHAR) || ' ' || id, rank FROM bm"""),
)
def e6(spark, sf):
    folder = new_folder(spark)
    none = F.lit(None)
    rows = atomic_assets(spark, sf).withColumn("target", F.lit("structured"))
    for name in ("entity_id", "entity_type", "canonical_name", "summary", "embedding_model"):
        rows = rows.withColumn(name, none.cast("string"))
    rows = rows.withColumn("aliases", none.cast("array<string>")).withColumn("embedding", none.cast("array<double>"))
    rows = rows.withColumn("attributes", none.cast(T.ArrayType(sinks.ATTRIBUTE)))
    plain = sinks.RoutedSink(spark, f"{folder}/plain")(rows, 0)
    index = sinks.SearchIndex(spark, folder)
    merged = sinks.IndexingSink(sinks.DedupSink(spark, folder), index)(rows, 0)
    count = lambda df, name: df.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("sink"), F.col("outcome").alias("name"), "n")
    hits = index.search(bind(spark, sf, "queries"), retrieve.CHANNEL_TOP_K)
    return count(plain, "plain").unionAll(count(merged, "dedup")).unionAll(
        hits.select(F.lit("index"), F.concat_ws(" ", F.col("query_id").cast("string"), "id"), F.col("rank").cast("bigint"))
    )
