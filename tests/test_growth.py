"""What must not grow faster than the input: rows and columns per task."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.operators import reconcile

ANCHORS = "array<struct<turn_id:string,quote:string,char_start:int,char_end:int>>"
CLAIM = f"entity_id string, key string, seq long, place int, value_json string, confidence double, turn_start string, source_turn_id string, anchors {ANCHORS}"


def claim(seq, value, anchors):
    return ("e", "k", seq, 0, value, 0.5, f"t{seq:03d}", f"t{seq:03d}", anchors)


def test_fold_hands_flat_columns_to_python(spark, monkeypatch):
    anchors = [None, [], [("t1", 'a "quote",\n é', 1, None)], [("t2", "", 0, 2), ("t2", None, None, None)]]
    rows = [claim(i, str(i // 2), anchors[i % 4]) for i in range(12)]
    df, seen = spark.createDataFrame(rows, CLAIM), []
    for name in ("mapInPandas", "mapInArrow"):
        real = getattr(type(df), name)
        monkeypatch.setattr(type(df), name, lambda self, *a, _real=real, **k: (seen.append(self.schema), _real(self, *a, **k))[1])
    got = reconcile.fold_attributes(df, 5).orderBy("seq").collect()
    assert [r.anchors if r.anchors is None else [tuple(a) for a in r.anchors] for r in got] == [r[8] for r in rows]
    assert [r.change for r in got] == ["added"] + ["corroborated", "state_changed"] * 5 + ["corroborated"]
    nested = [f.name for schema in seen for f in schema if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
    assert seen and not nested


def test_stream_parts_are_batches_of_many_files(spark, tmp_path):
    from mnemospark.streaming import turns
    from workload import streams

    df, batches = spark.range(0, 400, 1, 4).withColumn("part", F.when(F.col("id") < 10, 0).otherwise(2)), []

    def write(batch, batch_id):
        batches.append((batch_id, batch.count()))

    streams.in_parts(df, F.col("part"), 3, str(tmp_path), lambda s: turns.run_batches(s, write, f"{tmp_path}/checkpoint"))
    assert batches == [(0, 10), (1, 0), (2, 390)]
    # The last part was written by four tasks, not by one.
    assert len(list(tmp_path.glob("in/*.parquet"))) >= 6


def test_search_steps_are_dealt_by_their_rows(spark, monkeypatch):
    from mnemospark.operators import retrieve

    docs = spark.range(300).select("id", F.concat_ws(" ", F.lit("all"), F.concat(F.lit("w"), F.col("id") % 7), F.concat(F.lit("x"), F.col("id") % 11)).alias("text"))
    queries = spark.createDataFrame([(i, f"all w{i % 7} x{i % 11}") for i in range(20)], "query_id long, query string")
    rows = lambda: sorted(tuple(r) for r in retrieve.bm25_search(docs, queries, 5).collect())
    want = rows()
    monkeypatch.setattr(retrieve, "TASK_ROWS", 100)
    dealt, real = [], type(docs).repartition
    monkeypatch.setattr(type(docs), "repartition", lambda self, n, *c: (dealt.append(n), real(self, n, *c))[1])
    assert rows() == want and len(want) == 100
    # 20 queries with 27 or 43 postings each make some 1,500 rows, once all bounds are applied.
    assert max(dealt) >= 10


def test_stored_index_is_searched_by_bounds(spark, tmp_path, monkeypatch):
    from mnemospark.operators import retrieve
    from mnemospark.streaming.sinks import SearchIndex

    docs = spark.createDataFrame([(f"d{i}", f"all w{i % 7} w{i % 3}" if i % 10 else "", "k") for i in range(90)], "id string, text string, recency_key string")
    queries = spark.createDataFrame([(1, "all w1"), (2, "W2 w2 all"), (None, "w5"), (None, "w0"), (3, "nowhere"), (4, None)], "query_id long, query string")
    index = SearchIndex(spark, str(tmp_path))
    index.add(docs.select("id", "recency_key"), docs.select("id", "text"), 0)
    terms = retrieve.query_terms(queries)
    live = index.current_postings().join(terms.select("term").distinct(), "term", "left_semi")
    totals = index.current_docs().agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("doc_len").alias("avg")))
    full = retrieve.bm25_rank(live, live.groupBy("term").agg(F.count(F.lit(1)).alias("df")), terms, totals.scalar(), 4)
    rows = lambda df: sorted((tuple(r) for r in df.select("query_id", "id", "score", "rank").collect()), key=repr)
    want = rows(full)
    assert {r[0] for r in want} == {None, 1, 2}
    monkeypatch.setattr(retrieve, "bm25_rank", None)
    assert rows(index.search(queries, 4)) == want


def test_a_batch_makes_its_signatures_once(spark, tmp_path, monkeypatch):
    from mnemospark.streaming import sinks

    full = sinks.RoutedSink(spark, f"{tmp_path}/plain").log.schema
    row = dict.fromkeys(full.fieldNames()) | {
        "network": "world", "kind": "fact", "entity_ids": [], "tags": [], "relevance": 0, "target": "structured",
        "provenance": ("t1", 0.5, "inferred", [("t1", "q", None, None)], ("t1", None, None, None, False)),
    }
    arrivals = spark.createDataFrame([tuple((row | {"seq": i, "id": f"a{i}", "content": c}).values()) for i, c in enumerate(["A b", " a  B", "c"])], full)
    real = reconcile.mention_key
    monkeypatch.setattr(reconcile, "mention_key", lambda df: real(df) if "dedup_key" in df.columns else pytest.fail("a signature is made again"))
    got = sinks.DedupSink(spark, f"{tmp_path}/dedup")(arrivals, 0).orderBy("seq").collect()
    assert [(r.id, r.outcome) for r in got] == [("a0", "created"), ("a0", "bumped"), ("a2", "created")]


def test_normalize_replaces_white_space_only(spark):
    from mnemospark.functions import text

    odd = ["", " ", "\t\n", "a", " A  b ﻿", "　x  y ", "a\x0b\x0c\r\nB  c", "\x1c a\x85b", "É  ß \U0001f600", None]
    df = spark.createDataFrame([(s,) for s in odd], "s string").select(
        text.normalize("s").alias("new"), F.array_join(F.regexp_extract_all(F.lower("s"), F.lit(text.INK), F.lit(0)), " ").alias("old")
    )
    assert all(r.new == r.old for r in df.collect())
    # Texts are not cut into words, which takes six times as long.
    assert "regexp_extract_all" not in spark.range(1).select(text.normalize(F.lit("a")).alias("n"))._jdf.queryExecution().logical().toString()
