"""Ingest, streams and explanations end to end on a few turns."""

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import vector
from mnemospark.operators import explain, extract, graph
from mnemospark.operators import transcript as tr
from mnemospark.plans import ingest
from mnemospark.sources import json_records
from mnemospark.streaming import sinks, turns


def turn_table(spark, *contents):
    rows = [(1, f"t{i:04d}", "user", c, i, i) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "session_id BIGINT, turn_id STRING, role STRING, content STRING, turn_index INT, turn_seq BIGINT")


def test_repeats_bump_and_types_change(spark):
    out = ingest.ingest_batch(
        turn_table(spark, "Mojo is a dog. Mojo is at Docks.", "Mojo is at Docks.", "Mojo is a wolf. Mojo believes life is good."),
        embedder=vector.hash_embedder(),
    )
    place = out.atomic.assets.filter("kind = 'fact'").first()
    assert (place["content"], place["relevance"], place["last_updated_turn"]) == ("Mojo is at Docks.", 1, "t0001")
    assert place["provenance"]["source_turn_id"] == "t0000" and place["witness_count"] == 2
    card = out.cards.cards.first()
    assert (card["entity_id"], card["entity_type"], card["relevance"]) == ("char:mojo", "dog", 1)
    assert out.cards.attributes.first()["value_json"] == '"wolf"'
    assert sorted(r["outcome"] for r in out.outcomes.collect()) == ["bumped", "created", "created", "created", "state_changed"]
    view = explain.explain_assets(out.atomic.assets.filter("kind = 'opinion'")).first()
    assert view["headline"] == "Mojo believes life is good." and view["confidence_band"] == "medium"


def test_guard_throws_or_skips(spark):
    own = lambda content: [{"type": "atomic", "kind": "fact", "network": "world", "content": "c", "quote": "nope", "confidence": 0.9}]
    t = turn_table(spark, "something else")
    assert ingest.arrivals_of(t, extract.map_extractor(own), "skip", embedder=vector.hash_embedder()).count() == 0
    with pytest.raises(Exception, match="quote not found in turn t0000"):
        ingest.arrivals_of(t, extract.map_extractor(own), embedder=vector.hash_embedder()).collect()


def test_lore_needs_an_embedder(spark):
    own = lambda content: [{"type": "atomic", "kind": "lore", "network": "world", "content": "old tale", "quote": "tale", "confidence": 0.9}]
    t = turn_table(spark, "a tale")
    row = ingest.arrivals_of(t, extract.map_extractor(own), embedder=vector.hash_embedder()).first()
    assert len(row["embedding"]) == 16 and row["target"] == "vector"
    with pytest.raises(Exception, match="needs an embedder"):
        ingest.arrivals_of(t, extract.map_extractor(own)).collect()


def test_retried_batch_counts_once(spark, tmp_path):
    sink = sinks.DedupSink(spark, str(tmp_path))
    rows = lambda *c: ingest.arrivals_of(turn_table(spark, *c), embedder=vector.hash_embedder())
    sink(rows("Mojo is at Docks. Mojo is a dog."), 0)
    later = ingest.arrivals_of(
        turn_table(spark, "-", "Mojo is at Docks. Mojo is a wolf."), embedder=vector.hash_embedder()
    )
    for _ in range(2):
        told = sorted(r["outcome"] for r in sink(later, 1).collect())
        assert told == ["bumped", "state_changed"]
    asset = sink.current_assets().first()
    assert (asset["relevance"], asset["witness_count"], asset["provenance"]["source_turn_id"]) == (1, 2, "t0000")
    assert sink.current_cards().first()["relevance"] == 1
    state = sink.current_attributes().first()
    assert (state["value_json"], state["source_turn_id"]) == ('"wolf"', "t0001")


def test_index_follows_the_merged_cards(spark, tmp_path):
    index = sinks.SearchIndex(spark, str(tmp_path / "index"))
    sink = sinks.IndexingSink(sinks.DedupSink(spark, str(tmp_path / "store")), index)
    sink(ingest.arrivals_of(turn_table(spark, "Mojo is a dog. Mojo is at Docks."), embedder=vector.hash_embedder()), 0)
    sink(ingest.arrivals_of(turn_table(spark, "-", "Mojo is a wolf."), embedder=vector.hash_embedder()), 1)
    q = spark.createDataFrame([(1, "wolf"), (2, "docks"), (3, "dog")], "query_id INT, query STRING")
    hits = {}
    for r in index.search(q).collect():
        hits.setdefault(r["query_id"], set()).add(r["id"])
    card = sink.inner.current_cards().first()["id"]
    # The card keeps its first type and content; its attribute has become "wolf".
    assert hits[1] == {card} and hits[3] == {card} and len(hits[2]) == 1 and hits[2] != {card}
    assert [(r["name"], r["entity_id"]) for r in index.current_names().collect()] == [("mojo", "char:mojo")]
    assert index.current_docs().count() == 2


def test_gate_keeps_counts_across_batches(spark, tmp_path):
    gate = turns.StreamGate(spark, str(tmp_path), 0.8)  # floor 0.48, four mentions
    def weak(*seqs):
        rows = [(s, "fact", "world", "rumour", [], None) for s in seqs]
        df = spark.createDataFrame(rows, "seq BIGINT, kind STRING, network STRING, content STRING, entity_ids ARRAY<STRING>, viewpoint_holder STRING")
        return df.withColumn("provenance", F.struct(F.lit(0.1).alias("confidence_score")))
    assert gate(weak(1, 2), 0).count() == 0
    assert gate(weak(3), 1).count() == 0
    assert [r["seq"] for r in gate(weak(4, 5), 2).collect()] == [4, 5]
    assert [r["seq"] for r in gate(weak(4, 5), 2).collect()] == [4, 5]
    assert gate(weak(6), 3).count() == 1


def test_disallowed_pair_fails_the_plain_sink(spark, tmp_path):
    rows = ingest.arrivals_of(turn_table(spark, "Mojo is at Docks."), embedder=vector.hash_embedder())
    assert sinks.RoutedSink(spark, str(tmp_path))(rows, 0).first()["outcome"] == "created"
    bad = rows.withColumn("kind", F.lit("rule"))
    with pytest.raises(Exception, match="rule is not allowed in the experience network — permitted: world"):
        sinks.RoutedSink(spark, str(tmp_path))(bad, 1)


def test_summary_of_empty_turns(spark):
    t = turn_table(spark, "", "Hello there", "  ").withColumn("block", F.lit(0))
    asset = tr.summary_assets(t).first()
    assert asset["content"] == "[t0000..t0002] 3 turns: Hello"
    assert asset["empty_turns"] == 1 and len(asset["provenance"]["raw_quote_anchors"]) == 2


def test_graph(spark):
    m = spark.createDataFrame(
        [("1", "alice", "One."), ("1", "bob", "One."), ("2", "bob", "Two."), ("2", "alice", "Two."), ("3", "alice", "G"), ("3", "ghost", "G"),
         ("4", "a", "T"), ("4", "b", "T"), ("4", "c", "T")],
        "asset_id STRING, entity_id STRING, content STRING",
    )
    cards = spark.createDataFrame([(e,) for e in ("alice", "bob", "a", "b", "c")], "entity_id STRING")
    want = {("alice", "bob"): ["One.", "Two."], ("a", "b"): ["T"], ("a", "c"): ["T"], ("b", "c"): ["T"]}
    for block in (1, 2, 1000):
        pairs = graph.cooccurrence_join(m, cards, block)
        assert {(r["src"], r["dst"]): r["reasons"] for r in graph.graph_edges(pairs).collect()} == want


def test_remember(spark):
    rows = [('{"content":"  x ","tags":["a","",1],"entity_ids":"e"}',), ("[]",), ('{"content":7}',), ("oops",), ('{"content":" "}',)]
    df = spark.createDataFrame(rows, "record STRING").select("record", F.lit("t1").alias("turn_id"), F.lit("q").alias("quote"))
    got = [(r["content"], r["tags"], r["entity_ids"], r["error"]) for r in json_records.remember_facts(df).collect()]
    assert got[0] == ("x", ["a"], [], None)
    assert [g[3] for g in got[1:]] == [json_records.NOT_OBJECT, json_records.NO_CONTENT, json_records.NOT_OBJECT, json_records.NO_CONTENT]
