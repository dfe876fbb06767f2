"""Outcomes name the stored asset; a first witness keeps all its anchors."""

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import reconcile

ANCHOR = "struct<turn_id:string,quote:string,char_start:int,char_end:int>"
ASSET = (
    "seq long, id string, kind string, network string, viewpoint_holder string, content string, entity_ids array<string>, tags array<string>, "
    f"relevance long, last_updated_turn string, provenance struct<source_turn_id:string,confidence_score:double,raw_quote_anchors:array<{ANCHOR}>>"
)


def asset(seq, content, anchors, relevance=0, confidence=0.5):
    found = [(t, q, i, i + 1) for i, (t, q) in enumerate(anchors)]
    return (seq, f"a{seq}", "fact", "world", None, content, [], [], relevance, None, (f"t{seq}", confidence, found))


def frame(spark, rows):
    return spark.createDataFrame(rows, ASSET)


@pytest.fixture(scope="module")
def arrivals():
    return [
        asset(1, "The sky is blue", [("t1", "x"), ("t1", "x"), ("t2", "y")], relevance=3),
        asset(2, "Other", [("t2", "z")]),
        asset(3, "the  sky is blue", [("t1", "x"), ("t3", "w"), ("t3", "w")]),
        asset(4, "THE SKY IS BLUE", [("t3", "w")]),
    ]


def test_outcomes_name_the_stored_asset(spark, arrivals):
    got = {r.seq: (r.id, r.arrival_id, r.outcome) for r in reconcile.atomic_outcomes(frame(spark, arrivals)).collect()}
    assert got == {1: ("a1", "a1", "created"), 2: ("a2", "a2", "created"), 3: ("a1", "a3", "bumped"), 4: ("a1", "a4", "bumped")}
    # In a second batch the first batch's asset is the stored one.
    df = frame(spark, arrivals)
    before, after = df.filter("seq <= 2"), df.filter("seq > 2")
    known = reconcile.first_ids(reconcile.dedup_rows(before).assets, "dedup_key")
    got = {r.seq: (r.id, r.arrival_id, r.outcome) for r in reconcile.atomic_outcomes(after, known).collect()}
    assert got == {3: ("a1", "a3", "bumped"), 4: ("a1", "a4", "bumped")}


def test_details_of_bumps(spark, arrivals):
    got = sorted(tuple(r) for r in reconcile.bump_details(frame(spark, arrivals)).collect())
    assert got == [(3, 3, 4, 1), (4, 4, 5, 0)]


def anchors(df):
    return sorted((r.turn_id, r.quote, r.char_start, r.first_seq, r.copy) for r in df.collect())


def test_a_first_witness_keeps_equal_anchors(spark, arrivals):
    rows = frame(spark, arrivals).filter("seq <> 2").select(F.lit("k").alias("key"), "seq", F.col("provenance.raw_quote_anchors").alias("anchors"))
    want = [("t1", "x", 0, 1, 0), ("t1", "x", 1, 1, 1), ("t2", "y", 2, 1, 0), ("t3", "w", 1, 3, 0)]
    assert anchors(reconcile.evidence(rows, ["key"])) == want
    # Batch by batch, a later batch's first witness is not the asset's.
    parts = [reconcile.evidence(rows.filter(F.col("seq") == s), ["key"]) for s in (1, 3, 4)]
    assert ("t3", "w", 2, 3, 1) in anchors(parts[1])
    assert anchors(reconcile.merge_evidence(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["key"])) == want
    witnesses = reconcile.dedup_atomic(frame(spark, arrivals)).assets.select("id", "witness_count").collect()
    assert sorted(map(tuple, witnesses)) == [("a1", 4), ("a2", 1)]


def test_no_arrivals(spark):
    none = frame(spark, [])
    assert reconcile.atomic_outcomes(none).collect() == reconcile.bump_details(none).collect() == []
