"""Mentions are read once and pairs are formed once, whatever reads the edges."""

import re
from itertools import combinations

from pyspark.sql import functions as F

from mnemospark.operators import graph

MENTION = "asset_id string, entity_id string, content string"
NODE = "id string, label string, entity_type string"


def neighbors(spark, rows, block=1_000):
    mentions = spark.createDataFrame(rows, MENTION)
    cards = spark.createDataFrame([(f"e{i}",) for i in range(9)], "entity_id string")
    nodes = spark.createDataFrame([(f"e{i}", f"E{i}", "t") for i in range(9)], NODE)
    return graph.graph_neighbors(graph.graph_edges(graph.cooccurrence_join(mentions, cards, block)), nodes)


def test_neighbors_against_all_pairs(spark):
    named = {"a": "e0 e1 e2 ghost", "b": "e1 e0", "c": "e3", "d": " ".join(f"e{i}" for i in range(9)), None: "e1 e2", "f": ""}
    rows = [(a, e, f"on {a}") for a, es in named.items() for e in es.split()] + [("b", "e0", "on b"), ("a", None, "on a")]
    want = {}
    for a, es in named.items():
        for x, y in combinations(sorted(set(es.split()) - {"ghost"}), 2):
            want.setdefault((x, y), []).append(f"on {a}")
    want = sorted((i, n, f"E{n[1]}", "t", " · ".join(sorted(v))) for (x, y), v in want.items() for i, n in ((x, y), (y, x)))
    for block in (1, 2, 4, 1_000):
        got = neighbors(spark, rows, block).select("id", "neighbor", "label", "entity_type", "reasons")
        assert sorted(map(tuple, got.collect())) == want


def test_pairs_are_formed_once(spark):
    df = neighbors(spark, [("a", "e0", "A"), ("a", "e1", "A")])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # Each reading would deal out all mentions, and each forming all pairs, by itself.
    assert len(re.findall(r"LogicalRDD \[asset_id", plan)) == 1
    assert plan.count("posexplode(") == 1
    assert df.select(F.max("reasons")).first()[0] == "A"
