"""Column expressions and name mentions on hand-made texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import scoring, text, vector
from mnemospark.operators import mentions, retrieve, select


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} STRING" for k in values))
    return row.select(expr.alias("x")).first()["x"]


def test_lengths_count_utf16_units(spark):
    assert one(spark, text.estimate_tokens("s"), s="abcd😀") == 2
    assert one(spark, text.utf16_length("s"), s="a😀b") == 4
    span = one(spark, text.quote_span("c", "q"), c="😀é said hi", q="said")
    assert (span["char_start"], span["char_end"]) == (4, 8)
    assert one(spark, text.quote_span("c", "q"), c="abc", q="x") is None
    assert one(spark, text.quote_span("c", "q"), c="abc", q="") is None
    assert one(spark, text.utf16_head("s", 3), s="a😀b") == "a😀"


def fnv(s):
    h = 2166136261
    data = s.encode("utf-16-le")
    for i in range(0, len(data), 2):
        h = ((h ^ int.from_bytes(data[i : i + 2], "little")) * 16777619) & 0xFFFFFFFF
        yield h


def test_hash_and_embedding(spark):
    for s in ("", "abc", "é😀 z", "x" * 300):
        want = list(fnv(s))
        assert one(spark, text.fnv1a("s"), s=s) == (want[-1] if want else 2166136261)
        slots = [0.0] * 16
        for h in want:
            slots[h % 16] += (h & 255) / 127.5 - 1
        assert one(spark, vector.hash_embedder()("s"), s=s) == pytest.approx(slots)


def test_small_expressions(spark):
    assert one(spark, text.normalize("s"), s="  A\t\n b﻿") == "a b"
    assert one(spark, text.tokenize("s"), s="It's É-2 ok!") == ["it's", "2", "ok"]
    assert one(spark, text.truncate("s", 5), s="abcdef") == "abcd…"
    assert one(spark, text.display_value("s"), s="null") == "—"
    assert one(spark, text.display_value("s"), s='"a\\"b"') == 'a"b'
    assert one(spark, text.display_value("s"), s='{"a":1}') == '{"a":1}'
    assert one(spark, text.first_word("s"), s="  don't go") == "don't"
    assert one(spark, text.capitalized_tokens("s"), s="Anne- saw éBob and O'Neil.") == ["Anne", "Bob", "O'Neil"]
    assert one(spark, scoring.clamp01(F.lit(float("nan"))), s="") == 0.0
    assert one(spark, scoring.clamp01(F.lit(float("inf"))), s="") == 0.0
    assert one(spark, scoring.mentions_required(F.lit(0.3)), s="") == 2
    assert one(spark, select.same_entity_set(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("a"))), s="")


def mention_loop(body, names):
    """Longest name first, then registration; word-bounded; spans claimed once."""
    low, found, claimed = body.lower(), [], []
    order = {}
    for name, entity, reg in names:
        key = name.lower()
        order.setdefault(key, [reg, []])
        order[key][0] = min(order[key][0], reg)
        order[key][1].append((reg, entity))
    word = re.compile("[a-z0-9'-]")
    for name in sorted(order, key=lambda n: (-len(n), order[n][0])):
        at = low.find(name)
        while at >= 0:
            end = at + len(name)
            free = not (at and word.match(low[at - 1])) and not (end < len(low) and word.match(low[end]))
            if free and not any(at < e and s < end for s, e in claimed):
                claimed.append((at, end))
                for _, entity in sorted(order[name][1]):
                    if entity not in found:
                        found.append(entity)
            at = low.find(name, at + 1)
    return found


def test_mentions_against_loop(spark):
    rng = random.Random(4)
    parts = ["Mojo", "Jojo", "MJ", "é", "(x)", "an", "-", "o'k", ".", "the"]
    names = [("Mojo Jojo", "e:mojo", 0), ("Mojo", "e:mojo", 1), ("MJ", "e:mojo", 2), ("Jojo", "e:jojo", 3), ("é", "e:acute", 4),
             ("(x)", "e:x", 5), ("an an", "e:an", 6), ("the é", "e:the", 7), ("mojo", "e:other", 8), (".", "e:dot", 9)]
    texts = [(i, rng.choice(["", " ", "  "]).join(rng.choice(parts) for _ in range(rng.randrange(0, 9)))) for i in range(250)]
    texts += [(900, "Mojo Jojo arrived."), (901, ""), (902, "mojojojo")]
    got = {}
    out = mentions.mentions(
        spark.createDataFrame(texts, "id INT, text STRING"),
        spark.createDataFrame(names, "name STRING, entity_id STRING, reg_seq BIGINT"),
    )
    for r in sorted(out.collect(), key=lambda r: (r["id"], r["mention_rank"])):
        got.setdefault(r["id"], []).append(r["entity_id"])
    for i, body in texts:
        assert sorted(got.get(i, [])) == sorted(mention_loop(body, names)), body


def test_vector_topk_blocks_and_slices(spark):
    rng = random.Random(6)
    lore = [(f"v{i:03d}", [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)]) for i in range(120)] + [("zero", [0.0] * 4)]
    queries = [(q, [rng.random() for _ in range(4)]) for q in range(9)]
    left = spark.createDataFrame(lore, "id STRING, embedding ARRAY<DOUBLE>")
    right = spark.createDataFrame(queries, "query_id INT, vector ARRAY<DOUBLE>")
    whole = {tuple(r) for r in retrieve.vector_topk(left, right, 7).collect()}
    cut = {tuple(r) for r in retrieve.vector_topk(left, right, 7, slice_rows=11, block_rows=2).collect()}
    assert whole == cut and len(whole) == 63
    dims = right.withColumn("vector", F.slice("vector", 1, 3))
    with pytest.raises(Exception, match="does not match store dim"):
        retrieve.vector_topk(left, dims, 3).collect()


def test_bm25_prefers_rare_terms(spark):
    docs = spark.createDataFrame(
        [("a", "Mojo is a Pomeranian puppy."), ("b", "Mojo went for a walk in the park."), ("c", "Alice cooked dinner."), ("d", "")],
        "id STRING, text STRING",
    )
    q = spark.createDataFrame([(1, "pomeranian mojo"), (2, "dinner"), (3, "!!"), (4, "unknown")], "query_id INT, query STRING")
    hits = [(r["query_id"], r["id"]) for r in retrieve.bm25_search(docs, q).orderBy("query_id", "rank").collect()]
    assert hits == [(1, "a"), (1, "b"), (2, "c")]


def test_budget_skips_what_does_not_fit(spark):
    hits = spark.createDataFrame(
        [(1, "a", 0.9, 5), (1, "b", 0.8, 9), (1, "c", 0.7, 4), (1, "d", 0.6, 1)], "query_id INT, id STRING, score DOUBLE, tokens BIGINT"
    )
    took = lambda **k: [r["id"] for r in retrieve.token_budget(hits, **k).orderBy("position").collect()]
    assert took(budget=10) == ["a", "c", "d"]
    assert took(budget=10, k=2) == ["a", "c"]
    assert took(k=2) == ["a", "b"]
