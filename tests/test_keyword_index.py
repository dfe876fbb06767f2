"""Keyword search by bounds gives the rows of a full scoring, and reads far less."""

import math
import random
import re
from collections import Counter

import pytest

from mnemospark.operators import retrieve
from mnemospark.plans.recall import MemoryTables, fusion_recall


def brute(docs, queries, k, k1=1.5, b=0.75):
    tokens = {i: re.findall("[a-z0-9']+", (t or "").lower()) for i, t in docs}
    counts = {i: Counter(t) for i, t in tokens.items()}
    df = Counter(t for c in counts.values() for t in c)
    avg = sum(map(len, tokens.values())) / len(tokens)
    out = []
    for query_id, text in queries:
        wanted = Counter(re.findall("[a-z0-9']+", (text or "").lower()))
        scores = {}
        for i, c in counts.items():
            hit = [t for t in wanted if c[t]]
            if hit:
                norm = 1 - b + b * len(tokens[i]) / avg
                parts = (wanted[t] * math.log((len(docs) - df[t] + 0.5) / (df[t] + 0.5) + 1) * c[t] * (k1 + 1) / (c[t] + k1 * norm) for t in hit)
                scores[i] = round(sum(parts), 9)
        best = sorted(scores, key=lambda i: (-scores[i], i))[:k]
        out += [(query_id, i, round(scores[i], 6), rank) for rank, i in enumerate(best)]
    return sorted(out)


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    weights = [1 / (i + 1) for i in range(2000)]
    return [(i, " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 5, 40, 200])))) for i in range(n)]


def rows(df):
    return sorted((r.query_id, r.id, round(r.score, 6), r.rank) for r in df.collect())


@pytest.mark.parametrize("k", [1, 3, 25, 5000])
def test_equals_full_scoring(spark, k):
    docs = corpus(600, 1) + [(1000, None), (1001, "W1 w1, w1"), (1002, "W1 w1, w1"), (1003, "")]
    queries = [(i, t) for i, t in corpus(25, 2)] + [(90, None), (91, ""), (92, "nowhere"), (93, "w1 w1 w0"), (94, "w1999 w5 w0")]
    d, q = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(queries, "query_id long, query string")
    want = brute(docs, queries, k)
    assert rows(retrieve.bm25_search(d, q, k)) == want
    assert rows(retrieve.search_index(retrieve.keyword_index(d), q, k)) == want


def test_reads_less_than_queries_times_documents(spark):
    docs, queries = corpus(4000, 3), [(i, t) for i, t in corpus(60, 4) if len(t) > 100]
    d, q = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(queries, "query_id long, query string")
    index, sizes = retrieve.keyword_index(d), {}
    all_rows = index.postings.join(retrieve.query_terms(q), "term").count()
    got = rows(retrieve.search_index(index, q, 5, measure=lambda name, df: sizes.update({name: df.count()})))
    assert got == brute(docs, queries, 5)
    assert sizes["essential"] < 0.9 * all_rows and sizes["kept"] < 0.1 * len(docs) * len(queries)


def test_empty_tables(spark):
    d, q = spark.createDataFrame([], "id long, text string"), spark.createDataFrame([], "query_id long, query string")
    some = spark.createDataFrame([(1, "a")], "id long, text string")
    asked = spark.createDataFrame([(1, "a")], "query_id long, query string")
    assert rows(retrieve.bm25_search(d, asked)) == rows(retrieve.bm25_search(some, q)) == []


def test_recall_over_a_stored_index(spark):
    docs = corpus(300, 5)
    schema = "id long, kind string, network string, viewpoint_holder string, content string, recency_key long, body string"
    assets = spark.createDataFrame([(i, "fact", "world", None, t, i, t) for i, t in docs], schema)
    queries = spark.createDataFrame([(i, t) for i, t in corpus(8, 6)], "query_id long, query string")
    memory = MemoryTables(assets)
    plain = fusion_recall(memory, queries, k=10, channels=("bm25",)).select("query_id", "id", "position").collect()
    stored = fusion_recall(memory.indexed(), queries, k=10, channels=("bm25",)).select("query_id", "id", "position").collect()
    assert sorted(plain) == sorted(stored) and plain
