"""Phrase mining against brute force and SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np

from mnemospark.llm import collocations, queries
from mnemospark.llm.sql import COLLOCATIONS

SF = "/root/testdata/sf0.001"
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=30, longest=4, share=80, most=2000):
    counts, totals, out = {}, Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            own = counts.setdefault(lang, Counter())
            own.update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    for lang, own in counts.items():
        several = {p: a for p, a in own.items() if a >= least and len(p) > 1}
        gone = {
            q[i : i + k]
            for q, b in several.items()
            for k in range(2, len(q))
            for i in range(len(q) - k + 1)
            if 100 * b >= share * own[q[i : i + k]]
        }
        scored = []
        for p, a in several.items():
            if p not in gone:
                score, _, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def texts(n, seed):
    rng = random.Random(seed)
    words = ["a", "B", "c", "É", "éa", "ß-", "日本", "x y", "😀", "d'", "\x1c", "zz"]
    for i in range(n):
        parts = [rng.choice(words) if rng.random() < 0.7 else "New York City hall" for _ in range(rng.randint(0, 40))]
        text = "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\r\n", "\x0b", " ?! "]) for p in parts)
        yield rng.choice(["en", "de", None, "und"]), rng.choice([text, text, text, None, ""]) if i % 5 == 0 else text


def found(df, **how):
    return sorted(map(tuple, collocations.collocations(df, **how).collect()))


def test_all_phrases_of_brute_force(spark):
    rows = list(texts(400, 1))
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    for how in ({"least": 3}, {"least": 12, "most": 7, "share": 50}, {"least": 5, "longest": 3}):
        assert found(df, **how) == brute(rows, **how)


def test_a_long_text_and_clashing_columns(spark):
    text = " ".join(f"w{i % 977} x{i * i % 31}" for i in range(100_000))
    rows = [("en", text, 1, 2, 3), ("en", None, 1, 2, 3)]
    df = spark.createDataFrame(rows, "lang string, text string, n long, w long, phrase long")
    assert found(df) == brute([r[:2] for r in rows])
    assert found(df.limit(0)) == []


def test_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, lang VARCHAR, text VARCHAR)")
    rows = [*texts(3000, 2), ("en", "the end " * 40)]
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, *r) for i, r in enumerate(rows)])
    assert sorted(con.execute(COLLOCATIONS).fetchall()) == brute(rows)
    con.execute(f"CREATE OR REPLACE TABLE documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(map(tuple, queries.op12_collocations(spark, SF).collect())) == sorted(con.execute(COLLOCATIONS).fetchall())


def test_groups_in_a_bit_set_always_pass(spark):
    rng = np.random.default_rng(1)
    pairs = rng.integers(-(1 << 63), (1 << 63) - 1, (5000, 2))
    bits = collocations.bit_set(spark.createDataFrame(pairs.tolist(), "w1 long, w2 long"), 2)
    assert bits.has([pairs[:, 0].copy(), pairs[:, 1].copy()]).all()
    others = rng.integers(-(1 << 63), (1 << 63) - 1, (5000, 2))
    assert bits.has([others[:, 0].copy(), others[:, 1].copy()]).mean() < 0.05
