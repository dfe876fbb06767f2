"""The prefix trie against brute force and SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from mnemospark.llm import queries, trie
from mnemospark.llm.sql import PREFIX_TRIE

SCHEMA = "conv_id long, turn long, role string, text string"
SF = "/root/testdata/sf0.001"


def brute(rows):
    own = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            role, text = r[2] or "", r[3] or ""
            # Equal turns come in the order of their hashes.
            code = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[r[0]].append((r[1] is not None, r[1] or 0, code, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(abs(c) // 100 * (100 if c > 0 else -100), [])[:h] + turns[h:])
    members, nodes = defaultdict(list), []
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    for p, convs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below) for q in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(paths[c]) == len(p)))
        up = min(members[p[:-1]]) if p else None
        nodes.append((min(convs), len(p), up, len(convs), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(nodes, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for c in [*range(0, 60), *range(100, 140), *range(205, 230), -7, 100_000_000_007]:
        n = rng.choice([1, 2, 3, 3, 8])
        out += [(c, i, rng.choice(["user", "assistant", None]), rng.choice(["", "hi", "é😀", None, "a" * 300])) for i in range(n)]
    out += [(c, i, "user", f"same {i}") for c in range(300, 360) for i in range(7)]
    out += [(300, None, "user", "before"), (None, 1, "user", "nobody"), (1, 1, None, None), (400, 5, "user", "x" * 5000)]
    return out


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_trie_is_that_of_brute_force(spark, rows, ranges):
    paths = trie.rebuilt_paths(spark.createDataFrame(rows, SCHEMA))
    assert found(trie.prefix_trie(paths, ranges)) == brute(rows)


def test_trie_of_sql(spark, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(PREFIX_TRIE).fetchall(), key=repr) == brute(rows)
    con.execute(f"CREATE OR REPLACE TABLE conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = sorted(con.execute(PREFIX_TRIE).fetchall(), key=repr)
    assert found(queries.op11_prefix_trie(spark, SF)) == want


def test_one_hot_path_over_many_ranges(spark):
    """Equal conversations, ended and continued, fill more ranges than one."""
    rows = [(c, i, "user", f"t{i}") for c in range(500) for i in range(3)] + [(c, i, "user", f"t{i}") for c in range(1000, 1100) for i in range(9)]
    assert found(trie.prefix_trie(trie.rebuilt_paths(spark.createDataFrame(rows, SCHEMA)), 9)) == brute(rows)


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(trie.prefix_trie(trie.rebuilt_paths(empty))) == []
    rows = [(5, 0, "user", "a"), (6, 0, "user", "b")]
    odd = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", path long, codes long, shard long")
    assert found(trie.prefix_trie(trie.rebuilt_paths(odd))) == brute(rows)
    # A turnless conversation ends at the root.
    got = trie.prefix_trie(spark.createDataFrame([(1, bytearray()), (2, bytearray()), (None, None)], "conv_id long, path binary"))
    assert found(got) == [(1, 0, None, 2, 0, 1, 0, hashlib.sha256(b"1,2").hexdigest())]
