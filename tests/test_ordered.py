"""Chunked and blocked operators against plain loops, with sizes small enough to cut every group."""

import random

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import extract, reconcile, reflect
from mnemospark.operators import transcript as tr
from mnemospark.operators.mentions import mention_spans, name_index
from mnemospark.operators.ordering import listed, with_running


def fold_loop(rows):
    """The attribute rules, one arrival at a time."""
    state, out = {}, []
    for e, k, seq, place, value, conf, turn in sorted(rows, key=lambda r: (r[2], r[3])):
        held = state.get((e, k))
        if held is None:
            held, kind, old = [value, conf, turn, seq, place], "added", None
        elif held[0] == value:
            held[1] = max(held[1], conf)
            kind, old = "corroborated", None
        elif conf > held[1] or (conf == held[1] and turn > held[2]):
            kind, old, held = "state_changed", held[0], [value, conf, turn, seq, place]
        else:
            kind, old = "ignored", value
        state[(e, k)] = held
        out.append((e, k, seq, place, kind, old, held[0], held[1], held[3], held[4]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("in_order", [True, False])
@pytest.mark.parametrize("levels", [1, 2, 5])
def test_fold_attributes_over_chunks(spark, in_order, levels):
    rng = random.Random(levels * 2 + in_order)
    rows = []
    for seq in range(600):
        turn = f"t{seq // 2:05d}" if in_order else f"t{rng.randrange(300):05d}"
        for place in range(rng.choice([1, 1, 2])):
            rows.append(
                (rng.choice("ab"), rng.choice("xy"), seq, place, str(rng.randrange(3)), rng.randrange(levels) / 10 + 0.5, turn)
            )
    df = spark.createDataFrame(
        rows, "entity_id STRING, key STRING, seq BIGINT, place INT, value_json STRING, confidence DOUBLE, turn_start STRING"
    ).withColumn("source_turn_id", F.col("turn_start"))
    names = ["entity_id", "key", "seq", "place", "change", "previous_value", "new_value", "level", "state_seq", "state_place"]
    want = fold_loop(rows)
    for chunk in (10, 64, 1 << 20):
        got = sorted((tuple(r) for r in reconcile.fold_attributes(df, chunk).select(*names).collect()), key=repr)
        assert got == want, f"chunk {chunk}"


def test_with_running(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, rng.randrange(10)) for i in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "k STRING, o BIGINT, v INT")
    out = with_running(df, ["k"], "o", {"v": F.col("v")}, chunk=50).collect()
    for key in "ab":
        mine, total = sorted(r for r in rows if r[0] == key), 0
        by_order = {r["o"]: r for r in out if r["k"] == key}
        for place, (_, o, v) in enumerate(mine, 1):
            total += v
            r = by_order[o]
            assert (r["ordinal"], r["run_v"], r["n_rows"]) == (place, total, len(mine))
            assert r["all_v"] == sum(x[2] for x in mine)


def test_listed_gives_one_row_per_key(spark):
    df = spark.range(30_000).select(F.when(F.col("id") < 21_000, "hot").otherwise("cold").alias("k"), "id")
    rows = {r["k"]: r["items"] for r in listed(df, ["k"], F.col("id")).collect()}
    assert rows == {"hot": list(range(21_000)), "cold": list(range(21_000, 30_000))}


def test_names_come_from_the_alias_table(spark):
    cards = spark.createDataFrame([("e", "Old", 1), ("e", "Main", 9), ("f", "Other", 3)], "entity_id string, canonical_name string, seq long")
    aliases = spark.createDataFrame([("e", f"N{i}") for i in range(7)] + [("f", "N3"), ("gone", "X")], "entity_id string, alias string")
    got = {tuple(r) for r in name_index(cards, aliases=aliases).collect()}
    assert got == {("main", "e", 9), ("other", "f", 3), ("n3", "f", 3)} | {(f"n{i}", "e", 9) for i in range(7)}


def test_mentions_with_long_short_and_odd_names(spark):
    names = spark.createDataFrame(
        [("a", "al", 1), ("b", "Al Bo", 2), ("c", "al bo cy, and then some", 3), ("d", "(x)", 4), ("e", "word " * 300 + "end", 5)],
        "entity_id string, name string, reg_seq long",
    )
    texts = spark.createDataFrame(
        [(1, "Al bo. AL; pal al-x al bo cy, and then some"), (2, "f(x) (x)"), (3, None), (4, ""), (5, "al"), (6, "word " * 301 + "end")],
        "id long, text string",
    )
    got = {(r["id"], r["name"][:8], r["start"]) for r in mention_spans(texts, names).collect()}
    assert got == {(1, "al bo", 1), (1, "al", 6), (1, "al bo cy", 13), (2, "(x)", 6), (5, "al", 1), (6, "word wor", 3)}


def test_rolling_windows_against_loop(spark):
    rng = random.Random(3)
    turns, want = [], set()
    for session in range(12):
        live = []
        for index in range(rng.randrange(1, 25)):
            text, done = "x" * rng.randrange(0, 60), rng.random() < 0.2
            turns.append((session, f"{session}-{index:03d}", "user", text, index, done))
            if not done:
                live.append((f"{session}-{index:03d}", -(-len(text) // 4)))
        block = 0
        while live and sum(t for _, t in live) >= 40:
            want |= {(turn, block) for turn, _ in live[:3]}
            live, block = live[3:], block + 1
    df = spark.createDataFrame(turns, "session_id BIGINT, turn_id STRING, role STRING, content STRING, turn_index INT, summarized BOOLEAN")
    for chunk in (4, 1000):
        got = tr.rolling_summary_windows(df, 40, 3, chunk=chunk).select("turn_id", "block").collect()
        assert {tuple(r) for r in got} == want


@pytest.mark.parametrize("part", [3, 1 << 20])
def test_confidence_walk(spark, part):
    rng = random.Random(5)
    scores = {f"a{i}": rng.choice([0.02, 0.1, 0.5, 0.9, 1.0]) for i in range(6)}
    steps = []
    for i in range(200):
        steps.append((rng.randrange(2), f"a{rng.randrange(6)}", i, rng.choice([-0.1, 0.1, -0.3, 0.25])))
    df = spark.createDataFrame(steps, "phase INT, primary_id STRING, supporting_seq BIGINT, delta DOUBLE").withColumn(
        "effect", F.lit("adjust_confidence")
    )
    base = spark.createDataFrame(list(scores.items()), "id STRING, score DOUBLE")
    got = {r["id"]: r for r in reflect.confidence_walk(df, base, part=part).collect()}
    for name, value in scores.items():
        changed = 0
        for _, _, _, delta in sorted(s for s in steps if s[1] == name):
            new = min(0.99, max(0.05, value + delta))
            changed += new != value
            value = new
        assert got[name]["score"] == pytest.approx(value, abs=1e-9)
        assert abs(got[name]["changed"] - changed) <= 1  # a part may begin an ulp off a bound


def test_contradictions_against_all_pairs(spark):
    rng = random.Random(8)
    words = ["king", "is", "strong", "brave", "old", "rich", "tall"]
    rows = []
    for i in range(160):
        tokens = [w for w in words if rng.random() < 0.6] + (["not"] if rng.random() < 0.3 else [])
        rng.shuffle(tokens)
        ids = rng.sample(["e1", "e2", "e3"], rng.choice([0, 1, 2, 2]))
        rows.append((f"o{i:03d}", i, f"h{rng.randrange(5)}", " ".join(tokens), ids))
    df = spark.createDataFrame(rows, "id STRING, seq BIGINT, viewpoint_holder STRING, content STRING, entity_ids ARRAY<STRING>")
    want = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            sa, sb = set(a[3].split()), set(b[3].split())
            if a[2] == b[2] or ("not" in sa) == ("not" in sb):
                continue
            if not (set(a[4]) & set(b[4]) if a[4] and b[4] else sa & sb):
                continue
            x, y = sa - {"not"}, sb - {"not"}
            if (x | y) and len(x & y) / len(x | y) >= 0.6:
                want.add((a[0], b[0]))
    for block in (4, 2000):
        got = [(r["primary_id"], r["supporting_id"]) for r in reflect.contradiction_join(df, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("skepticism", [0.0, 0.3, 0.5, 1.0])
def test_gate_against_loop(spark, skepticism):
    rng = random.Random(9)
    rows = [(i, "fact", "world", rng.choice(["A  b", "a B", "c"]), rng.choice([0.1, 0.2, 0.7])) for i in range(60)]
    df = spark.createDataFrame(rows, "seq BIGINT, kind STRING, network STRING, content STRING, c DOUBLE").select(
        "*", F.array().cast("array<string>").alias("entity_ids"), F.lit(None).cast("string").alias("viewpoint_holder")
    )
    floor, needed = 0.6 * skepticism, max(1, -int(-4 * skepticism // 1))
    seen, want = {}, set()
    for seq, _, _, content, c in rows:
        key = " ".join(content.lower().split())
        if c >= floor:
            want.add(seq)
        else:
            seen[key] = seen.get(key, 0) + 1
            if seen[key] >= needed:
                want.add(seq)
    got = extract.skepticism_gate(df, skepticism, "c").collect()
    assert {r["seq"] for r in got} == want


def test_equal_steps_are_walked_by_their_count(spark):
    """Findings are counted per part before they move; only parts of several deltas are walked finding by finding."""
    rng = random.Random(9)
    rows = [("a", 0, i, -0.1 if i < 900 else 0.03, "adjust_confidence") for i in range(1800)]
    rows += [("b", 1, i, 2.0 if i < 10 else rng.choice([-3.0, 1.0]), "bump_relevance") for i in range(300)]
    rows += [("b", 0, i, 0.07, "adjust_confidence") for i in range(5)]
    rng.shuffle(rows)
    findings = spark.createDataFrame(rows, "primary_id STRING, phase INT, supporting_seq BIGINT, delta DOUBLE, effect STRING")
    assert reflect._counted(reflect._steps(findings, 100)).count() == 22
    assets = spark.createDataFrame([(x, 0.55, 1) for x in "abc"], "id STRING, score DOUBLE, relevance BIGINT").select(
        "id", "relevance", F.struct(F.col("score").alias("confidence_score"), F.lit("inferred").alias("confidence_source")).alias("provenance")
    )
    got = {r["id"]: r for r in reflect.apply_effects(assets, findings, part=100).collect()}
    for name in "abc":
        score, relevance, changed = 0.55, 1.0, 0
        for _, _, _, delta, effect in sorted(r for r in rows if r[0] == name):
            if effect == "bump_relevance":
                relevance, changed = max(0.0, relevance + delta), changed + 1
            else:
                new = min(0.99, max(0.05, score + delta))
                score, changed = new, changed + (new != score)
        assert got[name]["provenance"]["confidence_score"] == score
        assert (got[name]["relevance"], got[name]["changed"]) == (int(relevance), changed)
