"""Findings are added up without forming every pair of opinions, with the results that single findings give."""

import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T

from mnemospark.operators import reconcile, reflect
from mnemospark.schema import ANCHOR

OPINION = "id string, seq long, viewpoint_holder string, content string, entity_ids array<string>"


def opinions(n=150, several=True):
    rng, words, rows = random.Random(3), ["king", "is", "strong", "brave", "old", "rich"], []
    for i in range(n):
        tokens = [w for w in words if rng.random() < 0.7] + (["not"] if rng.random() < 0.4 else [])
        named = rng.sample(["e1", "e2", "e3"], rng.choice([0, 1, 1, 2, 3] if several else [0, 1, 1]))
        named += rng.choice([[], [], ["e1"], [None]]) if several and named else []
        # Ids and seqs that repeat, holders that are missing.
        rows.append((f"o{i % 140:03d}", rng.choice([i, i, i // 7]), rng.choice(["h1", "h2", "h3", "H 1", None]), " ".join(tokens), named))
    return rows


@pytest.mark.parametrize("several", [True, False])
def test_alike_contradictions_add_up(spark, several):
    df = spark.createDataFrame(opinions(several=several), OPINION)
    want = defaultdict(list)
    for r in reflect.contradiction_join(df).collect():
        want[r.primary_id, r.primary_seq, r.primary_holder, r.supporting_holder].append(r.supporting_seq)
    total = defaultdict(int)
    for key, seqs in want.items():
        total[key[:3]] += len(seqs)
    assert len(want) > 100
    for cut in (3,) if several else (1_000,):
        got, last = defaultdict(int), defaultdict(list)
        for r in reflect.alike_contradictions(df, True, counted=cut, counted_by=cut).collect():
            key = (r.primary_id, r.primary_seq, r.primary_holder, r.supporting_holder)
            got[key] += r.n
            last[key] += [r.supporting_seq, r.last_seq]
        assert got == {k: len(v) for k, v in want.items()}
        assert {k: (min(v), max(v)) for k, v in last.items()} == {k: (min(v), max(v)) for k, v in want.items()}
        got, last = defaultdict(int), defaultdict(list)
        for r in reflect.alike_contradictions(df, False, counted=cut, counted_by=cut).collect():
            got[r.primary_id, r.primary_seq, r.primary_holder] += r.n
            last[r.primary_id, r.primary_seq, r.primary_holder] += [r.supporting_seq, r.last_seq]
        assert got == total
        ends = {k: [s for key, v in want.items() if key[:3] == k for s in v] for k in total}
        assert {k: (min(v), max(v)) for k, v in last.items()} == {k: (min(v), max(v)) for k, v in ends.items()}


def assets(spark, several=True):
    none = F.lit(None)
    anchor = F.struct(F.col("id").alias("turn_id"), F.substring("content", 1, 9).alias("quote"), none.cast("int").alias("char_start"), none.cast("int").alias("char_end")).cast(ANCHOR)
    temporal = F.struct(F.col("id").alias("turn_start"), *[none.cast("string").alias(c) for c in ("turn_end", "narrative_start", "narrative_end")], F.lit(False).alias("narrative_always"))
    p = F.struct(F.col("id").alias("source_turn_id"), F.lit(0.6).alias("confidence_score"), F.lit("inferred").alias("confidence_source"), F.array(anchor).alias("raw_quote_anchors"), temporal.alias("temporal_range"))
    # Without equal seqs, of which any may be the first.
    rows = spark.createDataFrame([(o[0], i, *o[2:]) for i, o in enumerate(opinions(several=several))], OPINION)
    made = rows.select("*", F.lit("opinion").alias("network"), F.lit("opinion").alias("kind"), F.lit(1).cast("bigint").alias("relevance"), p.alias("provenance"))
    facts = spark.createDataFrame([("f1", 900, "King is strong"), ("f2", 901, " king  is STRONG ")], "id string, seq long, content string")
    return made.unionByName(facts.select("*", F.lit("world").alias("network"), F.lit("fact").alias("kind")), allowMissingColumns=True)


def test_reflections_of_alike_findings(spark):
    table = assets(spark)

    def rows(findings, **how):
        out = reconcile.dedup_atomic(reflect.reflection_assets(findings, table), **how)
        p = F.col("provenance")
        shown = out.assets.select("*", p["source_turn_id"].alias("turn"), p["confidence_score"].alias("score")).drop("provenance")
        return sorted(map(repr, shown.collect())), sorted(map(repr, out.evidence.collect()))

    singly = reflect.reflect(table)
    alike = reflect.reflect(table, written=False, alike="rationale")
    assert rows(alike, written=False, repeating=False) == rows(singly, written=True, repeating=True)


def test_effects_of_alike_findings(spark):
    table = assets(spark, False)
    # An id with several scores is walked finding by finding.
    assert "n" not in reflect.reflect(table, written=False, alike="effect").columns
    table = table.dropDuplicates(["id"])
    own, _ = reflect.reflection_inputs(table)
    rows = lambda findings: sorted(map(repr, reflect.apply_effects(own, findings).collect()))
    assert rows(reflect.reflect(table, written=False, alike="effect")) == rows(reflect.reflect(table))


def test_queries_form_no_pairs(spark, tmp_path, monkeypatch):
    from workload import reflection

    monkeypatch.setattr(reflect, "_block_join", lambda *a: pytest.fail("pairs are formed"))
    monkeypatch.setattr(reflection, "memory_assets", lambda spark, sf: assets(spark, False).dropDuplicates(["id"]))
    for query in (reflection.x10, reflection.x11):
        query(spark, "")


@pytest.mark.parametrize("by_holder", [True, False])
def test_cells_over_many_batches(monkeypatch, by_holder):
    rng = random.Random(4)
    rows = sorted((rng.choice([b"a", b"b", b"b", b"c"]), rng.random() < 0.5, True, rng.randrange(50), f"h{rng.randrange(4)}", f"i{i}") for i in range(400))
    names = ["cell", "first", "later", "seq", "viewpoint_holder", "id"]
    table = pa.table({c: pa.array(v) for c, v in zip(names, zip(*rows))})
    shape = to_arrow_schema(T.StructType.fromDDL(reflect.ALIKE))
    found = {}
    for step, size in ((100_000, 400), (30, 7)):
        monkeypatch.setattr(reflect, "STEP", step)
        out = pa.Table.from_batches(reflect._alike(by_holder, shape)(iter(table.to_batches(size))), shape)
        found[step] = sorted((r["primary_id"], r["supporting_holder"] or "", r["n"]) for r in out.to_pylist())
    want = defaultdict(int)
    for c, first, _, s, h, i in rows:
        for c2, first2, _, s2, h2, _ in rows:
            if first and not first2 and c == c2 and s < s2 and h != h2:
                want[i, h2 if by_holder else ""] += 1
    assert found[30] == found[100_000] == sorted((*k, n) for k, n in want.items())
