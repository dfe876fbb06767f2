"""Every write obeys the rules: what breaks one is quarantined or fails the batch, and touches no store."""

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import vector
from mnemospark.operators import validate
from mnemospark.plans import ingest
from mnemospark.streaming import sinks
from test_pipeline import turn_table


def arrivals(spark):
    rows = ingest.arrivals_of(turn_table(spark, "Mojo is at Docks.", "Mojo likes tea.", "Ann is at Docks."), embedder=vector.hash_embedder())
    assert rows.count() > 0
    return rows.cache()


def spoilt(rows):
    """Each kind of fault on copies of the first fact, under ids of their own."""
    one = rows.filter("target = 'structured'").orderBy("seq").limit(1)
    p = F.col("provenance")
    faults = {
        "pair": one.withColumn("kind", F.lit("rule")),
        "unknown": one.withColumn("network", F.lit("nowhere")),
        "holder": one.withColumn("viewpoint_holder", F.lit("ann")),
        "score": one.withColumn("provenance", p.withField("confidence_score", F.lit(1.5))),
        "anchor": one.withColumn("provenance", p.withField("source_turn_id", F.lit("elsewhere"))),
        "time": one.withColumn("provenance", p.withField("temporal_range", p["temporal_range"].withField("turn_start", F.lit("")))),
        "empty": one.withColumn("content", F.lit("")),
        "bare": one.withColumn("kind", F.lit("lore")).withColumn("target", F.lit("vector")).withColumn("embedding", F.lit(None).cast("array<double>")),
        "short": one.withColumn("kind", F.lit("lore")).withColumn("target", F.lit("vector")).withColumn("embedding", F.array(F.lit(1.0))),
        "null": one.withColumn("provenance", F.lit(None).cast(one.schema["provenance"].dataType)),
    }
    out = None
    for n, (name, df) in enumerate(faults.items()):
        df = df.withColumn("id", F.lit(name)).withColumn("seq", F.lit(10**9 + n).cast("bigint"))
        out = df if out is None else out.unionByName(df)
    return out, set(faults)


def test_rows_are_accepted_or_quarantined(spark):
    rows = arrivals(spark)
    bad, names = spoilt(rows)
    judged = validate.checked(rows.unionByName(bad), dimension=256)
    assert judged.accepted.count() == rows.count()
    assert judged.accepted.columns == rows.columns
    told = {r.id: r.violations for r in judged.quarantined.collect()}
    assert set(told) == names and all(told.values())
    assert told["pair"] == [f"rule is not allowed in the {rows.first().network} network — permitted: world"]
    assert told["short"] == ["the embedding must have 256 numbers"] and told["bare"] == ["a lore snippet needs an embedding"]
    # Without a dimension any embedding will do.
    assert "short" not in {r.id for r in validate.checked(bad).quarantined.collect()}


def test_dedup_sink_quarantines(spark, tmp_path):
    rows = arrivals(spark)
    bad, names = spoilt(rows)
    clean = sinks.DedupSink(spark, str(tmp_path / "clean"), dimension=256)
    mixed = sinks.DedupSink(spark, str(tmp_path / "mixed"), dimension=256)
    a, b = clean(rows, 0), mixed(rows.unionByName(bad), 0)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert {r.id for r in mixed.quarantine.read().collect()} == names
    assert mixed.current_assets().count() == clean.current_assets().count()


def test_routed_sink_fails_or_replaces(spark, tmp_path):
    rows = arrivals(spark)
    bad, names = spoilt(rows)
    sink = sinks.RoutedSink(spark, str(tmp_path), dimension=256)
    for name in ("pair", "score", "bare", "short"):
        with pytest.raises(Exception, match=name):
            sink(bad.filter(F.col("id") == name), 5)
    sink(rows, 0)
    sink(rows.withColumn("content", F.lit("newer")), 1)
    now = sink.current()
    assert now.count() == rows.select("id").distinct().count() and {r.content for r in now.collect()} == {"newer"}


def test_batch_ingest_quarantines(spark):
    out = ingest.ingest_batch(turn_table(spark, "Mojo is at Docks."), embedder=vector.hash_embedder(), dimension=3)
    assert out.outcomes.count() > 0
    assert out.quarantined.filter("kind <> 'lore'").count() == 0
