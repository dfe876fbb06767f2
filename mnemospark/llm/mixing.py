"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

A source's target is a share of all words; every document of a source expects the same number of copies. Documents are
lined up within their source by size, expected copies are summed along the line from one random offset, and a document is
emitted once per integer that its part of the sum crosses. As neighbours are about equally long, the words taken differ
from the target by a few documents at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS_WORD, settled, unique_name

#: Weights by the order of the sources' names, repeating.
WEIGHTS = (1, 2, 3)
#: No document is taken more often.
MOST = 3
SEED = 42
#: Parts that the documents of one source and size are dealt into, so that none is ranked in one task.
PARTS = 1024


def words(text: Column) -> Column:
    """The number of words of a text; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(BLANKS_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Targets from (source, size) rows, one per source and size with ``n`` documents, as (source, source_size, target).

    Targets share all words by weight, NULL last in the order of names, at most ``most`` times a source's size. What is
    above goes to the other sources by weight until none is above: if sources come by the level (cap over weight) at
    which they fill up, the final level is the highest of (words left) / (weight left). The windows run over one row
    per source.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    rows = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth.cast("int")))
    rows = rows.withColumn("cap", F.col("source_size").cast("double") * most)
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = rows.withColumn("level", left / weight)
    top = F.max("level").over(every)
    return level.select("source", "source_size", F.least("cap", F.col("weight") * top).alias("target"))


def offset(source: Column, seed: int = SEED) -> Column:
    """A source's random offset from 0 to 1, the same in every run."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 5), 16, 10).cast("double") / (1 << 20)


def with_copies(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source, ..) with ``size``, ``source_size``, ``target`` and ``copies``.

    Ranks along the line come from four levels of sums: sources and sizes, parts of one size, rows of a part. So the
    largest window holds a ``PARTS``-th of the rows of one source and size, and rows are shuffled once. A NULL text has size
    0, NULL is a source of its own, and a NULL id is lined up first. Rows that share an id count each; they are told
    apart by text. An empty table stays empty. Columns of ``docs`` with these names are replaced.
    """
    new = ["size", "source_size", "target", "copies"]
    rest = docs.drop(*new)
    name, part, rank, before = (unique_name([*rest.columns, *new], c) for c in ("name", "part", "rank", "before"))
    dealt = F.coalesce(F.pmod(F.col("doc_id"), F.lit(PARTS)), F.lit(-1)).cast("int")
    named = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    sized = rest.withColumn("size", words(F.col("text"))).withColumn(part, dealt).withColumn(name, named)
    counts = settled(sized.groupBy("source", name, "size", part).agg(F.count("*").alias("n")))
    sizes = counts.groupBy("source", name, "size").agg(F.sum("n").alias("n"))
    past = (Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    by_size = F.coalesce(F.sum("n").over(Window.partitionBy(name).orderBy("size").rowsBetween(*past)), none)
    by_part = F.coalesce(F.sum("n").over(Window.partitionBy(name, "size").orderBy(part).rowsBetween(*past)), none)
    goals = targets(sizes).withColumn(name, named).drop("source")
    lines = counts.select(name, "size", part, by_part.alias("b")).join(sizes.select(name, "size", by_size.alias("a")), [name, "size"])
    lines = lines.select(name, "size", part, (F.col("a") + F.col("b")).alias(before)).join(goals, name)
    within = Window.partitionBy(name, "size", part).orderBy("doc_id", F.xxhash64("text"))
    joined = sized.withColumn(rank, F.row_number().over(within)).join(lines, [name, "size", part])
    at = F.col(before) + F.col(rank)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    u = offset(F.col("source"), seed)
    copies = (F.floor(u + rate * at) - F.floor(u + rate * (at - 1))).cast("int")
    return joined.withColumn("copies", copies).select(*rest.columns, *new)


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, columns unchanged."""
    own = [c for c in docs.columns if c.lower() in ("size", "source_size", "target", "copies")]
    kept = {c: unique_name(docs.columns, f"kept_{c}") for c in own}
    out = with_copies(docs.withColumnsRenamed(kept), seed).filter("copies > 0")
    times = out.withColumn(unique_name(out.columns, "nth"), F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return times.select(*[F.col(kept.get(c, c)).alias(c) for c in docs.columns])
