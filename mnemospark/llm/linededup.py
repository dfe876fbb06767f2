"""Lines that repeat across documents, in DataFrame functions only.

Line hashes are range-partitioned with documents and positions as secondary sort; a window streams each hash' part and
marks the first line of every document. The answer is a compressed bitmap per document of the lines it keeps: only
words of 64 lines that lose some are stored. No text is shuffled to decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, settled, unique_name

#: Keys shorter than this many code points are left alone.
LEAST_LENGTH = 20
#: A key found in this many documents loses all its lines but those of one document.
LEAST_DOCS = 3
#: Parts that the documents of one key are dealt into, so that no key is streamed in one task.
PARTS = 64
BLANKS = " \t\n\x0b\f\r"


def lines_of(text: Column) -> Column:
    """The lines of a text; NULL and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, h1, h2) of every line whose key is long enough; h1 and h2 are a 128-bit hash of the key."""
    lines = docs.select("doc_id", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keys = lines.select("doc_id", "pos", F.btrim("line", F.lit(BLANKS)).alias("key")).filter(F.length("key") >= LEAST_LENGTH)
    keys = keys.select("doc_id", "pos", ascii_lower(F.col("key")).alias("key"))
    return keys.select("doc_id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos) of every line that goes."""
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")
    keys = settled(line_keys(docs.filter("doc_id IS NOT NULL")).withColumn("part", part))
    # A key and part is one range, and a very common key is several ranges; the window streams rows in this order.
    ranged = keys.repartitionByRange("h1", "h2", "part")
    stream = Window.partitionBy("h1", "h2", "part").orderBy(F.desc("doc_id"), "pos")
    first = F.coalesce(F.lag("doc_id").over(stream) != F.col("doc_id"), F.lit(True))
    marked = ranged.withColumn("first", first)
    parts = marked.filter("first").groupBy("h1", "h2", "part").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    common = parts.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last")).filter(F.col("n") >= LEAST_DOCS)
    return keys.join(common.select("h1", "h2", "last"), ["h1", "h2"]).filter("doc_id < last").select("doc_id", "pos")


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """(doc_id, words) for every document that loses lines: ``words`` maps w to a bitmap of lines 64w to 64w + 63 that are
    kept. Words that are not in the map keep all their lines."""
    word = F.shiftright("pos", 6)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos").bitwiseAND(63))
    gone = dropped_lines(docs).groupBy("doc_id", word.alias("w")).agg(F.bit_or(bit).alias("bits"))
    entry = F.struct("w", F.bitwise_not("bits").alias("bits"))
    return gone.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("words"))


def _kept(lines: Column, words: Column) -> Column:
    """The lines whose bit is set."""

    def keep(_: Column, i: Column) -> Column:
        word = F.element_at(words, F.shiftright(i, 6))
        return word.isNull() | (F.call_function("getbit", word, i.bitwiseAND(63)) == 1)

    return F.when(words.isNull(), lines).otherwise(F.filter(lines, keep))


def with_kept_lines(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ..) with ``n_lines`` before, ``n_dropped`` and the ``kept_text``.

    Repeated rows of an id are one document: they count once and lose the same lines by position (those of any of them). A row
    without an id counts nowhere and keeps its lines, and so does the largest id that holds a key. An empty table stays
    empty. Columns of ``docs`` with these names are replaced.
    """
    rest = docs.drop("n_lines", "n_dropped", "kept_text")
    lines, words, kept, own = (unique_name([*rest.columns, "n_lines", "n_dropped", "kept_text"], c) for c in ("lines", "words", "kept", "id"))
    bitmaps = keep_bitmaps(docs.select("doc_id", "text")).select(F.col("doc_id").alias(own), F.col("words").alias(words))
    joined = rest.join(bitmaps, F.col("doc_id") == F.col(own), "left").withColumn(lines, lines_of(F.col("text")))
    cut = joined.withColumn(kept, _kept(F.col(lines), F.col(words)))
    n = F.size(lines).cast("long")
    return cut.select(
        *rest.columns, n.alias("n_lines"), (n - F.size(kept)).alias("n_dropped"), F.array_join(kept, "\n").alias("kept_text")
    )
