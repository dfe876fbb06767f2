"""Phrases that recur far more often than their parts, by relational mining (SETM).

The corpus is a relation of word occurrences (piece, position, word), kept in blocks of whole texts in the order of their
positions: a block has the words' 64-bit keys and the gaps between their positions, and a new piece leaves a gap of more
than one. The relation of a length is merge-joined with itself at the adjacent position, which gives the occurrences that
are one word longer; these are counted by group, and only occurrences of frequent groups are written as the next
relation. Blocks never move: what is shuffled is counts, added up per task first.

The semi-join tests a bit set of the frequent groups, which has a fixed bound and so can go to every task. A group that
passes by chance is counted and then fails the exact count, as every part of a frequent phrase is frequent itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settled

#: Occurrences that make a phrase frequent, words of the longest phrase, phrases reported per language.
LEAST, LONGEST, MOST = 30, 4, 2000
#: A phrase goes if a longer one has this share (in percent) of its occurrences.
SHARE = 80
SCALE = 2_000_000
NO_LANG = "und"
#: Words of a block, about (a text is never cut), and occurrences that a task counts before it gives partial counts.
BLOCK, COUNTED = 1 << 16, 1 << 19
#: Words whose keys a task remembers.
REMEMBERED = 1 << 18
#: Bits per group of a bit set, and the most bits that any has (128 MB).
BITS, MOST_BITS = 16, 1 << 30
SEGMENT = 1 << 16
#: Blocks travel to Python in batches of about this size, whatever the session's setting: two tasks hold a few of them.
BATCH = "8m"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_BREAK = b"\xff"  # in no UTF-8 text
_BYTES = bytes(_BREAK[0] if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_OCCURRENCES = "gap array<int>, w array<long>, lang string, word string, key long, n long"
_RELATION = "gap array<int>, w array<long>, start array<boolean>"


def _schema(ddl: dict[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(ddl.items()))


_INTS, _LONGS = pa.list_(pa.int32()), pa.list_(pa.int64())
_READ = _schema({"gap": _INTS, "w": _LONGS, "lang": pa.string(), "word": pa.string(), "key": pa.int64(), "n": pa.int64()})
_KEPT = _schema({"gap": _INTS, "w": _LONGS, "start": pa.list_(pa.bool_())})


class _Words(dict):
    """Numbers of a language's words in the order of their coming; 0 is the break between pieces."""

    def __init__(self, lang: str, seed: int):
        super().__init__({_BREAK: 0})
        self.lang, self.seed, self.words = lang, seed, [_BREAK]
        self.keys, self.counts = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.block: list[np.ndarray] = []
        self.size = 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        return n

    def add(self, text: bytes) -> None:
        words = text.translate(_BYTES).replace(_BREAK, b" \xff ").split()
        words.append(_BREAK)
        self.block.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
        self.size += len(words)

    def relation(self) -> pa.RecordBatch | None:
        """The block as one row."""
        fresh, start = self.words[len(self.keys) :], f"{self.seed}:{self.lang}\0".encode()
        new = np.fromiter((xxhash.xxh64_intdigest(start + w) for w in fresh), np.uint64, len(fresh)).view(np.int64)
        self.keys = np.concatenate([self.keys, new])
        numbers = np.concatenate(self.block)
        self.block, self.size = [], 0
        self.counts = np.concatenate([self.counts, np.zeros(len(self.keys) - len(self.counts), np.int64)])
        at = np.flatnonzero(numbers)
        if not len(at):
            return None
        numbers = numbers[at]
        self.counts += np.bincount(numbers, minlength=len(self.keys))
        gap = np.diff(at, prepend=0).astype(np.int32)
        return pa.record_batch([_row(gap, pa.int32()), _row(self.keys[numbers], pa.int64()), *[pa.nulls(1, f.type) for f in list(_READ)[2:]]], schema=_READ)

    def totals(self) -> Iterator[pa.RecordBatch]:
        words = np.flatnonzero(self.counts)
        for i in range(0, len(words), 1 << 16):
            part = words[i : i + (1 << 16)]
            n = len(part)
            text = pa.array([self.words[j].decode("utf-8", "replace") for j in part.tolist()], pa.string())
            columns = [pa.nulls(n, _INTS), pa.nulls(n, _LONGS), pa.array([self.lang] * n, pa.string()), text]
            yield pa.record_batch([*columns, pa.array(self.keys[part]), pa.array(self.counts[part])], schema=_READ)


def _row(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _reader(seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Words] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                words = known.get(lang) or known.setdefault(lang, _Words(lang, seed))
                words.add(text.as_py())
                if words.size >= BLOCK:
                    if row := words.relation():
                        yield row
                    if sum(map(len, known.values())) > REMEMBERED:
                        full = known.pop(max(known, key=lambda x: len(known[x])))
                        if full.block and (row := full.relation()):
                            yield row
                        yield from full.totals()
        for words in known.values():
            if words.block and (row := words.relation()):
                yield row
            yield from words.totals()

    return run


def occurrences(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The relation of all word occurrences, written: blocks (gap, w) and, as rows of their own, counts (lang, word, key, n)."""
    lang = F.coalesce(F.col("lang"), F.lit(NO_LANG)).alias("lang")
    rows = docs.filter("text IS NOT NULL").select(lang, F.col("text").cast("binary").alias("text"))
    return settled(rows.mapInArrow(_reader(seed), _OCCURRENCES))


def _mixed(words: list[np.ndarray]) -> np.ndarray:
    """64 bits for every group of words (hashes)."""
    out = words[0].view(np.uint64) * _TURN
    for w in words[1:]:
        out = (out ^ (out >> np.uint64(29))) * _STEP + w.view(np.uint64)
    out = (out ^ (out >> np.uint64(32))) * _TURN
    return out ^ (out >> np.uint64(32))


def _places(words: list[np.ndarray], power: int) -> tuple[np.ndarray, np.ndarray]:
    h = _mixed(words)
    return h >> np.uint64(64 - power), (h * _STEP) >> np.uint64(64 - power)


class BitSet:
    """Tells which groups are in a set; a few others pass too."""

    def __init__(self, power: int, bits: np.ndarray):
        self.power, self.bits = power, bits

    def has(self, words: list[np.ndarray]) -> np.ndarray:
        out = np.ones(len(words[0]), bool)
        for place in _places(words, self.power):
            out &= (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def bit_set(groups: DataFrame, length: int) -> BitSet:
    """Of frequent groups (w1, w2, ..): 16 bits a group as a power of two, at most 128 MB, put together in segments."""
    n = groups.count()
    power = min(MOST_BITS.bit_length() - 1, max(SEGMENT.bit_length() - 1, (n * BITS).bit_length()))
    names = [f"w{i + 1}" for i in range(length)]

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            place = np.concatenate(_places([b[c].to_numpy(np.int64) for c in names], power)).astype(np.int64)
            yield pd.DataFrame({"segment": place // SEGMENT, "bit": place % SEGMENT})

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for segment, rows in b.groupby("segment"):
                found.setdefault(segment, np.zeros(SEGMENT, bool))[rows["bit"].to_numpy()] = True
        for segment, bits in found.items():
            yield pd.DataFrame({"segment": [segment], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    dealt = groups.select(names).mapInPandas(places, "segment long, bit int").repartition("segment")
    bits = np.zeros((1 << power) // 8, np.uint8)
    # The segments together have at most 128 MB, at any size of the input.
    for row in dealt.mapInPandas(segments, "segment long, bits binary").collect():
        part = np.frombuffer(row.bits, np.uint8)
        bits[row.segment * len(part) : (row.segment + 1) * len(part)] = part
    return BitSet(power, bits)


def _blocks(batch: pa.RecordBatch, first: BitSet | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A relation's blocks: positions, words, and indices where its phrases start (single words: the frequent ones)."""
    gaps, words = batch.column("gap"), batch.column("w")
    ends, gap, word = gaps.offsets.to_numpy(), gaps.values.to_numpy(), words.values.to_numpy()
    flags = None if first else batch.column("start").values.to_numpy(zero_copy_only=False)
    for a, b in zip(ends, ends[1:]):
        w = word[a:b]
        yield np.cumsum(gap[a:b], dtype=np.int64), w, np.flatnonzero(first.has([w]) if first else flags[a:b])


def _longer(at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sorted relation joined with itself at the next position: where phrases of one more word start."""
    place = at[starts]
    return starts[:-1][place[1:] == place[:-1] + 1]


def _counter(length: int, first: BitSet | None) -> Callable:
    """Partial counts of all phrases of ``length`` words that two frequent shorter ones make."""
    names = [f"w{i + 1}" for i in range(length)]

    def counted(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        words = [np.concatenate([p[i] for p in parts]) for i in range(length)]
        order = np.argsort(_mixed(words))
        words = [w[order] for w in words]
        new = np.concatenate([[True], np.logical_or.reduce([w[1:] != w[:-1] for w in words])])
        cut = np.flatnonzero(new)
        n = np.diff(np.append(cut, len(new)))
        return pa.record_batch([pa.array(w[cut]) for w in words] + [pa.array(n)], names=[*names, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for at, w, starts in _blocks(batch, first):
                found = _longer(at, starts)
                if len(found):
                    parts.append([w[found + i] for i in range(length)])
                    size += len(found)
                if size >= COUNTED:
                    yield counted(parts)
                    parts, size = [], 0
        if parts:
            yield counted(parts)

    return run


def _keeper(length: int, first: BitSet | None, frequent: BitSet) -> Callable:
    """The occurrences of frequent phrases of ``length`` words, with their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, w, starts in _blocks(batch, first):
                found = _longer(at, starts)
                if len(found):
                    found = found[frequent.has([w[found + i] for i in range(length)])]
                if not len(found):
                    continue
                needed, start = np.zeros(len(w), bool), np.zeros(len(w), bool)
                for i in range(length):
                    needed[found + i] = True
                start[found] = True
                gap = np.diff(at[needed], prepend=0).astype(np.int32)
                flags = pa.ListArray.from_arrays(pa.array([0, len(gap)], pa.int32()), pa.array(start[needed]))
                yield pa.record_batch([_row(gap, pa.int32()), _row(w[needed], pa.int64()), flags], schema=_KEPT)

    return run


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_BATCH_BYTES, None)
    spark.conf.set(_BATCH_BYTES, BATCH)
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_BYTES) if before is None else spark.conf.set(_BATCH_BYTES, before)


def _words(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The occurrences and the table of all words (lang, word, key, n). Keys are different for different words: in the
    unlikely case that two of 2^64 meet, the next seed is taken."""
    for seed in range(8):
        rows = occurrences(docs, seed)
        # A task's counts are added up already, so they are dealt out first and added up once.
        parts = rows.filter("word IS NOT NULL").select("lang", "word", "key", "n").repartition("lang", "word", "key")
        counts = parts.groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))
        words = settled(counts)
        if words.groupBy("key").count().filter("count > 1").isEmpty():
            return rows.filter("w IS NOT NULL").select("gap", "w"), words
    raise RuntimeError("no seed gives every word a key of its own")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(phrase, n): all phrases of up to ``longest`` words, as arrays of word keys, with at least ``least`` occurrences; and
    the table of all words (lang, word, key, n)."""
    relation, words = _words(docs)
    groups = settled(words.filter(F.col("n") >= least).select(F.col("key").alias("w1"), "n"))
    found = [groups]
    first = bit_set(groups, 1)
    for length in range(2, longest + 1):
        names = [f"w{i + 1}" for i in range(length)]
        schema = ", ".join(f"{c} long" for c in [*names, "n"])
        parts = relation.mapInArrow(_counter(length, first), schema).repartition(*names)
        counts = parts.groupBy(*names).agg(F.sum("n").alias("n"))
        found.append(settled(counts.filter(F.col("n") >= least)))
        if length < longest:
            relation = settled(relation.mapInArrow(_keeper(length, first, bit_set(found[-1], length)), _RELATION))
            first = None
    tables = [t.select(F.array(*[c for c in t.columns if c != "n"]).alias("phrase"), "n") for t in found]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out, words


def _wide(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHARE, most: int = MOST) -> DataFrame:
    """Each language's first ``most`` phrases of 2 to ``longest`` words, from ``docs`` (lang, text).

    Texts are lower-cased (A-Z), cut at ``.,;:!?`` and line ends into pieces, and these at blanks into words; a NULL text
    has none, and a NULL lang is the language ``und``. A phrase with a occurrences, cut after k words into parts with l
    and r, scores floor(2,000,000 a / (l + r)); its lowest cut counts, the smallest k of equal ones. It goes if a longer
    frequent phrase that holds it has ``share`` percent of its occurrences. Order: score, a (largest first), phrase.
    Columns: lang, rank, phrase, a, l, r, n (words of the language), score. An empty table gives no rows.
    """
    with _small_batches(docs.sparkSession):
        phrases, words = frequent_phrases(docs, least, longest)
        phrases = settled(phrases)
    size = F.size("phrase")
    several = phrases.filter(size > 1).withColumnRenamed("n", "a")
    spans = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.slice("phrase", i, k)))))
    inside = several.filter(size > 2).select(spans.alias("phrase"), "a").groupBy("phrase").agg(F.max("a").alias("longer"))
    covered = _wide(F.col("longer")) * 100 >= _wide(F.col("a")) * share
    alone = several.join(inside, "phrase", "left").filter(F.col("longer").isNull() | ~covered).select("phrase", "a")
    cuts = alone.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("phrase", "a", "k", F.slice("phrase", F.lit(1), F.col("k")).alias("left"), F.slice("phrase", F.col("k") + 1, size).alias("right"))
    lefts = phrases.join(words.select(F.array("key").alias("phrase"), "lang"), "phrase", "left").select(F.col("phrase").alias("left"), F.col("n").alias("l"), "lang")
    rights = phrases.select(F.col("phrase").alias("right"), F.col("n").alias("r"))
    parts = cuts.join(lefts, "left").join(rights, "right")
    score = F.expr(f"CAST({SCALE} AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    lowest = F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("cut")
    scored = parts.groupBy("phrase", "a").agg(lowest, F.max("lang").alias("lang")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    # Ties at the end stay until their texts are known.
    top = scored.withColumn("place", F.rank().over(by_score)).filter(F.col("place") <= most).drop("place")
    spelt = top.select("phrase", F.posexplode("phrase").alias("i", "key")).join(words.select("key", "word"), "key")
    spelt = spelt.groupBy("phrase").agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("words"))
    named = top.join(spelt, "phrase").withColumn("phrase", F.array_join("words.word", " "))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    ranked = named.withColumn("rank", F.row_number().over(by_score.orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    return ranked.filter(F.col("rank") <= most).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
