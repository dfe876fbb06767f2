"""MinHash fingerprints of whole texts.

A text's five-word shingles are hashed; every universal hash function (a x + b modulo 2^64) keeps its minimum over them,
in vectorised numpy, as 16 bits that do not depend on the minimum's size, which shrinks as texts grow. The share of equal
minima estimates the Jaccard similarity of two texts' shingle sets. For searches, bands of the signature are joined in Spark and Jaccard is verified on the sets themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_order_buckets, settled

SHINGLE = 5
HASHES = 128
#: 21 bands of 6 rows find a pair of similarity 0.8 with a probability of 0.998.
BANDS, ROWS = 21, 6
SIMILARITY = 0.8
SEED = 1
_CHUNK = 512
_REMEMBERED = 1 << 20
_RANDOM = np.random.default_rng(SEED)
_A = _RANDOM.integers(0, 1 << 64, HASHES, np.uint64, endpoint=False) | np.uint64(1)
_B = _RANDOM.integers(0, 1 << 64, HASHES, np.uint64, endpoint=False)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class Shingles:
    """64-bit hashes of a text's shingles: lower case, blank-separated words; a shorter text is one shingle, no words none."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        known = self.known
        if len(known) > _REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), SEED)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(SHINGLE, len(hashes))
        if not width:
            return hashes
        n = len(hashes) - width + 1
        state = np.full(n, width, np.uint64)
        for i in range(width):
            state = (state ^ (state >> np.uint64(31))) * _STEP + hashes[i : i + n]
        return state ^ (state >> np.uint64(29))


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of a mix of every hash function's minimum; all ones without shingles."""
    if not len(shingles):
        return np.full(HASHES, 0xFFFF, "<u2")
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), _CHUNK):
        value = _A[:, None] * shingles[None, i : i + _CHUNK]
        value += _B[:, None]
        np.minimum(low, value.min(axis=1), out=low)
    # The minimum over n shingles is about 2^64 / n: only mixed do its bits tell texts of any length apart.
    low = (low ^ (low >> np.uint64(30))) * _MIX[0]
    low = (low ^ (low >> np.uint64(27))) * _MIX[1]
    return ((low ^ (low >> np.uint64(31))) & np.uint64(0xFFFF)).astype("<u2")


def likeness(left: np.ndarray, right: np.ndarray) -> float:
    return float((left == right).mean())


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following``."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut] if cut else text


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs each own row with the row that follows it in its bucket; a guest only follows."""
    shingles, out, last = Shingles(), [], None
    for batch in batches:
        for bucket, guest, doc_id, text in zip(batch["bucket"], batch["guest"], batch["doc_id"], batch["text"]):
            text = text or ""
            if last is not None and last[0] != bucket:
                raise RuntimeError("a bucket ended without the document after it")
            if last is None and guest:
                continue
            own = signature(shingles(text))
            if last is not None:
                other = edited(last[2], text)
                changed = signature(shingles(other)) if other != last[2] else last[3]
                digest = hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((last[1], len(last[2]), digest, last[3].tobytes().hex(), changed.tobytes().hex(), likeness(last[3], changed), likeness(last[3], own)))
            last = None if guest else (bucket, None if pd.isna(doc_id) else int(doc_id), text, own)
            if len(out) >= 256:
                yield _frame(out)
                out = []
    if last is not None:
        raise RuntimeError("a bucket ended without the document after it")
    if out:
        yield _frame(out)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_COLUMNS)
    frame["doc_id"] = pd.array(frame["doc_id"], "Int64")
    return frame


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint and that of its edited text, whose end is the start of the next document.

    The next document has the next smaller id (the largest, for the smallest). Rows are shuffled once, into ranges of ids;
    the first document of each range also goes, as a guest, to the range before it, so a task holds two texts at a time.
    A NULL text is empty and a NULL id comes after all others. Rows that share an id are ordered by text hash. A single
    document is its own next. Texts without words have an all-ones fingerprint. An empty table gives no rows.
    """
    placed, bounds = in_order_buckets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "bucket")
    least = F.lit(-(1 << 63)).cast("long")
    keyed = placed.withColumn("k", F.coalesce("doc_id", least)).withColumn("h", F.xxhash64("text"))
    # One row per range, so at most the number of bounds and one.
    heads = dict(keyed.groupBy("bucket").agg(F.max("k")).collect())
    order = sorted(heads)
    host = {heads[b]: order[(i + 1) % len(order)] for i, b in enumerate(order)}
    if not host:
        return docs.sparkSession.createDataFrame([], _SCHEMA)
    to = F.create_map(*[F.lit(x).cast("long") for pair in host.items() for x in pair])[F.col("k")]
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(to.cast("int").alias("bucket"), F.lit(True).alias("guest"))
    places = F.when(to.isNull(), F.array(own)).otherwise(F.array(own, guest))
    rows = keyed.withColumn("place", F.explode(places)).select("place.bucket", "place.guest", "k", "h", "doc_id", "text")
    rows = rows.repartition(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", "guest", F.desc("k"), "h")
    return rows.select("bucket", "guest", "doc_id", "text").mapInPandas(_walk, _SCHEMA)


def _bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shingles = Shingles()
    for batch in batches:
        sets = [np.unique(shingles(t)) for t in batch["text"]]
        keys = []
        for s in sets:
            parts = signature(s)[: BANDS * ROWS].reshape(BANDS, ROWS)
            keys.append([int.from_bytes(xxhash.xxh64_digest(bytes([i]) + p.tobytes())[:8], "little", signed=True) for i, p in enumerate(parts)] if len(s) else [])
        yield pd.DataFrame({"id": batch["id"], "bands": keys, "shingles": [s.view(np.int64) for s in sets]})


def near_matches(queries: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(query_id, doc_id, jaccard) of every query and other document of at least this similarity, by (doc_id, text) tables.

    Bands of both sides meet by an equi-join; distinct candidate pairs are verified on the exact shingle sets. Texts without
    words match nothing. Ids must be unique and not NULL on each side.
    """
    schema = "id long, bands array<long>, shingles array<long>"

    def side(df: DataFrame) -> DataFrame:
        return settled(df.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "text").mapInPandas(_bands, schema))

    q, d = side(queries), side(docs)
    pairs = q.select(F.col("id").alias("query_id"), F.explode("bands").alias("band")).join(
        d.select(F.col("id").alias("doc_id"), F.explode("bands").alias("band")), "band"
    )
    pairs = pairs.filter("query_id <> doc_id").select("query_id", "doc_id").distinct()
    full = pairs.join(q.select(F.col("id").alias("query_id"), F.col("shingles").alias("a")), "query_id")
    full = full.join(d.select(F.col("id").alias("doc_id"), F.col("shingles").alias("b")), "doc_id")
    both = F.size(F.array_intersect("a", "b"))
    found = full.withColumn("jaccard", both / (F.size("a") + F.size("b") - both))
    return found.filter(F.col("jaccard") >= similarity).select("query_id", "doc_id", "jaccard")
