"""Language identification by language-bitmask n-gram filters.

Each language has a Bloom filter of its typical character n-grams. The filters are stored bit-sliced: cell ``i`` holds
bit ``i`` of all languages, so one lookup (the bitwise and of a few cells) gives every language that contains the n-gram.
A document's n-grams are counted per language, the counts are corrected for false positives, and the largest decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import unique_name

#: Labelled rows a language's filter is fitted on, at most: those with the smallest id hashes, whole texts.
SAMPLE = 400
SIZES = (2, 3, 4)
BITS = 20
HASHES = 3
#: An n-gram is typical of a language if its rate there is this share of its highest rate in any language ..
SHARE = 0.4
#: .. and it occurs this often in the language's sample.
LEAST = 3
#: Documents scoring lower are rejected by the filter.
MIN_SCORE = 0.2
UNKNOWN = "und"

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)
_CHUNK = 1 << 18
_LETTER = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    if not _LETTER[97]:
        _LETTER[:] = [chr(c).isalpha() for c in range(0x110000)]
    return _LETTER


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Hashes of the whole text's n-grams, in pieces of bounded size: lower case, letters, one mark between words."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return
    points = np.where(letter, points, 0)
    edge = np.zeros(1, np.uint32)
    points = np.concatenate([edge, points[letter | np.append(True, letter[:-1])], edge])
    for i in range(0, len(points), _CHUNK):
        part = points[i : i + _CHUNK + max(SIZES) - 1].astype(np.uint64)
        state = part + np.uint64(1)
        for n in range(2, max(SIZES) + 1):
            if len(part) < n:
                break
            state = (state[:-1] ^ (state[:-1] >> np.uint64(29))) * _MIX + part[n - 1 :]
            if n in SIZES:
                yield state[:_CHUNK]


def cells_of(hashes: np.ndarray) -> list[np.ndarray]:
    mixed = hashes ^ (hashes >> np.uint64(32))
    return [((mixed * odd) >> np.uint64(64 - BITS)).astype(np.int64) for odd in _ODD[:HASHES]]


@dataclass
class Filters:
    """``slices[s][cell]`` has a bit for each of the languages 8s to 8s + 7; ``false[l]`` is a filter's false-positive rate."""

    languages: list[str]
    slices: np.ndarray
    false: np.ndarray
    common: int

    def counts(self, text: str | None) -> tuple[int, np.ndarray]:
        """The number of n-grams and, per language, how many its filter contains."""
        total, hits = 0, np.zeros(len(self.slices) * 8, np.int64)
        for part in grams(text):
            total += len(part)
            where = cells_of(part)
            for s, cells in enumerate(self.slices):
                mask = cells[where[0]]
                for w in where[1:]:
                    mask = mask & cells[w]
                hits[8 * s : 8 * s + 8] += np.bincount(mask, minlength=256) @ _BIT
        return total, hits[: len(self.languages)]

    def decide(self, text: str | None) -> tuple[str, float]:
        """The language and its corrected share of the n-grams, from 0 to 1. Ties go to the first in code point order."""
        total, hits = self.counts(text)
        if not total or not self.languages:
            return UNKNOWN, 0.0
        share = np.clip((hits / total - self.false) / (1 - self.false), 0, 1)
        best = int(share.argmax())
        return self.languages[best if share[best] > 0 else self.common], float(share[best])


#: Bit b of each byte value.
_BIT = (np.arange(256)[:, None] >> np.arange(8)[None, :] & 1).astype(np.int64)


def fit(rows: list[tuple[str, str]]) -> Filters:
    """Filters from (language, text) rows, which are few (see ``SAMPLE``)."""
    texts: dict[str, list[str]] = {}
    for lang, text in rows:
        texts.setdefault(lang, []).append(text)
    languages = sorted(texts)
    seen, amount = [], []
    for lang in languages:
        values, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for text in texts[lang]:
            for part in grams(text):
                new, n = np.unique(part, return_counts=True)
                at = np.searchsorted(values, new)
                known = at < len(values)
                known[known] = values[at[known]] == new[known]
                counts[at[known]] += n[known]
                values, counts = np.insert(values, at[~known], new[~known]), np.insert(counts, at[~known], n[~known])
        seen.append((values, counts))
        amount.append(max(1, counts.sum()))
    every = np.unique(np.concatenate([v for v, _ in seen])) if seen else np.zeros(0, np.uint64)
    rates = np.zeros((len(languages), len(every)))
    for i, (values, counts) in enumerate(seen):
        rates[i, np.searchsorted(every, values)] = counts / amount[i]
    top = rates.max(axis=0, initial=0)
    slices = np.zeros(((len(languages) + 7) // 8, 1 << BITS), np.uint8)
    false = np.zeros(len(languages))
    for i in range(len(languages)):
        own = every[(rates[i] >= SHARE * top) & (rates[i] * amount[i] >= LEAST - 0.5)]
        bit = np.uint8(1 << i % 8)
        for where in cells_of(own):
            slices[i // 8][where] |= bit
        false[i] = (slices[i // 8] & bit > 0).mean() ** HASHES
    common = max(range(len(languages)), key=lambda i: len(texts[languages[i]]), default=0)
    return Filters(languages, slices, np.minimum(false, 0.99), common)


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, sample: int = SAMPLE) -> Filters:
    """Filters learned from ``doc_id``, ``text`` and ``lang``: per language the ``sample`` rows with the smallest id hashes.

    Only those rows reach the driver: ``sample`` whole texts per language. Rows without text, label or id teach nothing.
    """
    rows = docs.filter("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out())
    ids = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    # Hashes are even, so those below this share hold the smallest ``sample`` of a language and few more: a language with
    # many rows is not ranked whole. Sizes are one row per language.
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("size"))
    low = F.col("h").cast("double") / 2.0**64 + 0.5 <= F.lit(4.0 * sample) / F.col("size")
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    few = ids.join(F.broadcast(sizes), "lang").filter(low).select("lang", "doc_id", "h").distinct()
    picked = few.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sample)
    # The picked ids are at most ``sample`` per language, so they may be broadcast: the texts are not shuffled.
    texts = rows.select("doc_id", "lang", "text").join(F.broadcast(picked.select("doc_id", "lang")), ["doc_id", "lang"])
    got = sorted(((r["lang"], r["doc_id"], r["text"]) for r in texts.distinct().collect()), key=lambda r: (r[0], r[1], r[2]))
    return fit([(lang, text) for lang, _, text in got])


def _predictor(filters: Filters):
    @F.pandas_udf("lang_pred string, score double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            yield pd.DataFrame([filters.decide(t) for t in part], columns=["lang_pred", "score"])

    return run


def with_language(docs: DataFrame, filters: Filters | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from the whole text alone.

    NULL texts and texts without a letter are ``und`` with score 0, and so is everything if nothing was learned. Texts
    whose n-grams are all unknown get the language with most rows and score 0. Repeated rows get the same answer.
    Columns of ``docs`` that have these names are replaced.
    """
    filters = filters or learn(docs)
    own = unique_name(docs.columns, "found")
    rest = docs.drop("lang_pred", "score")
    found = rest.withColumn(own, _predictor(filters)(F.col("text")))
    return found.select(*rest.columns, F.col(f"{own}.lang_pred"), F.col(f"{own}.score"))


def in_known_language(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows whose text is in one of the learned languages, columns unchanged: not ``und``, and ``min_score`` reached."""
    found = unique_name(docs.columns, "found")
    kept = docs.withColumn(found, _predictor(learn(docs))(F.col("text")))
    return kept.filter((F.col(f"{found}.lang_pred") != UNKNOWN) & (F.col(f"{found}.score") >= min_score)).drop(found)
