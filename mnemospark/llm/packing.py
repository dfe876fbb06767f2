"""Documents packed into sequences of equal length, as a cutting-stock problem solved by column generation.

A document is its token ids and an end id. Whole sequences are cut off its start; what remains is shorter than a sequence
and counts in a histogram of lengths, whose size does not depend on the corpus. Over length classes of the histogram a
linear program chooses patterns (which classes share a sequence, and how often): a knapsack by dynamic programming prices
new patterns until none helps. Uses are rounded, the rest is filled up greedily, and the worst filled sequences are given
back until there are no more than the tokens need. Documents are ranked among those of their length and take the
places of their rank, which tables of lengths and patterns give in closed form: no sequence is looked for. The documents
given back are cut to fill what the others leave, and the last of them fills sequences of a power of two, so nothing is padded.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

#: Tokens of a sequence; lengths that make one class; the id that ends a document.
LENGTH, GRAIN, END_ID = 2048, 8, 1
#: Chunks of text whose ids a task remembers, and texts encoded together.
REMEMBERED, TOGETHER = 1 << 20, 256
_GAP = 1e-4

_ENCODED = "doc_id long, ids binary, n long, block int, nth long, before long"
_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_PIECE = pa.schema([(c, pa.binary() if c == "ids" else pa.int64()) for c in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")])


# Token ids


#: How the vocabulary writes a blank, and signs that are neither letters nor numbers nor start a contraction.
_BLANK, _SIGNS = "\u0120", ".,;:!?#$%&*()[]{}-_=+/@^~\""
_RUNS = regex.compile(r"\s\s")
_SPACED = regex.compile(r"(\s*)(\S+)")


class _Numbers(dict):
    """Chunks in the order of their coming; number 0 ends a document."""

    def __init__(self):
        super().__init__({None: 0})
        self.order: list[str | None] = [None]

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self.order)
        self.order.append(chunk)
        return n


class Encoder:
    """Ids of texts as little-endian 32-bit integers. A byte-level tokenizer of this kind never joins what is before a blank that
    follows a visible character with what comes after it, so texts are encoded chunk by chunk. Chunks are numbered, and the ids
    of the numbers of many texts are gathered together from one array."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.starts = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.starts[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(_BLANK)]] = True
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.ids = _Numbers(), np.array([END_ID], "<u4")
        self.begin, self.size = np.zeros(1, np.int64), np.ones(1, np.int64)

    def chunks(self, text: str) -> list[str]:
        """Where single blanks and line ends stand between visible characters, the text is cut before a blank and on both sides
        of a line end; a longer run of white space stays with what follows it."""
        if not ("\x1f" in text or _RUNS.search(text) or text[:1].isspace() or text[-1:].isspace()):
            return text.replace(" ", "\x1f ").replace("\n", "\x1f\n\x1f").split("\x1f") if text else []
        out, size = [], 0
        for gap, word in _SPACED.findall(text):
            out += [gap, word] if gap == "\n" and size else [gap + word]
            size += len(gap) + len(word)
        return [*out, text[size:]] if size < len(text) else out

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of words that start with a blank, encoded as one text and cut at the tokens that start with one."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.starts[ids])
        if len(cuts) == len(words) and cuts[0] == 0:
            return ids, np.diff(np.append(cuts, len(ids)))
        return self._apart(words)

    def _apart(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(coded), "<u4"), np.fromiter(map(len, coded), np.int64, len(coded))

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[numbers]
        shift = self.begin[numbers] - (np.cumsum(size) - size)
        return self.ids[np.repeat(shift, size) + np.arange(int(size.sum()))], size

    def _store(self, numbers: list[int], found: list[tuple[np.ndarray, np.ndarray]]) -> None:
        if numbers:
            size = np.concatenate([n for _, n in found])
            self.begin[numbers], self.size[numbers] = len(self.ids) + np.cumsum(size) - size, size
            self.ids = np.concatenate([self.ids, *[ids for ids, _ in found]])

    def _learn(self) -> None:
        """Encode the chunks that have numbers but no ids yet: words together, signs at their ends alone."""
        numbers, order, known = self.numbers, self.numbers.order, len(self.size)
        ends = {i: (numbers[e[0]], numbers[e[1]]) for i in range(known, len(order)) if len(e := _ends(order[i])) > 1}
        blank = np.zeros(len(order) - known, np.int64)
        self.begin, self.size = np.concatenate([self.begin, blank]), np.concatenate([self.size, blank])
        simple = [i for i in range(known, len(order)) if i not in ends]
        words = [i for i in simple if order[i][:1] == " " and order[i][1:].isalpha()]
        rest = sorted(set(simple).difference(words))
        for some, encode in ((words, self._words), (rest, self._apart)):
            parts = [some[i : i + 512] for i in range(0, len(some), 512)]
            self._store(some, [encode([order[i] for i in part]) for part in parts])
        if ends:
            ids, size = self._gather(np.array(list(ends.values())).ravel())
            self._store(list(ends), [(ids, size.reshape(-1, 2).sum(axis=1))])

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.numbers) > REMEMBERED:
            self._forget()
        parts = [[*self.chunks(t), None] for t in texts]
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        numbers = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(parts)), np.int64, int(n.sum()))
        if len(self.numbers) > len(self.size):
            self._learn()
        ids, size = self._gather(numbers)
        ends = np.cumsum(size)[np.cumsum(n) - 1].tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *ends], ends)]


def _ends(chunk: str) -> tuple[str, ...]:
    """Signs after a letter, up to the end of the chunk, are encoded alone: the tokenizer cuts there."""
    word = chunk.rstrip(_SIGNS)
    return (word, chunk[len(word) :]) if word and len(word) < len(chunk) and word[-1].isalpha() and word[-1] < "\u0250" else (chunk,)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _tokens(path: str, length: int) -> Callable:
    """Encodes a task's rows and numbers them: ``nth`` among those whose remainder is as long, ``before`` whole sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, block = _encoder(path), TaskContext.get().partitionId()
        seen, whole = np.zeros(length, np.int64), 0
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                rows = batch.slice(i, TOGETHER)
                ids = coder.encode([t or "" for t in rows.column("text").to_pylist()])
                n = np.array([len(x) // 4 for x in ids], np.int64)
                nth = np.empty(len(n), np.int64)
                for j, tail in enumerate((n % length).tolist()):
                    nth[j] = seen[tail]
                    seen[tail] += 1
                before = whole + np.cumsum(n // length) - n // length
                whole += int((n // length).sum())
                columns = [rows.column("doc_id"), pa.array(ids, pa.binary()), pa.array(n), pa.array([block] * len(n), pa.int32()), pa.array(nth), pa.array(before)]
                yield pa.record_batch(columns, names=["doc_id", "ids", "n", "block", "nth", "before"])

    return run


# Patterns


def _knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of classes that fits, by dynamic programming over the room: its value and counts."""
    best, taken = np.zeros(room + 1), np.full(room + 1, -1)
    for r in range(1, room + 1):
        n = np.searchsorted(sizes, r, "right")
        best[r] = best[r - 1]
        if n:
            sums = values[:n] + best[r - sizes[:n]]
            i = int(sums.argmax())
            if sums[i] > best[r]:
                best[r], taken[r] = sums[i], i
    counts, r = np.zeros(len(sizes), np.int64), room
    while r > 0:
        if taken[r] < 0:
            r -= 1
        else:
            counts[taken[r]] += 1
            r -= sizes[taken[r]]
    return float(best[room]), counts


def patterns(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The linear relaxation by column generation: patterns (one row each, counts per class) and how often each is used.

    The revised simplex method starts with one pattern per class; duals price the knapsack. It ends when no pattern has a
    value above 1, or when the bound on what is left to gain is below a ten-thousandth. ``sizes`` ascend, demands are positive.
    """
    m = len(sizes)
    columns = np.diag(room // sizes).astype(np.int64)
    inverse, uses = np.diag(1.0 / (room // sizes)), demand / (room // sizes)
    for _ in range(200 * m):
        duals = inverse.sum(axis=0)
        value, pattern = _knapsack(duals, sizes, room)
        # Dual values over the best pattern's value are feasible, so this bounds the optimum from below.
        if value <= 1 + 1e-9 or uses.sum() * (1 - 1 / value) <= _GAP * uses.sum():
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, uses / np.where(step > 1e-9, step, 1.0), np.inf)
        out = int(ratio.argmin())
        uses = np.maximum(uses - ratio[out] * step, 0.0)
        uses[out] = ratio[out]
        inverse[out] /= step[out]
        others = step.copy()
        others[out] = 0.0
        inverse -= np.outer(others, inverse[out])
        columns[:, out] = pattern
    return columns.T, uses


def _rounded(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole uses that serve exactly the demand: the program's, rounded down, then the rest first fit decreasing."""
    if not len(sizes):
        return []
    left, out = demand.copy(), []
    columns, uses = patterns(sizes, demand.astype(float), room)
    for pattern, use in zip(columns, np.floor(uses + 1e-6).astype(np.int64)):
        used = pattern > 0
        use = min(int(use), int((left[used] // pattern[used]).min())) if used.any() else 0
        if use > 0:
            left -= use * pattern
            out.append((pattern.copy(), use))
    while left.any():
        # What rounding leaves is less than one sequence per pattern.
        pattern, free = np.zeros(len(sizes), np.int64), room
        for i in np.flatnonzero(left)[::-1]:
            pattern[i] = min(left[i], free // sizes[i])
            free -= pattern[i] * sizes[i]
        use = int((left[pattern > 0] // pattern[pattern > 0]).min())
        left -= use * pattern
        out.append((pattern, use))
    return out


@dataclass
class Plan:
    """Where the remainders go. ``first``, ``sequence``, ``offset``: per length, documents from rank ``first`` on take the
    sequences from ``sequence`` on, one each, at ``offset``; sequence -1 marks documents that are cut, from place
    ``offset`` of all tokens to be cut. ``gap_place``, ``gap_size``, ``gap_sequence``, ``gap_offset``: runs of sequences
    with equal gaps, and the place from which the cut tokens fill them."""

    first: dict[int, np.ndarray] = field(default_factory=dict)
    sequence: dict[int, np.ndarray] = field(default_factory=dict)
    offset: dict[int, np.ndarray] = field(default_factory=dict)
    gap_place: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    gap_size: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    gap_sequence: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    gap_offset: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sequences: int = 0


def plan(histogram: dict[int, int], length: int = LENGTH, grain: int = GRAIN) -> Plan:
    """From the numbers of remainders of each length (1 to ``length`` - 1) make the plan: all of it is bounded by ``length``."""
    lengths = np.array(sorted(n for n, c in histogram.items() if n > 0 and c > 0), np.int64)
    counts = np.array([histogram[n] for n in lengths.tolist()], np.int64)
    classes = -(-lengths // grain)
    sizes, of = np.unique(classes, return_inverse=True)
    demand = np.bincount(of, weights=counts, minlength=len(sizes)).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
    total = int((lengths * counts).sum())
    found = _rounded(sizes, demand, length // grain)
    # Give back the worst filled sequences: as many whole sequences stay as the tokens can fill.
    back = max(0, sum(u for _, u in found) - total // length)
    found.sort(key=lambda x: int(x[0] @ sizes))
    kept = []
    for pattern, use in found:
        less = min(back, use)
        back -= less
        if use > less:
            kept.append((pattern, use - less))
    ends = np.cumsum(counts)
    starts = np.array([ends[i - 1] if i and of[i - 1] == of[i] else 0 for i in range(len(lengths))], np.int64)
    base = np.array([ends[np.flatnonzero(of == c)[0]] - counts[np.flatnonzero(of == c)[0]] for c in range(len(sizes))], np.int64)
    # Ranks within a class, shorter lengths first.
    low = np.array([starts[i] - base[of[i]] if starts[i] else 0 for i in range(len(lengths))], np.int64)
    bounds = [np.append(low[of == c], demand[c]) for c in range(len(sizes))]
    names = [lengths[of == c] for c in range(len(sizes))]
    served, out, places, gaps, sequence = np.zeros(len(sizes), np.int64), Plan(), {}, [], 0
    for pattern, use in kept:
        slots = [c for c in np.flatnonzero(pattern) for _ in range(pattern[c])]
        begin = []
        for c in slots:
            begin.append(int(served[c]))
            served[c] += use
        # Within a run of uses every slot has documents of one length.
        cuts = {0, use}
        for c, b in zip(slots, begin):
            inside = bounds[c][(bounds[c] > b) & (bounds[c] < b + use)]
            cuts.update((inside - b).tolist())
        cuts = sorted(cuts)
        for a, z in zip(cuts, cuts[1:]):
            offset = 0
            for c, b in zip(slots, begin):
                i = int(np.searchsorted(bounds[c], b + a, "right")) - 1
                n = int(names[c][i])
                places.setdefault(n, []).append((b + a - int(bounds[c][i]), sequence, offset))
                offset += n
            if offset < length:
                gaps.append((z - a, length - offset, sequence, offset))
            sequence += z - a
    place = 0
    for c in range(len(sizes)):
        for i, n in enumerate(names[c].tolist()):
            rank = max(0, int(served[c] - bounds[c][i]))
            rest = int(bounds[c][i + 1] - bounds[c][i]) - rank
            if rest > 0:
                places.setdefault(n, []).append((rank, -1, place))
                place += rest * n
    rest = place - sum(n * size for n, size, _, _ in gaps)
    while rest > 0:
        size = length if rest >= length else 1 << (rest.bit_length() - 1)
        n = rest // size
        gaps.append((n, size, sequence, 0))
        sequence, rest = sequence + n, rest - n * size
    for n, rows in places.items():
        rows = np.array(sorted(rows), np.int64)
        out.first[n], out.sequence[n], out.offset[n] = rows.T
    if gaps:
        runs, size, seq, off = np.array(gaps, np.int64).T
        out.gap_place, out.gap_size, out.gap_sequence, out.gap_offset = np.cumsum(runs * size) - runs * size, size, seq, off
    out.sequences = sequence
    return out


def _filled(p: Plan, place: int, n: int) -> Iterator[tuple[int, int, int, int]]:
    """(from, length, sequence, offset) of the parts of a cut remainder whose tokens are at ``place`` of those to be cut."""
    done = 0
    while done < n:
        i = int(np.searchsorted(p.gap_place, place + done, "right")) - 1
        size = int(p.gap_size[i])
        nth, within = divmod(place + done - int(p.gap_place[i]), size)
        part = min(n - done, size - within)
        yield done, part, int(p.gap_sequence[i]) + nth, int(p.gap_offset[i]) + within
        done += part


def _placed(p: Plan, length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                out = []
                part = batch.slice(i, 1024).to_pydict()
                for doc_id, ids, n, rank, whole in zip(part["doc_id"], part["ids"], part["n"], part["rank"], part["whole"]):
                    for k in range(n // length):
                        out.append((doc_id, k * length, length, n, p.sequences + whole + k, 0, ids))
                    at, tail = n - n % length, n % length
                    if not tail:
                        continue
                    j = int(np.searchsorted(p.first[tail], rank, "right")) - 1
                    nth, sequence, offset = rank - int(p.first[tail][j]), int(p.sequence[tail][j]), int(p.offset[tail][j])
                    if sequence >= 0:
                        out.append((doc_id, at, tail, n, sequence + nth, offset, ids))
                    else:
                        for a, size, s, o in _filled(p, offset + nth * tail, tail):
                            out.append((doc_id, at + a, size, n, s, o, ids))
                for j in range(0, len(out), 1024):
                    doc, start, size, n, sequence, offset, ids = zip(*out[j : j + 1024])
                    cut = [x[4 * a : 4 * (a + b)] for x, a, b in zip(ids, start, size)]
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip((doc, start, size, cut, n, sequence, offset), _PIECE)], schema=_PIECE)

    return run


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """The pieces of all ``docs`` (doc_id, text): doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    Every id of a document (with the end id) lies in exactly one piece; the pieces of a sequence fill it from 0 to ``length``
    without gaps, but for at most log2(length) sequences that hold a power of two. A NULL text is empty: one end id. Rows are
    told apart by their place, so repeated ids and rows count each; a NULL id stays NULL. An empty table gives no rows. The
    driver gets one row per remainder's length; the plan it makes goes to every task and is bounded by ``length``.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    coded = settled(rows.mapInArrow(_tokens(tokenizer, length), _ENCODED))
    tail = F.pmod(F.col("n"), F.lit(length)).cast("int")
    # Ranks among equal lengths go block by block; so do the numbers of whole sequences.
    numbers = coded.groupBy("block", tail.alias("tail")).agg(F.count("*").alias("c"), F.sum(F.floor(F.col("n") / length)).alias("s"))
    numbers = settled(numbers)
    histogram = {r.tail: r.c for r in numbers.groupBy("tail").agg(F.sum("c").alias("c")).collect()}
    made = plan(histogram, length)
    past = (Window.unboundedPreceding, -1)
    by_tail = numbers.withColumn("rank0", F.coalesce(F.sum("c").over(Window.partitionBy("tail").orderBy("block").rowsBetween(*past)), F.lit(0)))
    blocks = numbers.groupBy("block").agg(F.sum("s").alias("s"))
    blocks = blocks.select("block", F.coalesce(F.sum("s").over(Window.orderBy("block").rowsBetween(*past)), F.lit(0)).alias("whole0"))
    bases = by_tail.select("block", "tail", "rank0").join(blocks, "block")
    joined = coded.withColumn("tail", tail).join(bases, ["block", "tail"])
    ranked = joined.select("doc_id", "ids", "n", (F.col("rank0") + F.col("nth")).alias("rank"), (F.col("whole0") + F.col("before")).alias("whole"))
    return ranked.mapInArrow(_placed(made, length), _PIECES)
