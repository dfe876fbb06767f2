"""Packing: exact round trips, tokens as the tokenizer gives them, and little waste."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mnemospark.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LENGTH = 64


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def wanted(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_chunks_encode_as_whole_texts(tokenizer):
    rng = random.Random(7)
    parts = ["word", "it's", "We'll", "123", "é", "日本", "😀", ".", ",", "!?", "<|endoftext|>", "\x1c", "\x1f", "\x00", "a.", "b,", "x_", "ß", "'s", "U.S."]
    gaps = [" "] * 8 + ["\n", "\n", "  ", "\n\n", "\t", "\r\n", " ", " \n", "\n ", "", "　", "\x85", "\x0b"]
    texts = ["".join(rng.choice(parts) + rng.choice(gaps) for _ in range(rng.randint(0, 12))) for _ in range(6000)]
    texts += ["".join(rng.choice(gaps) for _ in range(3)) + t.strip() for t in texts[:2000]] + ["", " ", "\n", "a", " a", "a "]
    coder = packing.Encoder(PATH)
    for i in range(0, len(texts), 500):
        for text, got in zip(texts[i : i + 500], coder.encode(texts[i : i + 500])):
            assert np.frombuffer(got, "<u4").tolist() == wanted(tokenizer, text), repr(text)


def check(rows, want, length):
    """Pieces cover every document once and every sequence from 0 on; returns the sequences' sizes."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        docs[r.doc_id].append((r.start, ids, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(docs) == set(want)
    for doc_id, pieces in docs.items():
        assert [i for _, ids, _ in sorted(pieces) for i in ids] == want[doc_id]
        assert all(n == len(want[doc_id]) for _, _, n in pieces)
        assert all(start == at for (start, _, _), at in zip(sorted(pieces), np.cumsum([0, *(len(i) for _, i, _ in sorted(pieces))])))
    sizes = []
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        sizes.append(at)
    assert max(sizes, default=0) <= length
    return sizes


@pytest.mark.parametrize("seed", [1, 2])
def test_every_id_lies_in_one_piece(spark, tokenizer, seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(["a", "bcd", "efghij", "é\n"]) for _ in range(int(rng.lognormvariate(3, 1)))) for _ in range(700)]
    # A third of all documents are equally long; one is very long.
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, "same words here") for i in range(350)]
    rows += [(2000, None), (2001, ""), (2002, "long text " * 5000), (2003, "x " * (LENGTH - 1)), (None, "no id")]
    df = spark.createDataFrame([(*r, 5, "z") for r in rows], "doc_id long, text string, n long, ids string").repartition(7)
    sizes = check(packing.packed(df, PATH, LENGTH).collect(), {i: wanted(tokenizer, t) for i, t in rows}, LENGTH)
    odd = [n for n in sizes if n != LENGTH]
    assert len(odd) <= 6 and all(n & (n - 1) == 0 for n in odd)


def test_repeated_rows_and_empty_tables(spark, tokenizer):
    df = spark.createDataFrame([(7, "twice")] * 2 + [(None, None)] * 2, "doc_id long, text string")
    rows = packing.packed(df, PATH, LENGTH).collect()
    assert sum(r.length for r in rows) == 2 * len(wanted(tokenizer, "twice")) + 2
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.packed(df.limit(0), PATH, LENGTH).collect() == []


def test_column_generation_reaches_the_optimum():
    # Halves, thirds and quarters fit exactly, so as many sequences are needed as the total size fills.
    sizes, demand = np.array([3, 4, 6, 8]), np.array([40, 30, 20, 15])
    columns, uses = packing.patterns(sizes, demand.astype(float), 12)
    assert np.allclose(uses @ columns, demand) and (columns @ sizes <= 12).all()
    assert uses.sum() <= sizes @ demand / 12 * 1.001


@pytest.mark.parametrize("n, longest", [(3000, 2047), (20_000, 300), (1, 1), (40, 2047)])
def test_plans_keep_documents_whole(n, longest):
    rng = np.random.default_rng(n)
    lengths = np.clip(rng.lognormal(5.5, 1, n).astype(int), 1, longest)
    histogram = {int(a): int(b) for a, b in zip(*np.unique(lengths, return_counts=True))}
    made = packing.plan(histogram)
    filled, whole = defaultdict(list), 0
    for size, count in histogram.items():
        for rank in range(count):
            j = int(np.searchsorted(made.first[size], rank, "right")) - 1
            nth, sequence, offset = rank - int(made.first[size][j]), int(made.sequence[size][j]), int(made.offset[size][j])
            if sequence >= 0:
                filled[sequence + nth].append((offset, size))
                whole += 1
            else:
                for _, part, s, o in packing._filled(made, offset + nth * size, size):
                    filled[s].append((o, part))
    totals = []
    for parts in filled.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        totals.append(at)
    assert sum(totals) == lengths.sum() and sorted(filled) == list(range(made.sequences))
    assert all(t & (t - 1) == 0 for t in totals) and sum(t == 2048 for t in totals) == lengths.sum() // 2048
    if n >= 1000:
        assert whole >= 0.97 * n
