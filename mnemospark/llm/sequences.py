"""Token ids as Arrow files of equal-length sequences.

A dataset is a folder of pairs of Arrow IPC files. ``part-N.arrow`` holds record batches of ``ids`` and ``mask``, both
fixed-size lists: sequence ``s`` of a file is row ``s % BATCH`` of batch ``s // BATCH``, so a memory map gives any
sequence, and its mask of real ids, without copying or reading what is before it. ``part-N.docs.arrow`` holds each
document's id, first position in the file and number of ids. Files are numbered in the order of the document ids.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_order_buckets, shared_path

#: Ids of one sequence, and sequences of one record batch.
LENGTH = 2048
BATCH = 64
END_ID = 1
#: Words whose ids a task remembers.
REMEMBERED = 1 << 20


def _letters(word: str) -> bool:
    """Only letters, also once the tokenizer has composed and lower-cased them."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


def _parts(run: str) -> tuple[str, ...]:
    """A blank-free run in parts that are encoded alone: a stop or comma at the end of letters is a piece of its own. The
    tokenizer drops case; only ASCII is lower-cased here."""
    word, end = (run[:-1], run[-1]) if run[-1] in ".," else (run, "")
    if not _letters(word):
        return (run,)
    word = word.lower() if word.isascii() else word
    return (word, end) if end else (word,)


_encoders: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """This worker's encoder, which keeps what it has learned from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    """Ids of texts as bytes. The tokenizer matches no piece across white space, so a text's ids are those of its blank-free
    runs in turn; a run that came before is looked up, and new ones are encoded together."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.known: dict[str, bytes] = {"": b""}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of letters, encoded as one text and cut at the tokens that end a word. Nothing, if the cuts do not
        give one part for each word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.dtype)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words) or not len(ids) or cuts[-1] != len(ids):
            return {}
        data, size, cuts = ids.tobytes(), self.dtype.itemsize, cuts.tolist()
        return {w: data[size * a : size * b] for w, a, b in zip(words, [0, *cuts], cuts)}

    def encode(self, texts: list[str]) -> list[bytes]:
        runs = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
            known[""] = b""
        new = {w: _parts(w) for w in set(chain.from_iterable(runs)).difference(known)}
        fresh = list({p for parts in new.values() for p in parts}.difference(known))
        words = [p for p in fresh if _letters(p)]
        for i in range(0, len(words), 512):
            known.update(self._words(words[i : i + 512]))
        rest = [p for p in fresh if p not in known]
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            coded = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            known.update((w, np.array(c.ids, self.dtype).tobytes()) for w, c in zip(part, coded))
        known.update((w, b"".join(map(known.__getitem__, parts))) for w, parts in new.items())
        end = np.array([END_ID], self.dtype).tobytes()
        return [b"".join(map(known.__getitem__, r)) + end for r in runs]


def _filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


class _Part:
    """Writes one pair of files, under names of their own until they are complete."""

    def __init__(self, folder: str, number: int, dtype: np.dtype):
        self.fs, self.base = _filesystem(f"{folder}/part-{number:06d}")
        task = TaskContext.get()
        self.draft = f"{self.base}.{task.taskAttemptId() if task else 0}"
        self.item = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.dtype, self.rest, self.total = dtype, b"", 0
        self.schema = pa.schema([("ids", pa.list_(self.item, LENGTH)), ("mask", pa.list_(pa.bool_(), LENGTH))])
        self.index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.outs = [self.fs.open_output_stream(f"{self.draft}{x}") for x in (".tmp", ".docs.tmp")]
        self.ids = pa.ipc.new_file(self.outs[0], self.schema)
        self.docs = pa.ipc.new_file(self.outs[1], self.index)

    def _flush(self, data: bytes, real: int) -> None:
        ids = pa.FixedSizeListArray.from_arrays(pa.array(np.frombuffer(data, self.dtype), self.item), LENGTH)
        mask = np.arange(len(data) // self.dtype.itemsize) < real
        self.ids.write_batch(pa.record_batch([ids, pa.FixedSizeListArray.from_arrays(pa.array(mask), LENGTH)], schema=self.schema))

    def add(self, doc_ids: list, coded: list[bytes]) -> None:
        size = self.dtype.itemsize
        n = np.array([len(c) // size for c in coded], np.int64)
        start = self.total + np.cumsum(n) - n
        self.docs.write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(start), pa.array(n)], schema=self.index))
        self.total += int(n.sum())
        data, whole = self.rest + b"".join(coded), LENGTH * BATCH * size
        for i in range(0, len(data) - whole + 1, whole):
            self._flush(data[i : i + whole], LENGTH * BATCH)
        self.rest = data[len(data) // whole * whole :]

    def close(self) -> None:
        if self.rest:
            real, line = len(self.rest) // self.dtype.itemsize, LENGTH * self.dtype.itemsize
            self._flush(self.rest + bytes(-len(self.rest) % line), real)
        for x in (self.ids, self.docs, *self.outs):
            x.close()
        self.fs.move(f"{self.draft}.docs.tmp", f"{self.base}.docs.arrow")
        self.fs.move(f"{self.draft}.tmp", f"{self.base}.arrow")


def _writer(folder: str, tokenizer: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, part, number = encoder(tokenizer), None, None
        for batch in batches:
            for bucket, rows in batch.groupby("bucket", sort=False):
                if bucket != number:
                    if part:
                        part.close()
                        yield pd.DataFrame({"part": [number], "n_ids": [part.total]})
                    part, number = _Part(folder, int(bucket), coder.dtype), bucket
                ids = [None if pd.isna(i) else int(i) for i in rows["doc_id"]]
                for i in range(0, len(ids), 512):
                    part.add(ids[i : i + 512], coder.encode([t or "" for t in rows["text"].iloc[i : i + 512]]))
        if part:
            part.close()
            yield pd.DataFrame({"part": [number], "n_ids": [part.total]})

    return run


def write_sequences(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Write all ``docs`` (doc_id, text) and return the files' table (part, n_ids), which is written next to them.

    The rows are shuffled once, into ranges of ids; a file is written by one task, and a retry replaces it. A NULL text is
    empty: one end id. A NULL id comes first. Rows that share an id follow each other in the order of their texts' hashes.
    An empty table gives a dataset without files.
    """
    spark = docs.sparkSession
    placed, bounds = in_order_buckets(docs.select("doc_id", "text"), "doc_id", "bucket")
    ordered = placed.withColumn("h", F.xxhash64("text")).repartition(len(bounds) + 1, "bucket")
    rows = ordered.sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "h").select("bucket", "doc_id", "text")
    fs, path = _filesystem(folder)
    fs.create_dir(path)
    parts = f"{folder}/parts"
    rows.mapInPandas(_writer(folder, tokenizer), "part int, n_ids long").write.parquet(parts)
    return spark.read.schema("part int, n_ids long").parquet(parts)


def _open(uri: str):
    fs, path = _filesystem(uri)
    return pa.memory_map(path) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(path)


def _digests(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, base in zip(batch["part"], batch["base"]):
                name = f"{folder}/part-{number:06d}"
                with _open(f"{name}.arrow") as data, _open(f"{name}.docs.arrow") as index:
                    ids, docs = pa.ipc.open_file(data), pa.ipc.open_file(index)
                    for i in range(docs.num_record_batches):
                        part = docs.get_batch(i).to_pandas(integer_object_nulls=True)
                        sums = [_crc(ids, s, n) for s, n in zip(part["start"], part["n_tokens"])]
                        part["doc_id"] = part["doc_id"].astype(object)
                        yield part.assign(start=part["start"] + base, ids_crc32=np.array(sums, np.int64))

    return run


def _crc(ids: pa.ipc.RecordBatchFileReader, start: int, n: int) -> int:
    """Of the ids from ``start`` on, as little-endian 32-bit integers, read batch by batch."""
    crc, width = 0, LENGTH * BATCH
    while n > 0:
        at = start % width
        flat = ids.get_batch(start // width).column(0).flatten().to_numpy(zero_copy_only=True)[at : at + n]
        crc = zlib.crc32(flat.astype("<u4").tobytes(), crc)
        start, n = start + len(flat), n - len(flat)
    return crc


def read_documents(files: DataFrame, folder: str) -> DataFrame:
    """From a dataset's files, per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    based = files.withColumn("base", F.coalesce(before, F.lit(0)))
    spread = based.repartition(max(2, files.sparkSession.sparkContext.defaultParallelism), "part")
    return spread.mapInPandas(_digests(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def sequence(folder: str, part: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence ``number`` of a file and its mask, without reading the others."""
    batch = pa.ipc.open_file(_open(f"{folder}/part-{part:06d}.arrow")).get_batch(number // BATCH)
    row = number % BATCH
    return batch.column(0)[row].values.to_numpy(), batch.column(1)[row].values.to_numpy(zero_copy_only=False)


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` to a new folder in the shared one and read back each document's place, length and checksum."""
    folder = shared_path(docs.sparkSession, "sequences")
    return read_documents(write_sequences(docs, folder, tokenizer), folder)
