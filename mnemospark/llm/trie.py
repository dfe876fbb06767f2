"""The prefix trie of conversations, by a splitter skeleton.

A conversation is a path: 20 bytes a turn (a 128-bit hash of role and text, and the text's length), so that the order of
paths puts every node's members next to each other. Paths are range-partitioned with their ids and sorted. The first
paths of the ranges, the splitters, form a trie; sorted paths make a trie by the depths up to which each one agrees with
what is before it, and these depths, one number a range, are broadcast. A node whose path is such a common part has
members in several ranges and belongs to the skeleton. Every range finishes all its other nodes alone. For skeleton nodes
it gives partial sums, which are added by one reduction: a range counts what only one of them may count (a node as a
child, or as a leaf) in the first or last range that holds the node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

#: Bytes of one turn in a path: hash and length of the text.
HASH, WIDTH = 16, 20
#: Bytes of paths that one range holds, about.
RANGE_BYTES = 8 << 20
#: A conversation may take its start from the first one of its hundred: at most this many turns.
BLOCK, SHARED = 100, 5

_NODE = (
    "shard int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, ends binary"
)
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_code(role: Column, text: Column) -> Column:
    """A turn as 40 hex digits: equal turns, and only they (but for a collision of 128 bits), have equal codes."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    size = F.lpad(F.lower(F.hex(F.length(text).cast("long"))), 2 * (WIDTH - HASH), "0")
    return F.concat(F.substring(F.sha2(named, 256), 1, 2 * HASH), size)


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path) of every conversation, whose first turns are replaced by those of its block's first conversation.

    The number of replaced turns is the unsigned crc32 of the decimal id modulo 6. Turns are in the order of ``turn`` (NULL
    first); equal ones in the order of their codes. Rows without a ``conv_id`` belong to no conversation. A path is one row
    of 20 bytes a turn. Other columns are not read.
    """
    code = turn_code(F.col("role"), F.col("text"))
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", code.alias("code"))
    lists = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "code"))).alias("turns"))
    lists = settled(lists.select("conv_id", F.col("turns.code").alias("codes")))
    first = F.col("conv_id") - F.col("conv_id") % BLOCK
    heads = lists.filter(F.col("conv_id") == first).select(F.col("conv_id").alias("head_id"), F.slice("codes", 1, SHARED).alias("head"))
    joined = lists.withColumn("head_id", first).join(heads, "head_id", "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED + 1)).cast("int")
    start = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), h)
    rest = F.slice("codes", h + 1, F.greatest(F.size("codes"), F.lit(1)))
    return joined.select("conv_id", F.unhex(F.array_join(F.concat(start, rest), "")).alias("path"))


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths share from the start."""
    top = min(len(a), len(b)) // WIDTH
    if a[: top * WIDTH] == b[: top * WIDTH]:
        return top
    low = 0
    while top - low > 1:
        mid = (low + top) // 2
        low, top = (mid, top) if a[: mid * WIDTH] == b[: mid * WIDTH] else (low, mid)
    return low


def _agreed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        depth = [-1 if b is None else _common(bytes(a), bytes(b)) for a, b in zip(batch["path"], batch["before"])]
        yield pd.DataFrame({"shard": batch["shard"], "depth": depth})


def _key(path: bytes, depth: int) -> bytes:
    return hashlib.sha256(path[: depth * WIDTH]).digest()[:HASH] + depth.to_bytes(8, "big")


class _Range:
    """The nodes of one range of sorted paths. ``left`` and ``right``: depths it shares with the ranges beside it."""

    def __init__(self, shard: int, left: int, right: int):
        self.shard, self.left, self.right = shard, left, right
        self.depth, self.parent, self.size, self.row = [0], [-1], [0], [0]
        self.paths: list[bytes] = []
        self.end: list[int] = []
        self.ids: list[np.ndarray] = []
        self.at, self.last = [0], b""

    def add(self, paths: list[bytes], ids: np.ndarray) -> None:
        depth, parent, size, row, at, last = self.depth, self.parent, self.size, self.row, self.at, self.last
        for path in paths:
            if path != last:
                d = _common(last, path)
                del at[d + 1 :]
                for i in range(d, len(path) // WIDTH):
                    depth.append(i + 1)
                    parent.append(at[i])
                    size.append(int.from_bytes(path[i * WIDTH + HASH : (i + 1) * WIDTH], "big"))
                    row.append(len(self.paths))
                    at.append(len(depth) - 1)
                self.paths.append(path)
                last = path
            elif not self.paths:
                self.paths.append(path)
            self.end.append(at[-1])
        self.last = last
        self.ids.append(ids)

    def nodes(self) -> Iterator[pd.DataFrame]:
        depth, parent, size = (np.array(x, np.int64) for x in (self.depth, self.parent, self.size))
        end, ids, m = np.array(self.end, np.int64), np.concatenate(self.ids), len(self.depth)
        opened, kept = np.zeros(m, bool), np.zeros(m, bool)
        # Nodes of the first path are numbered 0, 1, 2, ..; those of the last one are still open.
        opened[: len(self.paths[0]) // WIDTH + 1] = True
        kept[self.at] = True
        starts, stops = ~(opened & (depth <= self.left)), ~(kept & (depth <= self.right))
        skeleton = ~(starts & stops)
        n = np.bincount(end, minlength=m).astype(np.int64)
        low = np.full(m, np.iinfo(np.int64).max)
        np.minimum.at(low, end, ids)
        levels = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[levels], np.arange(1, depth.max() + 2))
        parts = [levels[a:b] for a, b in zip(cuts, cuts[1:])][::-1]
        for part in parts:
            np.add.at(n, parent[part], n[part])
            np.minimum.at(low, parent[part], low[part])
        children = np.bincount(parent[1:], minlength=m) if m > 1 else np.zeros(m, np.int64)
        leaves = ((children == 0) & stops).astype(np.int64)
        saved = n * size - np.where(starts, size, 0)
        for part in parts:
            np.add.at(leaves, parent[part], leaves[part])
            np.add.at(saved, parent[part], saved[part])
        children = np.bincount(parent[1:], weights=starts[1:], minlength=m).astype(np.int64) if m > 1 else children
        order = np.argsort(end, kind="stable")
        first, stop = np.searchsorted(end[order], np.arange(m)), np.searchsorted(end[order], np.arange(m), "right")
        ids = ids[order]
        for i in range(0, m, 1 << 14):
            rows = range(i, min(m, i + (1 << 14)))
            text = [",".join(map(str, np.sort(ids[first[j] : stop[j]]).tolist())).encode() for j in rows]
            spine, above = skeleton[rows.start : rows.stop], parent[rows.start : rows.stop]
            outside = (above >= 0) & skeleton[above]
            yield pd.DataFrame(
                {
                    "shard": self.shard,
                    "key": [_key(self.paths[self.row[j]], self.depth[j]) if s else None for j, s in zip(rows, spine)],
                    "parent_key": [_key(self.paths[self.row[j]], self.depth[j] - 1) if s else None for j, s in zip(rows, outside)],
                    "conv_id": low[rows.start : rows.stop],
                    "depth": depth[rows.start : rows.stop],
                    "parent_conv_id": pd.array(np.where(outside | (above < 0), 0, low[above]), "Int64"),
                    "n_convs": n[rows.start : rows.stop],
                    "n_children": children[rows.start : rows.stop],
                    "n_leaves": leaves[rows.start : rows.stop],
                    "saved_tokens": saved[rows.start : rows.stop],
                    "ends_sha256": [None if s else _NO_ENDS if not t else hashlib.sha256(t).hexdigest() for s, t in zip(spine, text)],
                    "ends": [t if s and t else None for s, t in zip(spine, text)],
                }
            )


def _shards(depths: dict[int, tuple[int, int]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for batch in batches:
            for shard, rows in batch.groupby("shard", sort=False):
                if now is None or now.shard != shard:
                    if now is not None:
                        yield from now.nodes()
                    now = _Range(int(shard), *depths[int(shard)])
                now.add([bytes(p) for p in rows["path"]], rows["conv_id"].to_numpy(np.int64))
        if now is not None:
            yield from now.nodes()

    return run


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The hash of every key's ids, part by part: a task holds one part of one node at a time."""
    now, state = None, None
    for batch in batches:
        done = []
        for key, ends in zip(batch["key"], batch["ends"]):
            if key != now:
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state = key, hashlib.sha256(ends)
            else:
                state.update(b"," + ends)
        yield pd.DataFrame(done, columns=["key", "ends_sha256"])
    if now is not None:
        yield pd.DataFrame([(now, state.hexdigest())], columns=["key", "ends_sha256"])


def prefix_trie(paths: DataFrame, ranges: int | None = None) -> DataFrame:
    """The nodes of the trie over (conv_id, path), one row each.

    conv_id and parent_conv_id are the smallest members of the node and its parent (NULL above the root); n_convs counts the
    paths through the node, n_children the nodes right below, n_leaves the childless nodes of its subtree (itself
    included); saved_tokens is the subtree's sum of (n_convs - 1) times the length of the node's last text; ends_sha256
    hashes the ascending ids of the paths that end here. An empty path ends at the root. Equal paths may fill any number
    of ranges. An id with several paths counts as a member for each. A NULL id or path is left out; an empty table gives
    no rows. ``ranges`` is found from the size of all paths if it is not given.
    """
    spark = paths.sparkSession
    rows = settled(paths.filter("conv_id IS NOT NULL AND path IS NOT NULL").select("conv_id", "path"))
    if ranges is None:
        size = rows.agg(F.sum(F.length("path") + WIDTH)).first()[0] or 0
        ranges = max(1, -(-size // RANGE_BYTES), min(spark.sparkContext.defaultParallelism, size // (RANGE_BYTES // 32)))
    ranged = rows.repartitionByRange(ranges, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    nth = F.monotonically_increasing_id()
    placed = settled(ranged.select("conv_id", "path", F.shiftright(nth, 33).cast("int").alias("shard"), nth.bitwiseAND((1 << 33) - 1).alias("nth")))
    splitters = placed.filter("nth = 0").select("shard", "path")
    last = placed.groupBy("shard").agg(F.max("nth").alias("nth")).join(placed, ["shard", "nth"]).select("shard", F.col("path").alias("last"))
    # One row per range: its first path, and the last one before it.
    beside = splitters.join(last, "shard").select("shard", "path", F.lag("last").over(Window.orderBy("shard")).alias("before"))
    agreed = sorted((r.shard, r.depth) for r in beside.mapInPandas(_agreed, "shard int, depth int").collect())
    after = [d for _, d in agreed[1:]] + [-1]
    depths = {s: (d, right) for (s, d), right in zip(agreed, after)}
    there = placed.select("shard", "path", "conv_id").repartitionById(max(1, ranges), F.col("shard"))
    found = settled(there.sortWithinPartitions("shard", "path", "conv_id").mapInPandas(_shards(depths), _NODE))
    return _joined(found)


def _joined(found: DataFrame) -> DataFrame:
    """Add up the skeleton's partial rows, and give the nodes right below it their parents' ids."""
    partial = found.filter("key IS NOT NULL")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    whole = partial.groupBy("key").agg(F.first("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *sums)
    parts = partial.filter("ends IS NOT NULL").select("key", "shard", "ends")
    ends = parts.repartition("key").sortWithinPartitions("key", "shard").mapInPandas(_digests, "key binary, ends_sha256 string")
    named = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    skeleton = whole.join(ends, "key", "left").join(named, "parent_key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_ENDS)))
    # Parents are looked up range by range, so that the root's children do not meet at one key.
    there = partial.select("shard", F.col("key").alias("parent_key")).join(named, "parent_key")
    own = found.filter("key IS NULL")
    below = own.filter("parent_key IS NOT NULL").join(there, ["shard", "parent_key"])
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]

    def given(df: DataFrame, parent: str) -> DataFrame:
        return df.withColumn("parent_conv_id", F.col(parent)).select(columns)

    inner = own.filter("parent_key IS NULL")
    inner = inner.withColumn("up", F.when(F.col("depth") > 0, F.col("parent_conv_id")))
    return given(inner, "up").unionByName(given(below, "above")).unionByName(given(skeleton, "above"))
