"""Deduplication of assets and merging of entity cards.

A result keeps its witnesses in an evidence table next to it, one row per
distinct (turn, quote). All per-key results are partial aggregates, so a key
with a large share of the arrivals is reduced before it is shuffled. Only the
attribute fold needs order; it runs over bounded chunks (see ``fold_attributes``).
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import ANCHOR
from .extract import mention_key
from .lineage import settled
from .ordering import CHUNK, listed, with_running

OUTCOMES = ("created", "bumped", "merged", "state_changed")


# --- evidence -----------------------------------------------------------------


def evidence(rows: DataFrame, keys: list[str], repeating: bool = True) -> DataFrame:
    """(keys, turn_id, quote, char_start, char_end, first_seq, copy): the first span of every (turn, quote), as ``copy`` 0.

    The first witness of a key keeps all its anchors, so those that it repeats come once more each, as ``copy`` 1 and up;
    what later witnesses repeat is left out. ``rows`` has the keys, ``seq`` and ``anchors``. Without ``repeating`` no row has an
    anchor twice, and none is looked for.
    """
    rows = rows.select(*keys, "seq", "anchors")
    names = F.transform("anchors", lambda a: F.struct(a["turn_id"], a["quote"]))
    flat = rows.select(*keys, "seq", F.posexplode("anchors").alias("_p", "_a"))
    first = F.struct("seq", "_p", "_a.char_start", "_a.char_end")
    once = (
        flat.select(*keys, F.col("_a.turn_id").alias("turn_id"), F.col("_a.quote").alias("quote"), first.alias("_f"))
        .groupBy(*keys, "turn_id", "quote")
        .agg(F.min("_f").alias("_f"))
        .select(*keys, "turn_id", "quote", "_f.char_start", "_f.char_end", F.col("_f.seq").alias("first_seq"), F.lit(0).alias("copy"))
    )
    if not repeating:
        return once
    witnesses = rows.groupBy(*keys).agg(F.min("seq").alias("seq"))
    twice = rows.filter(F.size(F.array_distinct(names)) < F.size("anchors")).join(witnesses, [*keys, "seq"], "left_semi")
    again = twice.select(*keys, "seq", F.posexplode("anchors").alias("_p", "_a")).select(*keys, "seq", "_p", "_a.*")
    nth = F.row_number().over(Window.partitionBy(*keys, "turn_id", "quote").orderBy("_p"))
    again = again.withColumn("copy", nth - 1).filter("copy > 0")
    return once.unionByName(again.select(*keys, "turn_id", "quote", "char_start", "char_end", F.col("seq").alias("first_seq"), "copy"))


def nest_anchors(table: DataFrame, proof: DataFrame, keys: list[str]) -> DataFrame:
    """A view of ``table`` with the anchors as a list in order of arrival, one row per key. ``proof`` holds them one per row."""
    item = F.struct("first_seq", "turn_id", "quote", "char_start", "char_end")
    return table.join(listed(proof, keys, item, "anchors"), keys, "left")


# --- atomic assets ------------------------------------------------------------


@dataclass
class Deduped:
    """``assets``: one row per signature; ``evidence``: their anchors."""

    assets: DataFrame
    evidence: DataFrame


#: Bookkeeping of a merged row, which lets it merge again with later ones.
MERGE_COLUMNS = ("first_seq", "last_seq", "last_turn", "n_arrivals")


def merge_rows(rows: DataFrame, key: str) -> DataFrame:
    """Merge rows of one key: the earliest row's columns, with confidence, relevance and last update of all.

    Rows carry ``MERGE_COLUMNS``. The merge is associative, so it serves arrivals
    and the partial results of streaming batches alike.
    """
    names = [c for c in rows.columns if c not in (key, *MERGE_COLUMNS)]
    score = F.col("provenance.confidence_score")
    merged = rows.groupBy(key).agg(
        F.min_by(F.struct("first_seq", "n_arrivals", *names), "first_seq").alias("_first"),
        F.max_by(F.struct("last_seq", "last_turn"), "last_seq").alias("_last"),
        F.max(score).alias("_score"),
        F.sum("n_arrivals").alias("n_arrivals"),
    )
    first, cols = F.col("_first"), []
    for name in names:
        value = first[name]
        if name == "provenance":
            value = value.withField("confidence_score", F.col("_score"))
        elif name == "relevance":
            value = value + F.col("n_arrivals") - first["n_arrivals"]
        elif name == "last_updated_turn":
            value = F.when(F.col("n_arrivals") > 1, F.col("_last.last_turn")).otherwise(value)
        cols.append(value.alias(name))
    return merged.select(
        key, *cols, first["first_seq"].alias("first_seq"), F.col("_last.last_seq").alias("last_seq"),
        F.col("_last.last_turn").alias("last_turn"), "n_arrivals",
    )


def _single(arrivals: DataFrame) -> DataFrame:
    """Arrivals as rows that stand for themselves alone, or each for the ``n_arrivals`` alike ones up to ``last_seq`` if it says so."""
    rows = arrivals.withColumnRenamed("seq", "first_seq")
    if "n_arrivals" not in arrivals.columns:
        rows = rows.select("*", F.col("first_seq").alias("last_seq"), F.lit(1).cast("bigint").alias("n_arrivals"))
    return rows.withColumn("last_turn", F.col("provenance.source_turn_id"))


def with_witnesses(table: DataFrame, proof: DataFrame, key: str) -> DataFrame:
    counts = proof.groupBy(key).agg(F.count(F.lit(1)).alias("witness_count"))
    return table.join(counts, key, "left").withColumn("witness_count", F.coalesce("witness_count", F.lit(0)))


def merge_evidence(proof: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence of several batches as one: the first span of every (turn, quote), and the copies of the very first witness."""
    names = ("turn_id", "quote", "copy")
    merged = proof.groupBy(*keys, *names).agg(F.min(F.struct("first_seq", "char_start", "char_end")).alias("_f"))
    merged = merged.select(*keys, "turn_id", "quote", "_f.char_start", "_f.char_end", "_f.first_seq", "copy")
    witnesses = proof.groupBy(*keys).agg(F.min("first_seq").alias("first_seq"))
    copies = merged.filter("copy > 0").join(witnesses, [*keys, "first_seq"], "left_semi")
    return merged.filter("copy = 0").unionByName(copies)


def dedup_rows(arrivals: DataFrame, written: bool = True, repeating: bool = True) -> Deduped:
    """As ``dedup_atomic``, without the witness counts."""
    keyed = arrivals
    if "dedup_key" not in arrivals.columns:
        keyed = arrivals.withColumn("dedup_key", mention_key(arrivals))
        # Rows and evidence read the signatures four times.
        keyed = settled(keyed) if written else keyed
    anchors = F.col("provenance.raw_quote_anchors").alias("anchors")
    proof = evidence(keyed.select("dedup_key", "seq", anchors), ["dedup_key"], repeating)
    return Deduped(merge_rows(_single(keyed), "dedup_key"), proof)


def dedup_atomic(arrivals: DataFrame, written: bool = True, repeating: bool = True) -> Deduped:
    """One asset per (kind, network, viewpoint, normalised content, set of entity ids).

    The first witness gives id, content and source. Each repeat adds 1 to the
    relevance, sets the last updated turn and may raise the confidence. Arrivals with
    ``n_arrivals`` and ``last_seq`` stand for several, as merged rows do. Arrivals many times
    as many as their sources are made again for each reader instead of ``written``;
    without ``repeating`` none of them has an anchor twice.
    """
    d = dedup_rows(arrivals, written, repeating)
    return Deduped(with_witnesses(d.assets, d.evidence, "dedup_key"), d.evidence)


def first_ids(rows: DataFrame, key: str) -> DataFrame:
    """(key, id): of every key the id that came first, from rows with the key, ``id`` and ``first_seq``.

    The least ``first_seq`` is found by hashing, and its id by an equi-join.
    """
    least = rows.groupBy(key).agg(F.min("first_seq").alias("first_seq"))
    return rows.select(key, "first_seq", "id").join(least, [key, "first_seq"]).select(key, "id").dropDuplicates([key])


def _told(rows: DataFrame, key: str, known: DataFrame | None) -> DataFrame:
    """Rows of (seq, id, key) with ``arrival_id``, the ``id`` of the stored asset they went into, and whether they made it."""
    firsts = rows.groupBy(key).agg(F.min("seq").alias("seq"))
    own = firsts.join(rows.select("seq", F.col("id").alias("own_id")), "seq").withColumnRenamed("seq", "own_seq")
    if known is None:
        own = own.withColumn("known_id", F.lit(None).cast("string"))
    else:
        own = own.join(known.select(key, F.col("id").alias("known_id")), key, "left")
    rows = rows.withColumnRenamed("id", "arrival_id").join(own, key)
    made = F.col("known_id").isNull() & (F.col("seq") == F.col("own_seq"))
    return rows.select("seq", F.coalesce("known_id", "own_id").alias("id"), "arrival_id", made.alias("made"))


def atomic_outcomes(arrivals: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(seq, id, arrival_id, outcome): created for the first witness of a signature, bumped for the rest.

    ``id`` names the stored asset, which is the first witness's. ``known`` lists signatures already stored (``dedup_key``, ``id``).
    """
    keyed = settled(arrivals.select("seq", "id", mention_key(arrivals).alias("dedup_key")))
    told = _told(keyed, "dedup_key", known)
    return told.select("seq", "id", "arrival_id", F.when(F.col("made"), "created").otherwise("bumped").alias("outcome"))


def bump_details(arrivals: DataFrame) -> DataFrame:
    """(seq, previous_relevance, new_relevance, added_anchors) of every arrival that bumps the asset of an earlier one.

    Relevance counts the arrivals before it, chunk by chunk for keys of any size; an anchor is added by the first arrival that
    has it.
    """
    keyed = settled(arrivals.select("seq", "relevance", mention_key(arrivals).alias("dedup_key"), F.col("provenance.raw_quote_anchors").alias("anchors")))
    running = with_running(keyed.select("dedup_key", "seq"), ["dedup_key"], "seq")
    firsts = running.filter("ordinal = 1").select("dedup_key", "seq").join(keyed.select("seq", F.col("relevance").alias("_r")), "seq").drop("seq")
    added = evidence(keyed, ["dedup_key"]).groupBy(F.col("first_seq").alias("seq")).agg(F.count(F.lit(1)).alias("added_anchors"))
    rows = running.filter("ordinal > 1").join(firsts, "dedup_key").join(added, "seq", "left")
    new = F.col("_r") + F.col("ordinal") - 1
    return rows.select("seq", (new - 1).alias("previous_relevance"), new.alias("new_relevance"), F.coalesce("added_anchors", F.lit(0)).alias("added_anchors"))


# --- attributes ---------------------------------------------------------------


def explode_claims(cards: DataFrame) -> DataFrame:
    """One row per attribute of an arriving card, ordered by ``seq`` of the card and ``place`` in it.

    ``repeated`` marks a key seen earlier in the same card.
    """
    keys = F.transform("attributes", lambda a: a["key"])
    rows = cards.select("seq", "entity_id", keys.alias("_keys"), F.posexplode("attributes").alias("place", "_a"))
    return rows.select(
        "seq",
        "place",
        "entity_id",
        F.col("_a.key").alias("key"),
        F.col("_a.value_json").alias("value_json"),
        F.col("_a.provenance.confidence_score").alias("confidence"),
        F.col("_a.provenance.temporal_range.turn_start").alias("turn_start"),
        F.col("_a.provenance.source_turn_id").alias("source_turn_id"),
        F.col("_a.provenance.raw_quote_anchors").alias("anchors"),
        (F.array_position("_keys", F.col("_a.key")) <= F.col("place")).alias("repeated"),
    )


def _takes(value, record, turn, state) -> bool:
    """Whether a contender (confidence at the running maximum) replaces the state (value, turn, seq, place)."""
    return value != state[0] and (record or turn > state[1])


def _walk(contenders, state):
    for value, turn, seq, place, record in contenders:
        if state is None or _takes(value, record, turn, state):
            state = (value, turn, seq, place)
    return state


def _runs(parts: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Successive rows of equal keys of a sorted partition, as column lists; a run may come in several parts."""
    for pdf in parts:
        if pdf.empty:
            continue
        cols = {c: pdf[c].tolist() for c in pdf.columns}
        tags = list(zip(*(cols[k] for k in keys)))
        start = 0
        for i in range(1, len(tags) + 1):
            if i == len(tags) or tags[i] != tags[start]:
                yield tags[start], {c: v[start:i] for c, v in cols.items()}
                start = i


def _missing(x) -> bool:
    return x is None or x != x


# ``other``, ``same`` and ``raw`` are JSON: Spark takes time in the square of a batch to hand nested columns to Python.
SUMMARY = T.StructType(
    [
        T.StructField("entity_id", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("chunk", T.LongType()),
        T.StructField("before", T.DoubleType()),
        T.StructField("lead", T.StringType()),
        T.StructField("other", T.StringType()),
        T.StructField("same", T.StringType()),
        T.StructField("raw", T.StringType()),
    ]
)
START = T.StructType(
    [
        T.StructField("entity_id", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("chunk", T.LongType()),
        T.StructField("before", T.DoubleType()),
        T.StructField("start_value", T.StringType()),
        T.StructField("start_turn", T.StringType()),
        T.StructField("start_seq", T.LongType()),
        T.StructField("start_place", T.IntegerType()),
    ]
)


def _summarize(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a chunk does to an unknown incoming state.

    The running maximum before the chunk is known, so its contenders are known.
    If all are later than every earlier turn, the first one replaces any state
    of another value, and a state of its own value is replaced by the first
    contender that differs. So two end states describe the chunk. A chunk out
    of turn order hands on its contenders instead.
    """
    tag, info, todo, out = None, None, [], []

    def close():
        if tag is None:
            return
        before, last_turn = info
        row = dict(zip(("entity_id", "key", "chunk"), tag), before=before, lead=None, other=None, same=None, raw=None)
        if todo:
            row["lead"] = todo[0][0]
            if last_turn is None or all(c[1] > last_turn for c in todo):
                row["other"] = json.dumps(_walk(todo, None))
                same = _walk(todo[1:], (todo[0][0], "", None, None))
                row["same"] = None if same[2] is None else json.dumps(same)
            else:
                row["raw"] = json.dumps(todo)
        out.append(row)

    for key, run in _runs(parts, ["entity_id", "key", "chunk"]):
        if key != tag:
            close()
            before = run["before"][0]
            last_turn = run["last_turn"][0]
            tag, todo = key, []
            info = (None if _missing(before) else before, None if _missing(last_turn) else last_turn)
            top = -1.0 if info[0] is None else info[0]
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=SUMMARY.fieldNames())
                out.clear()
        for value, score, turn, seq, place in zip(
            run["value_json"], run["confidence"], run["turn_start"], run["seq"], run["place"]
        ):
            if score >= top:
                todo.append((value, turn, seq, place, score > top))
                top = score
    close()
    if out:
        yield pd.DataFrame(out, columns=SUMMARY.fieldNames())


def _relay(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state at the start of every chunk, handed from chunk to chunk of a key."""
    tag, state, out = None, None, []

    def flush():
        frame = pd.DataFrame(out, columns=START.fieldNames())
        out.clear()
        return frame.astype({"start_seq": "Int64", "start_place": "Int32", "before": "Float64"})

    for key, run in _runs(parts, ["entity_id", "key"]):
        if key != tag:
            tag, state = key, None
        for chunk, before, lead, other, same, raw in zip(
            run["chunk"], run["before"], run["lead"], run["other"], run["same"], run["raw"]
        ):
            out.append((*key, chunk, None if _missing(before) else before, *(state or (None, None, None, None))))
            if not _missing(raw):
                state = _walk(json.loads(raw), state)
            elif not _missing(lead):
                if state is None or state[0] != lead:
                    state = tuple(json.loads(other))
                elif not _missing(same):
                    state = tuple(json.loads(same))
        # Frames of many keys: one for each key would cost more than all the rest.
        if len(out) >= 10_000:
            yield flush()
    if out:
        yield flush()


CLAIM = (
    "entity_id", "key", "seq", "place", "value_json", "confidence", "turn_start", "source_turn_id", "anchors"
)


#: What the fold reads of a row; all other columns pass through it as they come.
FOLD_COLUMNS = (
    "entity_id", "key", "chunk", "seq", "place", "value_json", "confidence", "turn_start", "before", "start_value", "start_turn",
    "start_seq", "start_place",
)


def _folded(shape: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The fold over sorted batches: every batch goes on as it came, with the columns of ``CHANGE``.

    Claims are not turned into Python objects but for the few values that the walk compares.
    """

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag, state, score = None, None, None
        for batch in parts:
            if not batch.num_rows:
                continue
            added = []
            for entity, name, chunk, seq, place, value, confidence, turn, before, *start in zip(
                *(batch.column(c).to_pylist() for c in FOLD_COLUMNS)
            ):
                key, confidence = (entity, name, chunk), math.nan if confidence is None else confidence
                if key != tag or chunk is None:
                    tag, state = key, None
                    if start[2] is not None:
                        state = tuple(start)
                    score = -1.0 if _missing(before) else before
                old, here = None, (value, turn, seq, place)
                if state is None:
                    what, state = "added", here
                elif value == state[0]:
                    what = "corroborated"
                elif confidence > score or (confidence == score and turn > state[1]):
                    what, old, state = "state_changed", state[0], here
                else:
                    what, old = "ignored", value
                score = max(score, confidence)
                added.append((what, old, state[0], state[2], state[3], score))
            new = dict(zip(CHANGE.fieldNames(), zip(*added)))
            columns = [pa.array(new[f.name], f.type) if f.name in new else batch.column(f.name) for f in shape]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(f.name, c.type) for f, c in zip(shape, columns)]))

    return fold


CHANGE = T.StructType(
    [
        T.StructField("change", T.StringType()),
        T.StructField("previous_value", T.StringType()),
        T.StructField("new_value", T.StringType()),
        T.StructField("state_seq", T.LongType()),
        T.StructField("state_place", T.IntegerType()),
        T.StructField("level", T.DoubleType()),
    ]
)


def _chunk_starts(claims: DataFrame) -> DataFrame:
    """States at chunk starts, for keys that span more than one chunk."""
    keys = ["entity_id", "key"]
    tops = claims.groupBy(*keys, "chunk").agg(F.max("confidence").alias("_c"), F.max("turn_start").alias("_t"))
    w = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    spans = tops.select(
        *keys,
        "chunk",
        F.max("_c").over(w).alias("before"),
        F.max("_t").over(w).alias("last_turn"),
        F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"),
    ).filter("_n > 1")
    rows = claims.select(*keys, "chunk", "seq", "place", "value_json", "confidence", "turn_start")
    summaries = (
        rows.join(spans.drop("_n"), [*keys, "chunk"])
        .repartition(*keys, "chunk")
        .sortWithinPartitions(*keys, "chunk", "seq", "place")
        .mapInPandas(_summarize, SUMMARY)
    )
    return summaries.repartition(*keys).sortWithinPartitions(*keys, "chunk").mapInPandas(_relay, START)


def fold_attributes(claims: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Every attribute arrival with what it did to the state of its (entity, key).

    Adds ``change`` (added, corroborated, state_changed, ignored),
    ``previous_value``, ``new_value``, ``state_seq`` and ``state_place`` (the arrival that
    set the value now held) and ``level`` (the confidence now held). A different
    value replaces the state if it is more confident, or as confident and from
    a later turn.

    The fold does not commute, so each (entity, key) is walked in order of
    (``seq``, ``place``), but in chunks of ``chunk`` arrival numbers that run side by side.
    A key within one chunk is walked at once. For the others a first pass
    reduces each chunk to its effect on an unknown state, and a second hands
    states from chunk to chunk.
    """
    keys = ["entity_id", "key"]
    held = claims.schema["anchors"].dataType if "anchors" in claims.columns else None
    rows = claims.select(*[c for c in CLAIM if held or c != "anchors"])
    if held:
        # Text, as Spark takes time in the square of a batch to hand a nested column to Python.
        rows = rows.withColumn("anchors", F.to_json("anchors"))
    rows = rows.withColumn("chunk", F.floor(F.col("seq") / chunk))
    shape = T.StructType([f for f in rows.schema if f.name != "chunk"] + CHANGE.fields)
    rows = rows.join(_chunk_starts(rows), [*keys, "chunk"], "left")
    ordered = rows.repartition(*keys, "chunk").sortWithinPartitions(*keys, "chunk", "seq", "place")
    out = ordered.mapInArrow(_folded(to_arrow_schema(shape)), shape)
    anchors = F.from_json("anchors", held) if held else F.lit(None).cast(T.ArrayType(ANCHOR))
    return out.withColumn("anchors", anchors).select(*CLAIM, *CHANGE.fieldNames())


def attribute_state(changes: DataFrame) -> DataFrame:
    """(entity_id, key, value_json, confidence, source_turn_id, turn_start, state_seq, first_seq): what each key holds at the end."""
    last = changes.groupBy("entity_id", "key").agg(
        F.max_by(F.struct("new_value", "level", "state_seq", "state_place"), F.struct("seq", "place")).alias("_s"),
        F.min("seq").alias("first_seq"),
    )
    rows = last.select(
        "entity_id",
        "key",
        F.col("_s.new_value").alias("value_json"),
        F.col("_s.level").alias("confidence"),
        F.col("_s.state_seq").alias("state_seq"),
        F.col("_s.state_place").alias("state_place"),
        "first_seq",
    )
    origin = changes.select(
        F.col("seq").alias("state_seq"), F.col("place").alias("state_place"), "source_turn_id", "turn_start"
    )
    return rows.join(origin, ["state_seq", "state_place"])


def attribute_evidence(changes: DataFrame, state: DataFrame) -> DataFrame:
    """Anchors of the value that each key holds: its own arrival and all that corroborated it since."""
    owner = ["state_seq", "state_place"]
    support = changes.filter("change <> 'ignored'").select("entity_id", "key", *owner, "seq", "anchors")
    held = support.join(state.select(*owner), owner, "left_semi")
    return evidence(held, ["entity_id", "key"])


# --- entity cards -------------------------------------------------------------


@dataclass
class MergedCards:
    """``cards``, one row per entity; their ``aliases`` and ``attributes`` as tables; evidence of cards and of attributes; all changes."""

    cards: DataFrame
    aliases: DataFrame
    attributes: DataFrame
    evidence: DataFrame
    attribute_evidence: DataFrame
    changes: DataFrame


def first_cards(cards: DataFrame) -> DataFrame:
    return cards.groupBy("entity_id").agg(F.min("seq").alias("seq"))


def card_aliases(cards: DataFrame) -> DataFrame:
    """(entity_id, alias, first_seq, first_place): each alias where it arrived first."""
    return (
        cards.select("entity_id", "seq", F.posexplode("aliases").alias("_p", "alias"))
        .groupBy("entity_id", "alias")
        .agg(F.min(F.struct("seq", "_p")).alias("_f"))
        .select("entity_id", "alias", F.col("_f.seq").alias("first_seq"), F.col("_f._p").alias("first_place"))
    )


def nest_aliases(cards: DataFrame, aliases: DataFrame) -> DataFrame:
    """A view of the cards with their distinct aliases as a list in order of arrival, one row per card."""
    lists = listed(aliases, ["entity_id"], F.struct("first_seq", "first_place", "alias"), "_l")
    names = F.transform("_l", lambda a: a["alias"])
    rows = cards.join(lists, "entity_id", "left")
    return rows.withColumn("aliases", F.coalesce(names, F.array().cast("array<string>"))).drop("_l")


def card_rows(cards: DataFrame) -> DataFrame:
    """Arriving cards merged per entity, without their lists."""
    return merge_rows(_single(cards.drop("aliases", "attributes")), "entity_id")


def merge_entities(cards: DataFrame, chunk: int = CHUNK) -> MergedCards:
    """One card per entity. The first witness gives id, name, type, network, content, summary and tags."""
    aliases = card_aliases(cards)
    proof = evidence(cards.select("entity_id", "seq", F.col("provenance.raw_quote_anchors").alias("anchors")), ["entity_id"])
    table = with_witnesses(card_rows(cards), proof, "entity_id")
    # Four results read the changes.
    changes = settled(card_changes(cards, chunk))
    folded = changes.filter("change <> 'stored'")
    state = attribute_state(folded)
    return MergedCards(
        table, aliases, state.unionByName(stored_attributes(changes)), proof, attribute_evidence(folded, state), changes
    )


def stored_attributes(changes: DataFrame) -> DataFrame:
    """Repeated keys of first cards, which are kept as they came."""
    return changes.filter("change = 'stored'").select(
        F.col("seq").alias("state_seq"), F.col("place").alias("state_place"), "entity_id", "key", "value_json", "confidence",
        F.col("seq").alias("first_seq"), "source_turn_id", "turn_start",
    )


def card_changes(
    cards: DataFrame, chunk: int = CHUNK, known: DataFrame | None = None, state: DataFrame | None = None
) -> DataFrame:
    """Attribute changes of arriving cards. A first card is stored as it is, so a key it repeats is not folded.

    ``known`` (entity_id) names entities that have a card already, and ``state`` is
    what their attributes hold; the fold goes on from there.
    """
    claims = explode_claims(cards)
    repeated = claims.filter("repeated")
    first = first_cards(cards)
    if known is not None:
        first = first.join(known.select("entity_id"), "entity_id", "left_anti")
    first = first.select("seq")
    stored = repeated.join(first, "seq", "left_semi")
    folded = claims.filter("NOT repeated").unionByName(repeated.join(first, "seq", "left_anti")).select(*CLAIM)
    kept = stored.select(
        *CLAIM,
        F.lit("stored").alias("change"),
        F.lit(None).cast("string").alias("previous_value"),
        F.col("value_json").alias("new_value"),
        F.col("seq").alias("state_seq"),
        F.col("place").alias("state_place"),
        F.col("confidence").alias("level"),
    )
    if state is None:
        return fold_attributes(folded, chunk).unionByName(kept)
    touched = folded.select("entity_id", "key").distinct()
    held = state.join(touched, ["entity_id", "key"], "left_semi").select(
        "entity_id", "key", F.col("state_seq").alias("seq"), F.col("state_place").alias("place"), "value_json", "confidence",
        "turn_start", "source_turn_id", F.lit(None).cast(folded.schema["anchors"].dataType).alias("anchors"),
    )
    changes = fold_attributes(folded.unionByName(held), chunk)
    return changes.join(cards.select("seq"), "seq", "left_semi").select(*CLAIM, *CHANGE.fieldNames()).unionByName(kept)


def card_outcomes(cards: DataFrame, changes: DataFrame, aliases: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(seq, id, arrival_id, outcome) per arriving card: created, state_changed, merged (new key or alias) or bumped.

    ``id`` names the stored card. ``aliases`` are those that first arrived with these cards; ``known`` lists cards already
    stored (``entity_id``, ``id``).
    """
    marks = changes.groupBy("seq").agg(
        F.max(F.col("change") == "state_changed").alias("_flip"), F.max(F.col("change") == "added").alias("_new")
    )
    named = aliases.select(F.col("first_seq").alias("seq"), F.lit(True).alias("_alias")).distinct()
    told = _told(cards.select("seq", "id", "entity_id"), "entity_id", known)
    rows = told.join(marks, "seq", "left").join(named, "seq", "left")
    outcome = (
        F.when(F.col("made"), "created")
        .when(F.col("_flip"), "state_changed")
        .when(F.col("_new") | F.col("_alias"), "merged")
        .otherwise("bumped")
    )
    return rows.select("seq", "id", "arrival_id", outcome.alias("outcome"))


def tick_summary(turns: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(measure, n): turns processed and outcomes by kind."""
    return turns.agg(F.lit("turns_processed").alias("measure"), F.count(F.lit(1)).alias("n")).unionAll(
        outcomes.groupBy(F.col("outcome").alias("measure")).agg(F.count(F.lit(1)).alias("n"))
    )
