"""Turn logs: marks, live turns, cuts, rolling windows and summary assets, for all sessions at once.

Turns have session_id, turn_id, role, content, turn_index and, where it
matters, ``summarized``. A session may be very long, so places and running
token sums come from ``with_running`` and cuts from per-session aggregates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import (
    INK,
    capitalized_tokens,
    estimate_tokens,
    stable_id,
    stub_summary,
    trim_space,
    utf16_head,
)
from ..schema import ANCHOR
from .ordering import CHUNK, top_per_key, with_running

# Defaults of the rolling summariser.
THRESHOLD = 16_384
WINDOW = 6
ANCHOR_CHARS = 64
SUMMARY_CONFIDENCE = 0.95
MAX_WORDS = 120
SUMMARY_TAG = "rolling-summary"

Estimator = Callable[[Column], Column]


def is_live() -> Column:
    return ~F.coalesce(F.col("summarized"), F.lit(False))


def live_turns(turns: DataFrame) -> DataFrame:
    """Turns not yet summarised."""
    return turns.filter(is_live())


def live_tokens(turns: DataFrame, estimator: Estimator = estimate_tokens) -> DataFrame:
    """(session_id, live_tokens, turns, summarized)."""
    return turns.groupBy("session_id").agg(
        F.sum(F.when(is_live(), estimator(F.col("content"))).otherwise(0)).alias("live_tokens"),
        F.count(F.lit(1)).alias("turns"),
        F.sum(F.when(is_live(), 0).otherwise(1)).alias("summarized"),
    )


def duplicate_turns(turns: DataFrame, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): of equal turn ids the first by ``order`` is kept. ``order`` is unique."""
    first = turns.groupBy("turn_id").agg(F.min(order).alias(order)).select(order)
    return turns.join(first, order, "left_semi"), turns.join(first, order, "left_anti")


# --- processed marks ----------------------------------------------------------


def placed_turns(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Turns with ``place``, from 1 in each session, and the session's ``size``."""
    rows = with_running(turns, ["session_id"], "turn_index", chunk=chunk)
    return rows.withColumnRenamed("ordinal", "place").withColumnRenamed("n_rows", "size")


def pending_turns(turns: DataFrame, marks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Turns past their session's ``processed_count``; a session without a mark is pending whole."""
    rows = placed_turns(turns, chunk).join(marks.select("session_id", "processed_count"), "session_id", "left")
    return rows.filter(F.col("place") > F.coalesce("processed_count", F.lit(0))).drop("place", "size", "processed_count")


def mark_processed(turns: DataFrame, marks: DataFrame, through: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(session_id, processed_count) after marking through the given (session_id, turn_id).

    A mark never moves back and lies in [0, size]; an unknown turn id changes nothing.
    """
    rows = placed_turns(turns, chunk)
    asked = through.select("session_id", "turn_id", F.lit(True).alias("_hit")).distinct()
    sizes = (
        rows.join(asked, ["session_id", "turn_id"], "left")
        .groupBy("session_id")
        .agg(F.count(F.lit(1)).alias("_size"), F.max(F.when(F.col("_hit"), F.col("place"))).alias("_to"))
    )
    old = F.greatest(F.lit(0), F.least(F.coalesce("processed_count", F.lit(0)), F.col("_size")))
    return sizes.join(marks.select("session_id", "processed_count"), "session_id", "left").select(
        "session_id", F.greatest(old, F.coalesce("_to", F.lit(0))).alias("processed_count")
    )


def progress_sync(
    sessions: DataFrame, turns: DataFrame, progress: DataFrame, summarized: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(sessions, turns) after storing marks and summarised turn ids; doing it twice changes nothing more."""
    new = progress.select("session_id", F.col("processed_count").alias("_new"))
    told = sessions.join(new, "session_id", "left").withColumn(
        "processed_count", F.coalesce("_new", "processed_count")
    )
    done = summarized.select("session_id", "turn_id", F.lit(True).alias("_done")).distinct()
    marked = turns.join(done, ["session_id", "turn_id"], "left").withColumn(
        "summarized", F.coalesce("_done", "summarized", F.lit(False))
    )
    return told.drop("_new"), marked.drop("_done")


# --- cuts ---------------------------------------------------------------------


def _cut_index(turns: DataFrame, cuts: DataFrame) -> DataFrame:
    """(session_id, _cut): the earliest named turn per session; unknown ids fall out."""
    named = turns.join(cuts.select("session_id", "turn_id"), ["session_id", "turn_id"], "left_semi")
    return named.groupBy("session_id").agg(F.min("turn_index").alias("_cut"))


def context_before(turns: DataFrame, cuts: DataFrame) -> DataFrame:
    """Live turns strictly before a given turn of their session; nothing where it is unknown."""
    rows = turns.join(_cut_index(turns, cuts), "session_id")
    return live_turns(rows.filter(F.col("turn_index") < F.col("_cut"))).drop("_cut")


def truncate_from(turns: DataFrame, cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): a given turn and all after it go. Summarised marks go with their turns."""
    rows = turns.join(_cut_index(turns, cuts), "session_id", "left")
    gone = F.coalesce(F.col("turn_index") >= F.col("_cut"), F.lit(False))
    return rows.filter(~gone).drop("_cut"), rows.filter(gone).drop("_cut")


def clamp_marks(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Sessions whose mark lies past their last turn get it set to their size."""
    sizes = turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("_size"))
    size = F.coalesce("_size", F.lit(0))
    return (
        sessions.join(sizes, "session_id", "left")
        .withColumn("processed_count", F.greatest(F.lit(0), F.least(F.col("processed_count"), size)))
        .drop("_size")
    )


def replace_from(turns: DataFrame, cuts: DataFrame, new_turns: DataFrame) -> DataFrame:
    """Truncate, then append; where the turn is unknown the new turns are appended alone."""
    kept, _ = truncate_from(turns, cuts)
    return kept.unionByName(new_turns.withColumn("summarized", F.lit(False)), allowMissingColumns=True)


def clear_turns(turns: DataFrame, sessions: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, sessions): the sessions lose their turns and their mark, and keep their row."""
    wanted = ids.select("session_id").distinct()
    left = turns.join(wanted, "session_id", "left_anti")
    reset = sessions.join(wanted.withColumn("_clear", F.lit(True)), "session_id", "left")
    count = F.when(F.col("_clear"), F.lit(0)).otherwise(F.col("processed_count"))
    return left, reset.withColumn("processed_count", count).drop("_clear")


# --- rolling windows ----------------------------------------------------------


def rolling_summary_windows(
    turns: DataFrame,
    threshold: int = THRESHOLD,
    window: int = WINDOW,
    estimator: Estimator = estimate_tokens,
    chunk: int = CHUNK,
) -> DataFrame:
    """Live turns to be summarised now, with their ``block`` number per session.

    The oldest ``window`` live turns are taken while the live tokens reach the
    threshold. So a block is taken exactly if the tokens from its first turn on
    reach it, and those are the largest such sum among its turns.
    """
    if window <= 0 or threshold <= 0:
        raise ValueError("window and threshold must be positive")
    tokens = estimator(F.col("content"))
    rows = with_running(live_turns(turns), ["session_id"], "turn_index", {"tokens": tokens}, chunk)
    rows = rows.withColumn("block", F.floor((F.col("ordinal") - 1) / window)).withColumn(
        "_from_here", F.col("all_tokens") - F.col("run_tokens") + tokens
    )
    whole = Window.partitionBy("session_id", "block")
    taken = rows.withColumn("_from_first", F.max("_from_here").over(whole)).filter(F.col("_from_first") >= threshold)
    return taken.drop("ordinal", "n_rows", "run_tokens", "all_tokens", "_from_here", "_from_first")


def summary_flush(turns: DataFrame, window: int = WINDOW) -> DataFrame:
    """The oldest ``window`` live turns of every session, as block 0."""
    first = top_per_key(live_turns(turns), ["session_id"], window, F.col("turn_index"))
    return first.drop("rank").withColumn("block", F.lit(0).cast("bigint"))


def stub_summarizer(turns: Column) -> Column:
    """The default summariser: an expression over the ordered turns of a window."""
    return stub_summary(turns)


def summary_assets(
    windows: DataFrame,
    summarizer: Callable[[Column], Column] = stub_summarizer,
    candidates: DataFrame | None = None,
    network: str = "experience",
    anchor_chars: int = ANCHOR_CHARS,
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """One SUMMARY asset per block, from rows with session_id, block and turn columns.

    ``candidates`` (session_id, block, text) are taken where they are valid. An
    empty turn leaves no anchor; ``empty_turns`` counts them.
    """
    listed = windows.groupBy("session_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("turn_index", "turn_id", "content"))).alias("_t")
    )
    turns, first, last = F.col("_t"), F.element_at("_t", 1), F.element_at("_t", -1)
    text = summarizer(turns)
    if candidates is not None:
        listed = listed.join(candidates.select("session_id", "block", F.col("text").alias("_text")), ["session_id", "block"], "left")
        text = F.when(valid_summary(F.col("_text"), turns, max_words), trim_space("_text")).otherwise(text)
    none = F.lit(None)
    anchors = F.transform(
        F.filter(turns, lambda t: t["content"] != ""),
        lambda t: F.struct(
            t["turn_id"].alias("turn_id"),
            utf16_head(t["content"], anchor_chars).alias("quote"),
            none.cast("int").alias("char_start"),
            none.cast("int").alias("char_end"),
        ).cast(ANCHOR),
    )
    provenance = F.struct(
        last["turn_id"].alias("source_turn_id"),
        F.lit(SUMMARY_CONFIDENCE).alias("confidence_score"),
        F.lit("derived").alias("confidence_source"),
        anchors.alias("raw_quote_anchors"),
        F.struct(
            first["turn_id"].alias("turn_start"),
            last["turn_id"].alias("turn_end"),
            none.cast("string").alias("narrative_start"),
            none.cast("string").alias("narrative_end"),
            F.lit(False).alias("narrative_always"),
        ).alias("temporal_range"),
    )
    return listed.select(
        "session_id",
        "block",
        stable_id(F.lit("summary"), "session_id", first["turn_id"], last["turn_id"]).alias("id"),
        F.lit(network).alias("network"),
        F.lit("summary").alias("kind"),
        text.alias("content"),
        provenance.alias("provenance"),
        F.array().cast("array<string>").alias("entity_ids"),
        F.array(F.lit(SUMMARY_TAG)).alias("tags"),
        none.cast("string").alias("viewpoint_holder"),
        none.cast("string").alias("last_updated_turn"),
        F.lit(0).cast("bigint").alias("relevance"),
        F.size(F.filter(turns, lambda t: t["content"] == "")).alias("empty_turns"),
    )


def mark_summarized(turns: DataFrame, windows: DataFrame) -> DataFrame:
    """The turn table with the given turns marked."""
    done = windows.select("session_id", "turn_id", F.lit(True).alias("_done")).distinct()
    marked = turns.join(done, ["session_id", "turn_id"], "left")
    return marked.withColumn("summarized", F.coalesce("_done", "summarized", F.lit(False))).drop("_done")


def valid_summary(text: Column, turns: Column, max_words: int = MAX_WORDS) -> Column:
    """Whether a candidate is not empty, not too long, and names a capitalised word of its turns (if they have any)."""
    body = trim_space(F.coalesce(text, F.lit("")))
    words = F.regexp_count(body, F.lit(INK))
    names = F.flatten(F.transform(turns, lambda t: capitalized_tokens(t["content"])))
    named = (F.size(names) == 0) | F.exists(names, lambda n: F.contains(body, n))
    return (body != "") & (words <= max_words) & named
