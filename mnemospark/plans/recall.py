"""Hybrid recall and the memory context block, for tables of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CHARS_PER_TOKEN, estimate_tokens, trim_space, utf16_length
from ..operators import retrieve
from ..operators.mentions import mentions
from ..operators.ordering import top_per_key
from ..operators.select import recalled_except_summaries

# Defaults of the context block.
MAX_SUMMARIES = 3
MAX_RECALLED = 10
CONTEXT_BUDGET = 2000
RELEVANT_KINDS = ("fact", "rule", "lore", "opinion", "reflection")


@dataclass
class MemoryTables:
    """What recall reads.

    ``assets``: id, kind, network, viewpoint_holder, content, recency_key, body
    (the text to search), and ``tokens`` if stored. ``refs``: asset_id, entity_id. ``names``: name,
    entity_id, reg_seq. ``lore``: id, network, viewpoint_holder, embedding. ``index``: the written keyword index of all bodies,
    if there is one (``keyword_index(assets, text="body")``); otherwise each recall indexes the terms of its queries.
    """

    assets: DataFrame
    refs: DataFrame | None = None
    names: DataFrame | None = None
    lore: DataFrame | None = None
    index: retrieve.KeywordIndex | None = None

    def indexed(self) -> MemoryTables:
        """The same tables with a written keyword index, for many recalls over one state of the memory."""
        return replace(self, index=retrieve.keyword_index(self.assets, text="body"))


def fusion_recall(
    memory: MemoryTables,
    queries: DataFrame,
    k: int | None = None,
    budget: int | None = None,
    network: str | Iterable[str] | None = None,
    viewpoint_holder: str | None = None,
    channels: Iterable[str] = retrieve.CHANNELS,
    literalism: float = 0.0,
    channel_k: int = retrieve.CHANNEL_TOP_K,
    rrf_k: int = retrieve.RRF_K,
    estimator: Callable[[Column], Column] = estimate_tokens,
) -> DataFrame:
    """(query_id, id, score, channels, tokens, position, asset columns).

    ``queries`` has query_id and query, and ``vector`` where the vector channel is
    on. A channel without its table, or a query without a vector, adds nothing.
    """
    on = set(channels)
    ranked: dict[str, DataFrame] = {}
    if "vector" in on and memory.lore is not None and "vector" in queries.columns:
        scoped = retrieve.scope_filter(memory.lore, network, viewpoint_holder)
        have = queries.filter(F.col("vector").isNotNull()).select("query_id", "vector")
        ranked["vector"] = retrieve.vector_topk(scoped, have, channel_k)
    if "bm25" in on:
        if memory.index is not None:
            ranked["bm25"] = retrieve.search_index(memory.index, queries, channel_k)
        else:
            ranked["bm25"] = retrieve.bm25_search(memory.assets, queries, channel_k, text="body")
    if "entity" in on and memory.names is not None and memory.refs is not None:
        said = mentions(queries, memory.names, id="query_id", text="query").withColumnRenamed("id", "query_id")
        ranked["entity"] = retrieve.entity_channel(said, memory.refs, channel_k)
    if "chronological" in on:
        ranked["chronological"] = retrieve.recency_channel(queries, memory.assets, channel_k)
    fused = retrieve.rrf_fuse(ranked, rrf_k)
    assets = memory.assets.drop("body", "recency_key")
    hits = retrieve.hydrate(fused, retrieve.with_tokens(assets, estimator).drop("content"))
    hits = retrieve.literalism_boost(retrieve.scope_filter(hits, network, viewpoint_holder), literalism)
    if k is None and budget is None:
        k = len(retrieve.CHANNELS) * channel_k
    taken = retrieve.token_budget(hits, budget, k)
    # The texts join last, for the hits that are left.
    return taken.join(assets.select("id", "content"), "id")


def trim_lines(block: Column, budget: int, estimator: Callable[[Column], Column] | None = None) -> Column:
    """Drop lines from the end until the block fits; the first line always stays."""
    lines = F.split(block, "\n", -1)
    if estimator is None:
        # One pass: a prefix of k lines has the length of its lines and k - 1 line ends.
        start = F.struct(F.lit(-1).alias("units"), F.lit(0).alias("kept"))
        fits = lambda units: units <= budget * CHARS_PER_TOKEN
        run = F.aggregate(
            lines,
            start,
            lambda acc, line: F.struct(
                (acc["units"] + utf16_length(line) + 1).alias("units"),
                (acc["kept"] + F.when(fits(acc["units"] + utf16_length(line) + 1), 1).otherwise(0)).alias("kept"),
            ),
        )
        kept, whole = run["kept"], estimate_tokens(block)
    else:
        sizes = F.sequence(F.lit(1), F.size(lines))
        fitting = F.filter(sizes, lambda n: estimator(F.array_join(F.slice(lines, F.lit(1), n), "\n")) <= budget)
        kept, whole = F.coalesce(F.array_max(fitting), F.lit(1)), estimator(block)
    short = F.array_join(F.slice(lines, F.lit(1), F.greatest(kept, F.lit(1))), "\n")
    return F.when(whole <= budget, block).otherwise(short)


def summary_positions(summaries: DataFrame, turns: DataFrame) -> DataFrame:
    """Summaries placed by their last turn (else their source turn); those without such a turn fall out."""
    placed = summaries.withColumn("turn_id", F.coalesce("turn_end", "source_turn_id"))
    return placed.join(turns.select("turn_id", "session_id", F.col("turn_index").alias("pos")), "turn_id")


def recent_summaries(placed: DataFrame, n: int = MAX_SUMMARIES) -> DataFrame:
    """The last ``n`` summaries of each session, with ``place`` 1 for the oldest of them."""
    last = top_per_key(placed, ["session_id"], n, F.col("pos").desc(), F.col("id").desc(), rank="_back")
    listed = last.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "content"))).alias("_l"))
    rows = listed.select("session_id", F.posexplode("_l").alias("place", "_s"))
    return rows.select("session_id", "_s.id", "_s.content", "_s.pos", (F.col("place") + 1).alias("place"))


def memory_context(
    memory: MemoryTables,
    summaries: DataFrame,
    turns: DataFrame,
    queries: DataFrame,
    max_summaries: int = MAX_SUMMARIES,
    max_recalled: int = MAX_RECALLED,
    budget: int = CONTEXT_BUDGET,
    estimator: Callable[[Column], Column] = estimate_tokens,
) -> DataFrame:
    """(query_id, block): a markdown block per query, NULL where there is nothing to say.

    ``queries`` has query_id, session_id, query and maybe vector. A blank query
    recalls nothing but still tells the story so far.
    """
    told = recent_summaries(summary_positions(summaries, turns), max_summaries)
    per_query = queries.select("query_id", "session_id").join(told, "session_id")
    story = per_query.groupBy("query_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("place", "content"))), lambda s: trim_space(s["content"])),
            "\n\n",
        ).alias("story")
    )
    asked = queries.filter(trim_space("query") != "")
    hits = fusion_recall(memory, asked, k=max_recalled, budget=budget, estimator=estimator)
    hits = recalled_except_summaries(hits, per_query).filter(F.col("kind").isin(*RELEVANT_KINDS))
    bullets = hits.groupBy("query_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("position", "content"))),
                lambda h: F.concat(F.lit("- "), trim_space(h["content"])),
            ),
            "\n",
        ).alias("bullets")
    )
    rows = queries.select("query_id").join(story, "query_id", "left").join(bullets, "query_id", "left")
    parts = F.concat_ws(
        "\n\n",
        F.when(F.col("story").isNotNull(), F.concat(F.lit("## Story so far\n\n"), "story")),
        F.when(F.col("bullets").isNotNull(), F.concat(F.lit("## Relevant memories\n\n"), "bullets")),
    )
    block = F.when(parts != "", F.concat(F.lit("# Memory context\n\n"), parts))
    own = None if estimator is estimate_tokens else estimator
    return rows.select("query_id", block.alias("block")).select("query_id", trim_lines(F.col("block"), budget, own).alias("block"))
