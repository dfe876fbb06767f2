"""Streaming queries over a turn log. A file source's checkpoint is the mark of what has been processed."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scoring import gate_floor, gate_mentions
from ..functions.text import estimate_tokens
from ..operators import extract
from ..operators.lineage import settled
from ..operators.ordering import top_per_key
from ..plans.ingest import arrivals_of
from .deltas import DeltaLog
from .sinks import Sink


def turn_source(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = 1) -> DataFrame:
    """Turns from files that are added to a folder; without a number of files, all that are new are one batch."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(path)


class StreamGate:
    """The skepticism gate with mention counts kept across batches.

    Per signature only as many mentions count as the gate asks for, so both the
    rows that are ranked in a batch and the stored counts stay small, however
    often a claim is repeated.
    """

    def __init__(self, spark: SparkSession, path: str, skepticism: float):
        self.floor, self.needed = gate_floor(skepticism), gate_mentions(skepticism)
        shape = T.StructType([T.StructField("mention_key", T.StringType()), T.StructField("n", T.LongType())])
        self.counts = DeltaLog(spark, f"{path}/mentions", shape)

    def __call__(self, assets: DataFrame, batch_id: int) -> DataFrame:
        if self.needed <= 1:
            return assets
        weak = assets.filter(F.col("provenance.confidence_score") < self.floor)
        early = top_per_key(
            weak.select(extract.mention_key(weak).alias("mention_key"), "seq"), ["mention_key"], self.needed, F.col("seq")
        )
        before = self.counts.read(before=batch_id).groupBy("mention_key").agg(F.sum("n").alias("_n"))
        seen = settled(early.join(before, "mention_key", "left").withColumn("_n", F.coalesce("_n", F.lit(0))))
        counted = seen.groupBy("mention_key", "_n").agg(F.count(F.lit(1)).alias("n"))
        self.counts.write(counted.filter(F.col("_n") < self.needed), batch_id)
        held = seen.filter(F.col("_n") + F.col("rank") < self.needed)
        return assets.join(held.select("seq"), "seq", "left_anti")


def stream_ingest(
    turns: DataFrame,
    path: str,
    sink: Sink,
    skepticism: float = 0.0,
    checkpoint: str | None = None,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Extract, verify, gate, embed and hand every batch of turns to a sink. Options as for ``arrivals_of``."""
    gate = StreamGate(turns.sparkSession, path, skepticism)

    def process(batch: DataFrame, batch_id: int) -> None:
        arrivals = settled(arrivals_of(batch, **options))
        sink(gate(arrivals, batch_id), batch_id)

    return run_batches(turns, process, checkpoint or f"{path}/checkpoint", trigger)


def stream_assets(
    assets: DataFrame, sink: Sink, checkpoint: str, gate: StreamGate | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Hand a stream of assets to a sink."""

    def process(batch: DataFrame, batch_id: int) -> None:
        sink(batch if gate is None else gate(batch, batch_id), batch_id)

    return run_batches(assets, process, checkpoint, trigger)


def run_batches(
    stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Run a function on every micro-batch; without a trigger, on all there is and then stop."""
    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


WINDOW_ROW = T.StructType(
    [
        T.StructField("session_id", T.LongType()),
        T.StructField("block", T.LongType()),
        T.StructField("turn_id", T.StringType()),
        T.StructField("turn_index", T.IntegerType()),
        T.StructField("content", T.StringType()),
    ]
)
PENDING = T.StructType([T.StructField("pending", T.StringType()), T.StructField("block", T.LongType())])


def stream_windows(
    turns: DataFrame, threshold: int, window: int, estimator: Callable[[Column], Column] = estimate_tokens
) -> DataFrame:
    """Turns to be summarised as they fall due, with their block number: one tick per batch and session.

    The state of a session is its live turns, which hold less than the threshold's tokens after a tick.
    """

    def tick(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, block = state.get if state.exists else ("[]", 0)
        live = json.loads(pending)
        for pdf in parts:
            live.extend(zip(pdf["turn_index"].tolist(), pdf["turn_id"], pdf["content"], pdf["tokens"].tolist()))
        live.sort(key=lambda t: t[0])
        total, taken, out = sum(t[3] for t in live), 0, []
        while total >= threshold and taken < len(live):
            for index, turn_id, content, tokens in live[taken : taken + window]:
                out.append((key[0], block, turn_id, index, content))
                total -= tokens
            taken, block = taken + window, block + 1
        state.update((json.dumps(live[taken:]), block))
        if out:
            yield pd.DataFrame(out, columns=WINDOW_ROW.fieldNames())

    rows = turns.select("session_id", "turn_id", "turn_index", "content", estimator(F.col("content")).alias("tokens"))
    return rows.groupBy("session_id").applyInPandasWithState(
        tick, WINDOW_ROW, PENDING, "append", GroupStateTimeout.NoTimeout
    )
