"""Composable writers of arriving assets. A sink takes (arrivals, batch_id) and returns (seq, id, arrival_id, outcome)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import index_value, tokenize
from ..operators import reconcile, retrieve
from ..operators.extract import mention_key
from ..operators.lineage import settled
from ..operators.ordering import first_per_key
from ..operators.validate import checked, refused
from ..schema import ATTRIBUTE, PROVENANCE
from .deltas import DeltaLog

Sink = Callable[[DataFrame, int], DataFrame]

S, L, I, D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()


def _fields(*pairs: tuple[str, T.DataType]) -> list[T.StructField]:
    return [T.StructField(n, t) for n, t in pairs]


COMMON = _fields(
    ("id", S), ("network", S), ("kind", S), ("content", S), ("provenance", PROVENANCE), ("entity_ids", T.ArrayType(S)),
    ("tags", T.ArrayType(S)), ("viewpoint_holder", S), ("last_updated_turn", S), ("relevance", L),
)
MERGE = _fields(("first_seq", L), ("last_seq", L), ("last_turn", S), ("n_arrivals", L))
EVIDENCE = _fields(("turn_id", S), ("quote", S), ("char_start", I), ("char_end", I), ("first_seq", L), ("copy", I))
CARD = _fields(("entity_type", S), ("canonical_name", S), ("summary", S))
OUTCOME = T.StructType(_fields(("seq", L), ("id", S), ("arrival_id", S), ("outcome", S)))
STATE = _fields(
    ("entity_id", S), ("key", S), ("value_json", S), ("confidence", D), ("source_turn_id", S), ("turn_start", S),
    ("state_seq", L), ("state_place", I), ("first_seq", L),
)


class RoutedSink:
    """Writes assets as they come, to the store their kind belongs to. Every outcome is ``created``.

    A row that breaks a rule fails the batch. A later row replaces an earlier one of its id, as ``current`` reads them.
    """

    def __init__(self, spark: SparkSession, path: str, dimension: int | None = None):
        full = T.StructType(
            _fields(("seq", L)) + COMMON + _fields(("entity_id", S), *[(f.name, f.dataType) for f in CARD],
            ("aliases", T.ArrayType(S)), ("attributes", T.ArrayType(ATTRIBUTE)), ("embedding", T.ArrayType(D)), ("embedding_model", S), ("target", S))
        )
        self.log, self.dimension = DeltaLog(spark, f"{path}/routed", full), dimension

    def __call__(self, arrivals: DataFrame, batch_id: int) -> DataFrame:
        self.log.write(refused(arrivals, self.dimension), batch_id)
        return self.log.batch(batch_id).select("seq", "id", F.col("id").alias("arrival_id"), F.lit("created").alias("outcome"))

    def current(self) -> DataFrame:
        """The last row of every id and store."""
        return first_per_key(self.log.read(), ["target", "id"], F.col("batch_id").desc(), F.col("seq").desc()).drop("batch_id")


class DedupSink:
    """Reconciles arrivals with what is stored.

    Each batch stores its own merged rows and evidence. Since those merge
    associatively, the tables below are merges of all batches. Attribute
    states are the exception: a batch folds on from the stored ones. Arrivals that break a rule go to ``quarantine`` with
    what is wrong with them, and touch nothing else. ``dimension`` is that of the lore's embeddings.
    """

    def __init__(self, spark: SparkSession, path: str, dimension: int | None = None):
        self.dimension = dimension
        log = lambda name, fields: DeltaLog(spark, f"{path}/{name}", T.StructType(fields))
        entity, owner = ("entity_id", S), _fields(("state_seq", L), ("state_place", I))
        self.assets = log("assets", _fields(("dedup_key", S)) + COMMON + MERGE)
        self.evidence = log("evidence", _fields(("dedup_key", S)) + EVIDENCE)
        self.cards = log("cards", _fields(entity) + COMMON + CARD + MERGE)
        self.aliases = log("aliases", _fields(entity, ("alias", S), ("first_seq", L), ("first_place", I)))
        self.card_evidence = log("card_evidence", _fields(entity) + EVIDENCE)
        self.states = log("attribute_states", STATE)
        self.stored = log("stored_attributes", STATE)
        self.support = log("attribute_evidence", _fields(entity, ("key", S)) + owner + EVIDENCE)
        self.lore = log("lore", _fields(("seq", L)) + COMMON + _fields(("embedding", T.ArrayType(D)), ("embedding_model", S)))
        self.outcomes = log("outcomes", list(OUTCOME.fields))
        self.quarantine = log("quarantine", _fields(("seq", L)) + COMMON + _fields(("violations", T.ArrayType(S))))

    # --- tables as of the last batch ---

    def current_assets(self, before: int | None = None) -> DataFrame:
        rows = reconcile.merge_rows(self.assets.read(before).drop("batch_id"), "dedup_key")
        proof = reconcile.merge_evidence(self.evidence.read(before), ["dedup_key"])
        return reconcile.with_witnesses(rows, proof, "dedup_key")

    def current_aliases(self, before: int | None = None) -> DataFrame:
        place = F.struct("first_seq", "first_place")
        return (
            self.aliases.read(before).groupBy("entity_id", "alias").agg(F.min(place).alias("_f"))
            .select("entity_id", "alias", "_f.first_seq", "_f.first_place")
        )

    def current_cards(self, before: int | None = None) -> DataFrame:
        rows = reconcile.merge_rows(self.cards.read(before).drop("batch_id"), "entity_id")
        proof = reconcile.merge_evidence(self.card_evidence.read(before), ["entity_id"])
        return reconcile.with_witnesses(rows, proof, "entity_id")

    def current_states(self, before: int | None = None) -> DataFrame:
        """What each folded (entity, key) holds: its state of the latest batch."""
        value = F.struct(*[f.name for f in STATE if f.name not in ("entity_id", "key", "first_seq")])
        last = self.states.read(before).groupBy("entity_id", "key").agg(
            F.max_by(value, "batch_id").alias("_v"), F.min("first_seq").alias("first_seq")
        )
        return last.select("entity_id", "key", "_v.*", "first_seq")

    def current_attributes(self) -> DataFrame:
        names = [f.name for f in STATE]
        return self.current_states().select(*names).unionByName(self.stored.read().select(*names))

    def current_attribute_evidence(self) -> DataFrame:
        owner = ["state_seq", "state_place"]
        held = self.support.read().join(self.current_states().select(*owner), owner, "left_semi")
        return reconcile.merge_evidence(held, ["entity_id", "key"])

    # --- one batch ---

    def __call__(self, arrivals: DataFrame, batch_id: int) -> DataFrame:
        # A dozen tables are written from the arrivals.
        names = [f.name for f in COMMON]
        # The signatures are written with the judged arrivals, as several of the tables are made by them.
        arrivals = arrivals.drop("dedup_key")
        judged = checked(arrivals.withColumn("dedup_key", mention_key(arrivals)), self.dimension)
        self.quarantine.write(judged.quarantined.select("seq", *names, "violations"), batch_id)
        arrivals = judged.accepted
        atomic = arrivals.filter("target = 'structured'").select("seq", *names, "dedup_key")
        deduped = reconcile.dedup_rows(atomic)
        self.assets.write(deduped.assets, batch_id)
        self.evidence.write(deduped.evidence, batch_id)
        known_keys = reconcile.first_ids(self.assets.read(before=batch_id), "dedup_key")
        told = reconcile.atomic_outcomes(atomic, known_keys)

        cards = arrivals.filter("target = 'entity'").select(
            "seq", *names, "entity_id", *[f.name for f in CARD], "aliases", "attributes"
        )
        self.cards.write(reconcile.card_rows(cards), batch_id)
        proof = F.col("provenance.raw_quote_anchors").alias("anchors")
        self.card_evidence.write(reconcile.evidence(cards.select("entity_id", "seq", proof), ["entity_id"]), batch_id)
        known = reconcile.first_ids(self.cards.read(before=batch_id), "entity_id")
        old = self.aliases.read(before=batch_id).select("entity_id", "alias").distinct()
        fresh = settled(reconcile.card_aliases(cards).join(old, ["entity_id", "alias"], "left_anti"))
        self.aliases.write(fresh, batch_id)
        from ..plans.ingest import TURN_CHUNK

        changes = settled(
            reconcile.card_changes(cards, TURN_CHUNK, known=known, state=self.current_states(before=batch_id))
        )
        folded = changes.filter("change <> 'stored'")
        last = folded.groupBy("entity_id", "key").agg(
            F.max_by(F.struct("new_value", "level", "state_seq", "state_place"), F.struct("seq", "place")).alias("_s"),
            F.min("seq").alias("first_seq"),
        )
        states = last.select(
            "entity_id", "key", F.col("_s.new_value").alias("value_json"), F.col("_s.level").alias("confidence"),
            F.col("_s.state_seq").alias("state_seq"), F.col("_s.state_place").alias("state_place"), "first_seq",
        )
        origins = folded.select(F.col("seq").alias("state_seq"), F.col("place").alias("state_place"), "source_turn_id", "turn_start")
        origins = origins.unionByName(
            self.current_states(before=batch_id).select("state_seq", "state_place", "source_turn_id", "turn_start")
        )
        self.states.write(states.join(origins, ["state_seq", "state_place"]), batch_id)
        self.stored.write(reconcile.stored_attributes(changes), batch_id)
        support = folded.filter("change <> 'ignored'").select("entity_id", "key", "state_seq", "state_place", "seq", "anchors")
        self.support.write(reconcile.evidence(support, ["entity_id", "key", "state_seq", "state_place"]), batch_id)
        told = told.unionByName(reconcile.card_outcomes(cards, changes, fresh, known))

        lore = arrivals.filter("target = 'vector'")
        self.lore.write(lore, batch_id)
        self.outcomes.write(told.unionByName(lore.select("seq", "id", F.col("id").alias("arrival_id"), F.lit("created").alias("outcome"))), batch_id)
        return self.outcomes.batch(batch_id)

    def touched(self, batch_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """What a batch changed, as it stands after it: (assets, text fragments, names).

        assets: id, recency_key. fragments: id, text, whose tokens together are the
        asset's searchable text. names: id, entity_id, name, reg_seq.
        """
        upto = batch_id + 1
        key = retrieve.recency_key(F.col("last_updated_turn"), F.col("provenance.source_turn_id")).alias("recency_key")
        keys = self.assets.batch(batch_id).select("dedup_key")
        atomic = reconcile.merge_rows(
            self.assets.read(upto).drop("batch_id").join(keys, "dedup_key", "left_semi"), "dedup_key"
        ).select("id", "content", key)
        lore = self.lore.batch(batch_id).select("id", "content", key)
        plain = settled(atomic.unionAll(lore))
        entities = self.cards.batch(batch_id).select("entity_id")
        semi = lambda df: df.join(entities, "entity_id", "left_semi")
        cards = settled(
            reconcile.merge_rows(semi(self.cards.read(upto).drop("batch_id")), "entity_id").select(
                "entity_id", "id", "entity_type", "canonical_name", "content", "summary", "first_seq", key
            )
        )
        owner = cards.select("entity_id", "id")
        aliases = semi(self.current_aliases(upto)).join(owner, "entity_id").select("id", "entity_id", F.col("alias").alias("text"))
        held = semi(self.current_states(upto)).select("entity_id", "key", "value_json").unionByName(
            semi(self.stored.read(upto)).select("entity_id", "key", "value_json")
        )
        lines = held.join(owner, "entity_id").select("id", F.concat("key", F.lit(": "), index_value("value_json")).alias("text"))
        fixed = cards.select("id", F.explode(F.array("canonical_name", "entity_type", "content", "summary")).alias("text"))
        fragments = (
            plain.select("id", F.col("content").alias("text")).unionAll(fixed).unionAll(aliases.select("id", "text")).unionAll(lines)
        )
        order = cards.select("entity_id", F.col("first_seq").alias("reg_seq"))
        names = cards.select("id", "entity_id", F.col("canonical_name").alias("text")).unionAll(aliases)
        names = names.select("id", "entity_id", F.lower("text").alias("name")).filter("name <> ''").distinct().join(order, "entity_id")
        return plain.select("id", "recency_key").unionAll(cards.select("id", "recency_key")), fragments, names


class SearchIndex:
    """Keyword, entity-name and recency indexes. A document indexed again replaces its rows."""

    def __init__(self, spark: SparkSession, path: str):
        log = lambda name, *pairs: DeltaLog(spark, f"{path}/{name}", T.StructType(_fields(*pairs)))
        self.docs = log("index_docs", ("id", S), ("doc_len", L), ("recency_key", S), ("deleted", T.BooleanType()))
        self.postings = log("index_postings", ("term", S), ("id", S), ("doc_len", L), ("tf", L))
        self.names = log("index_names", ("id", S), ("entity_id", S), ("name", S), ("reg_seq", L))

    def add(
        self,
        assets: DataFrame,
        fragments: DataFrame,
        batch_id: int,
        names: DataFrame | None = None,
        deleted: DataFrame | None = None,
    ) -> None:
        """Index assets (id, recency_key) by the tokens of their text fragments (id, text), and drop deleted ids.

        The text of an asset may come in any number of fragments, so that a card
        with very many names or attributes need not be put together.
        """
        counted = settled(
            fragments.select("id", F.explode_outer(tokenize("text")).alias("term"))
            .filter("term IS NOT NULL")
            .groupBy("id", "term")
            .agg(F.count(F.lit(1)).alias("tf"))
        )
        sizes = counted.groupBy("id").agg(F.sum("tf").alias("doc_len"))
        docs = assets.join(sizes, "id", "left").select(
            "id", F.coalesce("doc_len", F.lit(0)).alias("doc_len"), "recency_key", F.lit(False).alias("deleted")
        )
        if deleted is not None:
            gone = deleted.select("id", F.lit(0).cast("bigint"), F.lit(None).cast("string"), F.lit(True))
            docs = docs.unionAll(gone)
        self.docs.write(docs, batch_id)
        self.postings.write(counted.join(sizes, "id"), batch_id)
        if names is not None:
            self.names.write(names, batch_id)

    def _latest(self) -> DataFrame:
        rows = first_per_key(self.docs.read(), ["id"], F.col("batch_id").desc())
        return rows.filter("NOT deleted")

    def current_docs(self) -> DataFrame:
        return self._latest().drop("batch_id", "deleted")

    def current_postings(self) -> DataFrame:
        return self.postings.read().join(self._latest().select("id", "batch_id"), ["id", "batch_id"], "left_semi")

    def current_names(self) -> DataFrame:
        live = self.names.read().join(self._latest().select("id", "batch_id"), ["id", "batch_id"], "left_semi")
        return live.select("name", "entity_id", "reg_seq")

    def search(self, queries: DataFrame, k: int = retrieve.CHANNEL_TOP_K) -> DataFrame:
        # As a struct a query's id may be NULL.
        queries = queries.select(F.struct("query_id").alias("query_id"), "query")
        wanted = retrieve.query_terms(queries).select("term").distinct()
        live = settled(self.current_postings().select("term", "id", "doc_len", "tf").join(wanted, "term", "left_semi"))
        whole = self.current_docs().agg(F.count(F.lit(1)).alias("n"), F.sum("doc_len").alias("total")).first()
        hits = retrieve.search_index(retrieve.index_of(live, whole.n, whole.total or 0), queries, k)
        return hits.select("query_id.query_id", "id", "score", "rank")


class IndexingSink:
    """Another sink, whose results are indexed as they stand after each batch."""

    def __init__(self, inner: DedupSink, index: SearchIndex):
        self.inner, self.index = inner, index

    def __call__(self, arrivals: DataFrame, batch_id: int) -> DataFrame:
        outcomes = self.inner(arrivals, batch_id)
        assets, fragments, names = self.inner.touched(batch_id)
        self.index.add(assets, fragments, batch_id, names)
        return outcomes


__all__ = ["DedupSink", "IndexingSink", "RoutedSink", "SearchIndex", "Sink"]
