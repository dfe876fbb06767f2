"""Entity names: exact lookup and mentions in free text.

A text is cut into *pieces*: each run of ``[a-z0-9'-]`` is one, and so is every
other character. A name stands word-bounded in a text exactly where a run of
pieces equals it and no word piece touches an outer end that is itself no
word piece. So finding names is an equi-join of piece runs to names, and
overlaps can be counted in pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import utf16_length
from .ordering import first_per_key

PIECE = "[a-z0-9'-]+|[^a-z0-9'-]"
#: Leading pieces of a name by which its places are found.
HEAD = 3


def _is_word(piece: Column) -> Column:
    """Two word pieces never touch, so a run that begins and ends with one is bounded by itself."""
    code = F.ascii(piece)
    return code.between(97, 122) | code.between(48, 57) | code.isin(39, 45)


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"(?s){PIECE}"), F.lit(0))


def name_index(cards: DataFrame, version: str = "seq", aliases: DataFrame | None = None) -> DataFrame:
    """(name, entity_id, reg_seq) from cards with ``canonical_name``; a later card of an entity replaces.

    Other names come from the child table ``aliases`` (entity_id, alias), one row each, or else from the cards' own
    column ``aliases``.
    """
    latest = first_per_key(cards, ["entity_id"], F.col(version).desc()).withColumnRenamed(version, "reg_seq")
    if aliases is None:
        names = F.array_union(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
        rows = latest.select("entity_id", "reg_seq", F.explode(names).alias("_n"))
    else:
        known = latest.select("entity_id", "reg_seq")
        rows = latest.select("entity_id", "reg_seq", F.col("canonical_name").alias("_n")).unionByName(
            aliases.join(known, "entity_id").select("entity_id", "reg_seq", F.col("alias").alias("_n"))
        )
    return rows.select(F.lower("_n").alias("name"), "entity_id", "reg_seq").filter("name <> ''").distinct()


def name_lookup(names: DataFrame, wanted: DataFrame, key: str = "lookup") -> DataFrame:
    """(lookup, entity_id): every entity that uses a name, letter case aside."""
    left = wanted.select(key, F.lower(key).alias("name"))
    return left.join(names.select("name", "entity_id").distinct(), "name").select(key, "entity_id")


def mention_spans(texts: DataFrame, names: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """(id, name, start, n_pieces, name_len, reg_seq): claimed, non-overlapping name occurrences.

    Longer names claim first, then earlier registered ones, then earlier places.
    """
    known = (
        names.groupBy(F.lower("name").alias("name"))
        .agg(F.min("reg_seq").alias("reg_seq"))
        .filter("name <> ''")
        .select("name", "reg_seq", utf16_length("name").alias("name_len"), _pieces(F.col("name")).alias("_p"))
        .select("name", "reg_seq", "name_len", F.size("_p").alias("n_pieces"), F.array_join(F.slice("_p", 1, HEAD), "").alias("head"))
    )
    # The lengths that names with given first pieces have: far fewer rows than names.
    heads = known.select("head", "n_pieces").distinct()
    # At most HEAD widths, and the different first characters of names that do not begin with a word.
    first = F.substring("name", 1, 1)
    shape = known.agg(
        F.struct(
            F.collect_set(F.least("n_pieces", F.lit(HEAD))).alias("widths"),
            F.collect_set(F.when(~_is_word(first), first)).alias("odd"),
        )
    )
    cut = texts.select(F.col(id).alias("id"), _pieces(F.col(text)).alias("_p"), shape.scalar().alias("_s"))
    pieces = F.col("_p")

    def from_here(piece: Column, at: Column) -> Column:
        fit = F.filter("_s.widths", lambda w: at + w <= F.size(pieces))
        head = lambda w: F.struct((at + 1).alias("start"), F.array_join(F.slice(pieces, at + 1, w), "").alias("head"))
        return F.when(_is_word(piece) | F.array_contains("_s.odd", piece), F.transform(fit, head))

    # A row per place and head that may begin a name: no text and no more pieces than a head has.
    places = F.flatten(F.filter(F.transform("_p", from_here), lambda x: x.isNotNull()))
    # Outer, so that no filter on the list is formed below, which would build it twice.
    begun = cut.select("id", F.explode_outer(places).alias("_b")).filter("_b IS NOT NULL").select("id", "_b.start", "_b.head")
    hits = begun.join(heads, "head").groupBy("id").agg(F.collect_list(F.struct("start", "n_pieces")).alias("_h"))
    # Only texts with hits are read again, and each hit is cut to the length of its own names.
    back = texts.select(F.col(id).alias("id"), F.col(text).alias("_t")).join(hits, "id")
    back = back.select("id", "_h", _pieces(F.col("_t")).alias("_p"))

    def run(hit: Column) -> Column:
        start, n = hit["start"], hit["n_pieces"]
        at = lambda i: F.get(pieces, i)
        free_left = _is_word(at(start - 1)) | ~F.coalesce(_is_word(at(start - 2)), F.lit(False))
        free_right = _is_word(at(start + n - 2)) | ~F.coalesce(_is_word(at(start + n - 1)), F.lit(False))
        name = F.array_join(F.slice(pieces, start, n), "").alias("name")
        whole = (start + n - 1 <= F.size(pieces)) & free_left & free_right
        return F.when(whole, F.struct(start.alias("start"), n.alias("n_pieces"), name))

    runs = back.select("id", F.explode_outer(F.transform("_h", run)).alias("_r")).filter("_r IS NOT NULL").select("id", "_r.*")
    return _claim(runs.join(known.drop("head"), ["name", "n_pieces"]))


def _claim(found: DataFrame) -> DataFrame:
    """Greedy claims. Only spans of one overlapping cluster compete, so each cluster is settled by itself."""
    by_start = Window.partitionBy("id").orderBy("start", "n_pieces", "reg_seq", "name")
    before = by_start.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.col("start") + F.col("n_pieces")).over(before)
    marked = found.withColumn("_new", F.when(F.col("start") < reach, 0).otherwise(1)).withColumn(
        "_cluster", F.sum("_new").over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    span = F.struct((-F.col("name_len")).alias("l"), "reg_seq", "start", "n_pieces", "name")
    spans = F.array_sort(F.collect_list(span))

    def step(acc: Column, s: Column) -> Column:
        hit = F.exists(
            acc, lambda c: (s["start"] < c["start"] + c["n_pieces"]) & (c["start"] < s["start"] + s["n_pieces"])
        )
        return F.when(hit, acc).otherwise(F.array_append(acc, s))

    claimed = marked.groupBy("id", "_cluster").agg(
        F.when(F.count(F.lit(1)) == 1, spans).otherwise(F.aggregate(spans, F.slice(spans, 1, 0), step)).alias("_c")
    )
    out = claimed.select("id", F.explode("_c").alias("c"))
    return out.select("id", "c.name", "c.start", "c.n_pieces", (-F.col("c.l")).alias("name_len"), "c.reg_seq")


def mentions(texts: DataFrame, names: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """(id, entity_id, mention_rank): every mentioned entity once per text, longest names first."""
    spans = mention_spans(texts, names, id, text)
    order = F.struct((-F.col("name_len")).alias("l"), F.col("reg_seq").alias("r"), F.col("start").alias("s"))
    owners = names.select(F.lower("name").alias("name"), "entity_id", F.col("reg_seq").alias("_own")).distinct()
    once = (
        spans.join(owners, "name")
        .groupBy("id", "entity_id")
        .agg(F.min(F.struct(order.alias("o"), F.col("_own").alias("w"))).alias("_o"))
    )
    w = Window.partitionBy("id").orderBy("_o", "entity_id")
    return once.select("id", "entity_id", (F.row_number().over(w) - 1).alias("mention_rank"))
