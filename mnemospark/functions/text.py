"""Text and display expressions, all JVM-side.

Lengths and offsets count UTF-16 code units, the unit in which the memory
model's character spans are defined. ``length`` counts code points, so it is
used only where no character lies outside the basic plane.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space class of the memory model's text normalisation.
SPACES = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WHITE_SPACE = f"[{SPACES}]"
INK = f"[^{SPACES}]+"
#: What a lower-cased text may need to be normalised for: other than printable ASCII, or a space that is not a single inner one.
UNEVEN = "[^!-~ ]|  |^ | $"
# An ASCII word character, and the two ways to stand at a word edge.
WORD = "[A-Za-z0-9_]"
NOT_AFTER_WORD = f"(?<!{WORD})"
WORD_EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
# Tokens that negate a claim.
NEGATORS = ("not", "isn't", "doesn't", "never", "no", "wasn't")

EM_DASH = "—"
ELLIPSIS = "…"
CHARS_PER_TOKEN = 4
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_space(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), f"^{WHITE_SPACE}+|{WHITE_SPACE}+$", "")


def tokenize(text: Column | str) -> Column:
    """Lower-cased runs of letters, digits and apostrophes.

    Extracting the runs is several times faster in Spark than splitting at what lies between.
    """
    return F.regexp_extract_all(F.lower(_col(text)), F.lit("[a-z0-9']+"), F.lit(0))


def normalize(text: Column | str) -> Column:
    """Trimmed, lower-cased, white space runs as one space.

    Replacing what lies between words is several times faster in Spark than extracting and joining them. A short look tells
    that a text is as it should be, which is faster again.
    """
    low = F.lower(_col(text))
    return F.when(low.rlike(UNEVEN), F.trim(F.regexp_replace(low, f"{WHITE_SPACE}+", " "))).otherwise(low)


def utf16_length(text: Column | str) -> Column:
    c = _col(text)
    # ASCII, which needs no second encoding.
    return F.when(F.octet_length(c) == F.length(c), F.length(c)).otherwise((F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int"))


def utf16_head(text: Column | str, units: int) -> Column:
    """The first ``units`` UTF-16 units of a text."""
    c = _col(text)
    wide = F.decode(F.substring(F.encode(c, "UTF-16BE"), 1, 2 * units), "UTF-16BE")
    return F.when(F.length(c) == utf16_length(c), F.substring(c, 1, units)).otherwise(wide)


def estimate_tokens(text: Column | str) -> Column:
    return F.ceil(utf16_length(text) / CHARS_PER_TOKEN).cast("bigint")


def code_units(text: Column | str) -> Column:
    """UTF-16 code units of a text, in order."""
    points = F.transform(F.regexp_extract_all(_col(text), F.lit("(?s)."), F.lit(0)), lambda ch: F.ascii(ch))
    return F.flatten(
        F.transform(
            points,
            lambda p: F.when(p < 65536, F.array(p)).otherwise(
                F.array(
                    (F.floor((p - 65536) / 1024) + 55296).cast("int"),
                    ((p - 65536) % 1024 + 56320).cast("int"),
                )
            ),
        )
    )


def fnv1a(text: Column | str) -> Column:
    """32-bit FNV-1a over UTF-16 units, as an unsigned value in a BIGINT."""
    return F.aggregate(
        code_units(text),
        F.lit(FNV_OFFSET).cast("bigint"),
        lambda h, unit: (h.bitwiseXOR(unit.cast("bigint")) * FNV_PRIME) % 4294967296,
    )


def content_key(text: Column | str) -> Column:
    return F.lower(F.hex(fnv1a(text)))


def jaccard(left: Column, right: Column) -> Column:
    """Set overlap of two arrays, 0 where both are empty."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(left, right)) / union)


def is_negated(tokens: Column) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in NEGATORS]))


def strip_negators(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*NEGATORS))


def quote_start(content: Column | str, quote: Column | str) -> Column:
    """UTF-16 offset of a quote's first verbatim occurrence, NULL on a miss or an empty quote."""
    c, q = _col(content), _col(quote)
    at = F.instr(c, q)
    return F.when(
        (F.length(q) > 0) & (at > 0),
        F.when(F.octet_length(c) == F.length(c), at - 1).otherwise(utf16_length(F.substring(c, F.lit(1), at - 1))),
    )


def quote_span(content: Column | str, quote: Column | str) -> Column:
    """``STRUCT<char_start, char_end>``, NULL on a miss."""
    start = quote_start(content, quote)
    return F.when(
        start.isNotNull(),
        F.struct(
            start.cast("int").alias("char_start"),
            (start + utf16_length(quote)).cast("int").alias("char_end"),
        ),
    )


def first_word(text: Column | str) -> Column:
    return F.regexp_extract(trim_space(text), r"^[\w']+", 0)


def stub_summary(turns: Column) -> Column:
    """Text for an ordered ``ARRAY<STRUCT<turn_id, content>>`` of turns."""
    n = F.size(turns)
    heads = F.filter(F.transform(turns, lambda t: first_word(t["content"])), lambda w: w != "")
    text = F.concat(
        F.lit("["),
        F.element_at(turns, 1)["turn_id"],
        F.lit(".."),
        F.element_at(turns, -1)["turn_id"],
        F.lit("] "),
        n.cast("string"),
        F.when(n == 1, F.lit(" turn: ")).otherwise(F.lit(" turns: ")),
        F.array_join(heads, ", "),
    )
    return F.when(n > 0, text).otherwise(F.lit("[empty window]"))


def capitalized_tokens(text: Column | str) -> Column:
    pattern = f"{NOT_AFTER_WORD}[A-Z][a-zA-Z'-]*{WORD_EDGE}"
    return F.array_distinct(F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(0)))


def truncate(text: Column | str, limit: int) -> Column:
    c = _col(text)
    return F.when(utf16_length(c) <= limit, c).otherwise(F.concat(utf16_head(c, limit - 1), F.lit(ELLIPSIS)))


def _json_text(value: Column, missing: str) -> Column:
    return (
        F.when(value.isNull() | (value == "null"), F.lit(missing))
        .when(value.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v"))
        .otherwise(value)
    )


def display_value(value_json: Column | str) -> Column:
    """A JSON value as shown to a reader."""
    return _json_text(_col(value_json), EM_DASH)


def index_value(value_json: Column | str) -> Column:
    """A JSON value as fed to the keyword index."""
    return _json_text(_col(value_json), "")


def headline(
    kind: Column | str,
    content: Column | str,
    entity_id: Column | str,
    canonical_name: Column | str,
    entity_type: Column | str,
    title: Column | str,
) -> Column:
    short = truncate(content, 80)
    return (
        F.when(
            (_col(kind) == "entity") & _col(entity_id).isNotNull(),
            F.concat(_col(canonical_name), F.lit(f" {EM_DASH} "), _col(entity_type)),
        )
        .when(_col(kind) == "lore", F.coalesce(_col(title), short))
        .otherwise(short)
    )


def indexable_text(
    kind: Column,
    content: Column,
    entity_id: Column,
    canonical_name: Column,
    aliases: Column,
    entity_type: Column,
    summary: Column,
    attributes: Column,
) -> Column:
    """Text of an asset for keyword search; ``attributes`` is ``ARRAY<STRUCT<key, value_json>>``."""
    empty = F.array().cast("array<string>")
    parts = F.flatten(
        F.array(
            F.array(canonical_name),
            F.coalesce(aliases, empty),
            F.array(entity_type, content),
            F.when(F.coalesce(summary, F.lit("")) != "", F.array(summary)).otherwise(empty),
            F.coalesce(
                F.transform(attributes, lambda a: F.concat(a["key"], F.lit(": "), index_value(a["value_json"]))), empty
            ),
        )
    )
    return F.when((kind == "entity") & entity_id.isNotNull(), F.array_join(parts, "\n")).otherwise(content)


def stable_id(*parts: Column | str) -> Column:
    """A 32-digit id from a natural key, so that a retried task writes the same id."""
    return F.md5(F.concat_ws("|", *[_col(p).cast("string") for p in parts]))


def name_tokens(text: Column | str) -> Column:
    """Runs of ``[a-z0-9'-]`` of the lower-cased text."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit("[a-z0-9'-]+"), F.lit(0))
