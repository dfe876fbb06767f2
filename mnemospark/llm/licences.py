"""Licence notices by a positional index of rare words, in DataFrame functions only.

Templates are indexed by word and place. Inverse document frequencies of the templates' words are counted over the
corpus; in each file every template is looked up by the highest-IDF word of its mandatory key phrase. A place of that word
less its place in the template gives a start; the starts are intersected with the places of the template's other words,
and a notice is found where enough words stand at their relative positions and the key phrase stands word for word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, unique_name

#: Runs of what is no word, in lower case; words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A notice in lower case: its words, the place of its key phrase among them, and the share of words to be found."""

    label: str
    text: str
    key: str
    cover: float = 0.7
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> int:
        words, key = self.words, self.key.split()
        return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


#: The three base phrases and their labels.
BASE = (
    Template("cc-by", "cc by", "cc by", 1.0, True),
    Template("gpl", "general public license", "general public license", 1.0, True),
    Template("reserved", "all rights reserved", "all rights reserved", 1.0, True),
)
#: Notices by which licences are usually named.
NOTICES = (
    Template("agpl-3.0", "gnu affero general public license version 3", "affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use"),
    Template("bsd", "released under the bsd license", "bsd license"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc0-1.0", "licensed under cc0 1 0 universal", "cc0 1 0"),
    Template("gpl-2.0", "gnu general public license version 2", "general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3", "general public license version 3"),
    Template("lgpl", "gnu lesser general public license version", "lesser general public license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license", "mozilla public license"),
)
TEMPLATES = BASE + NOTICES


def words_of(text: Column) -> Column:
    """The words of a text with A-Z in lower case; none for NULL."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """In how many documents each template word occurs: at most one row per word of the templates."""
    known = F.array(*[F.lit(w) for w in vocabulary(templates)])
    found = docs.select(F.explode(F.array_intersect(words_of(F.col("text")), known)).alias("w"))
    return {r["w"]: r["count"] for r in found.groupBy("w").count().collect()}


def rarest(template: Template, frequency: dict[str, int]) -> str:
    """The highest-IDF word of the key phrase; ties go to the first in the alphabet."""
    return min(set(template.key.split()), key=lambda w: (frequency.get(w, 0), w))


def _places(template: Template, hits: str, words: str, frequency: dict[str, int]) -> str:
    """SQL for (start, cover, label) of every place of a template."""
    own, key, at = template.words, template.key.split(), template.key_at
    rare = rarest(template, frequency)
    start = f"h.at - {at + key.index(rare)}"

    def stands(i: int, word: str) -> str:
        return f"coalesce(get({words}, {start} + {i}) = '{word}', false)"

    phrase = " AND ".join(stands(at + i, w) for i, w in enumerate(key))
    cover = " + ".join(f"int({stands(i, w)})" for i, w in enumerate(own))
    found = f"filter({hits}, h -> h.w = '{rare}' AND {start} + {at} >= 0 AND {phrase})"
    places = f"transform({found}, h -> struct({start} AS start, double({cover}) / {len(own)} AS cover, '{template.label}' AS label))"
    return f"filter({places}, p -> p.cover >= {template.cover}D)"


def with_licences(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels and score.

    ``first_word`` and ``last_word`` are the smallest and largest starts of base phrases, NULL if there are none. ``score`` is
    the largest share of a template's words in place: 1 for a base phrase, 0 without a notice. A NULL or empty text has no
    words. Every row is judged alone, so repeated rows agree, ids may be NULL and an empty table stays empty. Columns of
    ``docs`` with the new names are replaced.
    """
    new = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    rest = docs.drop(*new)
    words, hits, base, more = (unique_name([*rest.columns, *new], c) for c in ("words", "hits", "base", "more"))
    frequency = document_frequencies(docs, templates)
    listed = rest.withColumn(words, words_of(F.col("text")))
    rare = sorted({rarest(t, frequency) for t in templates})
    places = F.transform(F.col(words), lambda w, i: F.struct(i.cast("int").alias("at"), w.alias("w")))
    met = F.arrays_overlap(F.col(words), F.array(*[F.lit(w) for w in rare]))
    listed = listed.withColumn(hits, F.when(met, F.filter(places, lambda h: h["w"].isin(rare))))

    def all_places(some: list[Template]) -> Column:
        return F.expr(f"flatten(array({', '.join(_places(t, hits, words, frequency) for t in some)}))")

    none = F.array().cast("array<struct<start:int,cover:double,label:string>>")
    some = F.col(hits).isNotNull()
    found = listed.withColumn(base, F.when(some, all_places([t for t in templates if t.base])).otherwise(none))
    found = found.withColumn(more, F.when(some, all_places([t for t in templates if not t.base])).otherwise(none))
    starts = F.transform(F.col(base), lambda p: p["start"].cast("long"))

    def labels(*places: Column) -> Column:
        names = F.concat(*[F.transform(p, lambda x: x["label"]) for p in places])
        return F.array_join(F.array_sort(F.array_distinct(names)), ",")

    score = F.array_max(F.transform(F.concat(F.col(base), F.col(more)), lambda p: p["cover"]))
    return found.select(
        *rest.columns,
        F.size(words).cast("long").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(F.col(base)).alias("base_labels"),
        labels(F.col(base), F.col(more)).alias("labels"),
        F.coalesce(score, F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    """The same in SQL, by comparing every place of every text with every template."""
    lower = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    rows = ", ".join(
        f"('{t.label}', {t.words!r}, {t.key.split()!r}, {t.key_at}, {t.cover}, {str(t.base).lower()})" for t in TEMPLATES
    )
    return f"""WITH t(label, tw, kw, ka, cover, base) AS (VALUES {rows}),
d AS (SELECT doc_id, regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
k AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
m AS (SELECT k.doc_id, t.label, t.base, CAST(p - 1 - ka AS BIGINT) AS start,
  CAST(len(list_filter(range(1, len(tw) + 1), lambda i: p - 1 - ka + i >= 1 AND w[p - 1 - ka + i] = tw[i])) AS DOUBLE) / len(tw) AS share,
  t.cover FROM k JOIN t ON w[p] = kw[1] AND list_slice(w, p, p + len(kw) - 1) = kw),
f AS (SELECT * FROM m WHERE share >= cover)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, count(f.start) FILTER (f.base) AS n_base,
  min(f.start) FILTER (f.base) AS first_word, max(f.start) FILTER (f.base) AS last_word,
  coalesce(string_agg(DISTINCT f.label, ',' ORDER BY f.label) FILTER (f.base), '') AS base_labels,
  coalesce(string_agg(DISTINCT f.label, ',' ORDER BY f.label), '') AS labels, coalesce(max(f.share), 0) AS score
FROM d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id, d.w"""
