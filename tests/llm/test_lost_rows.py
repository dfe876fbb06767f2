"""Rows and text that must not be lost: clean rows beside leaking ones, pages after odd markup."""

import time

import pytest

from mnemospark.llm import decontaminate, mainpage


def test_clean_rows_stay_beside_leaking_ones(spark):
    words = [f"w{i}" for i in range(400)]
    leak = " ".join(words[100:140])
    other = " ".join(f"x{i}" for i in range(60))
    rows = [(None, f"before {leak} after", "a"), (None, other, "b"), (7, leak, "c"), (7, other + " more", "d"), (8, None, "e"), (9, "", "f")]
    rows += [(100 + i, " ".join(f"y{i}z{j}" for j in range(50)), "g") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_number string")
    bench = spark.createDataFrame([(1, leak), (2, " ".join(words[200:240]))], "item_id long, text string")
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(map(repr, (tuple(r) for r in kept.collect()))) == sorted(repr(r) for r in rows if r[2] not in "ac")


@pytest.mark.parametrize(
    "page, texts",
    [
        ('<article><p>one</p><svg width="1"/><p>two</p>', ["one", "two"]),
        ('<p>one</p><svg/><p>two</p><svg><g>no</g></svg><p>three', ["one", "two", "three"]),
        ("<p>one<svg><p>two<noscript><p>three<template><p>four", ["one", "two", "three", "four"]),
        ("<p>one<script>two<p>three", ["one"]),
        ("a < b <3 <p>c <", ["a < b <3", "c <"]),
        ("<p title=\"x>y\">t</p><p title='a>b>u", ["t", "b>u"]),
        ("<!-- <p>no</p> --><p>yes<!-- rest", ["yes"]),
        (None, []),
    ],
)
def test_odd_markup_loses_no_text(page, texts):
    assert [b.text for b in mainpage.blocks(page)] == texts


@pytest.mark.parametrize("part", ["<a", "<a ", '<a "', "<div><p>", "<svg>", "<!", "<b></i>", "<li>x"])
def test_long_pages_take_about_one_pass(part):
    start = time.process_time()
    mainpage.blocks(part * 100_000)
    assert time.process_time() - start < 15
