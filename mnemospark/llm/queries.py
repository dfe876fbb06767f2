"""The operators of this package bound to the test tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, language, licences, linededup, mainpage, minhash, mixing, packing, pii, sequences, simhash, trie
from .common import table
from .sql import ORACLES  # noqa: F401

TOKENIZER = "word_bpe_49k.json"
PACKING_TOKENIZER = "byte_bpe_50k.json"


def op1_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.with_language(docs)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.with_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainpage.with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.with_licences(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprints(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.with_kept_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.with_copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return found.select("doc_id", "size", "source_size", "target", taken)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt_paths(table(spark, sf_dir, "conversations")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(PACKING_TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_leaks,
        op2_language,
        op3_personal_data,
        op4_main_text,
        op5_licences,
        op6_minhash,
        op7_simhash,
        op8_sequences,
        op9_line_dedup,
        op10_mixing,
        op11_prefix_trie,
        op12_collocations,
        op13_packing,
    )
}
