"""Registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spokeworks.llm import (
    byte_bpe, collocations, lexical_search, mixing, packing, personal_data, phrase_dedup, quality, shared, simhash,
    sketches, suffix_dedup, token_counts, toxicity)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (shared.table(spark, sf_dir, t) for t in ("documents", "labels"))
    return quality.quality_rules(docs, labels)


#: Target weights are the square roots of the sources' bytes; the mixture is as large as the corpus.
MIX_ALPHA, MIX_EPOCHS, MIX_SEED = 0.5, 1.0, 17


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    return mixing.mixed(docs, mixing.source_rates(docs, MIX_ALPHA, MIX_EPOCHS), MIX_SEED)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(shared.table(spark, sf_dir, "documents"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(shared.table(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(shared.table(spark, sf_dir, "documents"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.compared(shared.table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.digests(shared.table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (shared.table(spark, sf_dir, t) for t in ("documents", "labels"))
    return toxicity.scores(docs, toxicity.learn(docs, labels))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_counts.token_counts(shared.table(spark, sf_dir, "documents"), path)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip(shared.table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.packed(shared.table(spark, sf_dir, "documents"), path)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(shared.table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (shared.table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return lexical_search.ranked(docs, items)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality_rules, op2_source_mixing, op3_simhash_near_dedup, op4_personal_data, op5_suffix_array_dedup,
        op6_document_fingerprints, op7_substring_dedup, op8_toxicity, op9_token_counts, op10_byte_bpe, op11_best_fit_packing,
        op12_phrase_collocations, op13_lexical_search)}

ORACLE_SQL: dict[str, str] = {
    "op2_source_mixing": mixing.oracle(MIX_ALPHA, MIX_EPOCHS, MIX_SEED),
    "op5_suffix_array_dedup": suffix_dedup.ORACLE,
    "op7_substring_dedup": phrase_dedup.ORACLE,
    "op12_phrase_collocations": collocations.oracle(),
    "op13_lexical_search": lexical_search.oracle(),
}
