"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

toxicity -> SimHash near-dedup -> personal data -> mixing -> byte-level BPE

Every stage but the last returns the columns of ``documents``. Each has a defined result for nulls, empty
texts, repeated rows and empty tables, stated with its operator; after mixing, an id occurs as often as the
document is repeated.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spokeworks.llm import byte_bpe, mixing, personal_data, shared, simhash, toxicity
from spokeworks.llm.queries import MIX_ALPHA, MIX_EPOCHS, MIX_SEED


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learnt from the labels of these documents, scores below one half."""
    return toxicity.accepted(docs, toxicity.learn(docs, shared.table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that the SimHash operator links: 3-word shingles, 2 bits."""
    return simhash.survivors(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by the name of its kind."""
    return personal_data.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in global random order."""
    rates = mixing.source_rates(docs, MIX_ALPHA, MIX_EPOCHS)
    return mixing.mixed(docs, rates, MIX_SEED).select(*[f"`{c}`" for c in docs.columns])


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    return byte_bpe.encode_checked(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: The stages learn from labels, hash with XXH64 and merge tokens, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
