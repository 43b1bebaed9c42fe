"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are taken in slices of equal bytes, cut at white space, where no token of this vocabulary and
no step of its normaliser reaches across, and the pieces of a slice are encoded once each. A long
text is therefore nothing special: it is cut like any other. Defined results: null and empty texts
have 0 bytes and 0 tokens; repeated rows are counted one by one; columns other than ``doc_id`` and
``text`` are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spokeworks.llm import shared, textbytes

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint"
#: Entries that a task remembers between slices; then it begins anew.
REMEMBERED = 400_000
#: Bytes of text handled at once, and of new pieces given to the encoder in one call.
SLICE, CALL = 4 << 20, 1 << 20


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _balanced(pieces: list[bytes], most: int) -> Iterator[list[bytes]]:
    """The pieces in calls of about ``most`` bytes."""
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    rest, start = iter(pieces), 0
    while start < len(pieces):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
        yield list(islice(rest, stop - start))
        start = stop


def counter(path: str):
    """The Arrow function that counts the tokens of (doc_id, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known = _tokenizer(path), {}
        for part in textbytes.slices(batches, "text", SLICE):
            texts = [(t or "").encode() for t in part.column("text").to_pylist()]
            pieces = [t.split() for t in texts]  # the six ASCII white spaces
            new = list(set(chain.from_iterable(pieces)).difference(known))
            if len(known) + len(new) > REMEMBERED and known:
                known, new = {}, list(set(chain.from_iterable(pieces)))
            for call in _balanced(new, CALL):
                encoded = tokenizer.encode_batch_fast([p.decode() for p in call], add_special_tokens=False)
                known.update(zip(call, map(len, encoded)))
            yield shared.batch(SCHEMA, [part.column("doc_id"), list(map(len, texts)),
                                        [sum(map(known.__getitem__, p)) for p in pieces]])

    return count


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document.

    ``path`` is a ``tokenizers`` file whose pre-tokenizer drops white space; it must be readable at
    the same place on every executor.
    """
    counted = shared.arrow_map(shared.keyed(docs), counter(path), SCHEMA)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def total(counts: DataFrame) -> DataFrame:
    """Documents, bytes and tokens of the corpus."""
    return counts.agg(F.count("*").alias("n_docs"), F.sum("n_bytes").alias("n_bytes"),
                      F.sum("n_tokens").alias("n_tokens"))
