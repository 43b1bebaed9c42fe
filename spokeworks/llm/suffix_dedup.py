"""Suffix-array dedup: removes bytes covered by a string of ``window`` bytes that also starts elsewhere.

Suffixes that begin at content-chosen places are range-partitioned by their leading token (a gram of
``GRAM`` bytes, ranked by its hash) with sampled splitters; each bucket sorts the suffixes of its windows
by multikey quicksort, token by token, and neighbours that agree for the whole window recur. A leading
token never straddles two buckets unless it is crowded, and then the suffixes are compared across all
buckets by their hashes (see ``repeats``).

Defined results: null and empty texts have 0 bytes, and nothing is removed; texts shorter than the window
stay whole; rows equal in id and text count as occurrences of each other; null ids are ids like others;
columns other than doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spokeworks.llm import repeats, shared, textbytes

WINDOW, GRAM = 400, 64
DIGEST = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _digests(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textbytes.slices(batches, "text"):
            rows = []
            for text, found in zip(part.column("text").to_pylist(), part.column("found").to_pylist()):
                data = np.frombuffer((text or "").encode(), np.uint8)
                gone = repeats.covered(found, len(data), window)
                begin, _ = repeats.spans(gone, np.zeros(len(gone), np.int8))
                rows.append((len(data), int(gone.sum()), len(begin), hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            yield shared.batch(DIGEST, [part.column("doc_id"), *map(list, zip(*rows))])

    return run


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textbytes.slices(batches, "text"):
            kept = []
            for text, found in zip(part.column("text").to_pylist(), part.column("found").to_pylist()):
                data = np.frombuffer((text or "").encode(), np.uint8)
                kept.append(data[~repeats.covered(found, len(data), window)].tobytes())
            yield shared.batch("doc_id bigint, kept binary", [part.column("doc_id"), kept])

    return run


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = repeats.CROWD) -> DataFrame:
    """(doc_id, kept): the bytes that stay; they may end within a character."""
    return repeats.removed(*repeats.located(docs, repeats.byte_units, window, gram, crowd), _kept(window),
                           "doc_id bigint, kept binary")


def digests(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = repeats.CROWD) -> DataFrame:
    """What was removed from every document, and a digest of what stays."""
    return repeats.removed(*repeats.located(docs, repeats.byte_units, window, gram, crowd), _digests(window), DIGEST)


#: The digests in DuckDB, window by window.
ORACLE = """
WITH split AS (
  SELECT doc_id, encode(coalesce(text, '')) AS bytes, octet_length(encode(coalesce(text, ''))) AS size FROM documents),
windows AS (
  SELECT doc_id, first, md5(bytes[first:first + 399]) AS content
  FROM (SELECT doc_id, bytes, unnest(range(1, size - 398)) AS first FROM split WHERE size >= 400)),
again AS (SELECT doc_id, first FROM windows QUALIFY count(*) OVER (PARTITION BY content) > 1),
steps AS (
  SELECT doc_id, first, (first - lag(first, 1, -400) OVER (PARTITION BY doc_id ORDER BY first) > 400)::INT AS opens FROM again),
runs AS (SELECT doc_id, first, sum(opens) OVER (PARTITION BY doc_id ORDER BY first) AS run FROM steps),
spans AS (SELECT doc_id, min(first) AS low, max(first) + 399 AS high FROM runs GROUP BY doc_id, run),
edges AS (
  SELECT doc_id, lag(high, 1, 0) OVER (PARTITION BY doc_id ORDER BY low) + 1 AS begins, low - 1 AS ends FROM spans
  UNION ALL SELECT doc_id, coalesce(max(high), 0) + 1, any_value(size) FROM split LEFT JOIN spans USING (doc_id) GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(hex(bytes[begins:ends]), '' ORDER BY begins) AS rest
  FROM edges JOIN split USING (doc_id) WHERE ends >= begins GROUP BY doc_id),
lost AS (SELECT doc_id, sum(high - low + 1) AS n, count(*) AS parts FROM spans GROUP BY doc_id)
SELECT doc_id, size::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(parts, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(rest, ''))) AS kept_sha256
FROM split LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)"""
