"""Substring dedup by repeated-phrase automata: removes words of passages that recur.

Passages of ``window`` words and more that occur twice are confirmed first; those that stand in varied
contexts are compiled into Aho-Corasick automata, one for each shard of phrases, and the texts that
hold a phrase of the shard are streamed through it, which finds every occurrence. Runs of windows that recur
as a whole are counted and located by their hash before, so they are not carried to the automata (see
``repeats``).

Defined results: null and empty texts have no words; texts shorter than the window stay whole; rows equal
in id and text count as occurrences of each other; null ids are ids like others; columns other than doc_id
and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spokeworks.llm import repeats, shared, textbytes

WINDOW, GRAM = 35, 8
DIGEST = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def matched(pieces: list[dict], units, window: int) -> pa.RecordBatch:
    """Confirms the recurring passages of a shard, compiles them, and streams its texts through."""
    hashes, lead, owner, place, _ = repeats.windows_in(pieces, units, window)
    begin, end = repeats.spans(repeats.multikey_repeated([lead, hashes]), owner)
    texts = [f" {p['piece'].decode()} " for p in pieces]
    # Characters at which words begin, the space before each included; one more at the end.
    edges = [np.flatnonzero(np.fromiter((c == " " for c in t), bool, len(t))) for t in texts]
    phrases = ahocorasick.Automaton()
    for i, low, high in zip(owner[begin], place[begin], place[end - 1] + window):
        phrase = texts[i][edges[i][low]:edges[i][high] + 1]
        phrases.add_word(phrase, (len(phrase), high - low))
    if not len(phrases):
        return repeats.found_batch(pieces, owner[:0], place[:0], place[:0])
    phrases.make_automaton()
    hits = []
    for i, text in enumerate(texts):
        for stop, (size, words) in phrases.iter(text):
            first = int(np.searchsorted(edges[i], stop - size + 1))
            hits.append((i, first, first + words - window + 1))
    found = np.array(hits, np.int64).reshape(-1, 3)
    return repeats.found_batch(pieces, found[:, 0], found[:, 1], found[:, 2])


def _digests(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textbytes.slices(batches, "text"):
            rows = []
            for text, found in zip(part.column("text").to_pylist(), part.column("found").to_pylist()):
                words = (text or "").encode().split()
                gone = repeats.covered(found, len(words), window)
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if found else b" ".join(words)
                rows.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            yield shared.batch(DIGEST, [part.column("doc_id"), *map(list, zip(*rows))])

    return run


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textbytes.slices(batches, "text"):
            kept = []
            for text, found in zip(part.column("text").to_pylist(), part.column("found").to_pylist()):
                words = (text or "").encode().split()
                gone = repeats.covered(found, len(words), window)
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode())
            yield shared.batch("doc_id bigint, text string", [part.column("doc_id"), kept])

    return run


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = repeats.CROWD) -> DataFrame:
    """(doc_id, text): the words that stay, with one space between."""
    return repeats.removed(*repeats.located(docs, repeats.word_units, window, gram, crowd, matched), _kept(window),
                           "doc_id bigint, text string")


def digests(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = repeats.CROWD) -> DataFrame:
    """What was removed from every document, and a digest of what stays."""
    return repeats.removed(*repeats.located(docs, repeats.word_units, window, gram, crowd, matched), _digests(window), DIGEST)


#: The digests in DuckDB, window by window.
ORACLE = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM split),
windows AS (
  SELECT doc_id, first, md5(array_to_string(words[first:first + 34], ' ')) AS content
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS first FROM split WHERE len(words) >= 35)),
again AS (SELECT doc_id, first FROM windows QUALIFY count(*) OVER (PARTITION BY content) > 1),
gone AS (SELECT DISTINCT doc_id, first + k AS place FROM again, range(0, 35) r(k)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS rest FROM placed ANTI JOIN gone USING (doc_id, place)
  GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM split LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)"""
