"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words and pairs of words are hashed into ``BUCKETS`` multinomial cells, once over the trusted documents
(labelled good) and once over all documents. The score of a document is the mean over its n-grams of
log p(cell | trusted) - log p(cell | raw). Weights are whole multiples of 2^-24, so the sum of a text
is exact and the decision does not depend on how the rows were dealt. One threshold decides every document.

The trusted target is a bounded sample, at most ``trusted_most`` labelled documents, chosen by the hash
of their ids; the raw counts cover every document. What goes to the driver is one row per cell.

Defined results: null and empty texts have no words, fail the base rules and are not kept; ids that are
null or repeated are scored row by row; an empty label table or no trusted document leaves all weights
at zero, so that the base rules decide alone; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spokeworks.llm import shared, textbytes
from spokeworks.llm.textbytes import U64

#: Cells of the multinomials; a power of two.
BUCKETS = 1 << 14
#: Nats per n-gram below which a document is taken for noise.
THRESHOLD = -0.06
_UNIT = float(1 << 24)
_LEAD = 0xC0
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

COUNTS = "cell int, trusted bigint, raw bigint"
SCORES = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
          "n_repeat_words bigint, log_ratio double")


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _cells(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the words, cells of the pairs, and which pairs lie within one text."""
    pairs = textbytes.mix(hashes[:-1] * U64(3) + hashes[1:])
    within = np.ones(len(pairs), bool)
    last = first[1:-1]
    within[last[(last > 0) & (last < len(hashes))] - 1] = False
    low = U64(BUCKETS - 1)
    return (hashes & low).astype(np.int64), (pairs & low).astype(np.int64), within


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, trusted = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for part in textbytes.slices(batches, "text"):
        data, offsets = textbytes.buffer_of(part.column("text"))
        starts, ends, first = textbytes.words_of(data, offsets)
        if not len(starts):
            continue
        words, pairs, within = _cells(textbytes.span_hashes(data, starts, ends), first)
        good = np.repeat(part.column("trusted").to_numpy(zero_copy_only=False), np.diff(first))
        raw += np.bincount(words, minlength=BUCKETS) + np.bincount(pairs[within], minlength=BUCKETS)
        trusted += (np.bincount(words[good], minlength=BUCKETS)
                    + np.bincount(pairs[within & good[1:]], minlength=BUCKETS))
    some = np.flatnonzero(raw)
    yield shared.batch(COUNTS, [some, trusted[some], raw[some]])


def cell_counts(docs: DataFrame, labels: DataFrame, trusted_most: int) -> DataFrame:
    """(cell, trusted, raw): n-grams of the trusted documents and of all documents in each cell."""
    trusted = (labels.filter("quality = 1 AND doc_id IS NOT NULL")
               .select(F.col("doc_id").cast("bigint").alias("good_id")).distinct()
               .orderBy(F.xxhash64("good_id"), "good_id").limit(trusted_most))
    marked = shared.keyed(docs).join(F.broadcast(trusted), F.col("doc_id") == F.col("good_id"), "left")
    marked = marked.select("text", F.col("good_id").isNotNull().alias("trusted"))
    return (shared.arrow_map(marked, _counted, COUNTS).groupBy("cell")
            .agg(F.sum("trusted").alias("trusted"), F.sum("raw").alias("raw")))


def weights(counts: DataFrame) -> np.ndarray:
    """Fixed-point log ratios of all cells, from at most ``BUCKETS`` rows."""
    trusted, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in counts.collect():
        trusted[row["cell"]], raw[row["cell"]] = row["trusted"], row["raw"]
    if not trusted.sum():
        return np.zeros(BUCKETS, np.int64)
    ratio = (np.log((trusted + 1) / (trusted.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS)))
    return np.round(ratio * _UNIT).astype(np.int64)


def _dup_lines(data: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    count = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    text = np.searchsorted(offsets, breaks, "right") - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([breaks, offsets[1:]])
    order, order_ends = np.lexsort((starts, np.concatenate([np.arange(count), text]))), np.lexsort(
        (ends, np.concatenate([text, np.arange(count)])))
    owner = np.concatenate([np.arange(count), text])[order]
    starts, ends = starts[order], ends[order_ends]
    worded = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends, owner = starts[worded], ends[worded], owner[worded]
    keys = textbytes.span_hashes(data, starts, ends) ^ textbytes.mix(owner.astype(U64) + U64(1))
    repeated = np.ones(len(keys), bool)
    repeated[np.unique(keys, return_index=True)[1]] = False
    return np.bincount(owner[repeated], minlength=count)


def _repeat_words(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each text in 3-word windows that the text holds twice or more."""
    count = len(first) - 1
    owner = np.repeat(np.arange(count), np.diff(first))
    if len(hashes) < 3:
        return np.zeros(count, np.int64)
    within = np.flatnonzero(owner[:-2] == owner[2:])
    keys = textbytes.window_hashes(hashes, 3)[within] ^ textbytes.mix(owner[within].astype(U64) + U64(1))
    _, at, times = np.unique(keys, return_inverse=True, return_counts=True)
    covered = np.zeros(len(hashes) + 1, np.int64)
    begin = within[times[at] > 1]
    covered[begin] += 1
    covered[begin + 3] -= 1
    return np.bincount(owner[np.cumsum(covered[:-1]) > 0], minlength=count)


def _scored(weight: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textbytes.slices(batches, "text"):
            data, offsets = textbytes.buffer_of(part.column("text"))
            starts, ends, first = textbytes.words_of(data, offsets)
            hashes = textbytes.span_hashes(data, starts, ends)
            n_words = np.diff(first)
            words, pairs, within = _cells(hashes, first)
            pair_weight = np.zeros(len(hashes), np.int64)
            pair_weight[:len(pairs)] = np.where(within, weight[pairs], 0)
            total = _per_text(weight[words] + pair_weight, first)
            grams = np.maximum(2 * n_words - 1, 1)
            yield shared.batch(SCORES, [
                part.column("doc_id"), n_words,
                _per_text(((data & _LEAD) != 0x80) & ~textbytes.SEPARATORS[data], offsets),
                _per_text(_SYMBOLS[data], offsets), _dup_lines(data, offsets, starts),
                _repeat_words(hashes, first), total / grams / _UNIT])

    return score


def quality_rules(docs: DataFrame, labels: DataFrame, trusted_most: int = 40_000,
                  threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, base_failed, the mean log ratio and ``kept`` of every document."""
    weight = weights(cell_counts(docs, labels, trusted_most))
    scored = shared.arrow_map(shared.keyed(docs), _scored(weight), SCORES)
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return (scored.withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= threshold)))
