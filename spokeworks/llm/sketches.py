"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k smallest distinct 64-bit hashes of the 5-word shingles of a text, in order, as
hexadecimal digits. It can be merged across the parts of anything, and two of them estimate
resemblance, containment and distinct shingle counts; below k shingles all three are exact.

Defined results: null and empty texts are empty; a text without a word has the empty sketch, one of
fewer than five words the hash of its whole sequence; two empty sketches resemble each other wholly, an
empty and another not at all; columns other than doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from spokeworks.llm import shared, textbytes

SHINGLE, K = 5, 128
#: Most ranges of ids that the documents are dealt to; each is read as a stream, whatever its size.
RANGES = 1000


def sketch_all(texts: list[str], k: int = K) -> list[np.ndarray]:
    """The sketch of every text, computed over their common buffer."""
    data, offsets = textbytes.buffer_of(pa.array(texts, pa.large_string()))
    starts, ends, first = textbytes.words_of(data, offsets)
    words = textbytes.span_hashes(data, starts, ends)
    shingles = textbytes.window_hashes(words, SHINGLE)
    out = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
        if j - i >= SHINGLE:
            out.append(smallest(shingles[i:j - SHINGLE + 1], k))
        else:
            out.append(textbytes.window_hashes(words[i:j], j - i) if j > i else words[:0])
    return out


def smallest(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct values, in order."""
    if len(hashes) > 8 * k:  # most are far too large: look below a bound that k distinct values meet
        part = np.unique(np.partition(hashes, 4 * k)[:4 * k])
        if len(part) >= k:
            return part[:k]
    return np.unique(hashes)[:k]


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.unique(np.concatenate([a, b]))[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of common shingles among all of both, from the k smallest of the union."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merged(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(both, union[-1], "right")) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the first one's shingles that the second has, from resemblance and counts."""
    if not len(a):
        return 1.0
    shared_part = resemblance(a, b, k)
    union = distinct_count(merged(a, b, k), k)
    return min(1.0, shared_part * union / distinct_count(a, k))


def distinct_count(sketch: np.ndarray, k: int = K) -> float:
    """Distinct shingles: exact below k, else (k - 1) over the k-th smallest as a share of all values."""
    if len(sketch) < k:
        return float(len(sketch))
    return (k - 1) / (float(sketch[k - 1]) / 2.0 ** 64)


def spelled(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def parsed(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


FINGERPRINTS = "doc_id bigint, n_shingles double, fingerprint string"


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in textbytes.slices(batches, "text"):
        sketches = sketch_all([t or "" for t in part.column("text").to_pylist()])
        yield shared.batch(FINGERPRINTS, [part.column("doc_id"), list(map(distinct_count, sketches)),
                                          list(map(spelled, sketches))])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, fingerprint) of every document."""
    return shared.arrow_map(shared.keyed(docs), _fingerprints, FINGERPRINTS)


def merge_parts(parts: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """One sketch per key from the fingerprints of its parts.

    Hashes are made distinct and cut to k per task before they are shuffled, so a key with very many
    parts sends k rows from each task.
    """
    digits = F.explode(F.expr("regexp_extract_all(fingerprint, '.{16}', 0)")).alias("hash")
    each = parts.filter("length(fingerprint) > 0").select(*keys, digits).dropDuplicates([*keys, "hash"])
    ranked = each.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("hash")))
    return (ranked.filter(F.col("place") <= k).groupBy(*keys)
            .agg(F.array_join(F.array_sort(F.collect_list("hash")), "").alias("fingerprint")))


# -- a document, its edited text and the next document ----------------------------

COMPARED = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
            "edited_fingerprint string, near_edited double, near_next double")


def in_order(docs: DataFrame) -> DataFrame:
    """(bucket, guest, doc_id, text) in ascending doc_id within each bucket, with the first document
    of the next bucket as a guest at the end, so that every document is followed by its successor.

    Buckets are ranges of ids cut at quantiles; documents are shuffled once. Null ids come first,
    rows of one id by their text.
    """
    spark, rows = docs.sparkSession, shared.keyed(docs)
    count = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), RANGES))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / count for i in range(1, count)] or [0.5], 20_000)).first()[0]
    cuts = sorted(set(cuts or []))[:count - 1] if count > 1 else []
    bucket = F.expr("0" if not cuts else
                    f"size(filter(array({','.join(f'{c}L' for c in cuts)}), c -> c < doc_id))")
    placed = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(bucket).cast("int"))
    lowest = sorted((r["bucket"], r["least"])
                    for r in placed.groupBy("bucket").agg(F.min("doc_id").alias("least")).collect())
    if not lowest:
        return placed.select("bucket", F.lit(False).alias("guest"), "doc_id", "text")
    firsts = [f"WHEN doc_id <=> {'NULL' if least is None else f'{least}L'} THEN {lowest[i - 1][0]}"
              for i, (_, least) in enumerate(lowest)]
    before = F.expr(f"CASE {' '.join(firsts)} END")
    own = F.struct("bucket", F.lit(False).alias("guest"))
    guest = F.struct(before.alias("bucket"), F.lit(True).alias("guest"))
    return (placed.withColumn("seat", F.explode(F.when(before.isNull(), F.array(own)).otherwise(F.array(own, guest))))
            .select("seat.bucket", "seat.guest", "doc_id", "text")
            .repartition(count, "bucket")
            .sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_first(), "text"))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # the last row of the slice before, whose successor is still to come
    for part in textbytes.slices(batches, "text"):
        rows = list(zip(*(part.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text"))))
        rows = ([held] if held else []) + rows
        held = rows[-1]
        mine = [i for i in range(len(rows) - 1) if not rows[i][1]]
        if mine:
            yield _answers(rows, mine)


def _answers(rows: list[tuple], mine: list[int]) -> pa.RecordBatch:
    texts = [r[3] or "" for r in rows]
    edited = []
    for i in mine:
        moved = len(texts[i]) // 4
        edited.append(texts[i][:len(texts[i]) - moved] + texts[i + 1][:moved])
    plain, changed = sketch_all(texts), sketch_all(edited)
    return shared.batch(COMPARED, [
        [rows[i][2] for i in mine], [len(texts[i]) for i in mine],
        [hashlib.sha256(t.encode()).hexdigest() for t in edited],
        [spelled(plain[i]) for i in mine], list(map(spelled, changed)),
        [resemblance(plain[i], c) for i, c in zip(mine, changed)],
        [resemblance(plain[i], plain[i + 1]) for i in mine]])


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness.

    The edited text has the last quarter of the code points (rounded down) replaced by the first as
    many of the next document in ascending doc_id; after the last comes the first.
    """
    return shared.arrow_map(in_order(docs), _compared, COMPARED)
