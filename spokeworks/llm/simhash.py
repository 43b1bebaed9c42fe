"""SimHash near duplicates by meet-in-the-middle ball hashing.

A fingerprint is taken from the XXH64 values of the 3-word shingles of a text. Every distinct
fingerprint emits itself and all its one-bit variants (half the radius of 2). Two fingerprints that
differ in at most 2 bits share one of them, so a shuffle on variants brings them together; a variant
has at most 65 distinct fingerprints, and each is tied to the smallest, after a check of their distance.
Texts with equal fingerprints are one node from the start, so a group of copies costs one row.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other;
texts of fewer than three words have one shingle, their whole sequence; repeated rows are answered
one by one; a component of rows without ids has a null id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from spokeworks.llm import shared, textbytes
from spokeworks.llm.components import components

SCHEMA = "doc_id bigint, bits bigint"
SHINGLE, SEED = 3, 42
#: Bits in which linked fingerprints may differ.
RADIUS = 2
#: Shingles whose bits are unfolded at once.
ROWS = 1 << 16


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of all shingles of a text, in order and with repeats."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, last = (ends - sizes).tolist(), ends[min(shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[i:j], SEED) for i, j in zip(starts, last)], dtype="<u8")


def folded(hashes: np.ndarray) -> int:
    """The bits that most of the hashes have."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), ROWS):
        part = hashes[i:i + ROWS].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    return folded(shingle_hashes(text, shingle))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in textbytes.slices(batches, "text"):
        bits = np.array([fingerprint(t) for t in part.column("text").to_pylist()], np.uint64)
        yield shared.batch(SCHEMA, [part.column("doc_id"), bits.view(np.int64)])


CONTENT = "doc_id bigint, content bigint, bits bigint"


def _with_content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in textbytes.slices(batches, "text"):
        bits = np.array([fingerprint(t) for t in part.column("text").to_pylist()], np.uint64)
        yield shared.batch(CONTENT, [part.column("doc_id"), part.column("content"), bits.view(np.int64)])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, bits) of every document."""
    return shared.arrow_map(shared.keyed(docs), _fingerprints, SCHEMA)


def variants(radius: int = RADIUS) -> str:
    """SQL for all values within half the radius, rounded up, of ``bits``."""
    balls = ["array(bits)"]
    for _ in range((radius + 1) // 2):
        balls.append(f"flatten(transform({balls[-1]}, b -> transform(sequence(0, 63), i -> b ^ shiftleft(1L, i))))")
    return f"array_distinct(concat({', '.join(balls)}))"


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (bits, lower) that differ in one or two bits, enough to connect all that do."""
    ball = distinct.select("bits", F.explode(F.expr(variants())).alias("variant"))
    lowest = F.min("bits").over(Window.partitionBy("variant"))
    return (ball.withColumn("lower", lowest).filter("bits <> lower").select("bits", "lower").distinct()
            .filter(f"bit_count(bits ^ lower) <= {RADIUS}"))


def grouped(prints: DataFrame) -> DataFrame:
    """(bits, root, component_id) of every distinct fingerprint; ``root`` tells groups apart."""
    distinct = prints.groupBy("bits").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct))
    rooted = (distinct.join(roots, distinct["bits"] == roots["node"], "left")
              .select("bits", "least", F.coalesce("component", "bits").alias("root")))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(lowest, "root").select("bits", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    prints = shared.written(fingerprints(docs), "fingerprints")
    return prints.join(grouped(prints), "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def survivors(docs: DataFrame) -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns.

    Where several rows of a group have that id, one whose text hashes lowest stays; of rows equal in
    both id and text, one stays. A row without an id stays only where its whole group has none.
    """
    prints = shared.written(
        shared.arrow_map(shared.keyed(docs).withColumn("content", F.xxhash64("text")), _with_content, CONTENT),
        "fingerprints")
    return first_of_each(docs, prints.join(grouped(prints), "bits"))


def first_of_each(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """The rows of ``docs`` that come first in their group; ``rooted`` has (doc_id, content, root) of each."""
    content, mine, hashed = (shared.fresh(docs.columns, n) for n in ("content", "kept_id", "kept_content"))
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "content")).alias("first")
    kept = (rooted.groupBy("root").agg(first)
            .select(F.col("first.doc_id").alias(mine), F.col("first.content").alias(hashed)))
    marked = docs.withColumn(content, F.xxhash64(F.col("text").cast("string")))
    same = marked["doc_id"].cast("bigint").eqNullSafe(kept[mine]) & (marked[content] == kept[hashed])
    return marked.join(kept, same, "left_semi").dropDuplicates(["doc_id", content]).drop(content)
