"""Finding every window of a corpus whose content also starts anywhere else.

Works for any unit (bytes, words) given as 64-bit values. The steps that operators share:

1. Every window holds a minimizer, a place chosen by its content alone. Consecutive windows of a text
   with the same minimizer are a *run*; equal windows lie in runs with equal minimizers. One row per run
   stands for some hundred windows.
2. Runs of equal content are counted (with partial sums): all windows of a run that occurs twice recur.
3. Runs left alone whose minimizer also occurs in other content are compared window by window: one
   representative of each content is cut out of its text and dealt, by sampled splitters over the minimizer's
   hash, to buckets that are sorted locally.
4. A minimizer that stands in more than ``CROWD`` contents is not brought together: each of its windows
   becomes a hash, counted and looked up across all buckets.

The windows found come back as intervals per text, and the caller cuts them out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spokeworks.llm import shared, textbytes
from spokeworks.llm.textbytes import U64

#: Contents of one minimizer that are compared in one task: some 3 MB of text.
CROWD = 4096
#: Windows handled at once.
STRIDE = 1 << 20
#: Bytes of runs that are compared at once.
GATHERED = 1 << 19

RUNS = "doc_id bigint, content bigint, first int, last int, key bigint, body bigint"
PIECES = "bucket int, crowded boolean, key bigint, doc_id bigint, content bigint, first int, last int, piece binary"
FOUND = "doc_id bigint, content bigint, first int, last int"
HASHED = "window_hash bigint, lead bigint, doc_id bigint, content bigint, first int"

#: (buffer, offsets of texts in bytes) -> (values, offsets of texts in units, start and end byte of units)
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]]


def byte_units(data: np.ndarray, offsets: np.ndarray):
    return data, offsets, None, None


def word_units(data: np.ndarray, offsets: np.ndarray):
    starts, ends, first = textbytes.words_of(data, offsets)
    return textbytes.span_hashes(data, starts, ends), first, starts, ends


def _values(units: np.ndarray) -> np.ndarray:
    return textbytes.byte_values(units) if units.dtype == np.uint8 else units


def runs_of(units: np.ndarray, offsets: np.ndarray, window: int, gram: int):
    """Blocks of (text, first window, last + 1, key, body), windows counted from the first unit of all."""
    begins, ends = offsets[:-1], offsets[1:] - window + 1
    for low in range(0, max(len(units) - window + 1, 0), STRIDE):
        values = _values(units[low:low + STRIDE + window - 1])
        grams = textbytes.window_hashes(values, gram)
        first, place = textbytes.minimizers(grams, window - gram + 1)
        text, start, stop, at = textbytes.clipped_runs(
            first, place, np.maximum(begins - low, 0), np.minimum(ends - low, STRIDE))
        if len(start):
            sums = textbytes.running(values)
            body = textbytes.mix((sums[stop - 1 + window] - sums[start]) * textbytes.powers(len(values))[1][start]
                                 ^ (U64(0x9E3779B97F4A7C15) * ((at - start).astype(U64) * U64(65536) + (stop - start).astype(U64))))
            yield text, start + low, stop + low, grams[at], body


def _runs(units: Units, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textbytes.slices(batches, "text"):
            values, offsets, _, _ = units(*textbytes.buffer_of(part.column("text")))
            for text, start, stop, key, body in runs_of(values, offsets, window, gram):
                at = pa.array(text)
                yield shared.batch(RUNS, [part.column("doc_id").take(at), part.column("content").take(at),
                                          start - offsets[text], stop - offsets[text], key.view(np.int64), body.view(np.int64)])

    return run


def _pieces(units: Units, window: int, splitters: np.ndarray, buckets: int, crowd: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textbytes.slices(batches, "text"):
            data, offsets = textbytes.buffer_of(part.column("text"))
            _, first, starts, ends = units(data, offsets)
            rows = []
            for i, (doc_id, content, picks) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc_id", "content", "picks")))):
                for pick in picks or ():
                    low, high = first[i] + pick["first"], first[i] + pick["last"] - 1 + window
                    if starts is None:
                        piece = data[low:high].tobytes()
                    else:  # words with one space between
                        piece = b" ".join(data[starts[low]:ends[high - 1]].tobytes().split())
                    crowded = pick["contents"] > crowd
                    bucket = (hash((doc_id, content, pick["first"])) % buckets if crowded
                              else int(np.searchsorted(splitters, pick["key"], "right")))
                    rows.append((bucket, crowded, pick["key"], doc_id, content, pick["first"], pick["last"], piece))
            if rows:
                yield shared.batch(PIECES, [list(c) for c in zip(*rows)])

    return run


def _gathered(batches: Iterator[pa.RecordBatch], crowded: bool) -> Iterator[list[dict]]:
    """Pieces in key order, whole keys together, about ``GATHERED`` bytes at a time."""
    held, size = [], 0
    for part in batches:
        for row in part.to_pylist():
            if row["crowded"] != crowded:
                continue
            if size >= GATHERED and (crowded or row["key"] != held[-1]["key"]):
                yield held
                held, size = [], 0
            held.append(row)
            size += len(row["piece"])
    if held:
        yield held


def windows_in(pieces: list[dict], units: Units, window: int):
    """Of all windows of the pieces: hash, leading token, piece and place; also the units of the pieces."""
    data, offsets = textbytes.buffer_of(pa.array([p["piece"] for p in pieces], pa.binary()))
    values, first, starts, ends = units(data, offsets)
    counts = np.array([p["last"] - p["first"] for p in pieces])
    owner = np.repeat(np.arange(len(pieces)), counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = first[owner] + place
    hashes = textbytes.window_hashes(_values(values), window)[at]
    if starts is None:
        lead = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)[at]).view(">u8").ravel().astype(U64)
    else:
        lead = values[at]
    return hashes, lead, owner, place, (data, first, starts, ends)


def multikey_repeated(keys: list[np.ndarray]) -> np.ndarray:
    """Rows that share all keys with another row, by multikey quicksort: only ties go on to the next key."""
    rows, group = np.arange(len(keys[0])), np.zeros(len(keys[0]), np.int64)
    for key in keys:
        order = np.lexsort((key[rows], group))
        rows, group = rows[order], group[order]
        value = key[rows]
        new = np.ones(len(rows), bool)
        new[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
        number = np.cumsum(new) - 1
        tied = np.bincount(number, minlength=1)[number] > 1
        rows, group = rows[tied], number[tied]
    found = np.zeros(len(keys[0]), bool)
    found[rows] = True
    return found


def spans(flags: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of each stretch of set flags within one owner."""
    if not flags.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.ones(len(flags), bool)
    change[1:] = (flags[1:] != flags[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(change)
    end = np.append(begin[1:], len(flags))
    return begin[flags[begin]], end[flags[begin]]


def sorted_locally(pieces: list[dict], units: Units, window: int) -> pa.RecordBatch | None:
    """Windows of the pieces that occur twice among them, as intervals."""
    hashes, lead, owner, place, _ = windows_in(pieces, units, window)
    begin, end = spans(multikey_repeated([lead, hashes]), owner)
    return found_batch(pieces, owner[begin], place[begin], place[end - 1] + 1)


def found_batch(pieces: list[dict], owner: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    base = np.array([p["first"] for p in pieces])[owner] if len(owner) else owner
    return shared.batch(FOUND, [[pieces[i]["doc_id"] for i in owner], [pieces[i]["content"] for i in owner],
                                first + base, last + base])


def _local(units: Units, window: int, match):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces in _gathered(batches, crowded=False):
            yield match(pieces, units, window)

    return run


def _hashed(units: Units, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces in _gathered(batches, crowded=True):
            hashes, lead, owner, place, _ = windows_in(pieces, units, window)
            base = np.array([p["first"] for p in pieces])
            yield shared.batch(HASHED, [hashes.view(np.int64), lead.view(np.int64), [pieces[i]["doc_id"] for i in owner],
                                        [pieces[i]["content"] for i in owner], place + base[owner]])

    return run


def located(docs: DataFrame, units: Units, window: int, gram: int, crowd: int = CROWD,
            match=sorted_locally) -> tuple[DataFrame, DataFrame]:
    """(texts, intervals): texts are (doc_id, content, text); intervals are (doc_id, content, found), one row
    for each text with a recurring window, ``found`` listing its (first, last + 1) windows, maybe overlapping.

    ``content`` is a hash of the text; rows equal in id and text are one text that occurs twice.
    """
    texts = shared.keyed(docs).select("doc_id", "text", F.xxhash64("text").alias("content"))
    runs = shared.written(shared.arrow_map(texts, _runs(units, window, gram), RUNS), "runs")
    bodies = runs.groupBy("key", "body").agg(F.count("*").alias("copies"), *(
        F.first(c).alias(c) for c in ("doc_id", "content", "first", "last")))
    keys = (bodies.groupBy("key").agg(F.count("*").alias("contents"), F.sum((F.col("copies") == 1).cast("int")).alias("alone"))
            .filter("contents > 1 AND alone > 0").select("key", "contents"))
    bodies = shared.written(bodies.join(keys, "key", "left").filter("copies > 1 OR contents IS NOT NULL"), "bodies")
    whole = runs.join(bodies.filter("copies > 1").select("key", "body"), ["key", "body"], "left_semi").select(*_names(FOUND))
    compared = bodies.filter("contents IS NOT NULL")
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = compared.filter(F.col("contents") <= crowd).agg(
        F.percentile_approx("key", [i / buckets for i in range(1, buckets)] or [0.5], 10_000)).first()[0]
    picks = (compared.groupBy("doc_id", "content")
             .agg(F.collect_list(F.struct("key", "contents", "first", "last")).alias("picks"))
             .select(F.col("doc_id").alias("pick_id"), F.col("content").alias("pick_content"), "picks"))
    same = texts["doc_id"].eqNullSafe(picks["pick_id"]) & (texts["content"] == picks["pick_content"])
    pieces = shared.arrow_map(texts.join(picks, same).select("doc_id", "content", "text", "picks"),
                              _pieces(units, window, np.array(cuts or [], np.int64), buckets, crowd), PIECES)
    # One exchange that the three readers below share.
    dealt = pieces.repartition(buckets, "bucket").sortWithinPartitions("key")
    local = shared.arrow_map(dealt, _local(units, window, match), FOUND)
    hashed = shared.arrow_map(dealt, _hashed(units, window), HASHED)
    twice = hashed.groupBy("window_hash", "lead").count().filter("count > 1").select("window_hash", "lead")
    across = (hashed.join(twice, ["window_hash", "lead"], "left_semi")
              .selectExpr("doc_id", "content", "first", "first + 1 AS last"))
    intervals = (whole.unionByName(local).unionByName(across).groupBy("doc_id", "content")
                 .agg(F.collect_list(F.struct("first", "last")).alias("found")))
    return texts, intervals


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def removed(texts: DataFrame, intervals: DataFrame, function, schema: str) -> DataFrame:
    """``function`` over batches of (doc_id, text, found), found null where nothing recurs."""
    found = intervals.select(F.col("doc_id").alias("found_id"), F.col("content").alias("found_content"), "found")
    same = texts["doc_id"].eqNullSafe(found["found_id"]) & (texts["content"] == found["found_content"])
    return shared.arrow_map(texts.join(found, same, "left").select("doc_id", "text", "found"), function, schema)


def covered(found: list[dict] | None, count: int, window: int) -> np.ndarray:
    """Which of ``count`` units lie in a window of the intervals."""
    steps = np.zeros(count + 1, np.int64)
    if found:
        first = np.array([f["first"] for f in found])
        last = np.array([f["last"] for f in found]) - 1 + window
        np.add.at(steps, first, 1)
        np.add.at(steps, last, -1)
    return np.cumsum(steps[:-1]) > 0
