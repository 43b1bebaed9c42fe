"""Vectorised text primitives over the UTF-8 bytes of Arrow string columns.

Everything here is a small numpy helper for use inside Spark tasks: byte buffers, words, 64-bit
hashes of spans, and minimizer anchors.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes that separate words: the space and \t \n \v \f \r.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[9, 10, 11, 12, 13, 32]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Bytes hashed at once, which bounds the memory of the running sums.
BLOCK = 1 << 20


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins (one more offset at the end); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of text, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            taken = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, taken + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


@functools.lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for base in (_BASE, _INVERSE):
        steps = np.full(size, base, U64)
        steps[0] = 1
        both.append(np.cumprod(steps, dtype=U64))
    return both[0], both[1]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64; sizes are rounded up to reuse them."""
    grown = 1 << max(16, (size - 1).bit_length()) if size > 1 else 1 << 16
    up, down = _powers(grown)
    return up[:size], down[:size]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a hash are usable."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def running(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over 64-bit values, one longer than the input."""
    sums = np.zeros(len(values) + 1, U64)
    if len(values):
        np.cumsum(values * powers(len(values))[0], out=sums[1:])
    return sums


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive values; equal content has equal hashes."""
    if len(values) < width:
        return np.zeros(0, U64)
    sums = running(values)
    count = len(values) - width + 1
    return mix((sums[width:] - sums[:-width]) * powers(count)[1])


def byte_values(data: np.ndarray) -> np.ndarray:
    return _VALUES[data]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of data[start:end) for sorted spans that do not overlap."""
    out, i = np.empty(len(starts), U64), 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        sums = running(_VALUES[data[base:int(ends[j - 1])]])
        first, last = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[last] - sums[first]) * powers(int(first[-1]) + 1)[1][first]
        i = j
    return mix(out + (ends - starts).astype(U64))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and the first word of each text (one more at the end)."""
    inside = ~SEPARATORS[data]
    before = np.empty_like(inside)
    before[1:], before[:1] = inside[:-1], False
    after = np.empty_like(inside)
    after[:-1], after[-1:] = inside[1:], False
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def minimizers(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of consecutive windows of ``width`` hashes that share their leftmost smallest one.

    Returns the first window of each run and the position of that smallest hash. The choice
    depends on the content of a window alone, so equal windows choose the same place.
    """
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.full(-(-len(hashes) // width) * width, np.iinfo(np.uint64).max, U64)
    padded[:len(hashes)] = hashes
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:count], ahead[width - 1:width - 1 + count])
    fresh = np.ones(count, bool)  # the old place has left the window, or there was none
    fresh[1:] = hashes[:count - 1] == least[:-1]
    lower = np.zeros(count, bool)
    lower[1:] = least[1:] < least[:-1]
    first = np.flatnonzero(fresh | lower)
    place = first + width - 1
    again = np.flatnonzero(fresh[first])
    views = np.lib.stride_tricks.sliding_window_view(hashes, width)
    for i in range(0, len(again), 4096):
        rows_at = first[again[i:i + 4096]]
        place[again[i:i + 4096]] = rows_at + views[rows_at].argmin(axis=1)
    return first, place


def clipped_runs(first: np.ndarray, place: np.ndarray, begins: np.ndarray,
                 ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs cut to the windows [begin, end) of each text: (text, first window, last + 1, place)."""
    some = np.flatnonzero(ends > begins)
    if len(some) == 0 or len(first) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    begins, ends = begins[some], ends[some]
    cuts = np.union1d(first, begins)
    text = np.searchsorted(begins, cuts, "right") - 1
    stops = np.minimum(np.append(cuts[1:], np.iinfo(np.int64).max), ends[np.maximum(text, 0)])
    keep = (text >= 0) & (cuts < stops)
    cuts, stops, text = cuts[keep], stops[keep], text[keep]
    return some[text], cuts, stops, place[np.searchsorted(first, cuts, "right") - 1]
