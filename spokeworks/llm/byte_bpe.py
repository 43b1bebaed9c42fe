"""Byte-level BPE encoding and decoding by a file of ranks, on padded numpy matrices.

The text is cut into matches of the pattern. Distinct matches of a slice go into matrices by length
class, one match a row and one token a cell. Each round finds, in every row, the leftmost pair of
lowest rank through a hash table of pairs, merges it, and closes the gap; rows without a pair leave
the matrix. Long matches (over ``WIDE`` bytes) merge by a heap instead, because a row that merges one
pair a round would take time with the square of its length.

Defined results: null and empty texts have no tokens and decode to nothing; repeated rows are encoded
one by one; columns other than ``doc_id`` and ``text`` are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from spokeworks.llm import shared, textbytes

#: Bytes of text handled at once, and matches that a task remembers between slices.
SLICE, REMEMBERED = 4 << 20, 300_000
#: Bytes of the longest match that is merged in a matrix.
WIDE = 128
_NONE = np.int32(np.iinfo(np.int32).max)

#: Cuts at ASCII white space, which no match of the pattern crosses from the left.
_CHUNK = re.compile(r"[ \t\n\r\f\v]*[^ \t\n\r\f\v]+|[ \t\n\r\f\v]+")
#: Other white space may run together with ASCII white space; such a text is matched whole.
_ODD_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


@dataclass(frozen=True)
class Vocabulary:
    """Ranks by bytes, the bytes of each id, and a hash table from pairs of ids to the merged id."""

    ranks: dict[bytes, int]
    of_byte: np.ndarray
    keys: np.ndarray
    merged: np.ndarray
    shift: int
    data: np.ndarray
    offsets: np.ndarray

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges to, or the largest int where it merges to none."""
        wanted = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = (wanted * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)
        at = self.keys[slot]
        out = np.where(at == wanted, self.merged[slot], _NONE)
        open_ = np.flatnonzero((at != wanted) & (at != _FREE))
        mask = np.uint64(len(self.keys) - 1)
        slot, wanted = slot[open_], wanted[open_]
        while len(open_):
            slot = (slot + np.uint64(1)) & mask
            at = self.keys[slot]
            hit = at == wanted
            out[open_[hit]] = self.merged[slot[hit]]
            go = ~hit & (at != _FREE)
            open_, slot, wanted = open_[go], slot[go], wanted[go]
        return out


_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[(left << 32) | right] = rank
    bits = max(4, (4 * len(pairs)).bit_length())
    keys, merged = np.full(1 << bits, _FREE, np.uint64), np.full(1 << bits, _NONE, np.int32)
    for key, rank in pairs.items():
        slot = ((key * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)) >> (64 - bits)
        while keys[slot] != _FREE:
            slot = (slot + 1) & ((1 << bits) - 1)
        keys[slot], merged[slot] = key, rank
    size = max(ranks.values()) + 1
    spelled = [b""] * size
    for token, rank in ranks.items():
        spelled[rank] = token
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in spelled])]).astype(np.int64)
    return Vocabulary(ranks, np.array([ranks[bytes([b])] for b in range(256)], np.int32), keys, merged, 64 - bits,
                      np.frombuffer(b"".join(spelled), np.uint8), offsets)


def merge_matrix(words: Vocabulary, cells: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges the rows of a padded matrix to the end; returns the matrix and the rows' lengths."""
    live = np.flatnonzero(lengths > 1)
    work, size = cells[live], lengths[live].copy()
    width = work.shape[1]
    columns = np.arange(width)
    ranks = np.full((len(work), max(width - 1, 1)), _NONE, np.int32)
    inside = columns[None, :-1] < (size - 1)[:, None]
    ranks[inside] = words.lookup(work[:, :-1][inside], work[:, 1:][inside])
    while len(live):
        best = ranks.argmin(axis=1)  # the first of equal ones, that is the leftmost
        rows = np.arange(len(work))
        rank = ranks[rows, best]
        done = rank == _NONE
        if done.any():
            out = live[done]
            cells[out, :work.shape[1]], lengths[out] = work[done], size[done]
            go = ~done
            live, work, size, ranks, best, rank = live[go], work[go], size[go], ranks[go], best[go], rank[go]
            if not len(live):
                break
            width = int(size.max())
            work, ranks = work[:, :width], ranks[:, :max(width - 1, 1)]
            rows = np.arange(len(work))
        # Close the gap: cells right of the merged pair move one to the left.
        later = columns[None, :work.shape[1] - 1] > best[:, None]
        work[:, :-1] = np.where(later, work[:, 1:], work[:, :-1])
        work[rows, best] = rank
        if ranks.shape[1] > 1:
            gap = columns[None, :ranks.shape[1] - 1] > best[:, None]
            ranks[:, :-1] = np.where(gap, ranks[:, 1:], ranks[:, :-1])
        ranks[:, -1] = _NONE
        size -= 1
        for shift in (-1, 0):  # the two pairs that hold the new token
            left = best + shift
            fits = (left >= 0) & (left + 1 < size)
            ranks[rows[fits], left[fits]] = words.lookup(work[rows[fits], left[fits]], work[rows[fits], left[fits] + 1])
            gone = ~fits & (left >= 0) & (left < ranks.shape[1])
            ranks[rows[gone], left[gone]] = _NONE
    return cells, lengths


def merge_long(words: Vocabulary, piece: bytes) -> list[int]:
    """The same merges for one long piece, by a heap of (rank, position)."""
    ids = [words.ranks[bytes([b])] for b in piece]
    spelled = [bytes([b]) for b in piece]
    after, before, heap = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < len(ids):
            rank = words.ranks.get(spelled[i] + spelled[after[i]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, len(spelled[i]), len(spelled[after[i]])))

    for i in range(len(ids) - 1):
        offer(i)
    while heap:
        rank, i, mine, next_ = heapq.heappop(heap)
        j = after[i]
        if len(spelled[i]) != mine or j >= len(ids) or len(spelled[j]) != next_ or not mine:
            continue
        ids[i], spelled[i], spelled[j], after[i] = rank, spelled[i] + spelled[j], b"", after[j]
        if after[i] < len(ids):
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [token for token, text in zip(ids, spelled) if text]


def encode_pieces(words: Vocabulary, pieces: list[bytes]) -> list[np.ndarray]:
    """Ids of each piece."""
    out: list = [None] * len(pieces)
    classes: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        whole = words.ranks.get(piece)
        if whole is not None:
            out[i] = np.array([whole], np.uint32)
        elif not piece:
            out[i] = np.zeros(0, np.uint32)
        elif len(piece) > WIDE:
            out[i] = np.array(merge_long(words, piece), np.uint32)
        else:
            classes.setdefault((len(piece) + 3) // 4, []).append(i)
    for rows in classes.values():
        for part in range(0, len(rows), 8192):
            some = rows[part:part + 8192]
            lengths = np.array([len(pieces[i]) for i in some])
            cells = np.zeros((len(some), int(lengths.max())), np.int32)
            inside = np.arange(cells.shape[1])[None, :] < lengths[:, None]
            cells[inside] = words.of_byte[np.frombuffer(b"".join(pieces[i] for i in some), np.uint8)]
            cells, lengths = merge_matrix(words, cells, lengths)
            kept = cells[np.arange(cells.shape[1])[None, :] < lengths[:, None]].astype(np.uint32)
            for i, ids in zip(some, np.split(kept, np.cumsum(lengths)[:-1])):
                out[i] = ids
    return out


@functools.lru_cache(maxsize=4)
def compiled(pattern: str):
    """The pattern with white space as Unicode defines it, which leaves out four control characters."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class Encoder:
    """Encodes texts, remembering the ids of chunks between ASCII white space."""

    def __init__(self, path: str, pattern: str):
        self.words, self.pattern, self.known = vocabulary(path), compiled(pattern), {}

    def _chunks(self, text: str) -> list[str]:
        return self.pattern.findall(text) if _ODD_SPACE.search(text) else _CHUNK.findall(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        chunks = [self._chunks(t) for t in texts]
        distinct = set(chain.from_iterable(chunks))
        new = list(distinct.difference(self.known))
        if len(self.known) + len(new) > REMEMBERED and self.known:
            self.known, new = {}, list(distinct)
        split = [self.pattern.findall(c) for c in new]
        pieces = dict.fromkeys(chain.from_iterable(split))
        ids = dict(zip(pieces, encode_pieces(self.words, [p.encode() for p in pieces])))
        for chunk, parts in zip(new, split):
            self.known[chunk] = ids[parts[0]] if len(parts) == 1 else np.concatenate([ids[p] for p in parts])
        nothing = np.zeros(0, np.uint32)
        return [np.concatenate(list(map(self.known.__getitem__, c))) if c else nothing for c in chunks]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, by gathering ranges of the vocabulary's bytes."""
        return decode(self.words, ids)


def decode(words: Vocabulary, ids: np.ndarray) -> bytes:
    first, size = words.offsets[ids], words.offsets[ids + 1] - words.offsets[ids]
    if len(ids) == 0:
        return b""
    ends = np.cumsum(size)
    return words.data[np.arange(ends[-1]) + np.repeat(first - ends + size, size)].tobytes()


DIGEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
IDS = "doc_id bigint, ids array<int>"


def _digests(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for part in textbytes.slices(batches, "text", SLICE):
            encoded = encoder.encode([t or "" for t in part.column("text").to_pylist()])
            yield shared.batch(DIGEST, [
                part.column("doc_id"), list(map(len, encoded)),
                [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in encoded],
                [hashlib.sha256(encoder.decode(i.astype(np.int64))).hexdigest() for i in encoded]])

    return run


def _encoded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for part in textbytes.slices(batches, "text", SLICE):
            encoded = encoder.encode([t or "" for t in part.column("text").to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in encoded])]).astype(np.int32)
            flat = np.concatenate(encoded).astype(np.int32) if encoded else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], schema=shared.arrow_schema(IDS))

    return run


CHECKED = "doc_id bigint, n_tokens bigint, ids array<int>, intact boolean"


def _checked(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for part in textbytes.slices(batches, "text", SLICE):
            texts = [t or "" for t in part.column("text").to_pylist()]
            encoded = encoder.encode(texts)
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in encoded])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(encoded).astype(np.int32), pa.int32()))
            intact = [encoder.decode(i.astype(np.int64)) == t.encode() for i, t in zip(encoded, texts)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(offsets).astype(np.int64)), ids, pa.array(intact)],
                schema=shared.arrow_schema(CHECKED))

    return run


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for part in batches:
            texts = [decode(words, np.array(i or [], np.int64)).decode("utf-8", "replace")
                     for i in part.column("ids").to_pylist()]
            yield shared.batch("doc_id bigint, text string", [part.column("doc_id"), texts])

    return run


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every document."""
    return shared.arrow_map(shared.keyed(docs), _encoded(path, pattern), IDS)


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids decode to the empty text."""
    return shared.arrow_map(encoded.select("doc_id", "ids"), _decoded(path), "doc_id bigint, text string")


def encode_checked(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, intact): ``intact`` says that the ids decode to the text's bytes."""
    return shared.arrow_map(shared.keyed(docs), _checked(path, pattern), CHECKED)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes and decodes every document: count, and digests of the ids and of the decoded bytes."""
    return shared.arrow_map(shared.keyed(docs), _digests(path, pattern), DIGEST)
