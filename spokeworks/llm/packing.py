"""Best-fit packing of documents into training sequences, under three capacities at once.

A document's tokens, with an end mark, are one piece, or pieces of full length where they are more; the first of
these may be shorter. A piece of ``n`` tokens asks for ``n`` tokens, one document and ``n * n`` of attention cost.
Pieces are taken from the longest to the shortest; each goes to the open sequence where, under every constraint,
the weighted norm of what stays free (or the weighted dot product of what is asked and what is free) is least, and
to a new one where none has room.

Pieces of one length ask for the same, and open sequences with the same content are alike, so the choice is made
once for a class of sequences and all pieces of a length that go there. The driver sees how many pieces have each
length, at most ``tokens`` rows whatever the size of the corpus, and returns *allotments*: ranks from..to of a
length belong to such sequences. Pieces are ranked in the tasks that cut them, offsets of the tasks are added by a
join, and a join on blocks of ranks brings them to their allotments; no piece passes through the driver.

Defined results: null and empty texts are a piece that is the end mark alone; repeated rows are packed one by one;
a null id stays null; very long texts are encoded in chunks and cut into pieces like any other; equal lengths (ties)
are ranked by the task and place they are read at; columns other than ``doc_id`` and ``text`` are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import functools
import math
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from spokeworks.llm import shared, textbytes

#: Bytes of text handled at once, chunks that a worker remembers, and new chunks joined into one text.
SLICE, REMEMBERED, JOINED = 4 << 20, 1_000_000, 400
#: Ranks of a length that meet their allotments under one key.
BLOCK = 1024
END = 0

# ASCII white space; bytes, and first two bytes, of other white space and of special strings.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.zeros(256, bool)
_ODD[28:32] = True
_ODD_PAIRS = np.zeros(65536, bool)
_ODD_PAIRS[[0xC285, 0xC2A0, 0xE19A, 0xE280, 0xE281, 0xE380, (ord("<") << 8) | ord("|")]] = True


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds, and the weights of the three in the choice of one."""

    tokens: int = 2048
    documents: int = 2048
    cost: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"

    @property
    def piece(self) -> int:
        """Tokens of the longest piece that a sequence of its own can hold."""
        return min(self.tokens, math.isqrt(self.cost))


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _whole(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts with white space beyond ASCII, which may run together with a chunk's, or with a special string."""
    pairs = (data[:-1].astype(np.uint16) << 8) | data[1:]
    odd = np.union1d(np.flatnonzero(_ODD[data]), np.flatnonzero(_ODD_PAIRS[pairs]))
    return np.unique(np.searchsorted(offsets, odd, "right") - 1)


class Encoder:
    """Ids of texts by a byte-level tokenizer file whose pattern matches white space with what follows.

    Texts are cut before every run of ASCII white space, where no match of the pattern reaches across. A chunk is
    known by a 64-bit hash and encoded once; new chunks go to the library joined into long texts, and as a token's
    bytes are known the ids are cut apart again where the chunks end.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        spelled = self.tokenizer.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(spelled.values()) + 1, np.int64)
        for token, number in spelled.items():
            self.sizes[number] = len(token)  # a character of the file stands for a byte
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _call(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        """Encodes new chunks, and drops all that was known before where it would be too much."""
        if len(self.hashes) + len(chunks) > REMEMBERED and len(self.hashes):
            self._forget()
        joins = np.array([bool(_SPACE[c[0]] and not _SPACE[c[-1]]) for c in chunks], bool)
        order = np.append(np.flatnonzero(joins), np.flatnonzero(~joins))
        inside, alone = [chunks[i] for i in np.flatnonzero(joins)], [chunks[i].decode() for i in np.flatnonzero(~joins)]
        texts = [b"".join(inside[i:i + JOINED]).decode() for i in range(0, len(inside), JOINED)]
        joined = np.concatenate([np.zeros(0, np.uint32), *(x for i in range(0, len(texts), 64) for x in self._call(texts[i:i + 64]))])
        ends = np.searchsorted(np.cumsum(self.sizes[joined]), np.cumsum([len(c) for c in inside])) + 1 if inside else []
        rest = self._call(alone)
        count = np.diff(np.concatenate([[0], ends, len(joined) + np.cumsum([len(r) for r in rest])]).astype(np.int64))
        first = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, joined, *rest])
        hashes = np.concatenate([self.hashes, hashes[order]])
        sort = np.argsort(hashes)
        self.hashes = hashes[sort]
        self.first, self.count = np.concatenate([self.first, first])[sort], np.concatenate([self.count, count])[sort]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (one more at the end)."""
        data, offsets = textbytes.buffer_of(texts)
        space = _SPACE[data]
        opens = space.copy()
        opens[1:] &= ~space[:-1]
        opens[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(opens)
        ends = np.append(starts[1:], len(data))[:len(starts)]
        hashes = textbytes.span_hashes(data, starts, ends)
        distinct, place, number = np.unique(hashes, return_index=True, return_inverse=True)
        for _ in range(2):  # once more where what was known has been dropped
            new = np.flatnonzero(~np.isin(distinct, self.hashes, assume_unique=True))
            if len(new):
                self._learn(distinct[new], [data[i:j].tobytes() for i, j in zip(starts[place[new]].tolist(), ends[place[new]].tolist())])
        at = np.searchsorted(self.hashes, distinct)[number]
        count = self.count[at]
        begins = np.append(0, np.cumsum(count))
        flat = self.ids[np.repeat(self.first[at] - begins[:-1], count) + np.arange(begins[-1])]
        cuts = begins[np.searchsorted(starts, offsets)]
        whole = _whole(data, offsets)
        if len(whole) == 0:
            return flat, cuts
        parts = [flat[i:j] for i, j in zip(cuts[:-1], cuts[1:])]
        for i, ids in zip(whole, self._call([data[offsets[i]:offsets[i + 1]].tobytes().decode() for i in whole])):
            parts[i] = ids
        return np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts]))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker, which keeps what it remembers from task to task."""
    return Encoder(path)


PIECES = ("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task bigint, place bigint")


def _cut(path: str, size: int, with_ids: bool):
    """The Arrow function from (doc_id, text) to pieces, each with its place among those of its length in this task."""
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen, task = encoder(path), [0] * (size + 1), TaskContext.get().partitionId()
        end = np.array([END], "<u4").tobytes()
        for part in textbytes.slices(batches, "text", SLICE):
            out: list[list] = [[] for _ in schema.split(", ")]
            flat, cuts = coder.encode(part.column("text"))
            for doc, low, high in zip(part.column("doc_id").to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist()):
                ids = flat[low:high].astype("<u4").tobytes() + end
                total, start = len(ids) // 4, 0
                for piece in range(-(-total // size)):
                    stop = total - (-(-total // size) - 1 - piece) * size
                    mine = ids[4 * start:4 * stop]
                    row = (doc, piece, start, stop - start, zlib.crc32(mine), task, seen[stop - start])
                    for column, value in zip(out, (*row, np.frombuffer(mine, "<i4")) if with_ids else row):
                        column.append(value)
                    seen[stop - start] += 1
                    start = stop
            yield shared.batch(schema, out)

    return run, schema


def pieces(docs: DataFrame, path: str, capacity: Capacity = Capacity(), with_ids: bool = False) -> DataFrame:
    """The pieces of all documents as a scratch table; ``path`` must be readable on every executor."""
    function, schema = _cut(path, capacity.piece, with_ids)
    return shared.written(shared.arrow_map(shared.keyed(docs), function, schema), "pieces")


class _Open:
    """Classes of open sequences: what is free in each, its first sequence and how many there are."""

    def __init__(self, capacity: Capacity):
        self.capacity, self.size = capacity, 0
        self.free = np.zeros((64, 3), np.int64)
        self.first, self.count = np.zeros(64, np.int64), np.zeros(64, np.int64)

    def add(self, free: np.ndarray, first: int, count: int) -> None:
        if count == 0 or free[0] == 0 or free[1] == 0 or free[2] == 0:
            return
        if self.size == len(self.first):
            kept = np.flatnonzero(self.count[:self.size] > 0)
            room = max(64, 2 * len(kept))
            for name in ("free", "first", "count"):
                old = getattr(self, name)
                new = np.zeros((room, *old.shape[1:]), np.int64)
                new[:len(kept)] = old[kept]
                setattr(self, name, new)
            self.size = len(kept)
        self.free[self.size], self.first[self.size], self.count[self.size] = free, first, count
        self.size += 1

    def best(self, asked: np.ndarray) -> int | None:
        """The class with room for a piece that leaves least, by the capacity's rule; ties to the first sequence."""
        fits = np.flatnonzero((self.count[:self.size] > 0) & (self.free[:self.size] >= asked).all(axis=1))
        if len(fits) == 0:
            return None
        scale = np.array([self.capacity.tokens, self.capacity.documents, self.capacity.cost], float)
        weights, free = np.array(self.capacity.weights), self.free[fits]
        if self.capacity.rule == "norm":
            score = ((((free - asked) / scale) ** 2) * weights).sum(axis=1)
        else:
            score = (free / scale * (asked / scale) * weights).sum(axis=1)
        return int(fits[np.lexsort((self.first[fits], score))[0]])


ALLOTMENTS = "length bigint, rank_from bigint, rank_to bigint, first_sequence bigint, per_sequence bigint, base bigint"


def allotments(counts: dict[int, int], capacity: Capacity = Capacity()) -> tuple[list[tuple], int]:
    """Where the pieces of each length go, and the number of sequences.

    An allotment (length, from, to, first, per, base): the pieces of that length with ranks from..to (not included)
    lie ``per`` to a sequence from sequence ``first`` on, at offset ``base`` and behind each other.
    """
    if capacity.rule not in ("norm", "dot"):
        raise ValueError("rule is 'norm' or 'dot'")
    opened, out, sequences = _Open(capacity), [], 0
    whole = np.array([capacity.tokens, capacity.documents, capacity.cost], np.int64)
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        asked, rank, left = np.array([length, 1, length * length], np.int64), 0, counts[length]
        while left:
            at = opened.best(asked)
            free, first, count = (whole, sequences, left) if at is None else (
                opened.free[at].copy(), int(opened.first[at]), int(opened.count[at]))
            per = int((free // asked).min())
            if per == 0:
                raise ValueError(f"a piece of {length} tokens fits no sequence")
            full = min(count, left // per)
            rest = left - full * per if full < count else 0
            base = capacity.tokens - int(free[0])
            if full:
                out.append((length, rank, rank + full * per, first, per, base))
                opened.add(free - per * asked, first, full)
            if rest:
                out.append((length, rank + full * per, rank + full * per + rest, first + full, per, base))
                opened.add(free - rest * asked, first + full, 1)
            used = full + (rest > 0)
            if at is None:
                sequences += used
            else:  # ``add`` may have moved the classes
                at = int(np.flatnonzero((opened.first[:opened.size] == first) & (opened.count[:opened.size] == count)
                                        & (opened.free[:opened.size] == free).all(axis=1))[0])
                opened.first[at], opened.count[at] = first + used, count - used
            rank += full * per + rest
            left -= full * per + rest
    return out, sequences


def placed(cut: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``."""
    per_task = cut.groupBy("task", "length").agg(F.count("*").alias("pieces"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("pieces").alias("n")).collect()}
    rows, _ = allotments(counts, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("task", "length", F.coalesce(F.sum("pieces").over(before), F.lit(0)).alias("before"))
    blocks = cut.sparkSession.createDataFrame(rows, ALLOTMENTS).select(
        "*", F.explode(F.expr(f"sequence(rank_from div {BLOCK}, (rank_to - 1) div {BLOCK})")).alias("block"))
    ranked = (cut.join(offsets, ["task", "length"]).withColumn("rank", F.col("before") + F.col("place"))
              .withColumn("block", F.expr(f"rank div {BLOCK}")))
    inside = F.expr("rank >= rank_from AND rank < rank_to")
    return (ranked.join(blocks.withColumnRenamed("length", "of"), (F.col("length") == F.col("of"))
                        & (ranked["block"] == blocks["block"]) & inside)
            .select(*cut.columns, F.expr("first_sequence + (rank - rank_from) div per_sequence").alias("sequence_id"),
                    F.expr("base + (rank - rank_from) % per_sequence * length").alias("offset")))


def packed(docs: DataFrame, path: str, capacity: Capacity = Capacity()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    return placed(pieces(docs, path, capacity), capacity).drop("task", "place")


def sequences(docs: DataFrame, path: str, capacity: Capacity = Capacity()) -> DataFrame:
    """The sequences themselves: sequence_id, ids, and of each document in it its id and where its tokens end."""
    rows = placed(pieces(docs, path, capacity, with_ids=True), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return (rows.groupBy("sequence_id").agg(parts.alias("parts"))
            .select("sequence_id", F.expr("flatten(parts.ids)").alias("ids"), F.col("parts.doc_id").alias("doc_ids"),
                    F.expr("transform(parts, p -> p.offset + size(p.ids))").alias("ends")))
