"""Collocations per language, counted by double-array tries of Apriori-safe candidates.

Texts become lists of word numbers once, in slices with a dictionary of their own; a word's identity is a 64-bit
hash of its language and bytes. Level by level, a phrase is a candidate only where its parts are frequent: a bitmap
of fixed size, which may let too much through and never too little, tells tasks which words (pairs) are; what is
seen of their successors is summed up to the floor only, so this step says which phrases can be frequent and not
how frequent they are.

Counts come from tries. Candidates are dealt by their hashes into shards of ``SHARD`` phrases, each compiled into a
double array whose symbols are words, in a task of its own. The texts are read once more: the phrases of a slice that
a bitmap of the candidates lets through go, with how often they stand there, to the shard that their hashes name. A
task reads its trie and then the blocks of the slices, one by one; numpy moves all phrases of a block through the
array at once, a word per level, and adds up the accepting states they reach. So work and traffic follow the text,
however many candidates there are; where they are few, a trie is copied to several tasks that share the slices.

Defined results: null texts have no words and a null language is ``und``; very long texts are one slice each and
cut into pieces like any other; repeated rows count again; ties are ordered by frequency and then by the bytes of
the phrase; columns other than text and language are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from spokeworks.llm import shared, textbytes
from spokeworks.llm.bitmaps import Bitmap

#: Bytes of text with one dictionary.
SLICE = 4 << 20
#: Phrases of a trie, and slices (at most 250,000 phrases each, or so) that a copy of it counts.
SHARD, SHARE = 100_000, 8
#: Parts that a language's phrases are ranked in before the last ranking.
PARTS = 64

#: What bytes are: 0 part of a word, 1 between words, 2 between pieces.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 32]] = 1
_CLASS[[10, 11, 12, 13, *b".,;:!?"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``shared.arrow_map`` whose workers, which live on, give memory that is free back to the system after a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
            ctypes.CDLL(None).malloc_trim(0)

    return shared.arrow_map(df, run, schema)


ENCODED = "numbers binary, hashes binary, words array<string>, langs array<string>, counts array<bigint>"


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and whether a word begins a piece."""
    kind = _CLASS[data]
    inside = kind == 0
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    del before, after
    walls = (kind == 2).astype(np.int8)
    walls[edges] += 1
    walls = np.cumsum(walls, dtype=np.int32 if len(data) < 1 << 30 else np.int64)
    opens = np.ones(len(starts), bool)
    opens[1:] = walls[starts[1:]] != walls[ends[:-1] - 1]
    return starts, ends, opens


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang) to slices: word numbers with -1 between pieces, and what the numbers stand for."""
    for part in textbytes.slices(batches, "text", SLICE):
        data, offsets = textbytes.buffer_of(part.column("text"))
        data = _LOWER[data]
        starts, ends, opens = _spans(data, offsets)
        langs = part.column("lang").to_pylist()
        salts = {name: xxhash.xxh64_intdigest(name.encode(), 7) for name in set(langs)}
        text = np.searchsorted(offsets, starts, "right") - 1
        salt = np.array([salts[name] for name in langs], np.uint64)
        hashes = textbytes.mix(textbytes.span_hashes(data, starts, ends) ^ salt[text])
        distinct, first, number, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        places = np.arange(len(starts)) + np.cumsum(opens)
        numbers = np.full(len(starts) + int(opens.sum()) + 1, -1, np.int32)
        numbers[places] = number
        words = [data[i:j].tobytes().decode() for i, j in zip(starts[first].tolist(), ends[first].tolist())]
        yield shared.batch(ENCODED, [[numbers.tobytes()], [distinct.tobytes()], [words],
                                     [[langs[i] for i in text[first].tolist()]], [count.tolist()]])


def encoded(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("text").cast("string").alias("text"),
                       F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    return shared.written(_map(rows, _encode, ENCODED), "phrase-slices", "zstd")


def vocabulary(slices: DataFrame) -> DataFrame:
    """(lang, word, f) of every word."""
    each = slices.select(F.explode(F.arrays_zip("langs", "words", "counts")).alias("e"))
    return shared.written(each.groupBy(F.col("e.langs").alias("lang"), F.col("e.words").alias("word"))
                          .agg(F.sum("e.counts").alias("f")), "phrase-words")


WORDS = "lang string, word string, f bigint, h bigint"


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        data, offsets = textbytes.buffer_of(part.column("word"))
        salts = np.array([xxhash.xxh64_intdigest(name.encode(), 7) for name in part.column("lang").to_pylist()], np.uint64)
        hashes = textbytes.mix(textbytes.span_hashes(data, offsets[:-1], offsets[1:]) ^ salts)
        yield shared.batch(WORDS, [*(part.column(c) for c in ("lang", "word", "f")), pa.array(hashes.view(np.int64))])


#: The place of a pair in a bitmap, in SQL and in numpy.
PAIR_KEY = "pair ^ shiftrightunsigned(pair, 35)"


def _pair_places(pairs: np.ndarray) -> np.ndarray:
    return pairs ^ (pairs >> np.uint64(35))


def _halves(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A pair of words by the upper halves of their hashes: half the bytes, and few pairs that share one."""
    return (first & np.uint64(0xFFFFFFFF00000000)) | (second >> np.uint64(32))


def _read(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word numbers and the hashes they stand for, of each slice."""
    for numbers, hashes in zip(part.column("numbers"), part.column("hashes")):
        yield np.frombuffer(numbers.as_buffer(), np.int32), np.frombuffer(hashes.as_buffer(), np.uint64)


PAIRS, TRIPLES = "pair bigint, seen int", "pair bigint, third bigint, seen int"


def _pairs_at(numbers: np.ndarray, hashes: np.ndarray, words: Bitmap) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where two frequent words follow each other, and their numbers."""
    frequent = np.append(words.holds(hashes), False)  # the wall between pieces, -1, is the last
    at = np.flatnonzero(frequent[numbers[:-1]] & frequent[numbers[1:]])
    return at, numbers[at].astype(np.int64), numbers[at + 1].astype(np.int64)


def _candidates(words, pairs, floor: int):
    """The Arrow function that lists pairs of frequent words or, given frequent pairs, triples of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for numbers, hashes in _read(part):
                at, first, second = _pairs_at(numbers, hashes, words.value)
                size = len(hashes)
                if pairs is None:
                    key, count = np.unique(first * size + second, return_counts=True)
                    columns = [_halves(hashes[key // size], hashes[key % size])]
                else:
                    some = np.flatnonzero(pairs.value.holds(_pair_places(_halves(hashes[first], hashes[second]))))
                    at, key, pair = at[some], *np.unique(first[some] * size + second[some], return_inverse=True)
                    next_ = np.flatnonzero(at[1:] == at[:-1] + 1)
                    last = numbers[at[next_] + 2].astype(np.int64)
                    triple, count = np.unique(pair[next_] * size + last, return_counts=True)
                    key = key[triple // size] if len(triple) else triple
                    columns = [_halves(hashes[key // size], hashes[key % size]), hashes[triple % size] >> np.uint64(32)]
                columns = [pa.array(c.view(np.int64)) for c in columns]
                yield shared.batch(TRIPLES if pairs else PAIRS, [*columns, pa.array(np.minimum(count, floor))])

    return run


def _seen(rows: DataFrame, keys: list[str], floor: int) -> DataFrame:
    """The phrases that can reach the floor; what is summed stops counting at it."""
    return rows.groupBy(*keys).agg(F.sum("seen").alias("seen")).filter(F.col("seen") >= floor).select(*keys)


def _named(halves: DataFrame, words: DataFrame, names: list[str]) -> DataFrame:
    """Halves k1, k2.. become hashes h1, h2..; where words share a half, every one of them is a candidate."""
    for i, name in enumerate(names, 1):
        word = words.select(F.shiftrightunsigned("h", 32).alias(f"k{i}"), F.col("h").alias(name))
        halves = halves.join(word, f"k{i}").drop(f"k{i}")
    return halves


TRIE = "alphabet binary, base binary, checked binary, nodes binary, phrases binary"


@dataclass(frozen=True)
class Trie:
    """A double array over words: ``base[state] + symbol`` is the next state if ``checked`` there is the state.

    Symbol ``i + 1`` is the word ``alphabet[i]``; zero is no word of the trie. ``nodes`` are the accepting states
    and ``phrases`` their words as symbols, three to a row and zero after a pair.
    """

    alphabet: np.ndarray
    base: np.ndarray
    checked: np.ndarray
    nodes: np.ndarray
    phrases: np.ndarray

    @staticmethod
    def read(row) -> Trie:
        return Trie(np.frombuffer(row["alphabet"], np.uint64), *(np.frombuffer(row[c], np.int32) for c in
                    ("base", "checked", "nodes")), np.frombuffer(row["phrases"], np.int32).reshape(-1, 3))


def _place(base: np.ndarray, checked: np.ndarray, parents: np.ndarray, symbols: np.ndarray, size: int):
    """Gives every parent a base at which its symbols' slots are free; returns the grown arrays and the slots.

    ``parents`` is sorted. Parents with many symbols come first, and the search goes on where the last one was placed;
    those with one symbol fill what is left.
    """
    heads = np.flatnonzero(np.append(True, parents[1:] != parents[:-1])) if len(parents) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(heads, len(parents)))
    slots = np.zeros(len(parents), np.int64)
    low, tried = size + 1, size + 1
    for i in np.argsort(-sizes, kind="stable"):
        if sizes[i] == 1:
            break
        mine = symbols[heads[i]:heads[i] + sizes[i]]
        while True:
            if tried + 512 + size >= len(checked):
                grown = np.full(2 * len(checked) + size + 1024, -1, np.int32)
                grown[:len(checked)] = checked
                checked = grown
            starts = tried + np.flatnonzero(checked[tried:tried + 512] < 0)
            for some in (starts[:8], starts[8:]):
                fit = (checked[some[:, None] - mine[0] + mine] < 0).all(axis=1)
                if fit.any():
                    break
            if fit.any():
                break
            tried += 512
        found = int(some[fit.argmax()]) - int(mine[0])
        slots[heads[i]:heads[i] + sizes[i]] = found + mine
        checked[found + mine] = parents[heads[i]]
    single = heads[sizes == 1]
    free = np.flatnonzero(checked[low:] < 0) + low
    if len(free) < len(single):
        first = len(checked)
        checked = np.concatenate([checked, np.full(len(single) + size, -1, np.int32)])
        free = np.append(free, np.arange(first, len(checked)))
    slots[single] = free[:len(single)]
    checked[slots[single]] = parents[single]
    base = np.concatenate([base, np.zeros(len(checked) - len(base), np.int32)])
    base[parents[heads]] = slots[heads] - symbols[heads]
    return base, checked, slots


def compiled(first: np.ndarray, second: np.ndarray, third: np.ndarray, is_pair: np.ndarray) -> Trie:
    """The double array of phrases of two or three hashes."""
    alphabet = np.unique(np.concatenate([first, second, third[~is_pair]]))
    size = len(alphabet)
    a, b = (np.searchsorted(alphabet, h) + 1 for h in (first, second))
    c = np.where(is_pair, 0, np.searchsorted(alphabet, third) + 1)
    base, checked = np.zeros(2 * size + 1024, np.int32), np.full(2 * size + 1024, -1, np.int32)
    checked[0] = 0
    checked[np.unique(a)] = 0  # a first word's state is its symbol
    pairs, of = np.unique(a.astype(np.int64) * (size + 1) + b, return_inverse=True)
    base, checked, slots = _place(base, checked, pairs // (size + 1), pairs % (size + 1), size)
    state = slots[of]
    longer = np.flatnonzero(~is_pair)
    order = longer[np.lexsort((c[longer], state[longer]))]
    base, checked, slots = _place(base, checked, state[order], c[order], size)
    state[order] = slots
    used, room = int(np.flatnonzero(checked >= 0)[-1]) + 1, size + 1  # so that no symbol leads beyond the end
    return Trie(alphabet, np.append(base[:used], np.zeros(room, np.int32)), np.append(checked[:used], np.full(room, -1, np.int32)),
                state.astype(np.int32), np.stack([a, b, c], axis=1).astype(np.int32))


def _compile(table: pa.Table) -> pa.Table:
    first, second, third = (table.column(c).fill_null(0).to_numpy().view(np.uint64) for c in ("h1", "h2", "h3"))
    trie = compiled(first, second, third, table.column("h3").is_null().to_numpy(zero_copy_only=False))
    arrays = (trie.alphabet, trie.base, trie.checked, trie.nodes, trie.phrases)
    return pa.Table.from_batches([shared.batch(TRIE, [[a.tobytes()] for a in arrays])])


def reached(trie: Trie, numbers: np.ndarray, hashes: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the places where words begin a phrase of the trie: those that go on, and their states, per level."""
    at = np.minimum(np.searchsorted(trie.alphabet, hashes), len(trie.alphabet) - 1)
    symbols = np.append(np.where(trie.alphabet[at] == hashes, at + 1, 0), 0).astype(np.int64)[numbers]
    places = places[symbols[places] > 0]
    places = places[trie.checked[symbols[places]] == 0]
    states = symbols[places]
    for level in (1, 2):
        inside = places + level < len(symbols)
        places, states = places[inside], states[inside]
        symbol = symbols[places + level]
        next_ = trie.base[states] + symbol
        alive = (symbol > 0) & (trie.checked[next_] == states)
        places, states = places[alive], next_[alive]
        yield places, states


def advance(trie: Trie, numbers: np.ndarray, hashes: np.ndarray) -> Iterator[np.ndarray]:
    """The states that all positions of a slice reach with their second word, and with their third."""
    for _, states in reached(trie, numbers, hashes, np.arange(len(numbers))):
        yield states


#: The place of a phrase in a bitmap (lower bits) and among shards (upper half), in SQL and in numpy.
PHRASE_KEY = ("h1 ^ (shiftrightunsigned(h2, 17) | shiftleft(h2, 47))"
              " ^ (shiftrightunsigned(coalesce(h3, 0L), 35) | shiftleft(coalesce(h3, 0L), 29))")


def _phrase_places(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    turned = [(h >> np.uint64(by)) | (h << np.uint64(64 - by)) for h, by in ((second, 17), (third, 35))]
    return first ^ turned[0] ^ turned[1]


def _held(held: Bitmap, hashes: np.ndarray, first: np.ndarray, second: np.ndarray, third: np.ndarray | None = None,
          most: int = 1 << 16) -> np.ndarray:
    """Which phrases of word numbers the bitmap holds; looked up some at a time, which bounds the memory."""
    found = np.zeros(len(first), bool)
    for i in range(0, len(first), most):
        last = np.uint64(0) if third is None else hashes[third[i:i + most]]
        found[i:i + most] = held.holds(_phrase_places(hashes[first[i:i + most]], hashes[second[i:i + most]], last))
    return found


def _phrases_of(numbers: np.ndarray, hashes: np.ndarray, words: Bitmap, held: Bitmap) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct phrases of a slice that may be candidates: word numbers in three rows (-1 after a pair), counts, places."""
    at, first, second = _pairs_at(numbers, hashes, words)
    size = len(hashes)
    some = np.flatnonzero(_held(held, hashes, first, second))
    at, key = at[some], first[some] * size + second[some]
    del first, second, some
    key, pair, twos = np.unique(key, return_inverse=True, return_counts=True)
    next_ = np.flatnonzero(at[1:] == at[:-1] + 1)  # both pairs of a frequent triple are candidates
    triple, threes = np.unique(pair[next_] * size + numbers[at[next_] + 2], return_counts=True)
    del at, pair, next_
    first, second = (key // max(1, size)).astype(np.int32), (key % max(1, size)).astype(np.int32)
    pair, third = triple // max(1, size), (triple % max(1, size)).astype(np.int32)
    kept = np.flatnonzero(_held(held, hashes, first[pair], second[pair], third))
    pair, third = pair[kept], third[kept]
    found = np.stack([np.append(first, first[pair]), np.append(second, second[pair]), np.append(np.full(len(key), -1, np.int32), third)])
    last = np.append(np.zeros(len(key), np.uint64), hashes[third])
    return found, np.append(twos, threes[kept]), _phrase_places(hashes[found[0]], hashes[found[1]], last)


BLOCK = "lane bigint, size int, words binary, numbers binary, counts binary"


def _packed(values: np.ndarray) -> bytes:
    """Numbers that are not negative, in as few bytes each as the largest one takes."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def _unpacked(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // size}").astype(np.int64)


def _deal(words, held, shards: int, copies: int):
    """The Arrow function that sends the phrases of each slice to their shards, as blocks with words of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copy = TaskContext.get().partitionId()
        for part in batches:
            for numbers, hashes in _read(part):
                found, counts, places = _phrases_of(numbers, hashes, words.value, held.value)
                shard = ((places >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(np.diff(shard[order], prepend=-1, append=shards))
                number, rows = np.zeros(len(hashes) + 1, np.int32), []
                for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    block = found[:, order[begin:end]]
                    used = np.zeros(len(hashes) + 1, bool)
                    used[block] = True
                    used = np.flatnonzero(used[:-1])
                    number[used] = np.arange(1, len(used) + 1)  # zero for no third word, the last place
                    rows.append((int(shard[order[begin]]) * copies + copy % copies, end - begin, hashes[used].tobytes(),
                                 _packed(number[block]), _packed(counts[order[begin:end]])))
                if rows:
                    yield shared.batch(BLOCK, list(map(list, zip(*rows))))
                copy += 1

    return run


COUNTED = "h1 bigint, h2 bigint, h3 bigint, a bigint"


def _tally(trie: Trie, counts: np.ndarray) -> pa.RecordBatch:
    """The phrases of a trie that occur."""
    found = np.flatnonzero(counts[trie.nodes])
    phrases, alphabet = trie.phrases[found], np.append(np.uint64(0), trie.alphabet).view(np.int64)
    columns = [alphabet[phrases[:, i]] for i in range(3)]
    return shared.batch(COUNTED, [*map(pa.array, columns[:2]), pa.array(columns[2], mask=phrases[:, 2] == 0),
                                  pa.array(counts[trie.nodes[found]])])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs blocks through the trie that comes before them; a block holds a phrase once, so no two reach one state."""
    trie = counts = None
    for part in batches:
        for i in range(part.num_rows):
            row = {name: column[i].as_py() for name, column in zip(part.schema.names, part.columns)}
            if row["base"] is not None:
                if trie is not None:
                    yield _tally(trie, counts)
                trie = Trie.read(row)
                counts = np.zeros(len(trie.checked), np.int64)
                continue
            block = _unpacked(row["numbers"], 3 * row["size"]).reshape(3, -1) - 1
            times = _unpacked(row["counts"], row["size"])
            pairs, triples = reached(trie, block.T.ravel(), np.frombuffer(row["words"], np.uint64), np.arange(0, block.size, 3))
            for (places, states), mine in ((pairs, block[2, pairs[0] // 3] < 0), (triples, slice(None))):
                counts[states[mine]] += times[places[mine] // 3]
    if trie is not None:
        yield _tally(trie, counts)


def counted(slices: DataFrame, candidates: DataFrame, frequent, shard: int = SHARD) -> DataFrame:
    """(h1, h2, h3, a): how often each candidate that occurs does so, ``h3`` null in pairs; written, as it takes a broadcast."""
    spark = slices.sparkSession
    shards = -(-candidates.count() // shard)
    if shards == 0:
        return spark.createDataFrame([], COUNTED)
    shared.ship_package(spark)
    copies = -(-slices.count() // (SHARE * shards))
    held = spark.sparkContext.broadcast(Bitmap(candidates, PHRASE_KEY))
    dealt = candidates.withColumn("shard", F.expr(f"shiftrightunsigned({PHRASE_KEY}, 32) % {shards}"))
    tries = shared.written(dealt.groupBy("shard").applyInArrow(
        lambda key, table: _compile(table).append_column("shard", pa.array([key[0].as_py()], pa.int64())),
        TRIE + ", shard bigint"), "phrase-tries")
    lanes = tries.withColumn("lane", F.explode(F.expr(f"sequence(shard * {copies}, shard * {copies} + {copies - 1})"))).drop("shard")
    blocks = _map(slices.select("numbers", "hashes"), _deal(frequent, held, shards, copies), BLOCK)
    met = (lanes.unionByName(blocks, allowMissingColumns=True).repartitionById(shards * copies, F.col("lane").cast("int"))
           .sortWithinPartitions("lane", F.isnull("base")))
    found = _map(met, _count, COUNTED)
    done = shared.written(found if copies == 1 else found.groupBy("h1", "h2", "h3").agg(F.sum("a").alias("a")), "phrase-counts")
    held.destroy()
    return done


def phrases(docs: DataFrame, floor: int = 10, shard: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words (lang, word, f, h), frequent phrases (h1, h2, h3, a) and totals (lang, n)."""
    spark: SparkSession = docs.sparkSession
    slices = encoded(docs)
    every = vocabulary(slices)
    words = shared.written(_map(every.filter(F.col("f") >= floor), _hashed, WORDS), "phrase-frequent")
    texts, frequent = slices.select("numbers", "hashes"), spark.sparkContext.broadcast(Bitmap(words, "h"))
    two = shared.written(_seen(_map(texts, _candidates(frequent, None, floor), PAIRS), ["pair"], floor), "phrase-pairs")
    pairs = spark.sparkContext.broadcast(Bitmap(two, PAIR_KEY))
    three = _seen(_map(texts, _candidates(frequent, pairs, floor), TRIPLES), ["pair", "third"], floor)
    split = [F.shiftrightunsigned("pair", 32).alias("k1"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("k2")]
    candidates = shared.written(_named(two.select(*split), words, ["h1", "h2"]).withColumn("h3", F.lit(None).cast("bigint")).unionByName(
        _named(three.select(*split, F.col("third").alias("k3")), words, ["h1", "h2", "h3"])), "phrase-candidates")
    pairs.destroy()
    found = counted(slices, candidates, frequent, shard).filter(F.col("a") >= floor)
    frequent.destroy()
    return words, found, every.groupBy("lang").agg(F.sum("f").alias("n"))


def _score(l_: str, r: str) -> str:
    """The score by whole numbers of up to 38 digits."""
    return f"(cast(1000000 AS decimal(38,0)) * cast(a AS decimal(19,0)) * cast(a AS decimal(19,0))) div (cast({l_} AS decimal(19,0)) * cast({r} AS decimal(19,0)))"


def collocations(docs: DataFrame, most: int = 2000, floor: int = 10, covered: int = 50, shard: int = SHARD) -> DataFrame:
    """The first ``most`` phrases of each language: lang, rank, phrase, a, l, r, n and score.

    A pair is left out where a frequent triple that holds it occurs at least ``covered`` percent as often.
    """
    words, found, totals = phrases(docs, floor, shard)
    word = lambda i: words.select(F.col("h").alias(f"h{i}"), F.col("word").alias(f"w{i}"), F.col("f").alias(f"f{i}"),
                                  *([F.col("lang")] if i == 1 else []))
    pairs, triples = found.filter("h3 IS NULL").select("h1", "h2", "a"), found.filter("h3 IS NOT NULL")
    longer = (triples.select("a", F.explode(F.array(F.struct("h1", "h2"), F.struct(F.col("h2").alias("h1"), F.col("h3").alias("h2")))).alias("p"))
              .groupBy("p.h1", "p.h2").agg(F.max("a").alias("longest")))
    two = (pairs.join(longer, ["h1", "h2"], "left").filter(f"longest IS NULL OR 100 * longest < {covered} * a")
           .join(word(1), "h1").join(word(2), "h2")
           .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"),
                   F.expr(_score("f1", "f2")).alias("score")))
    head = pairs.select("h1", "h2", F.col("a").alias("head"))
    tail = pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("tail"))
    three = (triples.join(head, ["h1", "h2"]).join(tail, ["h2", "h3"]).join(word(1), "h1").join(word(2), "h2").join(word(3), "h3")
             .withColumn("one", F.expr(_score("f1", "tail"))).withColumn("two", F.expr(_score("head", "f3")))
             .select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a",
                     F.expr("IF(one <= two, f1, head)").alias("l"), F.expr("IF(one <= two, tail, f3)").alias("r"),
                     F.least("one", "two").alias("score")))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = Window.partitionBy("lang", F.expr(f"pmod(xxhash64(phrase), {PARTS})")).orderBy(*order)
    best = two.unionByName(three).withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= most).drop("rank")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return (best.withColumn("rank", rank).filter(F.col("rank") <= most).join(totals, "lang")
            .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def oracle(most: int = 2000, floor: int = 10, covered: int = 50) -> str:
    """The same phrases in DuckDB, counted by grouping."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang,
        unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
      FROM documents),
    split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces),
    f1 AS (SELECT lang, p, count(*)::HUGEINT AS f FROM (SELECT lang, unnest(w) AS p FROM split) GROUP BY ALL),
    f2 AS (SELECT lang, p.x, p.y, count(*)::HUGEINT AS f FROM (
      SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: {{'x': w[i], 'y': w[i + 1]}})) AS p FROM split) GROUP BY ALL HAVING count(*) >= {floor}),
    f3 AS (SELECT lang, p.x, p.y, p.z, count(*)::HUGEINT AS f FROM (
      SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: {{'x': w[i], 'y': w[i + 1], 'z': w[i + 2]}})) AS p FROM split)
      GROUP BY ALL HAVING count(*) >= {floor}),
    inside AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY ALL),
    two AS (
      SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.f AS a, u.f AS l, v.f AS r, 1000000 * f2.f * f2.f // (u.f * v.f) AS score
      FROM f2 JOIN f1 u ON u.lang = f2.lang AND u.p = f2.x JOIN f1 v ON v.lang = f2.lang AND v.p = f2.y
      LEFT JOIN inside i ON i.lang = f2.lang AND i.x = f2.x AND i.y = f2.y
      WHERE i.f IS NULL OR 100 * i.f < {covered} * f2.f),
    cuts AS (
      SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z AS phrase, f3.f AS a, u.f AS l1, t.f AS r1, h.f AS l2, v.f AS r2,
        1000000 * f3.f * f3.f // (u.f * t.f) AS one, 1000000 * f3.f * f3.f // (h.f * v.f) AS other
      FROM f3 JOIN f1 u ON u.lang = f3.lang AND u.p = f3.x JOIN f1 v ON v.lang = f3.lang AND v.p = f3.z
      JOIN f2 h ON h.lang = f3.lang AND h.x = f3.x AND h.y = f3.y JOIN f2 t ON t.lang = f3.lang AND t.x = f3.y AND t.y = f3.z),
    scored AS (
      SELECT * FROM two UNION ALL
      SELECT lang, phrase, a, if(one <= other, l1, l2), if(one <= other, r1, r2), least(one, other) FROM cuts),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored),
    totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang)
    SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
    FROM ranked JOIN totals USING (lang) WHERE rank <= {most}"""
