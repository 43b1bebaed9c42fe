"""Which files of a keyed table may hold a key: a range and a Bloom filter per file.

The filter is blocked: a key sets ``len(SHIFTS)`` bits of one 64-bit word, and a word stands for two keys on average,
so a foreign key passes with about one chance in a thousand. Filters are built by ``bit_or`` and stored in blocks of
``BLOCK`` words. An increment's keys become at most ``INTERVALS`` ranges; a file is a candidate where its range meets
one of them and, for increments of up to ``PROBED`` keys, where the filter passes a key of the ranges it meets.
A candidate may turn out not to hold any key; a file that holds one is always a candidate.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spokeworks.operators.levels import LeveledTable
from spokeworks.session import ship_package

#: Words of a stored block, ranges an increment's keys are cut into, and keys that filters are asked for.
BLOCK, INTERVALS, PROBED = 4096, 1024, 1 << 20
#: Bits of a key's hash that choose its bits in the word.
SHIFTS = (6, 20, 34, 48)

SCHEMA = "low string, high string, words bigint, block bigint, at array<bigint>, bits array<bigint>"


def index_table(path: str, place: Sequence[str]) -> LeveledTable:
    return LeveledTable(f"{path.rstrip('/')}__keys", SCHEMA, tuple(place))


def _bits(hashed: Column) -> Column:
    bits = None
    for shift in SHIFTS:
        place = F.shiftrightunsigned(hashed, shift).bitwiseAND(63).cast("int")
        one = F.call_function("shiftleft", F.lit(1).cast("bigint"), place)
        bits = one if bits is None else bits.bitwiseOR(one)
    return bits


def summaries(rows: DataFrame, keys: Sequence[str], place: Sequence[str]) -> DataFrame:
    """(SCHEMA, place): a row per block of a file's filter; rows with a NULL key are in none."""
    keyed = (rows.dropna(subset=list(keys))
             .select(*place, F.col(keys[0]).cast("string").alias("key"), F.xxhash64(*keys).alias("hashed")))
    sizes = keyed.groupBy(*place).agg(F.min("key").alias("low"), F.max("key").alias("high"),
                                      F.ceil(F.count("*") / 2).cast("bigint").alias("words"))
    word = F.pmod("hashed", "words")
    placed = keyed.join(sizes, list(place)).select(*place, "low", "high", "words", word.alias("word"), _bits(F.col("hashed")).alias("bits"))
    one = placed.groupBy(*place, "low", "high", "words", "word").agg(F.bit_or("bits").alias("bits"))
    pairs = F.collect_list(F.struct((F.col("word") % BLOCK).alias("at"), "bits")).alias("pairs")
    return (one.groupBy(*place, "low", "high", "words", F.floor(F.col("word") / BLOCK).alias("block")).agg(pairs)
            .select("low", "high", "words", "block", F.col("pairs.at").alias("at"), F.col("pairs.bits").alias("bits"), *place))


class Probe:
    """An increment's keys: sorted ranges and, unless there are too many, the hashes of the keys in each."""

    def __init__(self, incoming: DataFrame, keys: Sequence[str]):
        known = incoming.dropna(subset=list(keys)).select(F.col(keys[0]).cast("string").alias("key"), F.xxhash64(*keys).alias("hashed"))
        count = known.count()
        parts = max(1, min(INTERVALS, count // 64))
        hashes = F.collect_list("hashed") if count <= PROBED else F.array().cast("array<bigint>")
        ranged = known.repartitionByRange(parts, "key") if parts > 1 else known.coalesce(1)
        rows = (ranged.groupBy(F.spark_partition_id().alias("part"))
                .agg(F.min("key").alias("low"), F.max("key").alias("high"), hashes.alias("hashes")).collect())
        rows.sort(key=lambda r: r["low"].encode())
        self.lows, self.highs = ([r[c].encode() for r in rows] for c in ("low", "high"))
        self.hashes = np.array([h for r in rows for h in r["hashes"]], np.int64) if count <= PROBED else None
        self.first = np.cumsum([0, *(len(r["hashes"]) for r in rows)])

    def may_hold(self, low: str, high: str, words: int, block: int, at: np.ndarray, bits: np.ndarray) -> bool:
        begin, end = bisect.bisect_left(self.highs, low.encode()), bisect.bisect_right(self.lows, high.encode())
        if begin >= end or self.hashes is None:
            return begin < end
        asked = self.hashes[self.first[begin]:self.first[end]]
        word = asked % words  # numpy's remainder has the sign of the divisor, as pmod
        asked, word = asked[word // BLOCK == block].view(np.uint64), word[word // BLOCK == block] % BLOCK
        held, wanted = np.zeros(BLOCK, np.uint64), np.zeros(len(asked), np.uint64)
        held[at] = bits.view(np.uint64)
        for shift in SHIFTS:
            wanted |= np.uint64(1) << ((asked >> np.uint64(shift)) & np.uint64(63))
        return bool(((held[word] & wanted) == wanted).any())


def _candidates(probe, place: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = set()  # a file is a candidate by its first block that may hold a key; the others are not asked
        for part in batches:
            columns = [part.column(c).to_pylist() for c in ("low", "high", "words", "block")]
            files, some = list(zip(*(part.column(c).to_pylist() for c in place))), []
            at, bits = (part.column(c) for c in ("at", "bits"))
            for i, row in enumerate(zip(*columns)):
                if files[i] not in found and probe.value.may_hold(*row, np.asarray(at[i].values), np.asarray(bits[i].values)):
                    found.add(files[i])
                    some.append(i)
            yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(some, pa.int64())) for c in place], names=list(place))

    return run


def candidates(spark: SparkSession, index: LeveledTable, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Files (place) of the index that may hold an incoming key."""
    ship_package(spark)
    probe = spark.sparkContext.broadcast(Probe(incoming, keys))
    schema = ", ".join(f"{c} string" for c in index.place)
    return index.read(spark).mapInArrow(_candidates(probe, index.place), schema).distinct()
