"""Packing against the library's ids and a plain best fit, piece by piece."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spokeworks.llm import packing
from spokeworks.llm.packing import Capacity

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, task string, length int, sequence_id string, rank int, block string"


def rows():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeéßñ", k=rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    texts = [None, "", " \n\t ", "one", "Two  words,\r\nthree", prose(4000), "x" * 5000, "a \n b   c\x85d", "<|endoftext|> in <|endoftext|>\n b",
             "don't we'll 12345 ...!!", "tab\t\tb \x1c\n c", "日本語のテキスト 😀😀"] + [prose(rng.randint(1, 400)) for _ in range(60)]
    out = [(i, t, "t", 1, "s", 2, "b") for i, t in enumerate(texts)]
    return out + [out[14], out[14], (None, texts[15], None, None, None, None, None), (None, None, None, None, None, None, None)]


ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def ids_of(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 0]


def cut(size):
    """(doc, piece, start, length, ids) of every piece."""
    out = []
    for doc, text, *_ in ROWS:
        ids = ids_of(text)
        parts, first = -(-len(ids) // size), (len(ids) - 1) % size + 1
        starts = [0, *range(first, len(ids), size)]
        assert len(starts) == parts
        out += [(doc, i, a, b - a, ids[a:b]) for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)]))]
    return out


def plain(lengths, capacity):
    """Contents of the sequences when pieces are placed one after the other."""
    scale = np.array([capacity.tokens, capacity.documents, capacity.cost], float)
    free, held = [], []
    for n in sorted(lengths, reverse=True):
        asked = np.array([n, 1, n * n])
        fits = [i for i, f in enumerate(free) if (f >= asked).all()]
        if capacity.rule == "norm":
            score = lambda i: float(((((free[i] - asked) / scale) ** 2) * np.array(capacity.weights)).sum())
        else:
            score = lambda i: float((free[i] / scale * (asked / scale) * np.array(capacity.weights)).sum())
        if fits:
            best = min(fits, key=lambda i: (score(i), i))
        else:
            best = len(free)
            free.append(np.array([capacity.tokens, capacity.documents, capacity.cost]))
            held.append([])
        free[best] = free[best] - asked
        held[best].append(n)
    return held


CAPACITIES = [Capacity(), Capacity(300, 4, 50_000), Capacity(256, 5, 65536, rule="dot")]


@pytest.mark.parametrize("capacity", CAPACITIES)
def test_pieces_are_packed_without_gaps_under_every_capacity(docs, capacity):
    got = packing.packed(docs, PATH, capacity).collect()
    want = [(d, p, s, n, zlib.crc32(np.array(i, "<u4").tobytes())) for d, p, s, n, i in cut(capacity.piece)]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in sequences.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))]
        assert sum(n for _, n in held) <= capacity.tokens and len(held) <= capacity.documents
        assert sum(n * n for _, n in held) <= capacity.cost
    assert sorted(sorted(n for _, n in h) for h in sequences.values()) == sorted(sorted(h) for h in plain([w[3] for w in want], capacity))


@pytest.mark.parametrize("seed", range(6))
def test_classes_of_sequences_choose_as_single_pieces_do(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([3, 7, 50, 51, 99, 100]) if rng.random() < 0.6 else rng.randint(1, 100) for _ in range(700)]
    capacity = Capacity(100, rng.choice([3, 9, 100]), rng.choice([5000, 10_000]) if seed % 2 else 10_000, rule=["norm", "dot"][seed // 3])
    lengths = [min(n, capacity.piece) for n in lengths]
    held = collections.defaultdict(list)
    allotted, sequences = packing.allotments(collections.Counter(lengths), capacity)
    for length, low, high, first, per, base in allotted:
        for j in range(high - low):
            held[first + j // per].append(length)
    assert sorted(held) == list(range(sequences))
    assert sorted(map(sorted, held.values())) == sorted(map(sorted, plain(lengths, capacity)))


def test_sequences_hold_the_ids(docs):
    capacity = Capacity(512, 50, 512 * 512)
    by_doc = collections.Counter()
    for r in packing.sequences(docs, PATH, capacity).collect():
        begins = [0, *r["ends"][:-1]]
        assert r["ends"][-1] == len(r["ids"]) <= 512
        by_doc.update((d, tuple(r["ids"][a:b])) for d, a, b in zip(r["doc_ids"], begins, r["ends"]))
    assert by_doc == collections.Counter((d, tuple(i)) for d, _, _, _, i in cut(512))


def test_a_third_of_one_length_is_few_rows_for_the_driver():
    counts = {2048: 10 ** 9, **{n: 10 ** 6 + n for n in range(1, 2048)}}
    allotted, sequences = packing.allotments(counts)
    tokens = sum(n * c for n, c in counts.items())
    assert sequences == -(-tokens // 2048) or sequences / (tokens / 2048) < 1.0001
    assert len(allotted) < 100_000 and sum(high - low for _, low, high, *_ in allotted) == sum(counts.values())


def test_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], SCHEMA), PATH).count() == 0
