"""Collocations and ranked search against plain restatements."""

import collections
import math
import random
import re

import numpy as np
import pytest

from spokeworks.llm import collocations, lexical_search

SCHEMA = "doc_id bigint, text string, lang string, word string, h1 string, a int, row string, terms string, score int"
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def rows():
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdeéßñ", k=rng.randint(1, 5))) for _ in range(40)]
    fixed = [["new", "york", "city"], ["Of", "THE"], ["a-b", "ÄÖ"], ["x", "x", "x", "x"], ["only", "pair"]]
    out = []
    for i in range(160):
        text = []
        for _ in range(rng.randint(0, 25)):
            text += rng.choice(fixed) if rng.random() < 0.3 else rng.choices(words, k=rng.randint(1, 3))
            if rng.random() < 0.2:
                text.append(rng.choice([".", ",", " \n", "\t;", "\x0b", "\x1c", "!?"]))
        out.append((i, " ".join(text), [None, "en", "de", "und"][i % 7 % 4], "w", "h", 1, "r", "t", 1))
    extra = [(200, None, "en"), (201, "", None), (202, " \n\t ", "en"), (203, "x x " * 3000, "fr"), (None, "new york city " * 12, None),
             (None, None, None), (204, "new york city " * 12, "en"), (204, "new york city " * 12, "en"), (205, "end new", "en"), (206, "york start", "en")]
    return out + [(*r, *[None] * 6) for r in extra]


ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def plain_phrases(most, floor=10, covered=50):
    counts, total = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in ROWS:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                counts.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in counts.items() if len(p) > 2 and a >= floor}
    out = collections.defaultdict(list)
    for (lang, *phrase), a in candidates.items():
        cuts = []
        for k in range(1, len(phrase)):
            left, right = counts[(lang, *phrase[:k])], counts[(lang, *phrase[k:])]
            cuts.append((1000000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        longer = [b for p, b in candidates.items() if p[0] == lang and len(p) > len(phrase) + 1
                  and any(list(p[i:i + len(phrase)]) == phrase for i in range(1, len(p)))]
        if not any(100 * b >= covered * a for b in longer):
            text = " ".join(phrase)
            out[lang].append((-score, -a, text.encode(), text, a, left, right, total[lang], score))
    return [(lang, i + 1, *r[3:]) for lang, found in out.items() for i, r in enumerate(sorted(found)[:most])]


@pytest.mark.parametrize("most, floor, covered, shard", [(2000, 10, 50, 200_000), (7, 2, 50, 17), (2000, 1, 101, 64)])
def test_phrases_are_those_of_plain_counts(docs, most, floor, covered, shard):
    got = [tuple(r) for r in collocations.collocations(docs, most, floor, covered, shard).collect()]
    want = plain_phrases(most, floor, covered)
    assert sorted(got) == sorted(want) and len(got) > 5


def test_texts_are_read_once_however_many_tries_there_are(spark, docs):
    jobs = []
    for shard in (200_000, 64):
        group = f"tries-of-{shard}"
        spark.sparkContext.setJobGroup(group, group)
        collocations.phrases(docs, 1, shard)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs[1] <= jobs[0] + 3


def test_slices_shared_by_copies_of_a_trie_add_up(spark, docs, monkeypatch):
    monkeypatch.setattr(collocations, "SHARE", 1)
    assert collocations.encoded(docs).count() > 1
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == sorted(plain_phrases(2000))


def test_tries_hold_their_phrases_and_no_others():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    phrases = {(0, int(b), -1) for b in range(1, 300)} | {tuple(map(int, (*rng.integers(0, 300, 2), -1))) for _ in range(900)}
    phrases |= {tuple(map(int, rng.integers(0, 60, 3))) for _ in range(3000)} | {(0, 1, c) for c in range(300)}
    phrases = sorted(phrases)
    a, b, c = (np.array([p[i] for p in phrases]) for i in range(3))
    trie = collocations.compiled(words[a], words[b], words[c], c < 0)
    assert len(set(trie.nodes.tolist())) == len(phrases)
    numbers = rng.integers(-1, 60, 20_000).astype(np.int32)
    counts = np.zeros(len(trie.checked), np.int64)
    for states in collocations.advance(trie, numbers, words):
        counts += np.bincount(states, minlength=len(counts))
    held = numbers.tolist()
    seen = collections.Counter((*held[i:i + 2], -1) for i in range(len(held) - 1)) + collections.Counter(
        tuple(held[i:i + 3]) for i in range(len(held) - 2) if held[i + 2] >= 0)
    assert counts[trie.nodes].tolist() == [seen[p] if -1 not in p[:2] else 0 for p in phrases]


def test_scores_of_products_beyond_64_bits(spark):
    a, l_, r = 3 * 10 ** 9, 4 * 10 ** 12, 7 * 10 ** 12
    row = spark.createDataFrame([(a, l_, r)], "a bigint, f1 bigint, f2 bigint").selectExpr(collocations._score("f1", "f2")).first()
    assert row[0] == 10 ** 6 * a * a // (l_ * r)


TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = [(0, "New York city a-b"), (1, "x"), (2, None), (3, ""), (None, "york york THE"), (4, "nowhere nothing"), (5, "ÄÖ a é x of"),
         (5, "ÄÖ a é x of"), (6, " ".join(r[1] for r in ROWS[:30] if r[1])), (7, "of the new york city x pair only")]


def plain_ranks(rows, items, k=10):
    docs = [(r[0], TERM.findall((r[1] or "").translate(UPPER))) for r in rows]
    total, length = sum(1 for _, t in docs if t), sum(len(t) for _, t in docs)
    df = collections.Counter(term for _, t in docs for term in set(t))
    counts, out = [collections.Counter(t) for _, t in docs], []
    for item, text in items:
        scores = []
        for (doc, terms), tf in zip(docs, counts):
            score = 0
            for term in TERM.findall((text or "").translate(UPPER)):
                if tf[term]:
                    weight = math.floor(1000 * math.log((2 * total + 2) / (2 * df[term] + 1)))
                    score += weight * (1000000000 * tf[term] // (1000 * tf[term] + 8 * (25 + 75 * len(terms) * total // length)))
            if score > 0:
                scores.append((-score, doc is None, doc, score))
        out += [(item, i + 1, s[2], s[3]) for i, s in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shares, documents, block, k", [((1024, 64, 8), 4096, 256, 10), ((20, 3), 25, 3, 4), ((9, 2), 60, 256, 1)])
def test_ranks_are_those_of_a_full_scan(spark, docs, monkeypatch, shares, documents, block, k):
    for name, value in (("SHARES", shares), ("DOCUMENTS", documents), ("ITEMS", block)):
        monkeypatch.setattr(lexical_search, name, value)
    items = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id bigint, text string, doc_id string")
    got = lexical_search.ranked(docs, items, k).collect()
    assert sorted(map(tuple, got), key=repr) == plain_ranks(ROWS, ITEMS, k)
    assert len(got) > 3 * k


def test_copies_of_one_document_tie_by_id(spark):
    rows = [(i, "same words here") for i in range(300, 0, -1)] + [(None, "same words here")] * 40 + [(900, "other"), (901, "other same")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    items = spark.createDataFrame([(1, "same words here"), (2, "other")], "item_id bigint, text string")
    got = sorted(map(tuple, lexical_search.ranked(docs, items).collect()), key=repr)
    assert got == plain_ranks(rows, [(1, "same words here"), (2, "other")])


def test_empty_tables(spark, docs):
    nothing = spark.createDataFrame([], SCHEMA)
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "x")], "item_id bigint, text string")
    assert collocations.collocations(nothing).count() == 0
    assert lexical_search.ranked(nothing, some).count() == lexical_search.ranked(docs, none).count() == 0
