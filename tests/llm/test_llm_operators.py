"""Every operator on awkward rows: nulls, empty and long texts, ties, repeated rows, clashing columns, no rows."""

import base64
import importlib.util
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import llm_brute as brute
from spokeworks.llm import (
    byte_bpe, components, mixing, personal_data, phrase_dedup, quality, repeats, simhash, sketches, suffix_dedup,
    textbytes, token_counts, toxicity)

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, bits string, content string,"
          " found int, bucket string, words string, copy_no string, toxic string, kind int, text_1 string")


def table():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeéßñ", k=rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, long_passage = prose(60), prose(140)
    texts = [None, "", " \n\t ", "one", "Two words", prose(40), passage, f"{prose(30)} {passage} {prose(25)}",
             f"{passage}\n{prose(10)}\n{passage}", long_passage, f"{prose(3)} {long_passage}", f"{long_passage} {prose(4)}",
             "same line\nsame line\nother | line\n\nsame line", "a b c a b c a b c " * 40, prose(9000),
             "x" * 5000, "  tab wide  \n space", "emoji 😀😀 ünï \x1c sep\x85x don't we'll 12345 ...!!",
             "mail a.b+c@host-1.example.com, x@y.z_q@r.st and ip 10.0.0.255 or 300.1.1.1 or 01.002.3.4.5.6.7.8",
             "card 4111 1111 1111 1111 or 4111-1111-1111-1112, call +1 (555) 010-9999 or +12 3", "+1.2.3.4.5.6.7.8.9.0 4012888888881881@x.y",
             "You stupid 1d10t, a worthle55 moron", "<|endoftext|> token <|startoftext|>", "á é " * 30]
    texts += [texts[7], texts[5], prose(55), prose(55).upper()]
    for base in (prose(120), prose(300)):
        for _ in range(6):
            words = base.split()
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    rows = [(i * 3 % 101, t, "en", f"s{i % 3}" if i % 5 else None, len(t) if t else None, "b", "c", 1, "k", "w", "z", "y", 2, "u")
            for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, texts[9], None, None, None, *[None] * 9), (None, None, None, None, None, *[None] * 9),
             (rows[10][0], "another text of the same id " + prose(20), "de", "s1", 1, *[None] * 9)]
    return rows


ROWS = table()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(r[0], i % 2, int("stupid" in (r[1] or "")), "x") for i, r in enumerate(ROWS)] + [(None, 1, 1, "x"), (999, None, None, "x")],
        "doc_id bigint, quality int, toxic int, text string")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def multiset(rows):
    return sorted(rows, key=repr)


def answers(df, *columns):
    return multiset([tuple(r[c] for c in columns) for r in df.collect()])


def expected(function):
    return multiset([(r[0], *function(r[1])) for r in ROWS])


def test_quality_base_and_verdict(docs, labels):
    out = quality.quality_rules(docs, labels)
    assert answers(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == expected(brute.quality_base)
    for row in out.collect():
        assert row["base_failed"] == (row["n_words"] < 50 or 100 * row["n_repeat_words"] > 50 * row["n_words"])
        assert row["kept"] == (not row["base_failed"] and row["log_ratio"] >= quality.THRESHOLD)


def test_quality_ratio_is_the_mean_over_ngrams(docs, labels):
    """The score restated one n-gram at a time from the same hashes."""
    good = {r[0] for i, r in enumerate(ROWS) if i % 2 == 1 and r[0] is not None}
    weight = quality.weights(quality.cell_counts(docs, labels, 1000))
    trusted, raw = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)

    def cells(text):
        words = [w.encode() for w in brute.WORD.findall(text or "")]
        if not words:
            return []
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        hashes = textbytes.span_hashes(data, ends - [len(w) for w in words], ends)
        pairs = textbytes.mix(hashes[:-1] * np.uint64(3) + hashes[1:])
        return [int(h) % quality.BUCKETS for h in [*hashes, *pairs]]

    for doc_id, text, *_ in ROWS:
        for c in cells(text):
            raw[c] += 1
            trusted[c] += doc_id in good
    ratio = np.log((trusted + 1) / (trusted.sum() + quality.BUCKETS)) - np.log((raw + 1) / (raw.sum() + quality.BUCKETS))
    assert np.allclose(weight / 2 ** 24, ratio, atol=1e-6)
    want = multiset([(r[0], round(float(np.mean(ratio[cells(r[1])])) if cells(r[1]) else 0.0, 5)) for r in ROWS])
    got = multiset([(r["doc_id"], round(r["log_ratio"], 5)) for r in quality.quality_rules(docs, labels, 1000).collect()])
    assert [a[0] for a in want] == [b[0] for b in got]
    assert np.allclose([a[1] for a in want], [b[1] for b in got], atol=2e-5)


def test_simhash(docs):
    prints = [brute.fingerprint(r[1]) for r in ROWS]
    groups = brute.linked(prints, [r[0] for r in ROWS])
    want = multiset([(r[0], f"{p:016x}", g) for r, p, g in zip(ROWS, prints, groups)])
    assert answers(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want


def test_one_document_of_each_group_stays(docs):
    kept = simhash.survivors(docs)
    assert kept.columns == docs.columns
    prints, ids = [brute.fingerprint(r[1]) for r in ROWS], [r[0] for r in ROWS]
    least = dict(zip(brute.linked(prints, ids, roots=True), brute.linked(prints, ids)))
    assert answers(kept, "doc_id") == multiset([(d,) for d in least.values()])


def test_all_fingerprints_within_two_bits_are_linked(spark):
    rng = random.Random(2)
    bases = [rng.getrandbits(64) for _ in range(20)]
    prints = bases + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in bases for _ in range(6)]
    prints += [prints[-1] ^ 3, prints[-1] ^ 3 ^ 12, 0, 1, 7]
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    got = components.components(simhash.links(spark.createDataFrame([(p,) for p in signed], "bits bigint")))
    want = brute.linked([p % (1 << 64) for p in signed], signed)
    found = {r["node"]: r["component"] for r in got.collect()}
    assert [found.get(p, p) for p in signed] == want


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (None, 3), (9, 8), (9, 8)]
    got = components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {(r["node"], r["component"]) for r in got} == {(i, 0) for i in range(41)} | {(100 + i, 100) for i in range(30)}
    assert len(got) == 71
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_personal_data(docs):
    def want(text):
        found = brute.personal(text)
        names = list(brute.KINDS)
        line = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in found)
        return (*[sum(k == n for _, k, _ in found) for n in range(4)], brute.sha(line))

    out = personal_data.personal_data(docs)
    assert answers(out, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == expected(want)


def test_personal_data_is_masked_in_place(docs):
    out = personal_data.masked(docs)
    assert out.columns == docs.columns
    want = expected(lambda t: (brute.masked(t) if t is not None else None,))
    assert answers(out, "doc_id", "text") == want


def test_patterns_of_seeds_find_other_identifiers(spark):
    rows = [(i, f"notes here\nCard: 411111111111111{'1' if i % 8 else '2'} end") for i in range(90)]
    rows += [(200 + i, f"see 411111111111111{d} end") for i, d in enumerate("23456")]
    out = {r["doc_id"]: r["spans"] for r in personal_data.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(re.fullmatch(r"card:17:33", out[i]) for i in range(90) if i % 8)
    assert all(out[200 + i] == "" for i in range(5))


def test_seeds_are_linear_in_long_runs(spark):
    texts = ["1." * 60_000, "4 " * 60_000, "a" * 300_000, "9" * 300_000, "x@" + "b." * 60_000, "+1" + "(" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = personal_data.seeds(docs).select("doc_id", F.size("email"), F.size("ip"), F.size("card"), F.size("phone")).collect()
    assert sorted((tuple(r)[0], tuple(r)[1], tuple(r)[4]) for r in got) == [(i, int(i == 4), 0) for i in range(6)]


@pytest.mark.parametrize("crowd", [256, 1])
def test_suffix_dedup(docs, crowd):
    def units(text):
        return list((text or "").encode())

    want = []
    for row, (data, gone) in zip(ROWS, brute.repeated([r[1] for r in ROWS], units, 400)):
        starts = int((gone[1:] & ~gone[:-1]).sum()) + int(len(gone) and gone[0])
        want.append((row[0], len(data), int(gone.sum()), starts, brute.sha(bytes(b for b, g in zip(data, gone) if not g))))
    got = answers(suffix_dedup.digests(docs, crowd=crowd), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sum(w[2] for w in want) > 10_000
    assert got == multiset(want)


@pytest.mark.parametrize("crowd", [256, 1])
def test_phrase_dedup(docs, crowd):
    want, kept = [], []
    for row, (words, gone) in zip(ROWS, brute.repeated([r[1] for r in ROWS], lambda t: brute.WORD.findall(t or ""), 35)):
        rest = " ".join(w for w, g in zip(words, gone) if not g)
        want.append((row[0], len(words), int(gone.sum()), brute.sha(rest)))
        kept.append((row[0], rest))
    assert sum(w[2] for w in want) > 1000
    assert answers(phrase_dedup.digests(docs, crowd=crowd), "doc_id", "n_words", "n_removed", "kept_sha256") == multiset(want)
    if crowd == 1:
        assert answers(phrase_dedup.deduplicated(docs), "doc_id", "text") == multiset(kept)


def test_bytes_that_stay(docs):
    want = [(r[0], bytes(b for b, g in zip(d, gone) if not g)) for r, (d, gone) in zip(
        ROWS, brute.repeated([r[1] for r in ROWS], lambda t: list((t or "").encode()), 400))]
    got = [(r["doc_id"], bytes(r["kept"])) for r in suffix_dedup.deduplicated(docs).collect()]
    assert multiset(got) == multiset(want)


@pytest.mark.parametrize("seed", range(4))
def test_runs_cover_every_window_once_and_agree(seed, monkeypatch):
    monkeypatch.setattr(repeats, "STRIDE", 50)
    rng = np.random.default_rng(seed)
    units = rng.integers(0, 3, 700).astype(np.uint8)
    units[400:520] = units[100:220]
    offsets = np.array([0, 0, 130, 350, 351, 700])
    seen, bodies = [], {}
    for text, start, stop, key, body in repeats.runs_of(units, offsets, 20, 5):
        for t, a, b, k, h in zip(text, start, stop, key, body):
            seen += [(t, i) for i in range(a, b)]
            bodies.setdefault((k, h), set()).add(bytes(units[a:b - 1 + 20]))
    assert sorted(seen) == [(t, i) for t in range(5) for i in range(offsets[t], offsets[t + 1] - 19)]
    assert all(len(b) == 1 for b in bodies.values())


def test_fingerprints_of_edited_texts(docs):
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for i, row in enumerate(order):
        text, after = row[1] or "", order[(i + 1) % len(order)][1] or ""
        moved = len(text) // 4
        want.append((row[0], len(text), brute.sha(text[:len(text) - moved] + after[:moved])))
    out = sketches.compared(docs)
    assert answers(out, "doc_id", "n_chars", "edited_sha256") == multiset(want)
    by_text = {}
    for row in out.collect():
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
        by_text.setdefault(row["doc_id"], set()).add(row["fingerprint"])
    assert by_text[ROWS[7][0]] == by_text[ROWS[24][0]]


def test_sketches_estimate_and_merge(spark):
    rng = random.Random(1)
    words = [str(rng.random()) for _ in range(6000)]
    a, b = " ".join(words[:4000]), " ".join(words[1000:5000])
    x, y = sketches.sketch_all([a, b], 512)
    assert abs(sketches.resemblance(x, y, 512) - 0.6) < 0.08
    assert abs(sketches.containment(x, y, 512) - 0.75) < 0.1
    assert abs(sketches.distinct_count(x, 512) / 3996 - 1) < 0.15
    parts = spark.createDataFrame([(1, "g", a), (2, "g", b), (3, "h", "few words"), (4, "h", None)], "doc_id bigint, g string, text string")
    prints = sketches.fingerprints(parts).join(parts.select("doc_id", "g"), "doc_id")
    merged = {r["g"]: r["fingerprint"] for r in sketches.merge_parts(prints, ["g"]).collect()}
    x, y = sketches.sketch_all([a, b])
    assert merged["g"] == sketches.spelled(sketches.merged(x, y))
    assert len(merged["h"]) == 16


@pytest.mark.parametrize("size", [3, 400, 5000])
def test_smallest_equals_sorting(size):
    values = np.random.default_rng(size).integers(0, size, size).astype(np.uint64)
    assert (sketches.smallest(values, 16) == np.unique(values)[:16]).all()


def test_token_counts(docs):
    tokenizer = Tokenizer.from_file(WORDS)
    want = expected(lambda t: (len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)))
    out = token_counts.token_counts(docs, WORDS)
    assert answers(out, "doc_id", "n_bytes", "n_tokens") == want
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in out.collect())
    assert tuple(token_counts.total(out).first())[0] == len(ROWS)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(docs, reference):
    def want(text):
        ids = reference.encode_ordinary(text or "")
        return len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(text or "")

    out = byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN)
    assert answers(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected(want)
    encoded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert answers(byte_bpe.decode_ids(encoded, RANKS), "doc_id", "text") == expected(lambda t: (t or "",))
    assert all(r["intact"] for r in byte_bpe.encode_checked(docs, RANKS, public_tokenizers.PATTERN).collect())


def test_matrix_and_heap_merge_alike(reference):
    words, rng = byte_bpe.vocabulary(RANKS), random.Random(3)
    pieces = ["".join(rng.choices("aaabenthing's é中", k=rng.randint(1, 60))).encode() for _ in range(400)]
    got = byte_bpe.encode_pieces(words, pieces)
    for piece, ids in zip(pieces, got):
        whole = words.ranks.get(piece)
        assert list(ids) == ([whole] if whole is not None else byte_bpe.merge_long(words, piece))
    for text in ("e" * 3000, "thing" * 500):
        assert list(byte_bpe.encode_pieces(words, [text.encode()])[0]) == reference.encode_ordinary(text)


def test_toxicity_scores(docs, labels):
    lexicon = toxicity.Lexicon({"stup": 5.0, "idiot": 6.0, "moro": 6.0, "worthless": 4.0}, ("stupid mistake",), 4.0, -6.0)
    rows = toxicity.scores(docs, lexicon).collect()
    assert len(rows) == len(ROWS)
    for row in rows:
        assert row["held_out"] == (row["doc_id"] is None or zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0)
        assert 0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= 0.5)
    assert {r["doc_id"] for r in rows if r["predicted"]} == {ROWS[21][0]}
    clean = toxicity.accepted(docs, lexicon)
    assert clean.columns == docs.columns and clean.count() == len(ROWS) - 1
    found = lexicon.automaton()
    assert toxicity.matches(found, toxicity.fold("a stupid mistake")) == []
    assert len(toxicity.matches(found, toxicity.fold("ѕtup1d $tupid 5tup​id"))) == 3


def test_toxicity_is_learnt_and_holds_out(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(200)]
    rows = []
    for i in range(900):
        text = rng.choices(words, k=60)
        toxic = int(i % 6 == 0)
        if toxic:
            for _ in range(3):
                text[rng.randrange(60)] = rng.choice(["zorfal", "zorfan", "quimto"]) + rng.choice("xyz")
        rows.append((i, " ".join(text), toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    lexicon = toxicity.learn(docs, labels)
    assert any("zorf".startswith(t) or t.startswith("zorf") for t in lexicon.terms)
    held = [r for r in toxicity.scores(docs, lexicon).collect() if r["held_out"]]
    assert len(held) > 100
    assert all(r["predicted"] == rows[r["doc_id"]][2] for r in held)


def test_toxicity_without_labels(docs, spark):
    none = toxicity.learn(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert none.terms == {}
    assert len({r["score"] for r in toxicity.scores(docs, none).collect()}) == 1


def test_mixing_repeats_by_poisson(docs):
    rates = mixing.source_rates(docs, 0.5, 3.0)
    out = mixing.mixed(docs, rates, 4)
    assert out.columns == [c for c in docs.columns if c not in mixing.OUT] + list(mixing.OUT)
    import hashlib
    import math

    sizes = {}
    for r in ROWS:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").encode())
    weights = {s: math.floor(math.sqrt(n) * 1000) for s, n in sizes.items()}
    want = []
    for r in ROWS:
        mean = 3.0 * sum(sizes.values()) * weights[r[3]] / (sum(weights.values()) * sizes[r[3]])
        parts, count = math.ceil(mean / mixing.PART), 0
        for i in range(1, parts + 1):
            name = "" if r[0] is None else str(r[0])
            u = (int(hashlib.md5(f"4|{name}|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
            term = total = math.exp(-mean / parts)
            k = 0
            while total < u:
                k += 1
                term *= mean / parts / k
                total += term
            count += k
        want += [(r[0], r[1], c) for c in range(count)]
    assert answers(out, "doc_id", "text", "copy_no") == multiset(want)


def test_mixing_reaches_large_means_and_given_weights(spark):
    docs = spark.createDataFrame([(i, "x" * 10, "rare" if i == 0 else "common") for i in range(500)], "doc_id bigint, text string, source string")
    rates = mixing.given_rates(docs, {"rare": 1.0, "common": 1.0}, 2.0)
    assert {r["mix_source"]: round(r["mean"], 6) for r in rates.collect()} == {"rare": 500.0, "common": round(500 / 499, 6)}
    counts = {r["source"]: r["count"] for r in mixing.mixed(docs, rates).groupBy("source").count().collect()}
    assert 380 < counts["rare"] < 620 and 400 < counts["common"] < 600


def test_no_rows(nothing, labels):
    assert quality.quality_rules(nothing, labels).count() == 0
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.survivors(nothing).count() == 0
    assert personal_data.personal_data(nothing).count() == 0
    assert personal_data.masked(nothing).count() == 0
    assert suffix_dedup.digests(nothing).count() == 0
    assert phrase_dedup.digests(nothing).count() == 0
    assert sketches.compared(nothing).count() == 0
    assert toxicity.scores(nothing, toxicity.learn(nothing, labels)).count() == 0
    assert token_counts.token_counts(nothing, WORDS).count() == 0
    assert byte_bpe.round_trip(nothing, RANKS, public_tokenizers.PATTERN).count() == 0
    assert mixing.mixed(nothing, mixing.source_rates(nothing, 0.5, 1.0)).count() == 0


def test_native_operators_run_no_python(docs, plan_of):
    for df in (personal_data.personal_data(docs), personal_data.masked(docs), mixing.mixed(docs, mixing.source_rates(docs, 0.5, 1.0))):
        assert not re.search("Python|Pandas|Arrow", plan_of(df))


def test_subpackage_stands_alone():
    assert importlib.util.find_spec("spokeworks.llm")


def test_spaced_identifiers_that_no_seed_covers_are_found(spark):
    digits = lambda i, n: f"{i * 7919 + 10 ** (n - 1)}"[:n]
    phones = [f"+1 ({digits(i, 3)}) 555-{digits(i * 3, 4)}" for i in range(40)]
    cards = [f"{n[:4]} {n[4:8]} {n[8:12]} {n[12:]}" for n in (str(4 * 10 ** 15 + i * 104729) for i in range(900))]
    luhn = lambda c: brute.personal(c)
    good, bad = [c for c in cards if luhn(c)], [c for c in cards if not luhn(c)]
    assert len(good) > 60
    rows = [f"ask me 12\nPhone: {p} soon" for p in phones] + [f"paid by Card: {c}, thanks" for c in good]
    first = len(rows)
    rows += ["Phone: +1 (017) 55-77 soon", f"ask Card: {bad[0]}, thanks", "Card: 12 items", f"see {bad[1]} here"]
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    out = {r["doc_id"]: r["spans"] for r in personal_data.personal_data(table).collect()}
    assert [out[first + i] for i in range(4)] == ["phone:7:21", "card:10:29", "", ""]
    hidden = {r["doc_id"]: r["text"] for r in personal_data.masked(table).collect()}
    assert hidden[first] == "Phone: [PHONE] soon" and hidden[first + 1] == "ask Card: [CARD], thanks"
