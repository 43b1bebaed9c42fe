"""Every stage of the pipeline against a plain restatement over what its predecessor kept."""

import base64
import collections
import hashlib
import math
import random

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as pipeline
import llm_brute as brute
from spokeworks.llm import mixing, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string"


def corpus():
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 7))) for _ in range(400)]
    prose = lambda n: rng.choices(words, k=n)
    rows = []
    for i in range(260):
        text = prose(rng.randint(30, 90))
        if i % 5 == 0:
            for _ in range(4):
                text[rng.randrange(len(text))] = rng.choice(["grumbol", "grumbats", "1mbecyl"])
        if i % 4 == 0:
            text[3] = rng.choice(["jo.e@mail.example.org", "10.20.30.40", "4111-1111-1111-1111", "+44 20 7946 0958"])
        rows.append((i, " ".join(text), "en", f"s{i % 7 % 3}", None, "x"))
    copies = [(300 + i, rows[7][1] + " end" * (i % 2), "en", "s0", 5, None) for i in range(9)]
    odd = [(400, None, None, None, None, None), (401, "", "en", "s1", 0, "y"), (None, "no id " + " ".join(prose(20)), "en", None, 1, "z"),
           (402, " ".join(prose(4000)), "de", "s2", 1, "z"), rows[9], rows[9]]
    return rows + copies + odd


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], int(r[0] % 5 != 2), int(r[0] % 5 == 0)) for r in rows[:260]]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def steps(spark, folder, tmp_path_factory):
    """What each stage was given and what it returned, as rows."""
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name)) + "/out"
        stage(spark, docs, folder).write.parquet(path)
        after = spark.read.parquet(path)
        seen.append((docs.columns, [tuple(r) for r in docs.collect()], after.columns, [tuple(r) for r in after.collect()]))
        docs = after
    return seen


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_all_but_the_last_return_the_columns_of_documents(steps):
    assert all(after == before for before, _, after, _ in steps[:-1])


def test_toxic_documents_go_and_clean_ones_stay(spark, folder, steps):
    _, given, _, kept = steps[0]
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.learn(docs, labels)
    terms = {t: w for t, w in lexicon.terms.items()}

    def score(text):
        folded = toxicity.fold(text)
        heaviest = [max([w for t, w in terms.items() if word.startswith(t)], default=0) for word in folded.split()]
        value = sum(heaviest) / math.log2(4 + folded.count(" "))
        return 1 / (1 + math.exp(-(lexicon.slope * value + lexicon.intercept)))

    same(kept, [r for r in given if score(r[1]) < 0.5])
    ids = {r[0] for r in kept}
    assert not ids & {i for i in range(260) if i % 5 == 0}
    assert {r[0] for r in given if r[0] is None or r[0] % 5 or r[0] >= 300} <= ids


def test_one_document_of_each_group_stays(steps):
    _, given, _, kept = steps[1]
    prints, ids = [brute.fingerprint(r[1]) for r in given], [r[0] for r in given]
    least = dict(zip(brute.linked(prints, ids, roots=True), brute.linked(prints, ids)))
    assert collections.Counter(r[0] for r in kept) == collections.Counter(least.values())
    assert set(kept) <= set(given)


def test_personal_data_is_masked(steps):
    _, given, _, kept = steps[2]
    want = []
    for r in given:
        text = brute.masked(r[1]) if r[1] is not None else None
        want.append((r[0], text, *r[2:4], r[4] if text == r[1] else len(text), r[5]))
    same(kept, want)
    assert any("[CARD]" in (r[1] or "") for r in kept)


def test_sources_are_repeated_to_their_weights(steps):
    _, given, _, kept = steps[3]
    sizes = collections.Counter()
    for r in given:
        sizes[r[3]] += len((r[1] or "").encode())
    weights = {s: math.floor(math.pow(n, pipeline.MIX_ALPHA) * 1000) for s, n in sizes.items() if n}
    want = []
    for r in given:
        mean = pipeline.MIX_EPOCHS * sum(sizes.values()) * weights.get(r[3], 0) / (sum(weights.values()) * (sizes[r[3]] or 1))
        parts = math.ceil(mean / mixing.PART)
        for i in range(1, parts + 1):
            name = "" if r[0] is None else str(r[0])
            u = (int(hashlib.md5(f"{pipeline.MIX_SEED}|{name}|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
            term = total = math.exp(-mean / parts)
            k = 0
            while total < u:
                k += 1
                term *= mean / parts / k
                total += term
            want += [r] * k
    same(kept, want)


def test_documents_are_encoded(steps):
    _, given, columns, kept = steps[4]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert columns == ["doc_id", "n_tokens", "ids", "intact"]
    want = [(r[0], ids) for r in given for ids in [reference.encode_ordinary(r[1] or "")]]
    same([(r[0], list(r[2])) for r in kept], want)
    assert all(r[3] and r[1] == len(r[2]) for r in kept)


def test_run_applies_all_stages(spark, folder, steps):
    same([(r["doc_id"], r["n_tokens"]) for r in pipeline.run(spark, folder).collect()], [(r[0], r[1]) for r in steps[-1][3]])


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
