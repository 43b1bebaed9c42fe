"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding disguises.

Texts are lower-cased and homoglyphs and digits that stand for letters are folded back. Terms match at
the beginning of a word. The lexicon, its weights and its exception phrases are learnt from labelled
documents: terms by the log odds of the documents that hold them, exceptions as words next to a term that
only occur in clean documents. The score is the weight found per logarithm of the length, through a
logistic curve fitted on the same rows.

Fitting uses at most ``most`` labelled documents, chosen by the hash of their ids; every document is scored,
over its whole text. Defined results: null and empty texts score like any text without a match; null ids
have no fold and are held out of learning; ties and repeated rows get equal scores; with no label there are
no terms and every score is the prior; columns other than doc_id and text are ignored; empty in, empty out.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spokeworks.llm import shared, sketches, textbytes

#: Letters of other scripts that look like Latin ones, and digits and signs used for letters.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j",
              "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i",
              "κ": "k", "τ": "t", "υ": "u", "ｅ": "e", "ａ": "a", "ｏ": "o"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
_FOLDED = str.maketrans(HOMOGLYPHS | DIGITS | {c: "" for c in "​‌‍­﻿"})
_SIGNS = re.compile(r"[@$](?=[^\W\d_])")
_GAPS = re.compile(r"[\W_]+")

#: Letters of the shortest and longest term, and documents that must hold one.
SHORTEST, LONGEST, FOUND_IN = 4, 12, 3
#: Least log odds of a term, least product of odds and toxic documents, and most terms kept.
LEAST_ODDS, LEAST_WEIGHT, MOST_TERMS = 3.0, 20.0, 4000
#: Bins of the document feature that the curve is fitted on.
BINS = 400


def fold(text: str | None) -> str:
    """Words in folded letters, each after one space."""
    text = _SIGNS.sub(lambda m: {"@": "a", "$": "s"}[m.group()], (text or "").lower().translate(_FOLDED))
    return " " + _GAPS.sub(" ", text).strip() + " "


@dataclass(frozen=True)
class Lexicon:
    terms: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    slope: float = 0.0
    intercept: float = -2.0

    def automaton(self):
        found = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            found.add_word(" " + term, (len(term) + 1, weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(found):
            found.make_automaton()
        return found


def matches(found, folded: str) -> list[tuple[int, float]]:
    """(end of match, weight) of the terms outside exception phrases; the heaviest at each word start."""
    if not len(found):
        return []
    starts: dict[int, float] = {}
    excused = []
    for end, (size, weight) in found.iter(folded):
        start = end - size + 1
        if weight is None:
            excused.append((start, end))
        else:
            starts[start] = max(weight, starts.get(start, -math.inf))
    if not excused:
        return list(starts.items())
    begins, ends = zip(*sorted(excused))
    reach = list(itertools.accumulate(ends, max))  # the furthest end of all that begin no later
    at = lambda s: bisect.bisect_right(begins, s)
    return [(s, w) for s, w in starts.items() if at(s) == 0 or reach[at(s) - 1] <= s]


def feature(found, text: str | None) -> float:
    """Weight found, over the logarithm of the number of words."""
    folded = fold(text)
    return sum(w for _, w in matches(found, folded)) / math.log2(4 + folded.count(" "))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learning_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, text, toxic) of at most ``most`` labelled documents outside the held-out fold."""
    chosen = (labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
              .select(F.col("doc_id").cast("bigint").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
              .filter(~held_out(F.col("label_id"))).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("label_id"), "label_id").limit(most))
    rows = (shared.keyed(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
            .select("doc_id", "text", "toxic"))
    # Copies and near copies mostly share their smallest shingle; one of them counts, else its words would.
    return (shared.arrow_map(rows, _with_twin, TWINS).filter("twin IS NOT NULL").dropDuplicates(["twin", "toxic"])
            .select("doc_id", "text", "toxic"))


TWINS = "doc_id bigint, text string, toxic int, twin bigint"


def _with_twin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in textbytes.slices(batches, "text"):
        least = sketches.sketch_all([t or "" for t in part.column("text").to_pylist()], 1)
        yield shared.batch(TWINS, [part.column("doc_id"), part.column("text"), part.column("toxic"),
                                   [int(s.view(np.int64)[0]) if len(s) else None for s in least]])


STEMS = "stem string, n_toxic bigint, n_clean bigint"
NEIGHBOURS = "phrase string, n_toxic bigint, n_clean bigint"
BINNED = "bin int, n_toxic bigint, n_clean bigint"


def _tallied(batches: Iterator[pa.RecordBatch], schema: str, of_text) -> Iterator[pa.RecordBatch]:
    """Documents of either label that hold each item; given out whenever many items have gathered."""
    counts = (Counter(), Counter())

    def given():
        items = list(set(counts[0]) | set(counts[1]))
        return shared.batch(schema, [items, [counts[1][i] for i in items], [counts[0][i] for i in items]])

    for part in textbytes.slices(batches, "text"):
        for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
            counts[1 if toxic else 0].update(of_text(text))
        if len(counts[0]) + len(counts[1]) > 400_000:
            yield given()
            counts = (Counter(), Counter())
    yield given()


def _stems(text: str | None) -> set[str]:
    found = set()
    for word in set(fold(text).split()):
        found.update(word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1))
    return found


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _tallied(batches, STEMS, _stems)


def _neighbour_counts(lexicon: Lexicon):
    found = lexicon.automaton()

    def phrases(text: str | None) -> set[str]:
        folded, near = fold(text), set()
        for start, _ in matches(found, folded):
            stop = folded.index(" ", start + 1)
            before, after = folded.rfind(" ", 0, start), folded.find(" ", stop + 1)
            if before >= 0 and folded[before + 1:start]:
                near.add(folded[before + 1:stop])
            if after >= 0:
                near.add(folded[start + 1:after])
        return near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _tallied(batches, NEIGHBOURS, phrases)

    return run


def _bin_counts(lexicon: Lexicon, width: float):
    found = lexicon.automaton()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _tallied(batches, BINNED, lambda t: [max(-1, min(BINS - 1, math.ceil(feature(found, t) / width)))])

    return run


def _summed(rows: DataFrame, function, schema: str) -> DataFrame:
    item = schema.split()[0]
    return (shared.arrow_map(rows, function, schema).groupBy(item)
            .agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean")))


def learn(docs: DataFrame, labels: DataFrame, most: int = 30_000, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Terms, exception phrases and the curve; what reaches the driver is bounded by the constants above."""
    rows = shared.written(learning_rows(docs, labels, most), "toxic-learning")
    size = rows.groupBy().agg(F.sum("toxic").alias("n"), F.sum(1 - F.col("toxic")).alias("m")).first()
    toxic, clean = size["n"] or 0, size["m"] or 0
    if not toxic or not clean:
        return Lexicon(exceptions=tuple(exceptions), intercept=math.log((toxic + 0.5) / (clean + 0.5)))
    odds = F.log((F.col("n_toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("n_clean") + 0.5) / (clean + 1.0))
    ranked = (_summed(rows, _stem_counts, STEMS).filter(F.col("n_toxic") >= FOUND_IN).withColumn("odds", odds)
              .filter((F.col("odds") >= LEAST_ODDS) & (F.col("odds") * F.col("n_toxic") >= LEAST_WEIGHT))
              .orderBy(F.desc(F.col("odds") * F.sqrt("n_toxic")), F.length("stem"), "stem").limit(MOST_TERMS))
    lexicon = Lexicon(terms=_shortest({r["stem"]: (r["odds"], r["n_toxic"]) for r in ranked.collect()}))
    clean_only = (_summed(rows, _neighbour_counts(lexicon), NEIGHBOURS)
                  .filter(f"n_toxic = 0 AND n_clean >= {FOUND_IN}").orderBy(F.desc("n_clean"), "phrase").limit(MOST_TERMS))
    lexicon = Lexicon(lexicon.terms, tuple(exceptions) + tuple(r["phrase"] for r in clean_only.collect()))
    width = 10.0 / BINS
    bins = _summed(rows, _bin_counts(lexicon, width), BINNED).collect()
    slope, intercept = _curve([(r["bin"] * width, r["n_toxic"], r["n_clean"]) for r in bins])
    return Lexicon(lexicon.terms, lexicon.exceptions, slope, intercept)


def _shortest(found: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Drops a stem when a shorter one of it tells as much."""
    kept: dict[str, float] = {}
    for stem in sorted(found, key=lambda s: (len(s), s)):
        above = [kept[stem[:n]] for n in range(SHORTEST, len(stem)) if stem[:n] in kept]
        if not above or found[stem][0] > max(above) + 1.0:
            kept[stem] = found[stem][0]
    return kept


def _curve(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and intercept of a logistic fit to counted bins, by Newton steps with a light ridge."""
    x = np.array([p[0] for p in points])
    pos, neg = np.array([p[1] for p in points], float), np.array([p[2] for p in points], float)
    theta = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], axis=1)
    ridge = np.diag([0.05, 0.01])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (pos - (pos + neg) * p) - ridge @ theta
        curvature = (design * ((pos + neg) * p * (1 - p))[:, None]).T @ design + ridge
        theta = theta + np.clip(np.linalg.solve(curvature, gradient), -2, 2)
    return float(theta[0]), float(theta[1])


def score_of(lexicon: Lexicon, folded: str, here: list[tuple[int, float]]) -> float:
    value = sum(w for _, w in here) / math.log2(4 + folded.count(" "))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, lexicon.slope * value + lexicon.intercept))))


SCORES = "doc_id bigint, score double, n_hits bigint"


def _scored(lexicon: Lexicon):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = lexicon.automaton()
        for part in textbytes.slices(batches, "text"):
            scores, hits = [], []
            for text in part.column("text").to_pylist():
                folded = fold(text)
                here = matches(found, folded)
                scores.append(score_of(lexicon, folded, here))
                hits.append(len(here))
            yield shared.batch(SCORES, [part.column("doc_id"), scores, hits])

    return score


def scores(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score, predicted and the number of matches of every document."""
    scored = shared.arrow_map(shared.keyed(docs), _scored(lexicon), SCORES)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits")


def accepted(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The documents, with all their columns, that score below one half."""
    shared.ship_package(docs.sparkSession)

    @F.arrow_udf("boolean")
    def toxic(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found = lexicon.automaton()
        for texts in batches:
            out: list[bool] = []
            for part in textbytes.slices([pa.RecordBatch.from_arrays([texts], ["text"])], "text"):
                folded = map(fold, part.column("text").to_pylist())
                out += [score_of(lexicon, f, matches(found, f)) >= 0.5 for f in folded]
            yield pa.array(out, pa.bool_())

    return docs.filter(~toxic(F.col("text").cast("string")))
