"""Personal data by bootstrapped contextual extraction, in DataFrame operations alone.

Seed entities are e-mail addresses, IP addresses, payment cards and phone numbers found by pattern and
checked. Instances are the seeds, seeds with what is glued to them, and whole runs of adjacent words with a
digit or an @ that no seed touches; the word before an instance in the full text (``^`` at its beginning), with
the shape of the instance, is its lexical pattern. Patterns and instances form a graph that is scored until
nothing changes: a pattern is as good as the share of its instances that are trusted, and an instance is trusted
as far as the best pattern that has it. Patterns with ``SUPPORT`` trusted instances and a share of ``TRUST`` mark
the runs that no seed touches, and single words of runs that are not marked whole.

Positions come from the texts between matches, which ``split`` gives; patterns are possessive and start
where a run starts, so their time is linear in the text and no repetition recurses.

Defined results: null and empty texts have no spans; null ids are ids like others; rows equal in id and text
get equal spans; columns other than doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spokeworks.llm import shared

_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: Sum of digits from the right, every second one doubled.
_DIGITS = "translate(x.m, ' -', '')"
_LUHN = (f"aggregate(sequence(1, length({_DIGITS})), 0, (s, i) -> s + element_at(if(i % 2 = 0, "
         "array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), array(0, 1, 2, 3, 4, 5, 6, 7, 8, 9)), "
         f"1 + cast(substr(reverse({_DIGITS}), i, 1) AS int))) % 10 = 0")
#: Kinds in the order of the contract: pattern, a sign that a text may match, and the check of a match x.m.
KINDS = {
    "email": (rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++", "instr(text, '@') > 0", "true"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", "text RLIKE '[0-9][.][0-9]'",
           "forall(split(x.m, '[.]'), p -> length(ltrim('0', p)) <= 3"
           " AND coalesce(try_cast(ltrim('0', p) AS int), 0) <= 255)"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "text RLIKE '[0-9][ -]?[0-9]'",
             f"CASE WHEN length({_DIGITS}) BETWEEN 12 AND 19 THEN {_LUHN} ELSE false END"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "instr(text, '+') > 0",
              "length(regexp_replace(x.m, '[^0-9]', '')) BETWEEN 9 AND 15"),
}
#: A word with a digit or an @.
_WORD = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Adjacent words with a digit or an @.
_RUN = rf"{_WORD}(?:\s++[^\s0-9@]*+[0-9@]\S*+)*+"

SUPPORT, TRUST = 5, 0.9
_NO_SPANS = "cast(array() AS array<struct<start:int,kind:int,end:int>>)"


def _literal(pattern: str) -> str:
    return pattern.replace("\\", "\\\\")


_NO_MATCH = "cast(array() AS array<struct<start:int,end:int,m:string,before:string>>)"


def _placed(pattern: str, when: str) -> str:
    """SQL for all matches as structs of start, end (exclusive), the match m and what stands before it."""
    rx = _literal(pattern)
    return (f"CASE WHEN {when} THEN aggregate("
            f"zip_with(regexp_extract_all(text, '{rx}', 0), split(text, '{rx}'), (m, b) -> named_struct('m', m, 'b', b)), "
            f"named_struct('at', 0, 'all', {_NO_MATCH}), (s, x) -> IF(x.m IS NULL, s, named_struct("
            "'at', s.at + length(x.b) + length(x.m), 'all', concat(s.all, array(named_struct("
            "'start', s.at + length(x.b), 'end', s.at + length(x.b) + length(x.m), 'm', x.m, 'before', right(x.b, 64)))))), "
            f"s -> s.all) ELSE {_NO_MATCH} END")


def seeds(texts: DataFrame) -> DataFrame:
    """Adds one array of (start, kind, end) per kind, named as the kind; ``text`` must be there."""
    for number, (kind, (pattern, when, valid)) in enumerate(KINDS.items()):
        texts = texts.withColumn(kind, F.expr(
            f"transform(filter({_placed(pattern, when)}, x -> {valid}), "
            f"x -> named_struct('start', x.start, 'kind', {number}, 'end', x.end))"))
    return texts


def spelled(spans: str) -> str:
    """SQL for spans as kind:start:end, by start and then kind."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return (f"array_join(transform(array_sort({spans}), "
            f"x -> concat(element_at(array({names}), x.kind + 1), ':', x.start, ':', x.end)), ',')")


def _shape(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '[0-9]+', '9'), '[A-Za-z]+', 'a')"


def _left(before: str) -> str:
    """SQL for the last word of a text, at most its last 40 characters; ^ where there is none."""
    word = f"regexp_extract({before}, '(\\\\S{{1,40}})\\\\s*+$', 1)"
    return f"regexp_replace(lower(IF({word} = '', '^', {word})), '[0-9]', '9')"


def _trimmed(found: str) -> str:
    """SQL for matches without the punctuation that ends them."""
    bare = "regexp_replace(x.m, '(?<![,;:.!?])[,;:.!?]++$', '')"
    return (f"transform({found}, x -> named_struct('start', x.start, 'end', x.start + length({bare}), 'm', {bare}, "
            "'before', x.before))")


def candidates(texts: DataFrame) -> DataFrame:
    """Adds ``words``, what may be identifiers: place, text, pattern, kind and role.

    The role is 0 for instances of the graph and 1 for single words in a run of several, which may only be
    marked. The kind is that of the seed, null where no seed touches the place.
    """
    when = "text RLIKE '[0-9@]'"
    spans = f"concat({', '.join(KINDS)})"
    touching = "filter(spans, s -> s.start < x.end AND s.end > x.start)"
    texts = (texts.withColumn("spans", F.expr(spans)).withColumn("runs", F.expr(_trimmed(_placed(_RUN, when))))
             .withColumn("parts", F.expr(_trimmed(_placed(_WORD, when)))))
    own = (f"transform(spans, s -> named_struct('start', s.start, 'end', s.end, "
           "'m', substring(text, s.start + 1, s.end - s.start), "
           "'before', substring(text, greatest(1, s.start - 127), least(128, s.start)), 'kind', s.kind, 'role', 0))")
    # a word right after another one with a digit has it on its left
    words = ("transform(parts, (x, i) -> named_struct('start', x.start, 'end', x.end, 'm', x.m, 'before', "
             "IF(i > 0 AND x.before NOT RLIKE '\\\\S', get(parts, i - 1).m, x.before)))")
    glued = ("s.start >= x.start AND s.end <= x.end AND substring(x.m, 1, s.start - x.start) NOT RLIKE '\\\\s' "
             "AND substring(x.m, s.end - x.start + 1) NOT RLIKE '\\\\s'")

    def placed(role: int, x: str = "x") -> str:
        return (f"named_struct('start', {x}.start, 'end', {x}.end, 'm', {x}.m, 'before', {x}.before, "
                f"'kind', get(filter({touching}, s -> {glued}), 0).kind, 'role', {role})")

    free = f"NOT exists(spans, s -> s.start < x.end AND s.end > x.start)"
    holds = f"exists(spans, s -> {glued})"
    texts = (texts.withColumn("parts", F.expr(words))
             .withColumn("own", F.expr(own))
             .withColumn("whole", F.expr(f"transform(filter(runs, x -> {free} OR {holds}), x -> {placed(0)})"))
             .withColumn("held", F.expr(f"transform(filter(parts, x -> {holds}), x -> {placed(0)})"))
             .withColumn("single", F.expr(
                 f"transform(filter(parts, x -> {free} AND NOT exists(runs, r -> r.start = x.start AND r.end = x.end)), "
                 f"x -> {placed(1)})")))
    shaped = (f"named_struct('start', x.start, 'end', x.end, 'word', x.m, 'kind', x.kind, 'role', x.role, "
              f"'pattern', concat({_left('x.before')}, ' ', {_shape('x.m')}))")
    return (texts.withColumn("words", F.expr(f"array_distinct(transform(concat(own, whole, held, single), x -> {shaped}))"))
            .drop("spans", "runs", "parts", "own", "whole", "held", "single"))


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, content, email, ip, card, phone, words) of every document, without its text."""
    texts = shared.keyed(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return candidates(seeds(texts)).withColumn("content", F.xxhash64("text")).drop("text")


def graph(found: DataFrame) -> DataFrame:
    """(pattern, word, kind, n): edges of instances; kind is that of the seed, null where none touches the word."""
    return (found.select(F.explode(F.expr("filter(words, w -> w.role = 0)")).alias("e"))
            .groupBy("e.pattern", "e.word", "e.kind").agg(F.count("*").alias("n")))


def scored_patterns(edges: DataFrame, support: int = SUPPORT, trust: float = TRUST) -> DataFrame:
    """(pattern, kind) of high confidence, after scoring patterns by instances and back until nothing changes."""
    words = edges.groupBy("pattern", "word").agg(F.max("kind").alias("kind"))
    trusted = words.filter("kind IS NOT NULL").groupBy("word", "kind").agg(F.lit(1.0).alias("score"))
    everything = words.groupBy("pattern").agg(F.count("*").alias("instances"))
    state = None
    while True:
        sums = (words.select("pattern", "word").join(trusted, "word").groupBy("pattern", "kind")
                .agg(F.sum("score").alias("weight"), F.count("*").alias("seen")))
        patterns = shared.written(
            sums.join(everything, "pattern").withColumn("score", F.round(F.col("weight") / F.col("instances"), 6))
            .filter((F.col("seen") >= support) & (F.col("score") >= trust)).select("pattern", "kind", "score"), "pii-patterns")
        now = tuple(patterns.agg(F.count("*"), F.sum(F.xxhash64("pattern", "kind", "score").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state = now
        learnt = (words.select("pattern", "word").join(patterns, "pattern").groupBy("word", "kind")
                  .agg(F.max("score").alias("score")))
        trusted = shared.written(trusted.unionByName(learnt).groupBy("word", "kind")
                                 .agg(F.max("score").alias("score")), "pii-instances")
    best = patterns.groupBy("pattern").agg(F.max(F.struct("score", F.negate("kind").alias("kind"))).alias("best"))
    return best.select("pattern", F.negate("best.kind").alias("kind"))


def discovered(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, content, added): places in trusted patterns that no seed touches, without those inside another."""
    loose = found.select("doc_id", "content", F.explode(F.expr("filter(words, w -> w.kind IS NULL)")).alias("w")).distinct()
    return (loose.join(patterns, loose["w.pattern"] == patterns["pattern"])
            .groupBy("doc_id", "content").agg(F.collect_list(F.struct(
                F.col("w.start").alias("start"), F.col("kind").cast("int").alias("kind"), F.col("w.end").alias("end"))).alias("added"))
            .select(F.col("doc_id").alias("added_id"), F.col("content").alias("added_content"), F.expr(
                "filter(added, x -> NOT exists(added, y -> y.start <= x.start AND y.end >= x.end"
                " AND y.end - y.start > x.end - x.start))").alias("added")))


def extracted(docs: DataFrame) -> DataFrame:
    """(doc_id, content, email, ip, card, phone, added): seeds and discovered spans of every document."""
    found = shared.written(marked(docs), "pii-marked")
    patterns = scored_patterns(shared.written(graph(found), "pii-graph"))
    added = discovered(found, patterns)
    same = found["doc_id"].eqNullSafe(added["added_id"]) & (found["content"] == added["added_content"])
    return found.join(added, same, "left").select(
        "doc_id", "content", *KINDS, F.coalesce("added", F.expr(_NO_SPANS)).alias("added"))


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts of the seeds by kind, their digest, and all spans of every document."""
    base, every = f"concat({', '.join(KINDS)})", f"concat({', '.join(KINDS)}, added)"
    return extracted(docs).select(
        "doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.expr(spelled(base)), 256).alias("base_sha256"), F.expr(spelled(every)).alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by [EMAIL], [IP], [CARD] or [PHONE], and ``n_chars`` made to fit.

    Spans that overlap are replaced as one, under the kind of the first. Other columns stay as they are.
    """
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    text, content, mine, hashed, spans = (
        shared.fresh(docs.columns, n) for n in ("plain", "content_key", "span_id", "span_content", "spans"))
    every = (extracted(docs).withColumn("spans", F.expr(f"array_sort(concat({', '.join(KINDS)}, added))"))
             .filter("size(spans) > 0").groupBy("doc_id", "content").agg(F.first("spans").alias("spans"))
             .select(F.col("doc_id").alias(mine), F.col("content").alias(hashed), F.col("spans").alias(spans)))
    plain = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn(text, plain).withColumn(content, F.xxhash64(text))
    same = rows["doc_id"].cast("bigint").eqNullSafe(every[mine]) & (rows[content] == every[hashed])
    cut = F.expr(
        f"aggregate({spans}, named_struct('at', 0, 'out', cast(array() AS array<string>)), (s, x) -> CASE "
        f"WHEN x.start >= s.at THEN named_struct('at', x.end, 'out', concat(s.out, array(substring({text}, s.at + 1, x.start - s.at), "
        f"element_at(array({names}), x.kind + 1)))) WHEN x.end > s.at THEN named_struct('at', x.end, 'out', s.out) ELSE s END, "
        f"s -> concat(array_join(s.out, ''), substring({text}, s.at + 1)))")
    joined = rows.join(every, same, "left")
    hidden = F.when(F.col(spans).isNull(), F.col("text")).otherwise(cut)
    out = joined.withColumn("text", hidden)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(
            F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
