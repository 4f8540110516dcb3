"""Guards over tables of drafted answers, joined to the hits they were drafted from; citations and decisions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundspark.functions.text import content_tokens, let
from groundspark.functions.vectors import hash_embedding
from groundspark.operators.vectors import unit_rows
from groundspark.sources.scratch import written

# Phrases of refusals and of editorial openers.
REFUSAL_OPENERS = ["i don't know", "i do not know", "i cannot answer", "i can't answer", "i am unable to answer", "i'm unable to answer"]
REFUSAL_STRONG = [
    "i do not know", "i don't know", "do not have enough", "don't have enough", "not enough information",
    "no information about", "i am unable to answer", "i'm unable to answer", "i am not able to answer",
    "i'm not able to answer",
]
REFUSAL_WEAK = [
    "does not contain", "doesn't contain", "could not find", "couldn't find", "cannot answer", "can't answer",
    "unable to answer", "not able to answer", "no mention of", "is not mentioned",
]
REFUSAL_ANCHORS = [
    "the source", "the sources", "the context", "the provided", "provided context", "knowledge base",
    "the document", "the documents", "the passage", "the passages", "available information", "information about",
    "any information", "enough information", "the information provided", "this question", "the question",
]
HEDGES = ["unfortunately,", "unfortunately ", "i'm sorry,", "i am sorry,", "sorry,", "sorry ", "hmm,", "hmm ", "well,"]
EDITORIAL_OPENERS = [
    "based on the provided context sources,", "based on the provided context source,", "based on the provided context,",
    "based on the context provided,", "based on the provided context", "based on the context,",
    "according to the provided context,", "according to the context,", "based on the information provided,",
    "from the provided context,", "based on the sources provided,", "based on the given context,",
]
ABBREVIATIONS = ["e.g", "i.e", "etc", "a.k.a", "p.m", "a.m", "u.s", "u.s.a"]
# Patterns of identifiers, numbers, code, headings of sources, and of what is tidied, in the order of tidying.
URI = r"(?:[A-Za-z][A-Za-z0-9+.\-]*://|jdbc:)[^\s)\]}>\"']+"
DOTTED = r"\b[A-Za-z][A-Za-z0-9_]*(?:\.[A-Za-z][A-Za-z0-9_]*){2,}\b"
NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
DOTTED_RUN = r"\bv?\d+(?:\.\d+){2,}\b"
# What any text with an identifier, or with a dotted run of numbers, has: found at a fraction of the cost of the pattern.
DOTTED_SIGN, RUN_SIGN = r"\.[A-Za-z][A-Za-z0-9_]*\.[A-Za-z]", r"\d\.\d+\.\d"
CODE = r"(?s)```.*?(?:```|$)|`[^`\n]+`"
SENTENCE_END = r"(?<=[.!?])\s+"
SOURCES_HEADING = r"(?i)^[#>*_\s-]*(?:sources?|references?|citations?)[\s:*_#-]*$"
REFERENCE, BARE_MARK = r"^[-*]?\s*\[\d+\]", r"^\[\d+\]$"
BLANKS = (r"(?<=\S)[ \t]{2,}", " ")
TIDIED = [
    BLANKS,
    (r"[ \t]+([.,;:!?])", "$1"),
    (r"(?<!\S)\(\s*\)(?=\s|$|[.,;:!?])", ""),
    (r"(?<!\S)\[\s*\](?=\s|$|[.,;:!?])", ""),
    (r"(?<!\.)\.\.(?!\.)", "."),
    BLANKS,
]

#: Stands for code while prose is split.
_CUT = "\uE002"

OVERLAP_FLOOR, LEAST_ANSWER_TOKENS, LEAST_SOURCE_TOKENS = 0.48, 12, 200
SENTENCE_FLOOR, LEAST_SENTENCE_TOKENS = 0.55, 6
#: Slices of questions, in which sentences meet hits, for each shuffle partition.
SLICES = 4


def _any(text: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def _begins(text: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.startswith(text, F.lit(p))
    return out


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_refusal(answer: Column) -> Column:
    """G1: empty; begins (behind a hedge) with a refusal; or cites nothing and has a strong phrase, or a weak one about
    the sources."""
    return let(F.lower(_strip(F.coalesce(answer, F.lit("")))), _refuses)


def _refuses(low: Column) -> Column:
    def opens(opener: Column) -> Column:
        unhedged = opener
        for hedge in reversed(HEDGES):
            unhedged = F.when(F.startswith(opener, F.lit(hedge)), F.ltrim(F.substring(opener, len(hedge) + 1, 1 << 30))).otherwise(unhedged)
        return let(unhedged, lambda u: _begins(u, REFUSAL_OPENERS))

    uncited = ~F.contains(low, F.lit("["))
    hedging = _any(low, REFUSAL_STRONG) | (_any(low, REFUSAL_WEAK) & _any(low, REFUSAL_ANCHORS))
    return (low == "") | let(F.regexp_replace(low, r"^[*_`\"' ]+", ""), opens) | (uncited & hedging)


def strip_trailing_refusal(answer: Column) -> Column:
    """Refusing lines at the end dropped; an answer of nothing else stays as it is."""
    text = _strip_end(F.coalesce(answer, F.lit("")))
    start = F.struct(F.lit(0).alias("dropped"), F.lit(False).alias("done"))

    def step(state: Column, line: Column) -> Column:
        """Lines in front of one that is kept aren't looked at."""
        refused = F.struct((state["dropped"] + 1).alias("dropped"), F.lit(False).alias("done"))
        return F.when(state["done"], state).when(is_refusal(line), refused).otherwise(F.struct(state["dropped"].alias("dropped"), F.lit(True).alias("done")))

    def kept(lines: Column) -> Column:
        n = F.size(lines) - F.aggregate(F.reverse(lines), start, step)["dropped"]
        return F.when(n == F.size(lines), text).otherwise(_strip_end(F.array_join(F.slice(lines, F.lit(1), n), "\n")))

    return let(let(F.split(text, "\n"), kept), lambda cut: F.when(cut == "", answer).otherwise(cut))


def _strip_end(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def source_text(hits: DataFrame) -> DataFrame:
    """question_id, source: title and text of all hits of a question, in order of rank."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(" ", "title", "text").alias("t"))))
    return hits.groupBy("question_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), " ").alias("source"))


def _identifiers(text: Column) -> Column:
    return F.concat(F.regexp_extract_all(text, F.lit(URI), 0), F.regexp_extract_all(F.regexp_replace(text, URI, " "), F.lit(DOTTED), 0))


def _may_identify(text: Column) -> Column:
    """False only for texts without identifiers."""
    return F.contains(text, F.lit("://")) | F.contains(text, F.lit("jdbc:")) | text.rlike(DOTTED_SIGN)


def _bare(token: Column) -> Column:
    return F.regexp_replace(F.lower(token), "[^a-z0-9]", "")


def fabricated_specifics(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """question_id, token: dotted identifiers and URIs (but web links) of an answer that are no whole identifier of its
    sources. An anti-join of tokens; answers without hits aren't judged."""
    said = answers.where(_may_identify(F.col("answer")))
    stated = said.select("question_id", F.explode(F.array_distinct(_identifiers(F.col("answer")))).alias("token"))
    stated = stated.where(~F.lower("token").rlike("^https?://") & ~F.lower(F.rtrim("token")).isin(ABBREVIATIONS)).withColumn("bare", _bare(F.col("token"))).where("bare <> ''")
    stated = stated.join(hits.select("question_id").distinct(), "question_id", "left_semi")
    sources = hits.select("question_id", F.lower(F.concat_ws(" ", "title", "text")).alias("source")).where(_may_identify(F.col("source")))
    known = sources.select("question_id", F.explode(_identifiers(F.col("source"))).alias("t")).select("question_id", _bare(F.col("t")).alias("bare"))
    return stated.join(known, ["question_id", "bare"], "left_anti").select("question_id", "token")


def _value_of(token: Column) -> Column:
    """A number's value as text: whole ones without a point, those beyond double precision as they stand."""
    value = token.try_cast("double")
    whole = (value % 1 == 0) & (F.abs(value) < 1e37)
    return F.when(F.abs(value) == float("inf"), token).when(whole, value.cast("decimal(38,0)").cast("string")).otherwise(value.cast("string"))


def canonical_number(token: Column) -> Column:
    """Equal values, equal text: digits without leading zeros exactly at any length, other forms by value."""
    plain = F.replace(token, F.lit(","), F.lit(""))
    digits = F.regexp_replace(plain, "^0+(?=.)", "")
    return F.when(plain.rlike("^[0-9]+$"), digits).otherwise(_value_of(plain))


def _without_runs(text: Column) -> Column:
    return F.when(text.rlike(RUN_SIGN), F.regexp_replace(text, DOTTED_RUN, " ")).otherwise(text)


def fabricated_numbers(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """question_id, token: the first number with a comma, point, exponent or five digits at least whose value is in no
    source. Citation marks and dotted runs are masked in the answer; sources are read with and without such runs."""
    text = _without_runs(F.regexp_replace(F.coalesce("answer", F.lit("")), r"\[[0-9]+\]", " "))
    stated = answers.select("question_id", F.posexplode(F.regexp_extract_all(text, F.lit(NUMBER), 0)).alias("pos", "token"))
    whole = F.regexp_extract(F.replace(F.col("token"), F.lit(","), F.lit("")), "^[0-9]+", 0)
    stated = stated.where(F.col("token").rlike("[,.eE]") | (F.length(whole) >= 5)).withColumn("value", canonical_number(F.col("token")))
    stated = stated.join(hits.select("question_id").distinct(), "question_id", "left_semi")
    source = F.concat_ws(" ", "title", "text")
    numbers = lambda of: F.regexp_extract_all(of, F.lit(NUMBER), 0)
    raw = F.when(source.rlike(RUN_SIGN), F.concat(numbers(source), numbers(F.regexp_replace(source, DOTTED_RUN, " ")))).otherwise(numbers(source))
    known = hits.select("question_id", F.explode(F.array_distinct(raw)).alias("t")).select("question_id", canonical_number(F.col("t")).alias("value"))
    missing = stated.join(known, ["question_id", "value"], "left_anti")
    return missing.groupBy("question_id").agg(F.min_by("token", "pos").alias("token"))


def grounding_overlap(answers: DataFrame, hits: DataFrame, floor: float = OVERLAP_FLOOR) -> DataFrame:
    """question_id, overlap (share of the answer's content words in the sources, 1 for none), weak (below the floor,
    where the answer has 12 such words and the sources 200)."""
    seen = hits.select("question_id", content_tokens(F.concat_ws(" ", "title", "text")).alias("t")).groupBy("question_id").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("seen"))
    out = answers.select("question_id", content_tokens(F.col("answer")).alias("said")).join(seen, "question_id", "left")
    seen_ = F.coalesce("seen", F.array().cast("array<string>"))
    overlap = F.when(F.size("said") == 0, 1.0).otherwise(F.size(F.array_intersect("said", seen_)) / F.size("said"))
    weak = (overlap < floor) & (F.size("said") >= LEAST_ANSWER_TOKENS) & (F.size(seen_) >= LEAST_SOURCE_TOKENS)
    return out.select("question_id", overlap.alias("overlap"), weak.alias("weak"))


def prose(answer: Column) -> Column:
    """The answer without fenced and inline code."""
    return F.regexp_replace(F.coalesce(answer, F.lit("")), CODE, " ")


def _best_cosines(said: pa.Table, held: pa.Table) -> pa.Table:
    """The rows of `said` whose question has vectors in `held`, with the best cosine; question by question in one product."""
    said, held = (t.filter(pc.is_valid(t["embedding"])) for t in (said, held))
    n = said.num_rows
    codes, _ = pd.factorize(np.concatenate([np.array(t["question_id"].to_pylist(), object) for t in (said, held)]))
    left, right = np.argsort(codes[:n], kind="stable"), np.argsort(codes[n:], kind="stable")
    width = len(said["embedding"][0]) if n else 1
    a, b = unit_rows(said["embedding"], width)[left], unit_rows(held["embedding"], width)[right]
    mine, theirs = codes[:n][left], codes[n:][right]
    kinds = np.unique(mine)
    ends = [np.searchsorted(x, kinds, side=s) for x in (mine, theirs) for s in ("left", "right")]
    best = np.full(n, np.nan)
    for i, j, k, m in zip(*(e.tolist() for e in ends), strict=True):
        if m > k:
            best[left[i:j]] = (a[i:j] @ b[k:m].T).max(1)
    return pa.table([*(said[c] for c in ("question_id", "n", "sentence")), pa.array(best)], names=["question_id", "n", "sentence", "best"]).filter(pa.array(~np.isnan(best)))


def unsupported_sentences(answers: DataFrame, hits: DataFrame, floor: float = SENTENCE_FLOOR, width: int = 64, embedder: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """question_id, n, sentence, best: prose sentences of six content words at least whose best cosine to any hit of
    their question is below the floor. embedder appends `embedding` for a text column; the built-in one is SQL.

    Sentences and hits meet by slices of questions; a slice's vectors are multiplied question by question."""
    embedder = embedder or (lambda df, text: df.withColumn("embedding", hash_embedding(F.col(text), width)))
    parts = answers.select("question_id", F.posexplode(F.split(prose(F.col("answer")), SENTENCE_END)).alias("n", "s"))
    parts = parts.where(F.size(content_tokens(F.col("s"))) >= LEAST_SENTENCE_TOKENS).select("question_id", "n", _strip(F.col("s")).alias("sentence"))
    slices = F.lit(SLICES * int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by_slice = lambda df, *columns: df.select("question_id", *columns, "embedding", F.pmod(F.xxhash64("question_id"), slices).alias("slice")).groupBy("slice")
    said = by_slice(embedder(parts, "sentence"), "n", "sentence")
    held = by_slice(embedder(hits.select("question_id", F.concat_ws(". ", "title", "text").alias("t")), "t"))
    best = said.cogroup(held).applyInArrow(_best_cosines, f"question_id {dict(answers.dtypes)['question_id']}, n int, sentence string, best double")
    return best.where(F.col("best") < floor)


def parse_verdict(text: Column) -> Column:
    """Fail, pass or open from a model's words; fail wins. Open counts as passing."""
    said = F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit("[A-Z]+"), 0)
    return F.when(F.array_contains(said, "FAIL"), "fail").when(F.array_contains(said, "PASS"), "pass").otherwise("open")


def split_code(text: Column) -> Column:
    """Segments in order, prose at even places and code at odd ones."""
    code = F.regexp_extract_all(text, F.lit(CODE), 0)
    rest = F.split(F.regexp_replace(text, CODE, ""), "")
    return F.flatten(F.transform(rest, lambda p, i: F.when(i < F.size(code), F.array(p, F.get(code, i))).otherwise(F.array(p))))


def tidy_answer(answer: Column) -> Column:
    """An editorial opener dropped; in prose runs of blanks, blanks before signs, empty brackets and double stops
    cleaned. Code stays untouched."""
    text = _strip(F.coalesce(answer, F.lit("")))
    low, out = F.lower(text), text
    for opener in reversed(EDITORIAL_OPENERS):
        rest = F.regexp_replace(F.substring(text, len(opener) + 1, 1 << 30), r"^[ ,:\-]+", "")
        out = F.when(F.startswith(low, F.lit(opener)), F.concat(F.upper(F.substring(rest, 1, 1)), F.substring(rest, 2, 1 << 30))).otherwise(out)

    def clean(segment: Column) -> Column:
        for pattern, to in TIDIED:
            segment = F.regexp_replace(segment, pattern, to)
        return segment

    return _strip(F.array_join(F.transform(split_code(out), lambda s, i: F.when(i % 2 == 0, clean(s)).otherwise(s)), ""))


def _nothing_left(answer: Column) -> Column:
    """Whether tidying empties an answer. It takes an opener's letters and digits only, so one with more isn't tidied."""
    most = max(map(len, EDITORIAL_OPENERS))
    some = F.length(F.regexp_replace(F.substring(answer, 1, 20 * most), "[^A-Za-z0-9]", ""))
    return F.when(some > most, False).otherwise(_strip(tidy_answer(answer)) == "")


def strip_sources_block(answer: Column) -> Column:
    """A trailing list of references dropped, if it stands under a heading for sources or is bare `[n]` lines."""
    def last(bare: Column, keep, upto: Column) -> Column:
        return F.coalesce(F.array_max(F.transform(F.slice(bare, F.lit(1), upto), lambda x, i: F.when(keep(x), i + 1).otherwise(0))), F.lit(0))

    def block(s: Column) -> Column:
        text, bare = s["text"], s["bare"]

        def cut(at: Column) -> Column:
            end, start = at["end"], at["start"]
            heading = last(bare, lambda x: x != "", start)
            named = F.coalesce(F.get(bare, heading - 1).rlike(SOURCES_HEADING), F.lit(False))
            under = (heading > 0) & named
            all_bare = F.forall(F.slice(bare, start + 1, end - start), lambda x: x.rlike(BARE_MARK))
            kept = F.slice(F.split(text, "\n"), F.lit(1), F.when(under, heading - 1).otherwise(start))
            return F.when((start == end) | ~(under | all_bare), text).otherwise(_strip_end(F.array_join(kept, "\n")))

        end = last(bare, lambda x: x != "", F.size(bare))
        return let(end, lambda e: let(F.struct(e.alias("end"), last(bare, lambda x: ~x.rlike(REFERENCE), e).alias("start")), cut))

    text = F.coalesce(answer, F.lit(""))
    return let(F.struct(text.alias("text"), F.transform(F.split(text, "\n"), _strip).alias("bare")), block)


def _source_key(url: str = "url", title: str = "title") -> Column:
    trimmed = F.trim(F.coalesce(url, F.lit("")))
    return F.when(trimmed == "", F.concat(F.lit("title::"), title)).otherwise(trimmed)


def finalize_citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """question_id, answer, citations (title, url): marks renumbered by the first appearance of their unique source.

    Marks are `[n]` in prose. One that is glued to a word counts only within range or right behind another mark; marks
    out of range are dropped. An answer without a usable mark cites the hit that shares most content words with it.
    """
    clean = answers.select("question_id", strip_sources_block(F.col("answer")).alias("answer"))
    ranked = hits.select("question_id", "rank", "title", F.trim("url").alias("url"), _source_key().alias("key"), "text")
    counts = ranked.groupBy("question_id").agg(F.max("rank").alias("n_hits"))
    pieces = clean.join(counts, "question_id", "left").select("question_id", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.posexplode(split_code(F.col("answer"))).alias("seg", "piece"))
    # prose is cut into text and marks; a mark keeps the character in front of it for the test of being glued
    tokens = F.when(F.col("seg") % 2 == 0, F.regexp_extract_all("piece", F.lit(r"\[\d+\]|[^\[]+|\["), 0)).otherwise(F.array("piece"))
    parts = pieces.select("question_id", "n_hits", "seg", F.posexplode(tokens).alias("i", "tok"))
    order = Window.partitionBy("question_id", "seg").orderBy("i")
    parts = parts.withColumn("bracket", (F.col("seg") % 2 == 0) & F.col("tok").rlike(r"^\[\d+\]$"))
    parts = parts.withColumn("before", F.lag("tok").over(order)).withColumn("n", F.when(F.col("bracket"), F.regexp_extract("tok", r"\d+", 0).try_cast("int")))
    in_range = F.coalesce((F.col("n") >= 1) & (F.col("n") <= F.col("n_hits")), F.lit(False))
    glued = F.coalesce(F.right("before", F.lit(3)).rlike(r"[\p{L}\p{N}_]$"), F.lit(False))
    # a bracket behind a bracket follows a mark, if that is one: the first of a chain decides
    first = F.last(F.when(~F.coalesce(F.lag("bracket").over(order), F.lit(False)), ~glued | in_range), ignorenulls=True).over(order)
    parts = parts.withColumn("mark", F.col("bracket") & ((~glued & F.coalesce(~F.col("before").rlike(r"^\[\d+\]$"), F.lit(True))) | in_range | (F.coalesce(F.col("before").rlike(r"^\[\d+\]$"), F.lit(False)) & first)))
    # read by the citations and by the text
    parts = written(parts.select("question_id", "seg", "i", "tok", "n", "mark", (F.col("mark") & in_range).alias("valid")), "parts")
    cited = parts.where("valid").join(ranked, (parts["question_id"] == ranked["question_id"]) & (parts["n"] == ranked["rank"])).select(parts["question_id"], "seg", "i", "key", "title", "url")
    firsts = cited.groupBy("question_id", "key").agg(F.min(F.struct("seg", "i", "title", "url")).alias("f"))
    numbered = firsts.withColumn("no", F.row_number().over(Window.partitionBy("question_id").orderBy("f.seg", "f.i")))
    renumber = cited.join(numbered.select("question_id", "key", "no"), ["question_id", "key"]).select("question_id", "seg", "i", "no")
    text = F.when(F.col("no").isNotNull(), F.concat(F.lit("["), F.col("no").cast("string"), F.lit("]"))).when(F.col("mark"), "").otherwise(F.col("tok"))
    whole = parts.join(renumber, ["question_id", "seg", "i"], "left").groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "i", text.alias("t")))), lambda x: x["t"]), "").alias("answer"))
    whole = clean.select("question_id").join(whole, "question_id", "left").withColumn("answer", F.coalesce("answer", F.lit("")))
    lists = numbered.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", F.col("f.title").alias("title"), F.col("f.url").alias("url")))), lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"))).alias("citations"))
    shared = whole.join(lists.select("question_id"), "question_id", "left_anti").join(ranked, "question_id")
    shared = shared.withColumn("common", F.size(F.array_intersect(content_tokens(F.col("answer")), content_tokens(F.concat_ws(" ", "title", "text")))))
    fallback = shared.groupBy("question_id").agg(F.array(F.min_by(F.struct("title", "url"), F.struct(-F.col("common"), "rank"))).alias("citations"))
    return whole.join(lists.unionByName(fallback), "question_id", "left")


def dedup_citations(hits: DataFrame) -> DataFrame:
    """question_id, citations: unique sources of the hits in order of first rank."""
    once = Window.partitionBy("question_id", "key").orderBy("rank")
    first = hits.withColumn("key", _source_key()).withColumn("_n", F.row_number().over(once)).where("_n = 1")
    item = F.struct("rank", "title", F.trim("url").alias("url"))
    return first.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"))).alias("citations"))


def label_curated(answers: DataFrame, hits: DataFrame, space: str = "curated", note: str = "\n\n(from a curated answer)") -> DataFrame:
    """A note behind the answer where any hit comes from the curated space."""
    curated = hits.groupBy("question_id").agg(F.max((F.col("space") == space).cast("int")).alias("_c"))
    out = answers.join(curated, "question_id", "left")
    return out.withColumn("answer", F.when(F.col("_c") == 1, F.concat("answer", F.lit(note))).otherwise(F.col("answer"))).drop("_c")


def _blocks(hits: DataFrame, line: Column, name: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return hits.groupBy("question_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n\n").alias(name))


def build_prompts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """question_id, prompt: the question with numbered sources in order of rank, or without any."""
    title = F.when(F.coalesce("title", F.lit("")) == "", F.col("doc_id")).otherwise(F.col("title"))
    url = F.when(F.coalesce("url", F.lit("")) == "", "").otherwise(F.concat(F.lit(" ("), "url", F.lit(")")))
    sources = _blocks(hits, F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), title, url, F.lit("\n"), "text"), "sources")
    out = questions.select("question_id", "question").join(sources, "question_id", "left")
    body = F.coalesce("sources", F.lit("(no sources found)"))
    return out.select("question_id", F.concat(F.lit("Question: "), "question", F.lit("\n\nSources:\n"), body).alias("prompt"))


def verdict_prompts(answers: DataFrame, hits: DataFrame, most: int = 2400) -> DataFrame:
    """question_id, prompt (null without hits), fails: question, answer and sources of at most `most` characters each."""
    sources = _blocks(hits, F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.substring("text", 1, most)), "sources")
    out = answers.join(sources, "question_id", "left")
    prompt = F.concat(F.lit("Question: "), "question", F.lit("\nAnswer: "), "answer", F.lit("\nSources:\n"), "sources")
    return out.select("question_id", prompt.alias("prompt"), F.col("sources").isNull().alias("fails"))


def escalations(answers: DataFrame, hits: DataFrame, include_draft: bool = False) -> DataFrame:
    """question_id, title (one line), summary (255 characters), body, suggested (the first three sources) of answers
    (question_id, question, confidence, answer) that are handed to a person."""
    url = F.when(F.coalesce("url", F.lit("")) == "", "(no url)").otherwise(F.col("url"))
    line = F.concat(F.lit("  "), F.col("rank").cast("string"), F.lit(". "), "title", F.lit(", "), url, F.lit(" (score "), F.format_string("%.3f", "score"), F.lit(")"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    listed = hits.groupBy("question_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("listed"))
    top = dedup_citations(hits.where("rank <= 3")).withColumnRenamed("citations", "suggested")
    out = answers.join(listed, "question_id", "left").join(top, "question_id", "left")
    title = F.concat(F.lit("Could not answer: "), F.trim(F.regexp_replace("question", r"(?U)\s+", " ")))
    sources = F.when(F.col("listed").isNull(), "No relevant sources were retrieved.").otherwise(F.concat(F.lit("Closest sources retrieved:\n"), "listed"))
    body = F.concat(F.lit("Question: "), "question", F.lit("\nConfidence: "), F.format_string("%.3f", "confidence"), F.lit("\n\n"), sources)
    if include_draft:
        draft = F.concat(body, F.lit("\n\nDraft, not shown to the asker:\n"), "answer")
        body = F.when(F.coalesce("answer", F.lit("")) != "", draft).otherwise(body)
    return out.select("question_id", title.alias("title"), F.substring(title, 1, 255).alias("summary"), body.alias("body"), "suggested")


def answer_with(prompts: DataFrame, outputs: DataFrame | Callable[[list[str]], list[str]]) -> DataFrame:
    """Prompts with an answer: from a table of outputs (question_id, answer), or from a user's function in batches."""
    if isinstance(outputs, DataFrame):
        return prompts.join(outputs.select("question_id", "answer"), "question_id", "left")
    schema = T.StructType([*prompts.schema.fields, T.StructField("answer", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(answer=outputs(f.prompt.tolist()))

    return prompts.mapInPandas(run, schema)


def decide(answers: DataFrame, gated: DataFrame, hits: DataFrame, verdicts: DataFrame | None = None, sentence_floor: float = SENTENCE_FLOOR) -> DataFrame:
    """question_id, answered, reason: the first guard that fails: gate, refusal, specifics, numbers, overlap, sentences,
    verdict, empty; null if none does. Later guards see only answers that the gate lets through."""
    through = gated.where("NOT escalate").select("question_id")
    drafts = answers.join(through, "question_id", "left_semi").withColumn("answer", strip_trailing_refusal(F.col("answer")))
    # each guard reads both again
    drafts, hits = written(drafts, "drafts"), written(hits.select("question_id", "rank", "title", "text"), "draft-hits")
    flag = lambda df, name: df.select("question_id", F.lit(True).alias(name)).distinct()
    out = gated.select("question_id", "escalate").join(drafts.select("question_id", "answer"), "question_id", "left")
    out = out.join(flag(fabricated_specifics(drafts, hits), "s"), "question_id", "left")
    out = out.join(flag(fabricated_numbers(drafts, hits), "n"), "question_id", "left")
    out = out.join(flag(grounding_overlap(drafts, hits).where("weak"), "o"), "question_id", "left")
    out = out.join(flag(unsupported_sentences(drafts, hits, sentence_floor), "u"), "question_id", "left")
    failed = F.lit(False)
    if verdicts is not None:
        out = out.join(verdicts.select("question_id", F.col("verdict").alias("v")), "question_id", "left")
        failed = F.coalesce(parse_verdict(F.col("v")) == "fail", F.lit(False))
    reason = (
        F.when(F.col("escalate"), "gate").when(is_refusal(F.col("answer")), "refusal").when(F.col("s"), "specifics")
        .when(F.col("n"), "numbers").when(F.col("o"), "overlap").when(F.col("u"), "sentences").when(failed, "verdict")
        .when(_nothing_left(F.col("answer")), "empty")
    )
    return out.select("question_id", reason.isNull().alias("answered"), reason.alias("reason"))
