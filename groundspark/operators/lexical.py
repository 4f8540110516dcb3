"""Lexical retrieval: places of words, web-style questions and their fallback; lexical_index matches and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundspark.functions.text import STOP_WORDS

#: Terms of a question that the fallback uses.
FALLBACK_TERMS = 12


def chunk_text() -> Column:
    """Title and text, in lower case."""
    return F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))


def chunk_words() -> Column:
    """The words of title and text, in order."""
    return F.regexp_extract_all(chunk_text(), F.lit("[a-z0-9]+"), 0)


def build_postings(chunks: DataFrame) -> DataFrame:
    """chunk_id, term, pos: the words of title and text but for stop words, with their places."""
    terms = chunks.select("chunk_id", F.posexplode(chunk_words()).alias("pos", "term"))
    return terms.where(~F.col("term").isin(STOP_WORDS))


def query_terms(questions: DataFrame) -> DataFrame:
    """question_id, grp, term, kind, place of a web-style query: bare words and "phrases" must all match; `or` joins
    the words around it to alternatives (one group); `-word` must not match. Stop words have no rows."""
    raw = F.regexp_extract_all(F.lower("question"), F.lit(r'-?"[^"]*"|-?[^\s"]+'), 0)
    parts = questions.select("question_id", F.posexplode(raw).alias("n", "raw"))
    order = Window.partitionBy("question_id").orderBy("n")
    is_or = F.col("raw") == "or"
    # a part begins a group unless an `or` stands before it
    parts = parts.withColumn("joins", F.coalesce(F.lag("raw").over(order) == "or", F.lit(False)) & ~is_or)
    parts = parts.where(~is_or).withColumn("grp", F.sum((~F.col("joins")).cast("int")).over(order))
    kind = F.when(F.col("raw").startswith("-"), "not").when(F.col("raw").contains('"'), "phrase").otherwise("word")
    found = parts.select("question_id", "grp", "n", kind.alias("kind"), F.posexplode(F.regexp_extract_all("raw", F.lit("[a-z0-9]+"), 0)).alias("place", "term"))
    found = found.where(~F.col("term").isin(STOP_WORDS))
    return found.select("question_id", "grp", "n", "term", "kind", "place")


def fallback_words(question: Column) -> Column:
    """The first 12 words of two characters at least, each once."""
    found = F.regexp_extract_all(F.lower(question), F.lit("[a-z0-9]+"), 0)
    return F.array_distinct(F.slice(F.filter(found, lambda t: F.length(t) >= 2), 1, FALLBACK_TERMS))


def or_fallback(questions: DataFrame, matched: DataFrame) -> DataFrame:
    """question_id, term for questions that match nothing at all (before any filter): the fallback words but for stop
    words, any of which will do."""
    left = questions.join(matched.select("question_id").distinct(), "question_id", "left_anti")
    terms = left.select("question_id", F.explode(fallback_words(F.col("question"))).alias("term"))
    return terms.where(~F.col("term").isin(STOP_WORDS))
