"""Confidence in retrieved hits, and the decision to answer or escalate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.functions.text import clip, content_tokens, sigmoid

THRESHOLD = 0.45


def confidence(questions: DataFrame, hits: DataFrame, rerank_is_prob: bool = False) -> DataFrame:
    """question_id, question, n_hits, confidence (0 to 1).

    Relevance is the best cosine, with a reranker 0.6 of its best score (as a probability) and 0.4 of the cosine; the
    share of the question's content words that the hits' titles and texts hold modulates it. No hits: 0.
    """
    # all words: only the question's content words are looked for among them
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "title", "text")), F.lit("[a-z0-9]+"), 0))
    per_hit = hits.select("question_id", "vector_score", "rerank_score", words.alias("tokens"))
    best = per_hit.groupBy("question_id").agg(F.count("*").alias("n_hits"), F.max("vector_score").alias("cos"), F.max("rerank_score").alias("rr"), F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("seen"))
    out = questions.select("question_id", "question").join(best, "question_id", "left")
    similarity = clip(F.coalesce("cos", F.lit(0.0)))
    judged = clip(F.col("rr")) if rerank_is_prob else sigmoid(F.col("rr"))
    relevance = F.when(F.col("rr").isNull(), similarity).otherwise(0.6 * judged + 0.4 * similarity)
    asked = content_tokens(F.col("question"))
    covered = F.when(F.size(asked) == 0, relevance).otherwise(F.size(F.array_intersect(asked, F.coalesce("seen", F.array().cast("array<string>")))) / F.size(asked))
    value = F.when(F.col("n_hits").isNull(), 0.0).otherwise(clip(relevance * (0.5 + 0.5 * covered)))
    return out.select("question_id", "question", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), value.alias("confidence"))


def gate(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """escalate where there is no hit or too little confidence."""
    return scored.withColumn("escalate", (F.col("n_hits") == 0) | (F.col("confidence") < threshold))


def search_results(gated: DataFrame, hits: DataFrame) -> DataFrame:
    """one row per question with its hits in order of rank, as a search endpoint would return them."""
    item = F.struct("rank", "chunk_id", "title", "url", "score", "vector_score")
    nested = hits.groupBy("question_id").agg(F.array_sort(F.collect_list(item)).alias("hits"))
    return gated.join(nested, "question_id", "left")


def rerank_range_check(hits: DataFrame) -> DataFrame:
    """how many questions' best rerank score can't be a probability, though it is said to be one."""
    best = hits.groupBy("question_id").agg(F.max("rerank_score").alias("best")).where(F.col("best").isNotNull())
    return best.agg(F.count_if((F.col("best") < -0.01) | (F.col("best") > 1.01)).alias("mismatches"), F.count("*").alias("questions"))
