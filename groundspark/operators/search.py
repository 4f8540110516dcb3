"""Hybrid search: filters, fusion, question variants, reranking, and the whole retrieval."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundspark.functions.text import LEAD_INS, content_tokens, normalize_question
from groundspark.functions.vectors import cosine
from groundspark.operators import lexical_index, partitions, vectors
from groundspark.operators.chunking import char_windows

RRF_K = 60
FILTERABLE = ("doc_id", "space", "title", "url")
TOP_K, CANDIDATES = 8, 20


def with_filters(df: DataFrame, filters: dict | None) -> DataFrame:
    """Rows that have the value, or one of the values, in each column; an unknown column raises."""
    for column, value in (filters or {}).items():
        if column not in FILTERABLE:
            raise ValueError(f"cannot filter by {column}; only by {', '.join(FILTERABLE)}")
        df = df.where(F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
    return df


def rrf_fuse(vec: DataFrame, lex: DataFrame, k: int = RRF_K) -> DataFrame:
    """question_id, chunk_id, score = 1 / (k + rank) of each side, a missing side counting 0."""
    a = vec.select("question_id", "chunk_id", F.col("rank").alias("vec_rank"))
    b = lex.select("question_id", "chunk_id", F.col("rank").alias("lex_rank"))
    part = lambda r: F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0))
    return a.join(b, ["question_id", "chunk_id"], "full_outer").select("question_id", "chunk_id", (part("vec_rank") + part("lex_rank")).alias("score"))


def hybrid_search(questions: DataFrame, chunks: DataFrame, index: DataFrame | None = None, top_k: int = TOP_K, filters: dict | None = None, width: int = 64, approx: bool = False) -> DataFrame:
    """The best top_k chunks of every question by rank fusion of vectors and words, with metadata and cosine.

    Filters hold in both arms before their limits of 4 * top_k, but a question falls back to any-term matching only if
    nothing at all matches all its terms. Text and metadata are joined to the final hits only. top_k <= 0 gives no rows.
    """
    pool = 4 * max(top_k, 1)
    kept = with_filters(chunks, filters)
    index = lexical_index.stored_index(chunks) if index is None else index
    near = partitions.approx_knn if approx else vectors.knn
    dense = near(questions, kept, pool, width=width)
    words = lexical_index.search(questions, index, pool, kept if filters else None)
    order = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    best = rrf_fuse(dense, words).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    hits = best.join(chunks, "chunk_id").join(questions.select("question_id", F.col("embedding").alias("q")), "question_id")
    score = cosine(F.col("q"), F.col("embedding"))
    return hits.select("question_id", "rank", "chunk_id", "doc_id", "title", "url", "space", "text", "score", score.alias("vector_score"), F.lit(None).cast("double").alias("rerank_score"))


def with_normalized(questions: DataFrame, lead_ins: list[str] = LEAD_INS) -> DataFrame:
    """E4 over a table of questions."""
    return questions.withColumn("question", normalize_question(F.col("question"), lead_ins))


def parse_variants(text: Column, question: Column, n: int = 2) -> Column:
    """E5: up to n reworded questions from a model's lines: numbering and quotes off, no repeats, not the question itself."""
    strip = lambda x: F.regexp_replace(x, r"^[\s\-*•\d.)\"']+|[\s\"']+$", "")
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda x: x != "")
    own = F.lower(F.trim(question))
    fresh = F.filter(lines, lambda x: F.lower(x) != own)
    lowered = F.transform(fresh, F.lower)
    first = F.filter(F.transform(fresh, lambda x, i: F.struct(x.alias("x"), (F.array_position(lowered, F.lower(x)) == i + 1).alias("f"))), lambda s: s["f"])
    return F.slice(F.transform(first, lambda s: s["x"]), 1, n)


def accept_rewrite(rewrite: Column, question: Column) -> Column:
    """The first line of a rewrite without quotes; the question itself if that is empty or far longer."""
    first = F.regexp_replace(F.get(F.split(F.trim(F.coalesce(rewrite, F.lit(""))), "\n"), F.lit(0)), r"^[\s\"'`]+|[\s\"'`]+$", "")
    return F.when((first != "") & (F.length(first) <= F.greatest(F.lit(140), 2 * F.length(question))), first).otherwise(question)


def union_variants(hits: DataFrame) -> DataFrame:
    """Hits of all variants of a question; of a chunk found more than once the first in order of variant, then rank."""
    same = Window.partitionBy("question_id", "chunk_id").orderBy("variant", "rank")
    once = hits.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
    order = Window.partitionBy("question_id").orderBy("variant", "rank")
    return once.withColumn("rank", F.row_number().over(order))


def overlap_score(question: Column, window: Column) -> Column:
    """Built-in scorer: share of the question's content words in the window, as a logit-like number from -4 to 4."""
    asked = content_tokens(question)
    return F.when(F.size(asked) == 0, 0.0).otherwise(8.0 * F.size(F.array_intersect(asked, content_tokens(window))) / F.size(asked) - 4.0)


def rerank(hits: DataFrame, questions: DataFrame, top_k: int, scorer: Callable[[list[str], list[str]], list[float]] | None = None) -> DataFrame:
    """Hits in the order of their best window's score, cut to top_k; score becomes that score, the cosine stays.

    A user's scorer takes lists of questions and windows; without one the built-in SQL scorer is used. A question with
    one hit keeps it unscored. Equal scores keep their order.
    """
    asked = questions.select("question_id", "question")
    counted = hits.withColumn("_n", F.count("*").over(Window.partitionBy("question_id")))
    several = counted.where("_n > 1")
    windows = several.join(asked, "question_id").select("question_id", "chunk_id", "question", F.explode(char_windows(F.concat_ws("\n", "title", "text"))).alias("window"))
    if scorer is None:
        scored = windows.select("question_id", "chunk_id", overlap_score(F.col("question"), F.col("window")).alias("s"))
    else:

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame({"question_id": f.question_id, "chunk_id": f.chunk_id, "s": [float(x) for x in scorer(f.question.tolist(), f.window.tolist())]})

        kind = dict(windows.dtypes)["question_id"]
        scored = windows.mapInPandas(run, f"question_id {kind}, chunk_id string, s double")
    best = scored.groupBy("question_id", "chunk_id").agg(F.max("s").alias("_s"))
    out = several.drop("_n").join(best, ["question_id", "chunk_id"])
    order = Window.partitionBy("question_id").orderBy(F.desc(F.round("_s", 9)), "rank")
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    out = out.withColumn("score", F.col("_s")).withColumn("rerank_score", F.col("_s")).drop("_s")
    return out.unionByName(counted.where("_n = 1").drop("_n")) if top_k > 0 else out


def retrieve(questions: DataFrame, chunks: DataFrame, index: DataFrame | None = None, top_k: int = TOP_K, reranked: bool = True, width: int = 64, variants: DataFrame | None = None) -> DataFrame:
    """Normalise, search every variant (question_id, variant, question; the question itself is variant 0), join the hits of a
    question, rerank. One job for all questions."""
    asked = with_normalized(questions.select("question_id", "question")).withColumn("variant", F.lit(0))
    if variants is not None:
        asked = asked.unionByName(variants.select("question_id", "question", "variant"))
    keyed = asked.withColumn("root", F.col("question_id")).withColumn("question_id", F.concat_ws(":", F.col("question_id").cast("string"), F.col("variant").cast("string")))
    keyed = vectors.with_hash_embedding(keyed, "question", width)
    found = hybrid_search(keyed, chunks, index, CANDIDATES if reranked else top_k, width=width)
    found = found.join(keyed.select("question_id", "root", "variant"), "question_id").drop("question_id").withColumnRenamed("root", "question_id")
    hits = union_variants(found).drop("variant")
    if not reranked:
        return hits.where(F.col("rank") <= top_k)
    return rerank(hits, asked.where("variant = 0"), top_k)


def dedup_chunk_ids(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Upsert by chunk_id: the new rows, of equal ids the last by `order`, and the old rows that they don't replace."""
    last = Window.partitionBy("chunk_id").orderBy(F.desc(order))
    newest = new.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return old.join(newest, "chunk_id", "left_anti").unionByName(newest, allowMissingColumns=True)
