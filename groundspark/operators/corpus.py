"""Keeping the chunk table in step with its source: changes by hash, whole-document replacement, guarded pruning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.functions.text import content_hash
from groundspark.operators import vectors
from groundspark.operators.chunking import OVERLAP, TARGET, chunk_documents
from groundspark.sources.scratch import written

#: Ids of documents that may be broadcast.
BROADCAST_IDS = 500_000
CURATED_PREFIX, CURATED_SPACE = "curated:", "curated"


def with_hash(docs: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """B7 over a table of documents."""
    columns = [F.col(c) for c in ("title", "content_type", "url", "space", "body")]
    return docs.withColumn("content_hash", content_hash(*columns, target, overlap))


def _bounded(ids: DataFrame) -> DataFrame:
    """Ids of documents, broadcast up to BROADCAST_IDS rows: a join with them then leaves the other table where it is."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def diff_corpus(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """H1: doc_id, content_hash, change: new, changed or unchanged against the stored hashes."""
    old = hashes.select("doc_id", F.col("content_hash").alias("old"))
    joined = docs.select("doc_id", "content_hash").join(old, "doc_id", "left")
    change = F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("content_hash"), "unchanged").otherwise("changed")
    return joined.select("doc_id", "content_hash", change.alias("change"))


def replace_docs(chunks: DataFrame, hashes: DataFrame, new: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """H2: chunks and hashes after all rows of the seen documents (doc_id, content_hash) are swapped for their new chunks.

    A document that has no new chunks loses its rows, and no hash is kept for it. Of up to BROADCAST_IDS seen documents
    the stored chunks aren't shuffled; beyond, both sides are.
    """
    ids = _bounded(seen.select("doc_id"))
    kept = chunks.join(ids, "doc_id", "left_anti").unionByName(new, allowMissingColumns=True)
    stamped = seen.join(new.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "content_hash")
    return kept, hashes.join(ids, "doc_id", "left_anti").unionByName(stamped)


def delete_docs(chunks: DataFrame, hashes: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """H3: both tables without the documents."""
    ids = _bounded(ids.select("doc_id"))
    return chunks.join(ids, "doc_id", "left_anti"), hashes.join(ids, "doc_id", "left_anti")


def prune_plan(chunks: DataFrame, seen: DataFrame, source_errors: int = 0, full_crawl: bool = True) -> DataFrame:
    """H4: one row: n_docs, n_seen, n_gone, decision (prune, partial, errors, empty, too_many). Curated documents are kept
    and don't count; more than half gone, or nothing seen, refuses."""
    ids = chunks.where(~F.col("doc_id").startswith(CURATED_PREFIX)).select("doc_id").distinct()
    marked = ids.join(seen.select("doc_id").distinct().withColumn("_s", F.lit(1)), "doc_id", "left")
    counts = marked.agg(F.count("*").alias("n_docs"), F.count_if(F.col("_s").isNull()).alias("n_gone"))
    counts = counts.crossJoin(seen.agg(F.count_distinct("doc_id").alias("n_seen")))  # one row each
    decision = (
        F.when(F.lit(not full_crawl), "partial").when(F.lit(source_errors > 0), "errors").when(F.col("n_seen") == 0, "empty")
        .when(F.col("n_gone") > F.floor(F.col("n_docs") / 2), "too_many").otherwise("prune")
    )
    return counts.select("n_docs", "n_seen", "n_gone", decision.alias("decision"))


def prune(chunks: DataFrame, hashes: DataFrame, seen: DataFrame, source_errors: int = 0, full_crawl: bool = True) -> tuple[DataFrame, DataFrame, str]:
    """H4: both tables without documents that weren't seen, if the plan allows; and the decision."""
    decision = prune_plan(chunks, seen, source_errors, full_crawl).first()["decision"]
    if decision != "prune":
        return chunks, hashes, decision
    ids = chunks.where(~F.col("doc_id").startswith(CURATED_PREFIX)).select("doc_id").distinct()
    gone = ids.join(seen, "doc_id", "left_anti")
    return *delete_docs(chunks, hashes, gone), decision


def list_doc_ids(chunks: DataFrame) -> DataFrame:
    """H5: documents with chunks."""
    return chunks.select("doc_id").distinct()


def set_doc_hash(hashes: DataFrame, new: DataFrame) -> DataFrame:
    """H5: upsert of hashes."""
    return hashes.join(new, "doc_id", "left_anti").unionByName(new.select("doc_id", "content_hash"))


def clear_doc_hashes(hashes: DataFrame) -> DataFrame:
    """H5: none left."""
    return hashes.limit(0)


def quarantine_bad_docs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """H8: good documents, and those that can't be processed with the reason; the latter keep their old rows and still
    count as seen."""
    reason = (
        F.when(F.col("doc_id").isNull() | (F.col("doc_id") == ""), "no id").when(F.col("body").isNull(), "no body")
        .when(~F.coalesce(F.col("content_type").isin("html", "markdown", "text"), F.lit(False)), "unknown type")
    )
    marked = docs.withColumn("error", reason)
    return marked.where("error IS NULL").drop("error"), marked.where("error IS NOT NULL").select("doc_id", "error")


def ingest(docs: DataFrame, chunks: DataFrame, hashes: DataFrame, target: int = TARGET, overlap: int = OVERLAP, width: int = 64) -> dict[str, DataFrame | Callable[[DataFrame], DataFrame]]:
    """H1, H2, H7 as one plan: chunks, hashes and summary after new and changed documents are chunked, embedded and replaced.

    Unchanged documents are neither chunked nor embedded; all embedding is in the plan of the new rows, before any swap.
    The differences are written once: they bound what is chunked, and what the stored chunks are joined with. Where nothing is
    unchanged, all documents are chunked where they are. `stamp` makes the hashes from the chunks as they were stored, which
    spares cutting them again.
    """
    good, bad = quarantine_bad_docs(docs)
    hashed = with_hash(good, target, overlap)
    diff = written(diff_corpus(hashed, hashes), "diff")
    todo = diff.where("change <> 'unchanged'").select("doc_id", "content_hash")
    changed = hashed if diff.where("change = 'unchanged'").isEmpty() else hashed.join(_bounded(todo.select("doc_id")), "doc_id", "left_semi")
    new = vectors.with_hash_embedding(chunk_documents(changed, target, overlap), "text", width)
    after, stamped = replace_docs(chunks, hashes, new, todo)
    stamp = lambda stored: replace_docs(chunks, hashes, stored, todo)[1]
    return {"chunks": after, "hashes": stamped, "stamp": stamp, "summary": ingest_summary(diff, new, bad), "new": new, "seen": docs.select("doc_id")}


def ingest_summary(diff: DataFrame, new: DataFrame, bad: DataFrame) -> DataFrame:
    """H7: one row of counts: docs, new, changed, unchanged, empty, chunks, failed."""
    with_rows = new.groupBy("doc_id").agg(F.count("*").alias("n"))
    per = diff.join(with_rows, "doc_id", "left")
    is_ = lambda c: F.count_if(F.col("change") == c).alias(c)
    empty = F.count_if((F.col("change") != "unchanged") & F.col("n").isNull()).alias("empty")
    one = per.agg(F.count("*").alias("docs"), is_("new"), is_("changed"), is_("unchanged"), empty, F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))
    return one.crossJoin(bad.agg(F.count("*").alias("failed")))  # one row each


def reindex(docs: DataFrame, approved: DataFrame, chunks: DataFrame, hashes: DataFrame, target: int = TARGET, overlap: int = OVERLAP, width: int = 64) -> dict[str, DataFrame]:
    """H6: every document and approved curated answer (documents too) chunked and embedded anew; live rows of documents
    that aren't seen stay. Another width than the table's raises."""
    vectors.refuse_dimension_change(chunks, width)
    return ingest(docs.unionByName(approved.select(*docs.columns)), chunks, clear_doc_hashes(hashes), target, overlap, width)
