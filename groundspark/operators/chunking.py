"""Chunking: documents to overlapping windows, by size or by heading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundspark.functions.cutting import windows
from groundspark.functions.text import clean_html, let, normalise_ws, without_controls

TARGET, OVERLAP = 500, 60
RERANK_CHARS, RERANK_OVERLAP = 1000, 200
#: Pieces of one document that are scored at most.
MOST_CHUNKS = 400


def check_window(target: int, overlap: int) -> None:
    if target <= 0:
        raise ValueError(f"target must be positive, not {target}")
    if not 0 <= overlap < target:
        raise ValueError(f"overlap must be at least 0 and less than target, not {overlap} of {target}")


def token_windows(text: Column, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    """Array of windows of `target` words that overlap by `overlap`; no words, no windows."""
    check_window(target, overlap)
    return windows(text, F.lit(target), F.lit(target - overlap))


def char_windows(text: Column, size: int = RERANK_CHARS, overlap: int = RERANK_OVERLAP) -> Column:
    """Array of overlapping windows of characters; a blank text is one empty window."""
    check_window(size, overlap)
    step = size - overlap
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")

    def cut(t: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.length(t) - size) / step).cast("int"))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(t, i * step + 1, F.lit(size)))

    return let(trimmed, cut)


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """Key, section (from 0), heading (null before the first one), body; headings in code fences don't count, empty
    sections are dropped. One shuffle by key: all that follows reuses its partitioning."""
    line = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    run = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fence = line.startswith("```") | line.startswith("~~~")
    lines = lines.withColumn("fences", F.sum(fence.cast("int")).over(run))
    is_heading = ~fence & (F.col("fences") % 2 == 0) & line.rlike(r"(?U)^#{1,6}\s+.+$")
    lines = lines.withColumn("heading", F.when(is_heading, F.trim(F.regexp_extract(line, r"(?U)^#{1,6}\s+(.+)$", 1))))
    lines = lines.withColumn("section", F.sum(F.col("heading").isNotNull().cast("int")).over(run))
    ordered = F.array_sort(F.collect_list(F.when(F.col("heading").isNull(), F.struct("pos", "line"))))
    out = lines.groupBy(key, "section").agg(F.max("heading").alias("heading"), F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("body"))
    out = out.withColumn("body", F.regexp_replace("body", r"(?U)^\s+|\s+$", ""))
    return out.where(F.col("heading").isNotNull() | (F.col("body") != ""))


def header_windows(df: DataFrame, key: str, text: str, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """Key, ordinal, piece: windows of each section with its heading in front; a heading without body stays."""
    found = sections(df, key, text)
    cut = F.when(F.col("body") == "", F.array(F.lit(""))).otherwise(token_windows(F.col("body"), target, overlap))
    pieces = found.select(key, "section", "heading", F.posexplode(cut).alias("n", "window"))
    piece = F.trim(F.concat(F.coalesce(F.concat("heading", F.lit("\n")), F.lit("")), "window"))
    pieces = pieces.withColumn("piece", F.regexp_replace(piece, r"(?U)^\s+|\s+$", "")).where("piece <> ''")
    order = Window.partitionBy(key).orderBy("section", "n")
    return pieces.select(key, (F.row_number().over(order) - 1).alias("ordinal"), "piece")


def chunk_documents(docs: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """chunk_id, doc_id, title, url, space, ordinal, text of every document (doc_id, title, url, space, body,
    content_type). HTML is cleaned, other types are only normalised; HTML and markdown are cut at headings. The title stands in front of each piece. Documents without text have no rows.

    Plain text is chunked row by row; only the types with headings are shuffled.
    """
    check_window(target, overlap)
    meta = ["doc_id", "title", "url", "space"]
    # windows set one blank between words, so white space needs no normalising before
    plain = docs.where("content_type = 'text'").select(*meta, F.posexplode(token_windows(without_controls(F.col("body")), target, overlap)).alias("ordinal", "piece"))
    clean = F.when(F.col("content_type") == "html", clean_html(F.col("body"))).otherwise(normalise_ws(F.col("body")))
    headed = docs.where("content_type <> 'text'").withColumn("clean", clean)
    pieces = header_windows(headed, "doc_id", "clean", target, overlap).join(headed.select(*meta), "doc_id")
    both = plain.unionByName(pieces.select(*meta, "ordinal", "piece"))
    text = F.when(F.coalesce("title", F.lit("")) == "", F.col("piece")).otherwise(F.concat("title", F.lit("\n"), "piece"))
    return both.select(F.concat("doc_id", F.lit("#"), F.col("ordinal").cast("string")).alias("chunk_id"), *meta, F.col("ordinal").cast("int").alias("ordinal"), text.alias("text"))


def cap_chunks(chunks: DataFrame, most: int = MOST_CHUNKS) -> tuple[DataFrame, DataFrame]:
    """Chunks of documents with at most `most` pieces, and the other documents with their counts."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("pieces"))
    large = counts.where(F.col("pieces") > most)
    return chunks.join(large, "doc_id", "left_anti"), large
