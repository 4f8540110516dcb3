"""Exact substring dedup: seed on winnowed anchors, extend, keep the maximal repeats.

Winnowing picks anchors: of every window of WINDOW words, the least hash among its SEED-word runs (the last of equal
ones). Equal windows thus have the same anchor at the same place. Occurrences of equal anchors are brought together;
each carries the hashes of the windows that it anchors, so extending a match to both sides means comparing these place
by place. Of equal windows all but the first (by document, then start) are repeats; what adjoining repeats cover is
removed. One shuffle deals anchors by their hash, a second one brings a document's repeats to its text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundspark.llm.common import annotate, flat_rows, fresh_names
from groundspark.llm.hashed import WordHashes, runs

WINDOW, SEED = 20, 8
#: Bytes of a window's hash that travel; the anchor's own 8 bytes come on top.
HASH_BYTES = 5


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, unchanged."""
    return text.encode("utf-8", "replace").split() if text else []


def winnowed(words: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the seed runs, and for every window the place of its anchor."""
    seeds = runs(words, seed)
    span = window - seed + 1
    n = len(words) - window + 1
    if n <= 0:
        return seeds, np.zeros(0, np.int64)
    least = seeds[:n].copy()
    for i in range(1, span):
        np.minimum(least, seeds[i : i + n], out=least)
    place = np.zeros(n, np.int64)
    for i in range(span):
        place = np.where(seeds[i : i + n] == least, i, place)
    return seeds, place + np.arange(n)


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Anchor occurrences: anchor, doc and row (a hash of the text, for equal ids), first (start of the first window that it anchors), ahead
    (words from there to the anchor) and the hashes of these adjoining windows."""
    kind = dict(docs.dtypes)[id_col]
    schema = f"anchor long, doc {kind}, row int, first int, ahead int, windows binary"

    def make():
        hashes = WordHashes()

        def rows(texts: list[str | None], part: pa.RecordBatch) -> pa.RecordBatch:
            owner, keys, first, ahead, payload = [], [], [], [], []
            for d, text in enumerate(texts):
                words = split_words(text)
                if len(words) < window:
                    continue
                own = hashes.of(words)
                seeds, place = winnowed(own, window, seed)
                whole = np.frombuffer(runs(own, window).astype("<u8").tobytes(), np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()
                starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
                ends = np.append(starts[1:], len(place))
                at = place[starts]
                owner += [d] * len(starts)
                keys.append(seeds[at].view(np.int64))
                first.append(starts)
                ahead.append(at - starts)
                payload += [whole[HASH_BYTES * a : HASH_BYTES * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            join = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
            own = pa.array(owner, pa.int64())
            return pa.RecordBatch.from_arrays([join(keys, pa.int64()), part.column(0).take(own), part.column(2).take(own), join(first, pa.int32()), join(ahead, pa.int32()), pa.array(payload, pa.binary())], names=["anchor", "doc", "row", "first", "ahead", "windows"])

        return rows

    return flat_rows(docs.select(id_col, text_col, "row"), text_col, schema, make)


def repeats(found: DataFrame) -> DataFrame:
    """Windows that start earlier elsewhere: doc, row, and for each anchor occurrence `first` with a bit for each repeat.

    Anchors that occur once are dropped right after the shuffle. Equal windows meet in their anchor's partition, where
    a running rank in the order of document and start marks all but the first; the sort spills, no group is held.
    """
    together = Window.partitionBy("anchor").orderBy("doc", "row", "first")
    near = found.withColumn("_before", F.lag("row").over(together)).withColumn("_after", F.lead("row").over(together))
    shared = near.where(F.col("_before").isNotNull() | F.col("_after").isNotNull()).drop("_before", "_after")
    n = (F.length("windows") / HASH_BYTES).cast("int")
    places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), (F.col("ahead") - i).alias("place"), F.substring(F.col("windows"), F.lit(HASH_BYTES) * i + 1, F.lit(HASH_BYTES)).alias("hash")))
    each = shared.select("anchor", "doc", "row", "first", F.explode(places).alias("w")).select("anchor", "doc", "row", "first", "w.*")
    equal = Window.partitionBy("anchor", "place", "hash").orderBy("doc", "row", "first", "i")
    again = each.withColumn("_rank", F.dense_rank().over(equal)).where("_rank > 1")
    return again.groupBy("anchor", "doc", "row", "first").agg(F.expr("bit_or(shiftleft(1L, i))").alias("bits")).select("doc", "row", "first", "bits")


def _covered(n: int, marks: list[dict] | None, window: int) -> np.ndarray:
    cover = np.zeros(n + 1, np.int64)
    for m in marks or ():
        bits, at = m["bits"], m["first"]
        while bits:
            if bits & 1:
                cover[at] += 1
                cover[min(n, at + window)] -= 1
            bits >>= 1
            at += 1
    return np.cumsum(cover[:n]) > 0


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED) -> tuple[DataFrame, list[str]]:
    """Append n_words, n_removed, kept (the words left, joined by one space) and spans (start and length in words of
    each maximal repeat); returns the table and the four columns' names.

    A window of `window` words is a repeat where its words also start earlier: in a smaller document, or earlier in the
    same one. Rows with equal ids count in the order of a hash of their text, null ids first; of rows that are equal in
    both, all but one lose every window. Null texts, and texts of fewer words than a window, lose nothing.
    """
    # the table's own columns travel in one, so that none can clash
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.lit(0).alias("_")).alias("row_")
    rows = docs.select(own, F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.hash(text_col).alias("row"))
    marks = repeats(anchors(rows, "doc", "text", window, seed))
    key = lambda doc, row: F.xxhash64(doc, row)  # noqa: E731  one column, so that the twins' window needs no further shuffle
    per_row = marks.groupBy(key("doc", "row").alias("mark_key"), F.col("doc").alias("mark_doc")).agg(F.collect_list(F.struct("first", "bits")).alias("marks"))
    same = F.coalesce(F.col("doc") == F.col("mark_doc"), F.col("doc").isNull() & F.col("mark_doc").isNull())
    joined = rows.withColumn("key", key("doc", "row")).join(per_row, (F.col("key") == F.col("mark_key")) & same, "left").drop("mark_doc", "mark_key")
    twins = Window.partitionBy("key", "doc", F.xxhash64("text")).orderBy("key")
    joined = joined.withColumn("twin", F.row_number().over(twins) > 1)
    names = fresh_names(docs, ["n_words", "n_removed", "kept", "spans"])
    at, twin = joined.columns.index("marks"), joined.columns.index("twin")

    def make():
        def judge(texts: list[str | None], part: pa.RecordBatch) -> list[pa.Array]:
            counts, removed, kept, spans = [], [], [], []
            for text, marks, again in zip(texts, part.column(at).to_pylist(), part.column(twin).to_pylist(), strict=True):
                words = split_words(text)
                cover = np.full(len(words), len(words) >= window) if again else _covered(len(words), marks, window)
                counts.append(len(words))
                removed.append(int(cover.sum()))
                kept.append(b" ".join(w for w, c in zip(words, cover.tolist(), strict=True) if not c).decode("utf-8") if removed[-1] else b" ".join(words).decode("utf-8"))
                edge = np.flatnonzero(np.diff(np.concatenate([[False], cover, [False]]).astype(np.int8)))
                spans.append([{"start": int(a), "length": int(b - a)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
            span = pa.struct([("start", pa.int64()), ("length", pa.int64())])
            return [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(span))]

        return judge

    fields = list(zip(["n_words", "n_removed", "kept", "spans"], ["long", "long", "string", "array<struct<start:long,length:long>>"], strict=True))
    marked = annotate(joined, "text", fields, make)
    back = [F.col("text").alias(c) if c == text_col else F.col("row_").getField(c).alias(c) for c in docs.columns]
    return marked.select(*back, *(F.col(n).alias(new) for new, (n, _) in zip(names, fields, strict=True))), names


def report(docs: DataFrame) -> DataFrame:
    """One row per document, in the form of query op8."""
    out, _ = dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


REPORT_SQL = r"""
WITH words AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM words WHERE len(w) >= 20),
windows AS (SELECT doc_id, s, row_number() OVER (PARTITION BY list_slice(w, s, s + 19) ORDER BY doc_id, s) AS nth FROM starts),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM windows WHERE nth > 1),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
kept AS (
  SELECT e.doc_id, count(g.i) AS n_removed, coalesce(string_agg(e.word, ' ' ORDER BY e.i) FILTER (WHERE g.i IS NULL), '') AS text
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
