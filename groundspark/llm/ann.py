"""Nearest neighbours by inner product: score-aware anisotropic quantisation, four-bit table scans, exact reranking.

A vector is split into pairs of components, each coded by one of 16 centres. The loss weighs the part of the residual
that is parallel to the vector PARALLEL times as much as the orthogonal part, for it is the parallel part that changes
large inner products. Codebooks are fitted on a bounded sample; every row is coded. A search looks up a query's
products with the centres, adds them over each row's codes, and ranks the best rows of every shard again by the exact
inner product of the original vectors.

The rows lie in shards, the queries in blocks, both of bounded size; each block meets each shard once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundspark.llm.common import sampled, small_batches, written

#: Rows that the codebooks are fitted on, about, and rounds of fitting.
SAMPLE_ROWS, ROUNDS = 8000, 8
CENTRES = 16
#: Inner products above this share of a vector's length are those that should come out right.
THRESHOLD = 0.2
SHARD_ROWS, BLOCK_QUERIES = 4096, 1024
#: Rows of a shard that are ranked again for each query, at least.
RERANKED = 120


@dataclass
class Quantiser:
    centres: np.ndarray  # pairs x CENTRES x 2
    extra: float  # weight of the parallel part beyond that of the rest

    def _pairs(self, x: np.ndarray) -> np.ndarray:
        if x.shape[1] % 2:
            x = np.pad(x, ((0, 0), (0, 1)))
        return x.reshape(len(x), -1, 2).astype(np.float64)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows x pairs) by coordinate descent on the anisotropic loss, from the nearest centres."""
        parts = self._pairs(x)
        length = np.sqrt((parts**2).sum((1, 2), keepdims=True))
        unit = parts / np.maximum(length, 1e-30)
        codes = np.empty(parts.shape[:2], np.uint8)
        for s in range(parts.shape[1]):
            codes[:, s] = ((parts[:, s, None] - self.centres[s]) ** 2).sum(2).argmin(1)
        chosen = self.centres[np.arange(parts.shape[1]), codes]
        along = (unit * (parts - chosen)).sum((1, 2))
        for _ in range(sweeps):
            for s in range(parts.shape[1]):
                residual = parts[:, s, None] - self.centres[s]
                part = (unit[:, s, None] * residual).sum(2)
                rest = along - part[np.arange(len(x)), codes[:, s]]
                loss = (residual**2).sum(2) + self.extra * (rest[:, None] + part) ** 2
                codes[:, s] = loss.argmin(1)
                along = rest + part[np.arange(len(x)), codes[:, s]]
        return codes

    def refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Best centres for the codes: for each centre a linear system of two unknowns."""
        parts = self._pairs(x)
        unit = parts / np.maximum(np.sqrt((parts**2).sum((1, 2), keepdims=True)), 1e-30)
        along = (unit * (parts - self.centres[np.arange(parts.shape[1]), codes])).sum((1, 2))
        for s in range(parts.shape[1]):
            u, p, own = unit[:, s], parts[:, s], self.centres[s][codes[:, s]]
            rest = along - (u * (p - own)).sum(1)
            outer = np.eye(2) + self.extra * u[:, :, None] * u[:, None, :]
            right = p + self.extra * u * (rest + (u * p).sum(1))[:, None]
            for k in range(CENTRES):
                some = codes[:, s] == k
                if some.any():
                    self.centres[s, k] = np.linalg.solve(outer[some].sum(0), right[some].sum(0))
            along = rest + (u * (p - self.centres[s][codes[:, s]])).sum(1)


def fit_sample(x: np.ndarray, threshold: float = THRESHOLD, rounds: int = ROUNDS, seed: int = 5) -> Quantiser:
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    extra = max(0.0, (width - 1) * threshold**2 / (1 - threshold**2) - 1)
    out = Quantiser(np.zeros((-(-width // 2), CENTRES, 2)), extra)
    parts = out._pairs(x)
    for s in range(parts.shape[1]):
        out.centres[s] = parts[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES), s]
    for _ in range(rounds):
        out.refit(x, out.encode(x, sweeps=1))
    return out


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec (array<double>) of rows that take part: an id, a vector without nulls, NaN or infinity, not all 0, and of
    the width that most such rows have (the larger one of equals)."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = v.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~bad & F.exists("vec", lambda c: c != 0))
    widths = v.groupBy(F.size("vec").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).limit(1).collect()
    return v.where(F.size("vec") == (widths[0]["w"] if widths else 0))


def fit(rows: DataFrame, count: int, sample_rows: int = SAMPLE_ROWS) -> Quantiser | None:
    """Fit on about sample_rows rows, chosen by a hash of the id: the same at every run. A repeated id counts once, with
    its greatest vector."""
    rate = min(1.0, sample_rows / max(1, count))
    some = rows.where(sampled(F.col("id"), rate)).groupBy("id").agg(F.max("vec").alias("vec"))
    found = sorted(some.toArrow().to_pylist(), key=lambda r: (r["id"], r["vec"]))
    return fit_sample(np.array([r["vec"] for r in found])) if found else None


def _stacked(batches) -> tuple[np.ndarray, np.ndarray] | None:
    ids, vectors = [], []
    for batch in batches:
        if batch.num_rows:
            ids.append(batch.column(0).to_numpy())
            vectors.append(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1))
    if not ids:
        return None
    ids, vectors = np.concatenate(ids), np.concatenate(vectors)
    order = np.lexsort((*vectors.T[::-1], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
    return ids[order], vectors[order]


def index(rows: DataFrame, count: int, quantiser: Quantiser) -> tuple[DataFrame, int]:
    """Every row coded, in shards: shard, ids, codes (two in a byte), vectors (original, as doubles); and the number of
    shards. Rows are dealt evenly, so copies of a vector spread over the shards."""
    shards = max(1, -(-count // SHARD_ROWS))
    sent = rows.sparkSession.sparkContext.broadcast(quantiser)

    def run(batches):
        found = _stacked(batches)
        if found is not None:
            ids, vectors = found
            codes = sent.value.encode(vectors)
            if codes.shape[1] % 2:
                codes = np.pad(codes, ((0, 0), (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([ids.astype("<i8").tobytes()]), pa.array([(codes[:, ::2] | codes[:, 1::2] << 4).tobytes()]), pa.array([vectors.astype("<f8").tobytes()])], names=["shard", "ids", "codes", "vectors"])

    return written(rows.repartition(shards).mapInArrow(run, "shard int, ids binary, codes binary, vectors binary"), "ann-index"), shards


def query_blocks(queries: DataFrame, count: int) -> DataFrame:
    """Queries in blocks: q_ids, q_vectors."""

    def run(batches):
        found = _stacked(batches)
        if found is not None:
            ids, vectors = found
            for at in range(0, len(ids), BLOCK_QUERIES):
                part = slice(at, at + BLOCK_QUERIES)
                yield pa.RecordBatch.from_arrays([pa.array([ids[part].astype("<i8").tobytes()]), pa.array([vectors[part].astype("<f8").tobytes()])], names=["q_ids", "q_vectors"])

    return queries.repartition(max(1, -(-count // BLOCK_QUERIES))).mapInArrow(run, "q_ids binary, q_vectors binary")


def scan(quantiser: Quantiser, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Approximate inner products of queries and coded rows, as whole numbers: 8-bit tables of both codes of a byte."""
    parts = quantiser._pairs(queries)
    tables = np.einsum("qpd,pcd->qpc", parts, quantiser.centres)
    if tables.shape[1] % 2:
        tables = np.pad(tables, ((0, 0), (0, 1), (0, 0)))
    low = tables.min(2, keepdims=True)
    step = np.maximum((tables - low).max((1, 2), keepdims=True), 1e-30) / 255
    small = np.rint((tables - low) / step).astype(np.uint16)
    both = small[:, 1::2, :, None] + small[:, ::2, None, :]
    both = both.reshape(len(queries), both.shape[1], CENTRES * CENTRES)
    out = np.zeros((len(queries), len(codes)), np.uint16 if both.shape[1] <= 128 else np.uint32)
    for byte in range(codes.shape[1]):
        out += np.take(both[:, byte], codes[:, byte], axis=1)
    return out


def search(quantiser: Quantiser, q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, codes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k rows of a shard for each query: query id, row id, exact score; a row with the query's id is left out.

    The rows are in order of id, and equal approximate products are taken in that order, so among copies of a vector
    the smaller ids come first.
    """
    keep = min(len(ids), max(RERANKED, 3 * k))
    found: list[list[np.ndarray]] = [[], [], []]
    place = np.arange(len(ids))[::-1]
    for at in range(0, len(q), 64):
        part, own = q[at : at + 64], q_ids[at : at + 64]
        rough = scan(quantiser, part, codes).astype(np.int64)
        rough[own[:, None] == ids[None]] = -1
        key = rough * len(ids) + place
        best = np.argpartition(-key, keep - 1, axis=1)[:, :keep] if keep < len(ids) else np.tile(np.arange(len(ids)), (len(part), 1))
        exact = np.einsum("qkd,qd->qk", rows[best], part)
        exact[own[:, None] == ids[best]] = -np.inf
        order = np.lexsort((ids[best], -exact), axis=1)[:, :k]
        score = np.take_along_axis(exact, order, 1)
        real = np.isfinite(score)
        found[0].append(np.repeat(own, order.shape[1]).reshape(score.shape)[real])
        found[1].append(np.take_along_axis(ids[best], order, 1)[real])
        found[2].append(score[real])
    return tuple(np.concatenate(x) for x in found)


def neighbours(vectors: DataFrame, is_query, k: int, id_col: str = "vec_id", vec_col: str = "embedding", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The k rows of largest inner product found for each query row: query_id, rank (from 1), vec_id, score.

    is_query is a condition over id. Equal scores are ranked by the smaller id; rows with the query's own id don't
    count; with fewer candidates all are returned. Null ids, and vectors that are null, zero, of another width than
    most, or that hold null or non-finite components, take no part. Equal rows each count.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = valid(vectors, id_col, vec_col)
    count = rows.count()
    quantiser = fit(rows, count, sample_rows)
    schema = "query_id long, vec_id long, score double"
    if quantiser is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards, n_shards = index(rows, count, quantiser)
    asked = rows.where(is_query)
    blocks = query_blocks(asked, asked.count())
    pairs = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).join(shards, "shard")
    sent = spark.sparkContext.broadcast(quantiser)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                raw = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                ids, q_ids = np.frombuffer(raw["ids"], "<i8"), np.frombuffer(raw["q_ids"], "<i8")
                q = np.frombuffer(raw["q_vectors"], "<f8").reshape(len(q_ids), -1)
                own = np.frombuffer(raw["vectors"], "<f8").reshape(len(ids), -1)
                codes = np.frombuffer(raw["codes"], np.uint8).reshape(len(ids), -1)
                a, b, score = search(sent.value, q_ids, q, ids, codes, own, k)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])

    found = pairs.select("q_ids", "q_vectors", "ids", "codes", "vectors").mapInArrow(run, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(vectors: DataFrame) -> DataFrame:
    """The 20 nearest rows of every row whose id is divisible by 20, in the form of query op10."""
    return neighbours(vectors, F.col("id") % 20 == 0, k=20)
