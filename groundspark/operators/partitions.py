"""Approximate nearest neighbours from vectors stored by learned partitions.

A bounded sample of unit vectors is halved again and again, the largest part first, so parts are balanced; all vectors
go to the nearest part and are stored in order of part. A question asks the parts of the nearest centres first; its k-th
best cosine there is what others must reach. How many vectors of a part can be expected to reach it follows from the
part's size, its mean angle, and how evenly the vectors' rests behind the centre spread: a rest's cosine to the question
is nearly normal, with the inverse of the rests' effective dimension as its variance. Parts are asked until what is
expected in the others is below the share of neighbours that may be missed. With a share of 0 a part is left out only if
its largest angle excludes that any of its vectors reaches the cosine: nothing is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.operators.vectors import Nearest, PRODUCTS, comparable, question_blocks, ranked, unit_rows, vector_ids
from groundspark.sources.scratch import written

#: Vectors that parts are learned from, about, and parts at most; there are as many as the root of the rows.
SAMPLE_ROWS, MOST_PARTS = 20_000, 1024
#: Share of the neighbours that may be missed, as expected, and of the parts that every question asks first.
MISSED, FIRST = 0.1, 0.05
_SLACK = 1e-7


def halved(sample: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """Unit centres of parts of a sample of unit vectors: the largest is always cut at the median between two means."""
    rng, groups = np.random.default_rng(seed), [np.arange(len(sample))]
    while len(groups) < parts and len(groups[0]) > 1:
        own = groups.pop(0)
        x = sample[own]
        a, b = x[rng.choice(len(own), 2, replace=False)]
        for _ in range(5):
            side = x @ (a - b)
            order = np.argsort(side, kind="stable")
            low, high = order[: len(own) // 2], order[len(own) // 2 :]
            a, b = x[high].mean(0), x[low].mean(0)
        groups = sorted([*groups, own[low], own[high]], key=lambda g: -len(g))
    return _unit(np.array([sample[g].mean(0) for g in groups]))


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length == 0, 1, length)


@dataclass
class Partitions:
    """rows: part, angle, chunk_id, embedding in order of part; by part its centre, size, largest and mean angle; and the
    effective dimension of what vectors have besides their centre."""

    rows: DataFrame
    centres: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray
    angles: np.ndarray
    dimension: float
    width: int

    def bounds(self, questions: np.ndarray) -> np.ndarray:
        """The best cosine that any vector of a part can have (questions x parts)."""
        angle = np.arccos(np.clip(questions @ self.centres.T, -1, 1))
        return np.cos(np.maximum(0, angle - self.radii))

    def expected(self, questions: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """How many vectors of a part can be expected to have a cosine of at least `floor` (questions x parts)."""
        near = np.clip(questions @ self.centres.T, -1, 1)
        spread = np.sin(self.angles) * np.sqrt(1 - near**2) / np.sqrt(self.dimension)
        away = (floor[:, None] - near * np.cos(self.angles)) / np.maximum(spread, 1e-12)
        return self.sizes * 0.5 * _erfc(away / np.sqrt(2))


_erfc = np.frompyfunc(math.erfc, 1, 1)


def _effective_dimension(sample: np.ndarray, centres: np.ndarray) -> float:
    """The inverse of the mean squared cosine between the rests of two vectors of one part."""
    part = (sample @ centres.T).argmax(1)
    rest = _unit(sample - (sample * centres[part]).sum(1, keepdims=True) * centres[part])
    squares = pairs = 0.0
    for k in np.unique(part):
        own = rest[part == k]
        squares += ((own.T @ own) ** 2).sum() - len(own)
        pairs += len(own) * (len(own) - 1)
    return float(np.clip(pairs / squares, 1, sample.shape[1])) if squares > 0 else 1.0


def partitioned(chunks: DataFrame, width: int = 64, parts: int | None = None, sample_rows: int = SAMPLE_ROWS) -> Partitions:
    """Learn partitions and store the vectors by them. Chunks whose vector is null, of another width or holds null
    components take no part. A part may hold any share of the rows: it is cut into tasks by a hash of the id."""
    spark = chunks.sparkSession
    rows = comparable(chunks.select("chunk_id", "embedding"), width)
    n = rows.count()
    if not n:
        return Partitions(rows.select(F.lit(0).alias("part"), F.lit(0.0).alias("angle"), "*"), np.zeros((0, width)), np.zeros(0, np.int64), np.zeros(0), np.zeros(0), 1.0, width)
    chosen = F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 40)) < F.lit(int(min(1.0, sample_rows / n) * (1 << 40)))
    some = rows.where(chosen).limit(2 * sample_rows).toArrow().sort_by("chunk_id")
    sample = unit_rows(some["embedding"], width) if some.num_rows else np.eye(1, width)
    centres = halved(sample, parts or int(np.clip(np.sqrt(n), 1, MOST_PARTS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = unit_rows(batch.column(1), width) @ centres.T if batch.num_rows else np.zeros((0, len(centres)))
            part = near.argmax(1) if len(near) else np.zeros(0, np.int64)
            angle = np.arccos(np.clip(near[np.arange(len(near)), part], -1, 1))
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(angle), *batch.columns], names=["part", "angle", "chunk_id", "embedding"])

    dealt = rows.mapInArrow(run, "part int, angle double, chunk_id string, embedding array<float>")
    stored = written(dealt.repartitionByRange("part", F.xxhash64("chunk_id")).sortWithinPartitions("part"), "partitions")
    # one row a part
    about = stored.groupBy("part").agg(F.count("*").alias("n"), F.max("angle").alias("most"), F.avg("angle").alias("mean")).collect()
    sizes, radii, angles = np.zeros(len(centres), np.int64), np.zeros(len(centres)), np.zeros(len(centres))
    for r in about:
        sizes[r["part"]], radii[r["part"]], angles[r["part"]] = r["n"], r["most"], r["mean"]
    return Partitions(stored, centres, sizes, radii, angles, _effective_dimension(sample, centres), width)


def _scan(index: Partitions, ids: pa.Array, questions: np.ndarray, asks: np.ndarray, pool: int, kind: str, floor: np.ndarray | None = None) -> DataFrame:
    """question_id, chunk_id, vector_score: the best chunks of the parts that each question asks (questions x parts)."""
    spark, width = index.rows.sparkSession, index.width
    sent = spark.sparkContext.broadcast((ids, questions, asks, floor))
    probed = np.flatnonzero(asks.any(0)).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, questions, asks, floor = sent.value
        nearest = Nearest(pool, len(ids), floor)
        for batch in batches:
            part = batch.column(0).to_numpy()
            ends = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for a, b in zip(ends, ends[1:], strict=False):
                which = np.flatnonzero(asks[:, part[a]]) if b > a else ()
                step = max(1, PRODUCTS // max(1, len(which)))
                for at in range(a, b if len(which) else a, step):
                    own = batch.slice(at, min(step, b - at))
                    nearest.add(vector_ids(own.column(1)), unit_rows(own.column(2), width) @ questions[which].T, which)
        yield nearest.batch(ids)

    return index.rows.where(F.col("part").isin(probed)).select("part", "chunk_id", "embedding").mapInArrow(run, f"question_id {kind}, chunk_id string, vector_score double")


def _more(index: Partitions, questions: np.ndarray, floor: np.ndarray, asked: np.ndarray, pool: int, missed: float) -> np.ndarray:
    """Parts that questions ask besides those they have asked."""
    if missed <= 0:
        return (index.bounds(questions) >= floor[:, None] - _SLACK) & ~asked
    expected = np.where(asked, 0, index.expected(questions, floor)).astype(float)
    order = np.argsort(expected, axis=1)  # the least promising ones are left out as long as they hold little together
    left_out = np.cumsum(np.take_along_axis(expected, order, 1), axis=1) <= missed * pool
    more = np.zeros_like(asked)
    np.put_along_axis(more, order, ~left_out, axis=1)
    return more & ~asked


def search(questions: DataFrame, index: Partitions, pool: int, missed: float = MISSED, first: float = FIRST) -> DataFrame:
    """question_id, chunk_id, vector_score, rank: of the parts that a question's bounds call for, the chunks of highest
    cosine. The driver holds a block of questions and their k-th best cosines."""
    kind = dict(questions.dtypes)["question_id"]
    out = questions.sparkSession.createDataFrame([], f"question_id {kind}, chunk_id string, vector_score double, rank int")
    if pool <= 0 or not len(index.centres):
        return out
    for some in question_blocks(comparable(questions, index.width), ["question_id", "embedding"]):
        asked = some.toArrow()
        ids, q = asked["question_id"].combine_chunks(), unit_rows(asked["embedding"], index.width)
        order = np.argsort(-(q @ index.centres.T), axis=1, kind="stable")
        before = np.cumsum(index.sizes[order], axis=1) - index.sizes[order]
        start = (np.arange(len(index.centres)) < max(2, first * len(index.centres))) | (before < 2 * pool)  # surely enough rows
        asks = np.zeros_like(start)
        np.put_along_axis(asks, order, start, axis=1)
        near = written(ranked(_scan(index, ids, q, asks, pool, kind), pool), "probed")
        floors = {r["question_id"]: r["s"] for r in near.where(F.col("rank") == pool).groupBy("question_id").agg(F.min("vector_score").alias("s")).collect()}
        floor = np.array([floors.get(i, -np.inf) for i in ids.to_pylist()])
        more = _more(index, q, floor, asks, pool, missed)
        both = near.drop("rank")
        if more.any():
            both = both.unionByName(_scan(index, ids, q, more, pool, kind, np.round(floor, 9)))
        out = out.unionByName(ranked(both, pool))
    return out


def approx_knn(questions: DataFrame, chunks: DataFrame, pool: int, width: int = 64, missed: float = MISSED) -> DataFrame:
    """C8 over a table of chunks, whose partitions are learned and stored first."""
    return search(questions, partitioned(chunks, width), pool, missed)
