"""Centroid clustering in whole numbers, with centroids filtered by n-simplex projection.

Pivots are a few spread-out vectors. Every vector's distances to them are turned once into the coordinates of an apex
over the pivots' simplex, and kept: the first coordinates place the apex's foot in the pivots' space, the last one is
its height. For two apexes the Euclidean distance is a lower bound of the vectors' distance, and with one height turned
downwards an upper bound. In each round a centroid whose lower bound is above the least upper bound is out; between
those that are left, squared distances are compared as whole numbers, so the filter changes the work, never the result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.llm.common import Scratch, small_batches
from groundspark.llm.integers import SCALE, exact_sums, integer_vectors, matrix

CLUSTERS, ROUNDS, WIDTH = 8, 10, 64
#: Pivots at most, and vectors (those of the smallest hashes) that they and the first centroids are chosen from.
PIVOTS, CANDIDATES = 16, 256
#: A pivot's height over the others' simplex, as a share of the longest distance: lower ones make bounds imprecise.
LEAST_HEIGHT = 0.02
#: Share of the squared distances that bounds may be wrong by; rounding makes about a thousandth of it.
SLACK = 1e-9
ROWS = 4096


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x (n x d) to those of y (k x d), exact."""
    return np.stack([((x - c) ** 2).sum(1) for c in y], axis=1)


class Simplex:
    """Pivots in their own coordinates: the first at the origin, the others below one another in a triangular matrix."""

    def __init__(self, candidates: np.ndarray, most: int = PIVOTS) -> None:
        """Choose pivots among the candidates: the first one, then always the one highest over those chosen."""
        self.pivots = candidates[:1].astype(np.int64)
        self.base = np.zeros((0, 0))
        longest = np.sqrt(squared(candidates, self.pivots)[:, 0].max())
        while len(self.pivots) < most and longest > 0:
            foot, height = self.apex(candidates)
            best = int(height.argmax())
            if height[best] < LEAST_HEIGHT * longest:
                break
            base = np.zeros((len(self.base) + 1, len(self.base) + 1))
            base[:-1, :-1] = self.base
            base[-1] = np.append(foot[best], height[best])
            self.base, self.pivots = base, np.vstack([self.pivots, candidates[best]])

    def apex(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Foot (n x pivots - 1) and height (n) of every row, from its distances to the pivots alone."""
        d = squared(x, self.pivots).astype(np.float64)
        right = (d[:, :1] - d[:, 1:] + (self.base**2).sum(1)) / 2
        foot = np.zeros_like(right)
        for j in range(right.shape[1]):  # forward substitution
            foot[:, j] = (right[:, j] - foot[:, :j] @ self.base[j, :j]) / self.base[j, j]
        return foot, np.sqrt(np.maximum(d[:, 0] - (foot**2).sum(1), 0))


def open_centroids(apexes: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Which centroids (columns) each row may be nearest to. apexes: foot and height of the rows; centres: of the centroids."""
    base = np.stack([((apexes[:, :-1] - c[:-1]) ** 2).sum(1) for c in centres], axis=1)
    lower = base + (apexes[:, -1:] - centres[:, -1]) ** 2
    upper = (base + (apexes[:, -1:] + centres[:, -1]) ** 2).min(1, keepdims=True)
    size = (apexes**2).sum(1, keepdims=True) + (centres**2).sum(1).max()
    return lower <= upper + SLACK * size + 1


def nearest(x: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, centres: np.ndarray, distances: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's nearest centroid, the smaller one of equals, and its squared distance. Without `distances`
    rows with one open centroid get it uncompared."""
    left = open_centroids(apexes, centres)
    far = np.iinfo(np.int64).max
    exact = np.full(left.shape, far)
    several = left if distances else left & (left.sum(1, keepdims=True) > 1)
    for k in range(len(centroids)):
        rows = np.flatnonzero(several[:, k])
        exact[rows, k] = ((x[rows] - centroids[k]) ** 2).sum(1)
    number = exact.argmin(1)
    if not distances:
        alone = ~several.any(1)
        number[alone] = left[alone].argmax(1)
    return number, exact[np.arange(len(x)), number]


def _stored(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return matrix(batch.column(1), batch.num_rows).astype(np.int64), matrix(batch.column(2), batch.num_rows)


def with_apexes(rows: DataFrame, simplex: Simplex) -> DataFrame:
    """id, x (array<int>), apex (array<double>)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1), batch.num_rows)
                foot, height = simplex.apex(x)
                apex = np.column_stack([foot, height])
                ends = [pa.array(np.arange(batch.num_rows + 1) * m.shape[1], pa.int32()) for m in (x, apex)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends[0], pa.array(x.ravel().astype(np.int32))), pa.ListArray.from_arrays(ends[1], pa.array(apex.ravel()))], names=["id", "x", "apex"])

    return rows.mapInArrow(run, "id long, x array<int>, apex array<double>")


def moved(stored: DataFrame, simplex: Simplex, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor(sum / count) of their vectors' components, exact; without vectors, unmoved.

    A task adds its vectors up, so at most one row a centroid and component leaves it."""
    centres = np.column_stack(simplex.apex(centroids))
    k, width = centroids.shape

    def run(batches):
        sums, seen = np.zeros((k, width + 1), np.int64), False
        for batch in batches:
            if batch.num_rows:
                x, apexes = _stored(batch)
                number, _ = nearest(x, apexes, centroids, centres, distances=False)
                for c in np.unique(number):
                    own = x[number == c]
                    sums[c, :-1] += own.sum(0)
                    sums[c, -1] += len(own)
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), width + 1), pa.int32()), pa.array(np.tile(np.arange(width + 1), k), pa.int32()), pa.array(sums.ravel())], names=["cluster", "at", "value"])

    total = exact_sums(stored.mapInArrow(run, "cluster int, at int, value long"), ["cluster", "at"])
    out = centroids.copy()
    for c in range(k):
        if total.get((c, width)):
            out[c] = [total[c, i] // total[c, width] for i in range(width)]
    return out


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 3, pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray]:
    """id, cluster (int), distance (long, squared) of every vector that takes part, and the final centroids.

    Vectors become whole numbers (integers.integer_vectors says which take part). The first centroids are the vectors
    with the smallest sha256 of "<seed>:<id>"; of repeated ids in order of their components; null ids come last. With
    fewer vectors than clusters each is a centroid. Equal distances go to the smaller number; an empty centroid stays.
    An empty table gives no rows and no centroids. Vectors are stored once with their apexes, in the shared folder.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = integer_vectors(vectors, id_col, vec_col, width)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(F.asc_nulls_last(hashed), "x").limit(max(CANDIDATES, clusters)).select("x").collect()
    if not first:
        return spark.createDataFrame([], "id long, cluster int, distance long"), np.zeros((0, width), np.int64)
    candidates = np.array([r["x"] for r in first], np.int64)
    centroids, simplex = candidates[:clusters], Simplex(candidates[:CANDIDATES], pivots)
    scratch = Scratch(spark, "centroids")
    stored = scratch.write(with_apexes(rows, simplex), "vectors")
    for _ in range(rounds):
        new = moved(stored, simplex, centroids)
        if (new == centroids).all():  # later rounds would change nothing either
            break
        centroids = new
    final, centres = centroids, np.column_stack(simplex.apex(centroids))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, apexes = _stored(batch)
                number, distance = nearest(x, apexes, final, centres)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    out = scratch.write(stored.mapInArrow(run, "id long, cluster int, distance long"), "assigned")
    scratch.drop("vectors")
    return out, centroids


def report(vectors: DataFrame) -> DataFrame:
    """Rows of query op11: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256. Sums that don't fit a long
    are null."""
    assigned, centroids = cluster(vectors)
    held = exact_sums(assigned.select("cluster", F.col("distance").alias("value")), ["cluster"])
    long = lambda n: n if n < 1 << 63 else None
    told = [(c, long(held.get((c,), 0)), long(sum(held.values())), hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest()) for c, v in enumerate(centroids)]
    # one row for each cluster
    about = vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _report_sql() -> str:
    """The same in DuckDB: all distances, round by round."""
    parts = [
        f"v0 AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, x AS c FROM v0 ORDER BY sha256('3:' || vec_id) LIMIT {CLUSTERS})",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, x, k, d FROM (SELECT vec_id, x, k, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS n FROM (
            SELECT vec_id, x, k, list_sum(list_transform(range(1, {WIDTH + 1}), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d FROM v0, c{i})) WHERE n = 1)""")
        if i < ROUNDS:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT o.k, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN (SELECT k, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY i) AS c FROM (
                SELECT k, i, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT k, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{i}) GROUP BY k, i) GROUP BY k) m ON m.k = o.k)""")
    return f"""WITH {', '.join(parts)}
        SELECT vec_id, a.k::INT AS "cluster", d AS distance, sum(d) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.k = a.k"""


REPORT_SQL = _report_sql()
