"""Centroid clustering and whitening against plain recomputation in Python's whole numbers and in NumPy."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from groundspark.llm import centroids, integers, queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=300, width=64, seed=1, groups=12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, width))
    return [(i, (centres[i % groups] + 0.3 * r.normal(size=width)).astype(np.float32).tolist(), i % 3) for i in range(n)]


def odd():
    """Null, short, long and empty vectors, null and non-finite components, repeated rows and ids, copies, null ids, huge ones."""
    rows = vectors()
    rows += [(900 + i, rows[0][1], 0) for i in range(20)] + [rows[5], rows[5], (6, rows[9][1], 1), (None, rows[3][1], 1)]
    rows += [(950, [0.0] * 64, 0), (951, [-1.5] * 64, 0), (952, [1.5] * 64, 0)]
    bad = [None, [], [1.0] * 63, [1.0] * 65, [None] + [1.0] * 63, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [-float("inf")] * 64, [1e30] * 64, [131072.0] * 64]
    return rows + [(970 + i, v, 0) for i, v in enumerate(bad)]


def kept(rows, width=64):
    fine = [(i, v) for i, v, _ in rows if v is not None and len(v) == width and None not in v and all(math.isfinite(c) and abs(c) < 131072 for c in v)]
    return [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v in fine]


def brute_clusters(rows, k=8, rounds=10):
    own = kept(rows)
    order = sorted(own, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in order[:k]]
    distance = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    best = lambda v: min((distance(v, c), i) for i, c in enumerate(centres))
    for _ in range(rounds):
        held = {}
        for _, v in own:
            held.setdefault(best(v)[1], []).append(v)
        centres = [[sum(x) // len(held[i]) for x in zip(*held[i], strict=True)] if i in held else c for i, c in enumerate(centres)]
    out = [(i, *best(v)[::-1]) for i, v in own]
    inertia = {c: sum(d for _, n, d in out if n == c) for c in range(k)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in out]


def key(row):
    return tuple((x is None, x or 0) if not isinstance(x, str) else x for x in row)


def test_clusters_with_odd_rows(spark):
    rows = odd()
    got = [tuple(r) for r in centroids.report(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()]
    assert sorted(got, key=key) == sorted(brute_clusters(rows), key=key)


def test_fewer_vectors_than_clusters_and_none(spark):
    few = vectors(3)
    got = [tuple(r) for r in centroids.report(spark.createDataFrame(few, SCHEMA)).collect()]
    assert sorted(got) == sorted(brute_clusters(few)) and {r[2] for r in got} == {0}
    copies = [(i, [0.25] * 64, 0) for i in range(30)]
    assert {tuple(r)[1:5] for r in centroids.report(spark.createDataFrame(copies, SCHEMA)).collect()} == {(0, 0, 0, 0)}
    assert centroids.report(spark.createDataFrame([], SCHEMA)).collect() == []
    assert centroids.report(spark.createDataFrame([(1, None, 0)], SCHEMA)).collect() == []


def test_columns_of_clashing_names(spark):
    rows = vectors(60)
    plain = spark.createDataFrame(rows, SCHEMA)
    clash = plain.selectExpr("vec_id", "embedding", "label AS id", "label AS x", "label AS cluster", "label AS component", "label AS n")
    for report in (centroids.report, whitening.report):
        rounded = lambda t: sorted(tuple(round(x, 6) + 0.0 if isinstance(x, float) else x for x in r) for r in report(t).collect())  # noqa: B023, E731
        assert rounded(clash) == rounded(plain)


def test_clusters_equal_their_twin(spark):
    folder = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    got = queries.op11_centroids(spark, folder)
    want = c.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL['op11_centroids']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("spread", [0.0, 0.3, 3.0])
def test_bounds_hold_and_filter(spread):
    r = np.random.default_rng(2)
    x = np.floor(1024 * (3 * np.repeat(r.normal(size=(6, 64)), 50, axis=0) + spread * r.normal(size=(300, 64)))).astype(np.int64)
    simplex = centroids.Simplex(x)
    foot, height = simplex.apex(x)
    d = centroids.squared(x, x).astype(float)
    base = ((foot[:, None] - foot) ** 2).sum(2)
    slack = 1e-9 * d.max() + 1
    assert (base + (height[:, None] - height) ** 2 <= d + slack).all() and (base + (height[:, None] + height) ** 2 >= d - slack).all()
    apexes = np.column_stack([foot, height])
    left = centroids.open_centroids(apexes, apexes[::50])
    assert left[np.arange(300), centroids.squared(x, x[::50]).argmin(1)].all()
    assert left.mean() < (0.4 if spread < 1 else 1.01)


def test_exact_sums_beyond_a_long(spark):
    rows = spark.range(8).selectExpr("id % 2 AS k", "9223372036854775807 AS value")
    assert integers.exact_sums(rows, ["k"]) == {(0,): 4 * (2**63 - 1), (1,): 4 * (2**63 - 1)}


def check_whitening(rows, got, width=64, most=8):
    own = kept(rows, width)
    x = np.array([[c + 100_000 for c in v] for _, v in own], object)
    n, sums = len(own), x.sum(0)
    centred = np.array(n * x - sums, object)
    v = np.array((centred.T @ centred) / n**3, float)
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1], basis[:, ::-1]
    rank = min(most, int((values > 1e-9 * values[0]).sum()))
    want = np.array(centred / n, float) @ basis[:, :rank] / np.sqrt(values[:rank])
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    assert sum(map(len, by.values())) == n * rank
    signs = np.ones(rank)
    for m in range(rank):
        mine = sorted(r.whitened for r in got if r.component == m + 1)
        if not np.allclose(mine, np.sort(want[:, m]), atol=1e-6):
            signs[m] = -1
    left = {k: sorted((r.deviation, round(r.whitened, 6) + 0.0) for r in found) for k, found in by.items()}
    expected = {}
    for k, (i, _) in enumerate(own):
        for m in range(rank):
            expected.setdefault((i, m + 1), []).append((int((centred[k] ** 2).sum()), signs[m] * want[k, m]))
    assert left.keys() == expected.keys()
    for k, found in expected.items():
        for (a, b), (c, d) in zip(left[k], sorted(found), strict=True):
            assert a == c and abs(b - d) < 2e-6
    for r in got:
        assert r.n == n and abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9 and 0 <= r.identity_error < 1e-8


def test_whitening_with_odd_rows(spark):
    rows = odd()
    check_whitening(rows, whitening.report(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect())


def test_whitening_of_low_rank(spark):
    r = np.random.default_rng(8)
    plane = r.integers(-3, 4, size=(3, 10))
    rows = [(i, (r.integers(-5, 6, size=3) @ plane).astype(float).tolist(), 0) for i in range(80)]
    check_whitening(rows, whitening.report(spark.createDataFrame(rows, SCHEMA)).collect(), width=10)


def test_whitening_of_equal_rows_and_none(spark):
    for rows in ([], [(1, [1.0, 2.0], 0)], [(i, [1.0, 2.0], 0) for i in range(9)], [(1, None, 0), (2, [], 0)]):
        assert whitening.report(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_whitening_takes_the_commonest_width(spark):
    rows = vectors(40, 6) + [(100 + i, [1.0] * 7, 0) for i in range(5)]
    got = whitening.report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.vec_id for r in got} == set(range(40)) and max(r.component for r in got) == 6
    assert whitening.whiten(spark.createDataFrame(rows, SCHEMA), width=7).count() == 0  # all equal


def test_jacobi_gives_small_eigenvalues_relatively_exact():
    """Graded matrices: errors in proportion to each eigenvalue, which a plain solver doesn't give."""
    r = np.random.default_rng(3)
    scale = np.logspace(0, -9, 10)
    b = np.eye(10) + 0.1 * r.normal(size=(10, 10))
    well = (b @ b.T).astype(np.longdouble)
    v = (scale[:, None] * well * scale).astype(float)
    values, basis = whitening.one_sided_jacobi(whitening.pivoted_cholesky(v))
    assert np.allclose(basis.T @ basis, np.eye(len(values)), atol=1e-12)
    # v's inverse has the reciprocals: the least eigenvalue from the well-conditioned inverse
    inverse = np.linalg.inv(well.astype(float)) / scale[:, None] / scale
    assert abs(values[-1] * np.linalg.eigvalsh(inverse)[-1] - 1) < 1e-9
    assert np.allclose((basis * values) @ basis.T, v, rtol=1e-10, atol=1e-25)


def test_deviation_beyond_a_long_is_null(spark):
    t = spark.range(2000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: (F.pmod(F.xxhash64(F.col("id"), k), F.lit(2)) * 100_000).cast("float")).alias("embedding"))
    got = whitening.report(t).collect()
    assert len(got) == 2000 * 8 and {r.deviation for r in got} == {None} and got[0].identity_error < 1e-8
