"""Nearest neighbours against brute force."""

import numpy as np
from pyspark.sql import functions as F

from groundspark.llm import ann


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(rows, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for i, q in good:
        if i % 20 == 0:
            out.setdefault(i, [])
            out[i] = sorted(((-float(q @ v), j) for j, v in good if j != i))[:k]
    return out


def test_search_with_odd_rows(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=8).astype(np.float32).tolist(), 0) for i in range(300)]
    rows += [(500 + i, [1.0] * 8, 0) for i in range(60)]  # copies: ties by the smaller id
    rows += [(700, None, 0), (720, [0.0] * 8, 0), (740, [float("nan")] + [1.0] * 7, 0), (760, [None] + [1.0] * 7, 0), (780, [1.0] * 5, 0), (None, [1.0] * 8, 0), (800, [float("inf")] + [1.0] * 7, 0)]
    got = {}
    for x in ann.report(table(spark, rows)).collect():
        got.setdefault(x.query_id, {})[x["rank"]] = (x.vec_id, x.score)
    want = brute(rows, 20)
    assert got.keys() == want.keys()
    same = 0
    for q, best in want.items():
        assert sorted(got[q]) == list(range(1, 21))
        same += len({j for _, j in best} & {j for j, _ in got[q].values()})
        for vec, score in got[q].values():
            assert abs(score - float(np.array(dict((i, v) for i, v, _ in rows)[q], float) @ np.array(dict((i, v) for i, v, _ in rows)[vec], float))) < 1e-5
    assert same / (20 * len(want)) >= 0.99
    for best in got.values():  # nearest first, ties by the smaller id
        assert [(-s, v) for v, s in (best[k] for k in range(1, 21))] == sorted((-s, v) for v, s in best.values())
    # among the copies of one vector the exact order is known: all ties
    assert [got[500][k][0] for k in range(1, 21)] == [j for _, j in want[500]]


def test_search_keeps_to_its_columns_among_others(spark):
    rows = [(i, np.random.default_rng(i).normal(size=8).astype(np.float32).tolist(), i) for i in range(60)]
    plain = ann.report(table(spark, rows)).collect()
    clash = table(spark, rows).selectExpr("vec_id", "embedding", "label AS id", "label AS vec", "label AS shard", "label AS rank")
    assert sorted(map(tuple, ann.report(clash).collect())) == sorted(map(tuple, plain))


def test_few_rows_and_none(spark):
    few = table(spark, [(0, [1.0, 2.0, 3.0], 0), (1, [1.0, 0.0, 1.0], 0), (2, [0.0, 1.0, 0.0], 0)])
    assert [(x["rank"], x.vec_id) for x in ann.report(few).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.report(few.limit(0)).count() == 0


def test_recall_of_the_scan(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(5000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = spark.createDataFrame([(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.neighbours(t, F.col("id") % 100 == 0, k=20).collect()
    own = x.astype(np.float32).astype(float)
    hits = 0
    for q in range(0, 5000, 100):
        s = own @ own[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:20].tolist()) & {g.vec_id for g in got if g.query_id == q})
    assert hits / (20 * 50) >= 0.95


def test_parallel_residual_is_smaller_than_with_plain_codes():
    r = np.random.default_rng(6)
    x = r.normal(size=(2000, 16))
    score_aware, plain = ann.fit_sample(x, threshold=0.4), ann.fit_sample(x, threshold=0.0)

    def parallel(q):
        back = q.centres[np.arange(8), q.encode(x)].reshape(len(x), -1)
        return np.mean(((x - back) * x).sum(1) ** 2 / (x**2).sum(1))

    assert plain.extra == 0 and score_aware.extra > 0 and parallel(score_aware) < parallel(plain)
