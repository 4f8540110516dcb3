"""Nearest neighbours: exact, from halves, and by learned partitions, against plain products."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundspark.operators import partitions, vectors


def table(spark, x, more=()):
    rows = [(f"c{i}", v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, *more], "chunk_id string, embedding array<float>")


def clustered(n=600, width=16, centres=20, seed=1):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, width))
    return c[np.arange(n) % centres] + 0.1 * r.normal(size=(n, width))


ODD = [("null", None), ("short", [1.0] * 8), ("hole", [None] + [1.0] * 15), ("long", [1.0] * 32), ("zero", [0.0] * 16)]


def asked(spark, x, n=30):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:n])] + [(900, None), (901, [1.0])], "question_id long, embedding array<float>")


def brute(x, n, pool):
    x = x.astype(np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u[:n].T, 9)
    return {q: [f"c{i}" for i in sorted(range(len(x)), key=lambda i: (-s[i, q], f"c{i}"))[:pool]] for q in range(n)}


def listed(df):
    out = {}
    for r in df.orderBy("rank").collect():
        out.setdefault(r.question_id, []).append(r.chunk_id)
    return out


def test_exact_neighbours_with_odd_rows(spark):
    x = np.vstack([clustered(), np.tile(clustered()[:1], (40, 1))])  # with copies
    got = vectors.knn(asked(spark, x), table(spark, x, ODD).repartition(4), 10, width=16)
    assert listed(got) == brute(x, 30, 10)
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()


def test_blocks_refuse_other_widths():
    for rows in ([[1.0, 2.0], [3.0, 4.0]], [[1.0, 2.0, 3.0, 4.0], None], [[1.0, None, 2.0, 3.0]]):
        with pytest.raises(ValueError, match="4 components"):
            vectors.unit_rows(pa.array(rows, pa.list_(pa.float32())), 4)
    assert vectors.unit_rows(pa.array([], pa.list_(pa.float32())), 4).shape == (0, 4)


def test_halves(spark):
    x = clustered()
    half = table(spark, x, ODD).select("chunk_id", vectors.to_fp16("embedding").alias("embedding"))
    assert {r.n for r in half.where("chunk_id LIKE 'c%'").select(F.octet_length("embedding").alias("n")).collect()} == {32}
    got = {(r.question_id, r.chunk_id): r.vector_score for r in vectors.knn(asked(spark, x), half, 10, width=16).collect()}
    h, q = x.astype(np.float32).astype(np.float16).astype(float), x.astype(np.float32).astype(float)
    cos = (h / np.linalg.norm(h, axis=1, keepdims=True)) @ (q / np.linalg.norm(q, axis=1, keepdims=True)).T
    assert len(got) == 300 and all(abs(s - cos[int(c[1:]), k]) < 1e-12 for (k, c), s in got.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_partitions_that_may_miss_nothing_miss_nothing(spark, seed):
    x = np.vstack([clustered(seed=seed), np.random.default_rng(seed).normal(size=(200, 16)), np.tile(clustered(seed=seed)[:1], (300, 1))])
    t, q = table(spark, x, ODD).repartition(4), asked(spark, x)
    assert listed(partitions.approx_knn(q, t, 10, width=16, missed=0.0)) == brute(x, 30, 10)


def test_partitions_ask_few_parts(spark):
    x = clustered(3000, centres=40)
    index = partitions.partitioned(table(spark, x), 16)
    assert index.sizes.sum() == 3000 and len(index.centres) == 54 and index.sizes.max() < 10 * 3000 / 54
    exact = vectors.knn(asked(spark, x), table(spark, x), 10, width=16)
    near = partitions.search(asked(spark, x), index, 10)
    assert vectors.recall_at_k(exact, near, 10).agg(F.avg("recall")).first()[0] >= 0.95
    unit = x[:30] / np.linalg.norm(x[:30], axis=1, keepdims=True)
    floor = np.array([[min(r.vector_score for r in near.where(F.col("question_id") == k).collect())] for k in range(3)])
    assert (index.bounds(unit[:3]) >= floor).mean() < 0.5
    assert (index.expected(unit[:3], floor[:, 0]) > 0.02).mean() < 0.2


def test_expected_neighbours_of_isotropic_vectors(spark):
    """What a part is expected to hold is about what it holds, and the effective dimension about the width."""
    x = np.random.default_rng(3).normal(size=(4000, 16))
    index = partitions.partitioned(table(spark, x), 16)
    assert 10 < index.dimension <= 16
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosines, floor = unit[:20] @ unit.T, np.full(20, 0.5)
    held = np.zeros((20, len(index.centres)))
    np.add.at(held.T, (unit @ index.centres.T).argmax(1), (cosines >= 0.5).T)
    told = index.expected(unit[:20], floor).astype(float)
    assert abs(told.sum() / held.sum() - 1) < 0.3 and np.corrcoef(told.ravel(), held.ravel())[0, 1] > 0.8
    near = partitions.search(asked(spark, x), index, 10)
    exact = vectors.knn(asked(spark, x), table(spark, x), 10, width=16)
    assert vectors.recall_at_k(exact, near, 10).agg(F.avg("recall")).first()[0] >= 0.95


def test_partitions_of_no_rows_and_few(spark):
    x = clustered(3)
    assert partitions.approx_knn(asked(spark, x), table(spark, x).limit(0), 10, width=16).count() == 0
    assert listed(partitions.approx_knn(asked(spark, x, 2), table(spark, x, ODD), 10, width=16)).keys() == {0, 1}
    assert partitions.approx_knn(asked(spark, x), table(spark, x), 0, width=16).count() == 0


def test_halving_balances():
    x = clustered(1000)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = partitions.halved(x, 16)
    assert len(centres) == 16 and np.allclose(np.linalg.norm(centres, axis=1), 1)
    assert len(partitions.halved(x[:3], 16)) == 3


def test_neighbours_within_a_document(spark):
    """Few large documents and many small ones, in batches: against all pairs, of which there are too many to join."""
    rng = np.random.default_rng(3)
    docs = [f"d{i % 2}" if i < 400 else f"s{i // 3}" for i in range(900)]
    rows = [(f"c{i}", doc, [float(x) for x in rng.integers(-2, 3, 4)]) for i, doc in enumerate(docs)]
    rows += [("null", "d0", None), ("short", "d0", [1.0]), ("nowhere", None, [1.0, 0.0, 0.0, 0.0])]
    schema = "chunk_id string, doc_id string, embedding array<float>"
    asked = [(i, docs[i], rows[i][2]) for i in range(0, 900, 7)] + [(1000, "unknown", [1.0] * 4), (1001, None, [1.0] * 4)]
    got = vectors.knn_within(spark.createDataFrame(asked, "question_id long, doc_id string, embedding array<float>"), spark.createDataFrame(rows, schema).repartition(3), 5, 4)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    want = {}
    for q, doc, v in asked:
        near = sorted((-round(float(unit(v) @ unit(e)), 9), c) for c, d, e in rows if doc is not None and d == doc and e is not None and len(e) == 4)[:5]
        want |= {(q, k + 1): c for k, (_, c) in enumerate(near)}
    assert {(r.question_id, r["rank"]): r.chunk_id for r in got.collect()} == want


def test_ids_are_held_as_bytes_in_their_order():
    ids = ["z", "é", "日", "a#10", "a#2"]
    near = vectors.Nearest(4, 1)
    near.add(vectors.vector_ids(pa.array(ids)), np.ones((5, 1)))
    assert near.chunk.itemsize == 4 and near.batch(pa.array([7])).column(1).to_pylist() == sorted(ids)[:4]


@pytest.mark.parametrize("pool", [1, 7, 500])
def test_products_in_single_precision_lose_nothing(pool):
    """Cosines that single precision can't tell apart, copies, and batches of all sizes: as from exact products, merged once."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16))
    x[1000:1500] = x[0] + 1e-8 * rng.normal(size=(500, 16))
    x[2000:2200] = x[1]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True))[rng.permutation(3000)]
    q = x[rng.permutation(3000)[:700]]
    ids = vectors.vector_ids(pa.array([f"c{i}" for i in range(3000)]))
    merges = []

    class Counting(vectors.Nearest):
        def merge(self, found):
            merges.append(len(found))
            super().merge(found)

    near = Counting(pool, len(q))
    for a, b in [(0, 3), (3, 40), (40, 2600), (2600, 3000)]:
        near.multiply(ids[a:b], x[a:b], q)
    near.settle()
    rough = np.round(x @ q.T, 9)
    got = {}
    for k, c in zip(near.question.tolist(), near.chunk.tolist(), strict=True):
        got.setdefault(k, set()).add(c)
    assert len(merges) == 1
    for k in range(len(q)):
        assert got[k] == {ids[i] for i in np.lexsort((ids, -rough[:, k]))[:pool]}


def words_counted(n, few, seed):
    """Hashed counts: n of up to 200 words, the first `few` of up to 8."""
    r = np.random.default_rng(seed)
    sizes = np.append(r.integers(1, 9, few), r.integers(1, 201, n - few))
    return np.array([np.bincount(r.integers(0, 64, k) ** 3 // 4096, minlength=64) for k in sizes], float)


def test_more_questions_than_a_block_meet_all_chunks_in_one_task(spark, monkeypatch):
    """Questions in groups, chunks in packs: the same neighbours, and of a question only the best leave its task."""
    x = np.vstack([words_counted(300, 40, 1), np.tile(words_counted(1, 1, 2), (40, 1))])
    chunks, questions = table(spark, x, [("null", None), ("short", [1.0] * 8), ("hole", [None] + [1.0] * 63), ("nan", [float("nan")] * 64)]).repartition(4), asked(spark, x, 60)
    monkeypatch.setattr(vectors, "QUESTION_BLOCK", 10)
    monkeypatch.setattr(vectors, "GROUP", 8)
    monkeypatch.setattr(vectors, "PACK", 50)
    left = []
    ranked = vectors.ranked
    monkeypatch.setattr(vectors, "ranked", lambda scored, pool: left.append(scored) or ranked(scored, pool))
    want = brute(x, 60, 10)
    assert listed(vectors.knn(questions, chunks, 10, width=64)) == want
    assert len(left) == 1 and left[0].count() == 600
    half = chunks.select("chunk_id", vectors.to_fp16("embedding").alias("embedding"))
    assert {q: len(c) for q, c in listed(vectors.knn(questions, half, 10, width=64)).items()} == dict.fromkeys(range(60), 10)


@pytest.mark.parametrize("seed", [1, 2])
def test_sums_of_counts_find_what_products_find(seed):
    """Questions of few and many words, with repeated ones, and chunks that aren't counts, are short of a byte or beyond it."""
    r = np.random.default_rng(seed)
    chunks = np.vstack([words_counted(900, 200, seed), 300 * np.eye(64)[:3], r.random((20, 64)), r.normal(size=(20, 64)), np.zeros((1, 64)), np.full((1, 64), np.nan)])
    few = np.vstack([words_counted(150, 140, seed + 9), 8 * np.eye(64)[:2], r.normal(size=(3, 64)), np.zeros((1, 64))])
    units = [vectors._units(v.astype(np.float32).astype(float)) for v in (chunks, few)]
    ids, weighed = np.array([f"c{i}" for i in range(len(chunks))], "S"), []
    for pool in (1, 10, 2000):
        plain, summed = vectors.Nearest(pool, len(few)), vectors.Nearest(pool, len(few))
        plain.multiply(ids, *units)
        plain.settle()
        weigh = summed.weigh
        summed.weigh = lambda c, rows, a, row, q, weigh=weigh: weighed.append(len(row)) or weigh(c, rows, a, row, q)
        for at in range(0, len(chunks), 300):
            summed.sum_up(ids[at : at + 300], units[0][at : at + 300], units[1], vectors.FewWords(units[1]))
            summed.settle()
        got, want = ({(q, c): s for q, c, s in zip(n.question, n.chunk, n.score)} for n in (summed, plain))
        assert got.keys() == want.keys() and len(got) == len(summed.question) and all(abs(got[k] - want[k]) < 1e-12 for k in got)
        assert pool > 10 or sum(weighed) < 0.5 * len(chunks) * len(few)
