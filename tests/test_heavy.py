"""Frequent keys by summaries of bounded size against whole counts."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from groundspark.operators import feedback, heavy
from groundspark.streaming import jobs


def skewed(n=8000, seed=4):
    r = np.random.default_rng(seed)
    return [f"k{int(x)}" for x in np.minimum(r.zipf(1.3, n), 5000)]


def test_bounds_of_merged_summaries(spark):
    keys = skewed()
    true = Counter(keys)
    t = spark.createDataFrame([(k,) for k in [*keys, None, None]], "key string").repartition(6)
    rows = {r.key: r.n for r in heavy.summary(t, F.col("key"), capacity=50).collect()}
    lost = rows.pop(None)
    assert lost <= len(keys) / 51 and len(rows) <= 6 * 50
    assert all(n <= true[k] <= n + lost for k, n in rows.items())
    assert all(true[k] <= lost for k in true if k not in rows)
    exact = {r.key: r.n for r in heavy.summary(t, F.col("key"), capacity=10_000).collect()}
    assert exact.pop(None) == 0 and exact == true


def test_shortened():
    counts, lost = heavy.shortened(pd.Series({"a": 5, "b": 3, "c": 3, "d": 1}), 2)
    assert counts.to_dict() == {"a": 2} and lost == 3
    assert heavy.shortened(pd.Series({"a": 5}), 2)[1] == 0


@pytest.mark.parametrize(("capacity", "limit"), [(60, 5), (10_000, 50), (3, 50), (10_000, 500)])
def test_gaps_are_exact_at_any_capacity(spark, capacity, limit):
    keys = skewed()
    t = spark.createDataFrame([(i, k, i % 7 > 0, float(i % 3)) for i, k in enumerate(keys)], "asked_at long, question string, escalated boolean, confidence double").repartition(5)
    got = [tuple(r) for r in feedback.gaps(t, limit, capacity).collect()]
    want = {}
    for i, k in enumerate(keys):
        if i % 7 > 0:
            n, last, total = want.get(k, (0, -1, 0.0))
            want[k] = (n + 1, max(last, i), total + i % 3)
    best = sorted(want, key=lambda k: (-want[k][0], -want[k][1], k))[:limit]
    assert [r[:3] for r in got] == [(k, want[k][0], want[k][1]) for k in best]
    assert all(abs(r[3] - want[r[0]][2] / want[r[0]][0]) < 1e-9 for r in got)
    some = heavy.candidates(t.where("escalated"), F.col("question"), limit, capacity)
    assert (some is None) == (capacity == 3)
    if some is not None:
        assert {r.key for r in some.collect()} >= set(best)


def test_gaps_of_an_empty_log(spark):
    assert feedback.gaps(spark.createDataFrame([], "asked_at long, question string, escalated boolean, confidence double")).count() == 0


def test_a_stream_keeps_bounded_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    keys, true = [], Counter()
    for k in range(3):
        new = skewed(1500, seed=20 + k)
        keys += new
        t = spark.createDataFrame([(x, True) for x in new] + [("never", False), ("", True)], "question string, escalated boolean")
        t.repartition(2).write.mode("append").parquet(str(tmp_path / "log"))
        stream = jobs.stream_frequent_gaps(spark.readStream.schema(t.schema).parquet(str(tmp_path / "log")), capacity=30, shards=2)
        done = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert done.awaitTermination(240)
        true.update(new)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    now = [r for r in rows if r.total == max(x.total for x in rows if x.shard == r.shard)]
    assert sum({r.shard: r.total for r in now}.values()) == len(keys) == 4500
    assert all(len([r for r in rows if (r.shard, r.total) == at]) <= 30 for at in {(r.shard, r.total) for r in rows})
    assert all(r.at_least <= true[r.question_key] <= r.at_most and 31 * r.lost <= r.total for r in now)
    lost, told = max(r.lost for r in now), {r.question_key for r in now}
    assert all(k in told for k, n in true.items() if n > lost) and true.most_common(1)[0][0] in told


def test_a_summary_without_keys_tells_its_numbers(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    t = spark.createDataFrame([(f"k{i % 40}", True) for i in range(80)], "question string, escalated boolean").coalesce(1)
    t.write.parquet(str(tmp_path / "log"))
    stream = jobs.stream_frequent_gaps(spark.readStream.schema(t.schema).parquet(str(tmp_path / "log")), capacity=5, shards=1)
    done = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert done.awaitTermination(240)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(0, None, 0, 2, 2, 80)]
