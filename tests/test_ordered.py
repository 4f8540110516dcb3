"""Running values and life cycles over keys of which one holds a third of the rows, against plain loops."""

from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundspark.operators import feedback, life, ordered


def hot_rows(n=6000, seed=3):
    """Key 0 has a third of the rows, null is a key of its own, others are rare."""
    r = np.random.default_rng(seed)
    keys = [0 if x < 0.34 else None if x < 0.36 else int(k) for x, k in zip(r.random(n), r.integers(1, 400, n), strict=True)]
    return [(k, int(at), i) for i, (k, at) in enumerate(zip(keys, r.permutation(n), strict=True))]


def in_order(rows):
    by = {}
    for row in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1])):
        by.setdefault(row[0], []).append(row)
    return by


@pytest.mark.parametrize("before", [False, True])
def test_running_values(spark, before):
    rows = hot_rows()
    t = spark.createDataFrame(rows, "k int, at int, v int")
    odd = F.when(F.col("v") % 3 == 0, F.col("v"))
    own = ordered.Slices(t, ["k"], ["at"], 12).running("total", F.col("v"), before=before).running("top", odd, "max", before=before)
    got = {(r.k, r["at"]): (r.total, r.top) for r in own.rows.collect()}
    for k, mine in in_order(rows).items():
        total = top = None
        for _, at, v in mine:
            new = ((total or 0) + v, v if v % 3 == 0 and (top is None or v > top) else top)
            assert got[k, at] == ((total, top) if before else new)
            total, top = new
    assert len(got) == len(rows)


def test_slices_are_even_and_carries_few(spark):
    t = spark.createDataFrame(hot_rows(), "k int, at int, v int")
    own = ordered.Slices(t, ["k"], ["at"], 24)
    sizes = [r["count"] for r in own.rows.groupBy(ordered.SLICE).count().collect()]
    assert len(sizes) > 20 and max(sizes) <= 3 * median(sizes)
    held = own.rows.where("k = 0").select(ordered.SLICE).distinct().count()
    assert held > 5  # the hot key isn't one task
    plan = own.running("total", F.col("v")).rows._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan or "ResolvedHint" in plan or "broadcast" in plan.lower()


def test_without_keys(spark):
    t = spark.createDataFrame([(i * 7 % 50, i) for i in range(50)], "at int, v int")
    got = {r["at"]: r.s for r in ordered.Slices(t, [], ["at"], 5).running("s", F.col("v")).rows.collect()}
    total = 0
    for at, v in sorted((i * 7 % 50, i) for i in range(50)):
        total += v
        assert got[at] == total


def test_cache_hits_of_a_hot_key(spark):
    r = np.random.default_rng(5)
    asks = [(i, int(r.integers(0, 900)), f"Topic {0 if r.random() < 0.34 else r.integers(1, 60)}", bool(r.random() < 0.5)) for i in range(3000)]
    busts = sorted({int(x) for x in r.integers(0, 900, 12)})
    t = spark.createDataFrame(asks, "id long, at int, question string, escalated boolean").select("id", F.timestamp_seconds("at").alias("asked_at"), "question", "escalated")
    got = {x.id: x.hit for x in feedback.cache_hits(t, spark.createDataFrame([(b,) for b in busts], "b int").select(F.timestamp_seconds("b").alias("at"))).collect()}
    answered, want = set(), {}
    for i, at, question, escalated in sorted(asks, key=lambda a: (a[1], a[0])):
        key = (question, max((b for b in busts if b <= at), default=None))
        want[i] = key in answered
        if not escalated:
            answered.add(key)
    assert got == want and 0 < sum(want.values()) < len(want)


def test_quarantine_of_a_hot_key(spark):
    rows = [(k or 0, at, v, "approve" if v % 5 == 0 else "down" if v % 5 < 4 else "other") for k, at, v in hot_rows()]
    t = spark.createDataFrame(rows, "id long, at long, seq long, kind string")
    for threshold in (3, 0):
        got = sorted(map(tuple, feedback.quarantine(t, threshold).collect()))
        want, state = [], {}
        for k, at, _, kind in sorted(rows, key=lambda x: (x[1], x[2])):
            approved, votes = state.get(k, (False, 0))
            if kind == "approve":
                approved, votes = True, 0
            elif kind == "down" and approved:
                votes += 1
                if threshold and votes == threshold:
                    want.append((k, at))
            state[k] = (approved, votes)
        assert got == sorted(want) and bool(want) == bool(threshold)


def plain_life(events, four_eyes=True):
    status, accepted, refused = "", 0, 0
    for _, _, kind, author, approver in sorted(events, key=lambda e: e[1]):
        name = (approver or "").strip().lower()
        eyes = not four_eyes or name != "" and name != (author or "").strip().lower()
        fine = {
            "submit": status == "", "approve": status != "" and (status == "approved" or eyes), "reject": status not in ("", "approved"),
            "revoke": status == "approved", "quarantine": status == "approved",
        }.get(kind, False)
        if fine:
            status = {"submit": "pending", "approve": "approved", "revoke": "revoked", "quarantine": "quarantined"}.get(kind, status if status == "revoked" else "rejected")
        accepted, refused = accepted + fine, refused + (not fine)
    return status, accepted, refused


@pytest.mark.parametrize("four_eyes", [True, False])
def test_life_of_a_hot_candidate(spark, four_eyes):
    r = np.random.default_rng(7)
    kinds = ["submit", "approve", "approve", "reject", "revoke", "quarantine", "down", None]
    rows = [(k or 0, at, kinds[int(r.integers(0, 8))], ["ann", "Bob ", None][int(r.integers(0, 3))], ["bob", " ANN", "", None, "eve"][int(r.integers(0, 5))]) for k, at, _ in hot_rows()]
    t = spark.createDataFrame(rows, "id long, seq long, kind string, author string, approver string")
    by = {}
    for row in rows:
        by.setdefault(row[0], []).append(row)
    got = {x.id: (x.status, x.accepted, x.refused) for x in life.candidate_state(t, four_eyes, slices=10).collect()}
    assert got == {k: plain_life(v, four_eyes) for k, v in by.items()}
    parts = life.sliced(t, four_eyes, slices=10).collect()
    assert len([p for p in parts if p.id == 0]) > 2 and len(parts) <= len(by) + 10
    assert sum(p.events for p in parts) == len(rows)


def test_life_with_string_ids_and_no_events(spark):
    schema = "id string, seq long, kind string, author string, approver string"
    rows = [("a", 1, "submit", "x", None), ("a", 2, "approve", "x", "y"), (None, 1, "submit", None, None)]
    assert {(x.id, x.status) for x in life.candidate_state(spark.createDataFrame(rows, schema)).collect()} == {("a", "approved"), (None, "pending")}
    assert life.candidate_state(spark.createDataFrame([], schema)).count() == 0
