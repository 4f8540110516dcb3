"""How rows of the token-group matrix are dealt to units."""

import pyarrow as pa
import pytest

from groundspark.llm import jaccard_join
from groundspark.llm.common import Scratch


def dealt(spark, rows, block):
    t = spark.createDataFrame(rows, "token long, set long, group long")
    old, jaccard_join.BLOCK = jaccard_join.BLOCK, block
    try:
        return jaccard_join._units(t, Scratch(spark, "units"), "test").collect()
    finally:
        jaccard_join.BLOCK = old


def met(units):
    """Pairs of rows that meet: in one unit, and in different blocks where the unit has two."""
    by, out = {}, []
    for r in units:
        by.setdefault((r.token, r.lo, r.hi), []).append(r)
    for (token, lo, hi), own in by.items():
        for i, x in enumerate(own):
            out += [(token, *sorted((x.set, y.set))) for y in own[i + 1 :] if x.group != y.group and (lo == hi or x.block != y.block)]
    return out


@pytest.mark.parametrize("sizes", [{1: 50}, {1: 50, 2: 3}, {1: 50, 2: 40, 3: 4, 4: 9}, {g: 1 for g in range(60)}, {1: 30, **{g: 1 for g in range(10, 40)}}, {1: 8, 2: 2}])
def test_pairs_of_different_groups_meet_once(spark, sizes):
    rows, number = [], 0
    for group, n in sizes.items():
        rows += [(7, number + i, group) for i in range(n)] + [(8, number, group)]
        number += n
    pairs = met(dealt(spark, rows, block=10))
    want = [(t, *sorted((a, b))) for t, a, g in rows for u, b, h in rows if t == u and a < b and g != h]
    assert sorted(pairs) == sorted(want)


def test_a_large_group_is_dealt_in_proportion(spark):
    """Near copies that are one group already go nowhere; beside some other sets each is dealt once."""
    counts = {}
    for n in (3000, 12_000):
        alone = [(7, i, 1) for i in range(n)]
        assert dealt(spark, alone, 1024) == []
        counts[n] = len(dealt(spark, [*alone, *((7, n + i, 100 + i) for i in range(20))], 1024))
    assert counts[3000] <= 3000 + 20 * 4 and counts[12_000] <= 12_000 + 20 * 13


def test_units_of_one_batch_are_worked_on_a_few_at_a_time(monkeypatch):
    """Each unit is whole and comes once, and those that come together have no more pairs than a large one."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 10)
    sizes = [1, 20, 3, 3, 3, 12, 1, 1, 2, 20, 30, 1]
    rows = [(token, 0, 0, 0, 100 * token + i, 50, 50, i) for token, n in enumerate(sizes) for i in range(n)]
    names = ["token", "lo", "hi", "block", "set", "n", "rest", "group"]
    table = pa.table({c: [r[k] for r in rows] for k, c in enumerate(names)})
    for length in (7, 40, len(rows)):
        units = list(jaccard_join._whole_units(iter(table.to_batches(length)), 80))
        assert pa.concat_tables([u.table for u in units]).equals(table)
        pairs = 0
        for u in units:
            tokens = set(u.table["token"].to_pylist())
            assert len(tokens) == 1 or sum(sizes[t] * (sizes[t] - 1) // 2 for t in tokens) <= 200
            pairs += len(u.a)
        assert pairs == sum(n * (n - 1) // 2 for n in sizes)
