"""Texts whose patterns are looked for only behind a cheaper sign."""

import re

import pytest
from pyspark.sql import functions as F

from groundspark.operators import guards

TEXTS = [
    "a.b.c", "x.y_1.z9 w", "a.b", "a..b.c", "1.2.3", "v1.2.3", "1.2", "1.2.3.4,5", "see http://x.y/z", "jdbc:x", "A1+.-://q)", "no dots", "", "a.b.1", "a.b.c.1.2.3", "1.2 3.4", "a._b.c", "x1.2.3y", "12,345.67.89",
]


@pytest.mark.parametrize("text", TEXTS)
def test_no_identifier_or_run_is_without_its_sign(text):
    if re.search(guards.URI, text) or re.search(guards.DOTTED, re.sub(guards.URI, " ", text)):
        assert "://" in text or "jdbc:" in text or re.search(guards.DOTTED_SIGN, text)
    if re.search(guards.DOTTED_RUN, text):
        assert re.search(guards.RUN_SIGN, text)


def test_specifics_and_numbers_shuffle_no_texts(spark):
    """Only tokens meet: neither answers nor sources go through a join whole."""
    answers = spark.createDataFrame([(1, "uses a.b.c and 1.25 [1]"), (2, "has d.e.f and 9.75"), (3, None), (4, "a.b.c without hits 5.5")], "question_id long, answer string")
    hits = spark.createDataFrame([(1, 1, "t", "A.B.c is 1.250"), (2, 1, "t", "1.9.75 only"), (3, 1, None, None)], "question_id long, rank int, title string, text string")
    s, n = guards.fabricated_specifics(answers, hits), guards.fabricated_numbers(answers, hits)
    assert [tuple(r) for r in s.collect()] == [(2, "d.e.f")]
    assert [tuple(r) for r in n.collect()] == [(2, "9.75")]
    for df in (s, n):
        joins = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
        assert joins and df.columns == ["question_id", "token"]
        below = df._jdf.queryExecution().optimizedPlan().toString()
        assert below.index("Join LeftSemi") < below.index("Generate")
