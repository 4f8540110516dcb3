"""Marks among odd brackets, and a citation of answers without any."""

from pyspark.sql import functions as F

from groundspark.operators import guards
from test_queries import cited


def test_brackets_that_are_no_marks_stay(spark):
    rows = [
        (1, "a[[1] b [2][1]"), (2, "[[2]] [x [1] [12 ] [9] z["), (3, "word\n[9] word[9] [1]\r\n[9]"), (4, "beta words [7]"), (5, ""), (6, "[1]"), (7, "`a[1]` gamma"),
    ]
    answers = spark.createDataFrame(rows, "question_id long, answer string")
    hits = spark.createDataFrame([(q, r, f"t{r}", f"u{r}", text) for q in range(1, 8) for r, text in ((1, "gamma"), (2, "beta"))], "question_id long, rank int, title string, url string, text string")
    own = {r.question_id: {} for r in hits.collect()}
    for r in hits.collect():
        own[r.question_id][r["rank"]] = (r.title, r.url, r.text)
    clean = answers.select("question_id", guards.strip_sources_block(F.col("answer")).alias("answer")).collect()
    got = {r.question_id: (r.answer, [c.url for c in r.citations]) for r in guards.finalize_citations(answers, hits).collect()}
    assert got == {r.question_id: cited(r.answer, own[r.question_id]) for r in clean}


def test_sources_are_cut_into_words_where_they_are_compared(spark):
    """Content words are cut behind the join with answers that have no mark, not of all hits."""
    answers = spark.createDataFrame([(1, "alpha")], "question_id long, answer string")
    hits = spark.createDataFrame([(1, 1, "t", "u", "alpha")], "question_id long, rank int, title string, url string, text string")
    plan = guards.finalize_citations(answers, hits.withColumn("text", F.upper("text")))._jdf.queryExecution().optimizedPlan().toString()
    common = next(line for line in plan.splitlines() if "array_intersect" in line)
    assert "regexp_extract_all" in common and common.count("array_except") == 2
