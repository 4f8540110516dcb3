"""What models are fitted on is bounded by ids, however often one is repeated."""

import numpy as np

from groundspark.llm import ann, language_id, quality

WORDS = {"a": "the quick brown fox jumps over a lazy dog", "b": "der schnelle braune fuchs springt ueber den hund", "c": "le renard brun saute par dessus un chien"}


def documents():
    return [(i, f"{WORDS['abc'[i % 3]]} {i}", "abc"[i % 3], 40) for i in range(60)]


def test_quality_counts_a_repeated_id_once(spark):
    names = "doc_id long, text string, lang string, n_chars long"
    rows = documents()
    labels = spark.createDataFrame([(i, i % 3 != 0) for i, *_ in rows], "doc_id long, quality boolean")
    once = quality.fit(spark.createDataFrame(rows, names), labels)
    often = quality.fit(spark.createDataFrame(rows + [rows[7]] * 400, names), labels.union(labels.where("doc_id = 7")))
    assert once.bias == often.bias and np.array_equal(once.weights, often.weights) and np.array_equal(once.factors, often.factors)


def test_repeated_labels_do_not_thin_the_sample(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, i % 3 != 0) for i, *_ in rows], "doc_id long, quality boolean")
    more = labels
    for _ in range(4):
        more = more.union(labels)
    once, often = quality.fit(docs, labels, sample_rows=60), quality.fit(docs, more, sample_rows=60)
    assert np.array_equal(once.weights, often.weights)


def test_language_counts_a_repeated_id_once(spark):
    names = "doc_id long, text string, lang string, n_chars long"
    rows = documents()
    once = language_id.fit(spark.createDataFrame(rows, names))
    often = language_id.fit(spark.createDataFrame(rows + [rows[7]] * 400, names))
    assert once.languages == often.languages and np.array_equal(once.weights, often.weights)


def test_vectors_count_a_repeated_id_once(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=8).tolist()) for i in range(50)]
    once, often = (ann.fit(spark.createDataFrame(x, "id long, vec array<double>"), len(rows)) for x in (rows, rows + [rows[3]] * 300))
    assert np.array_equal(once.centres, often.centres)
