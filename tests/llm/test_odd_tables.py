"""Odd tables: nulls in any column, empty and very long texts, repeated rows, no rows, columns whose names clash."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from groundspark.llm import language_id, licenses, packing, quality

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, or give to what they append.
CLASHES = ["score", "SCORE_", "_id", "_y", "_text", "_lang", "_rate", "_n", "_numbers", "may_hold", "n_hit", "n_words", "doc", "key", "set", "row", "item", "piece", "lang_pred", "ambiguous", "licence", "directory", "path_", "host", "line"]


def prose(seed, n, vocabulary=400):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, vocabulary, n))


def rows():
    passage = prose(99, 30)
    out = [(k, prose(k, 60), "en" if k % 2 else "de", f"s{k % 3}", None if k % 7 == 0 else 300) for k in range(1, 40)]
    out += [(40, None, "en", "s1", 0), (41, "", None, None, None), (42, " \n\t", "en", "s0", 3), (43, prose(43, 60_000, 50_000), "en", "s0", -1)]
    out += [(None, prose(50, 60), "en", "s1", 1), (None, None, None, None, None), (7, prose(7, 60), "en", "s1", 300), (7, prose(7, 60), "en", "s1", 300), (7, prose(70, 60), None, "s1", 9)]
    return [*out, (44, prose(51, 20) + " " + passage, "en", "s2", 5)], passage


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    labels = [(k, k % 2) for k in range(1, 30)] + [(None, 1), (30, None), (7, 0), (7, 0), (999, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, rows()[1]), (None, prose(3, 20)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def with_clashes(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def test_stages_of_odd_rows(spark, folder):
    docs = with_clashes(spark.createDataFrame(rows()[0], DOCUMENTS))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert 0 < len(kept) <= docs.count(), name
        assert all(r[c] == f"own {c}" for r in kept[:20] for c in CLASHES), name
        ids = [r.doc_id for r in kept]
        if name == "benchmark_decontamination":
            assert sorted(i for i in ids if i is not None) == sorted(r[0] for r in rows()[0] if r[0] not in (None, 44))
        if name == "jaccard_join":  # rows without id and different texts of one id stay, equal rows once
            assert ids.count(None) == 2 and ids.count(7) == 2 and {40, 41, 42, 43} <= set(ids)
        if name == "line_dedup":
            assert len(kept) == docs.count() and [r.n_chars for r in kept if r.doc_id in (40, 41)] in ([None, 0], [0, None])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == {r[0] for r in rows()[0]} and len({r.piece for r in packed if r.doc_id == 43}) > 10


def test_stages_of_no_rows(spark, folder):
    docs = with_clashes(spark.createDataFrame([], DOCUMENTS))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0, name
        assert name == "best_fit_packing" or out.columns == docs.columns


def test_classifiers_leave_other_columns_alone(spark, folder):
    plain = spark.createDataFrame(rows()[0], DOCUMENTS)
    docs, labels = with_clashes(plain), spark.read.parquet(f"{folder}/labels.parquet")
    of = lambda df, *names: sorted(map(repr, df.select("doc_id", "text", *names).collect()))
    one, name = quality.score(plain, quality.fit(plain, labels))
    other, new = quality.score(docs, quality.fit(docs, with_clashes(labels)))
    assert new.lower() not in {c.lower() for c in docs.columns} and other.columns[: len(docs.columns)] == docs.columns
    assert of(one.withColumnRenamed(name, "x"), "x") == of(other.withColumnRenamed(new, "x"), "x")
    one, names = language_id.identify(plain, language_id.fit(plain))
    other, new = language_id.identify(docs, language_id.fit(docs))
    assert other.columns[: len(docs.columns)] == docs.columns
    assert of(one.withColumnRenamed(names[0], "x"), "x") == of(other.withColumnRenamed(new[0], "x"), "x")
    assert {r[new[0]] for r in other.where("text is null or trim(text) = ''").collect()} == {"und"}


def test_packing_of_ids_that_repeat(spark):
    docs = spark.createDataFrame(rows()[0], DOCUMENTS)
    packed = packing.report(docs).collect()
    assert sum(r.doc_id == 7 and r.piece == 0 for r in packed) == 4 and sum(r.doc_id is None for r in packed) == 2
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in by_sequence.values():
        found.sort()
        assert [a for a, _ in found] == [sum(n for _, n in found[:k]) for k in range(len(found))] and sum(n for _, n in found) <= 4096


def test_licence_behind_a_very_long_text(spark):
    text = "\n".join(prose(k, 12) for k in range(20_000)) + "\n\nSPDX-License-Identifier: MIT\n"
    docs = with_clashes(spark.createDataFrame([("a/b/1", text), ("a/b/2", None), (None, ""), (None, None)], "path string, text string"))
    out, names = licenses.scan(docs, "path")
    got = {(r.path, r.text is None): r[names[0]] for r in out.collect()}
    assert got[("a/b/1", False)] == "MIT" and got[(None, True)] is None and len(got) == 4
