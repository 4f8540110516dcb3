"""The queries that SQL can't express, and the pipeline, against plain recomputation of their rows."""

import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from test_text_operators import brute_components, folded, ids_of, prose

from groundspark.llm import language_id, line_dedup, packing, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    own = {t: spark.read.parquet(f"{SF}/{t}.parquet").cache() for t in ("documents", "labels", "benchmark", "pages")}
    yield own
    for t in own.values():
        t.unpersist()


def odd_rows(spark, docs):
    """A few documents with nulls, empty, repeated and very long texts."""
    long = prose(70, 400_000, 5000)
    rows = [(900_001, None, None, None, None), (900_002, "", "en", "s", 0), (900_003, long, "en", "s", len(long)), (900_004, "½ 12 !", "en", "s", 6), (900_005, "same text here", "fr", "s", 14), (900_005, "same text here", "fr", "s", 14), (None, "no id", None, "s", 5)]
    return docs.unionByName(spark.createDataFrame(rows, docs.schema))


def fm_score(machine, text, n_chars):
    """Score of one text: features one by one, all pairs of them multiplied out."""
    raw = (text or "").encode("utf-8", "replace")
    slots = [zlib.crc32(w) % quality.WORDS for w in raw.lower().split()]
    kinds = sorted(set(slots))
    stats = quality.structure(raw, np.array(slots, np.int64), len(kinds), n_chars)
    x = {k: 1 / np.sqrt(len(kinds)) for k in kinds} | {k: 1 / np.sqrt(len(stats)) for k in stats}
    numbers, values = np.array(list(x)), np.array(list(x.values()))
    v = machine.factors[numbers] * values[:, None]
    pairs = np.triu(v @ v.T, 1).sum()
    return 1 / (1 + np.exp(-(machine.bias + machine.weights[numbers] @ values + pairs)))


def held_out(doc_id, modulus, rest):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == rest


def key(r):
    return (r.doc_id is not None, r.doc_id or 0)


def test_quality_query(spark, tables):
    docs = odd_rows(spark, tables["documents"])
    machine = quality.fit(docs, tables["labels"], quality.learning_rows())
    rows = sorted(docs.collect(), key=key)
    got = sorted(quality.report(docs, tables["labels"]).collect(), key=key)
    assert len(got) == len(rows)
    for r, g in zip(rows, got, strict=True):
        want = fm_score(machine, r.text, r.n_chars)
        assert g.doc_id == r.doc_id and g.held_out == held_out(r.doc_id, 3, 1)
        assert abs(g.score - want) < 1e-6 and g.predicted == (g.score >= 0.5)


def test_quality_learns_from_its_rows_only(spark, tables):
    """Other labels of held-out rows, languages and sources change no score."""
    docs, labels = tables["documents"], tables["labels"]
    before = {r.doc_id: r.score for r in quality.report(docs, labels).collect()}
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1, 1 - quality, quality) AS quality", "toxic")
    after = {r.doc_id: r.score for r in quality.report(docs.selectExpr("doc_id", "text", "'x' AS lang", "'y' AS source", "n_chars"), turned).collect()}
    assert before == after


def test_language_query(spark, tables):
    docs = odd_rows(spark, tables["documents"])
    codes = language_id.fit(docs.select("doc_id", "text", "lang"), language_id.learning_rows())
    texts = {k: r for k, r in enumerate(sorted(docs.collect(), key=lambda r: (*key(r), r.text or "")))}
    got = sorted(language_id.report(docs).join(docs.select("doc_id"), "doc_id", "left").dropDuplicates(["doc_id"]).collect(), key=key)
    by = {r.doc_id: r for r in got}
    for r in texts.values():
        if r.doc_id is None:
            continue
        g = by[r.doc_id]
        assert g.held_out == held_out(r.doc_id, 5, 0) and 0 <= g.score <= 1
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (g.lang_pred, g.score) == ("und", 0)
            continue
        bits = language_id.grams(r.text).astype(float) @ codes.weights + codes.bias
        losses = [sum(t * np.log1p(np.exp(-c * b)) for t, c, b in zip(codes.trust[k], codes.code[k], bits, strict=True)) for k in range(len(codes.languages))]
        two = sorted(losses)[:2]
        assert g.lang_pred == codes.languages[int(np.argmin(losses))] or two[1] - two[0] < 1e-5
    assert by[900_004].lang_pred == "und"


def cut(text, capacity=packing.CAPACITY):
    ids = ids_of(text, 1)
    return [(at, ids[at : at + capacity]) for at in range(0, len(ids), capacity)]


def check_packing(rows, out):
    want = sorted((i is not None, i or 0, p, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in rows for p, (at, ids) in enumerate(cut(t)))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return len(bins)


def test_packing_query(spark, tables):
    docs = odd_rows(spark, tables["documents"])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    n = check_packing(rows, packing.report(docs).collect())
    total = sum(len(ids) for _, t in rows for _, ids in cut(t))
    assert n <= 1.02 * -(-total // packing.CAPACITY) + 1


def brute_lines(rows, ratio=line_dedup.RATIO, least=line_dedup.LEAST_HOLDERS):
    """(id, host, text) -> text without lines that more than a share of the host's pages hold and at least `least` distinct ones."""
    trim = lambda x: re.sub("[ \t\r]+", " ", x).strip(" ")
    pages = {}
    for _, host, text in rows:
        if host is not None and text is not None:
            pages.setdefault(host, []).append(tuple(trim(x) for x in text.split("\n") if trim(x)))
        elif host is not None:
            pages.setdefault(host, []).append(())
    bad = {}
    for host, own in pages.items():
        held = {}
        for page in own:
            for line in set(page):
                held.setdefault(line, []).append(page)
        bad[host] = {x for x, on in held.items() if len(set(on)) >= least and len(on) > ratio * len(own)}
    return {i: text if text is None else "\n".join(x for x in text.split("\n") if trim(x) not in bad.get(host, ())) for i, host, text in rows}


def test_line_dedup_of_documents(spark, tables):
    docs = odd_rows(spark, tables["documents"]).where("doc_id IS NOT NULL")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    assert {r.doc_id: r.text for r in line_dedup.clean_documents(docs).collect()} == brute_lines(rows)


def test_pipeline(spark, tables):
    docs, labels = tables["documents"], tables["labels"]
    machine = quality.fit(docs, labels, quality.learning_rows())
    rows = [(r.doc_id, r.source, r.text, fm_score(machine, r.text, r.n_chars)) for r in docs.collect()]
    assert min(abs(s - 0.5) for *_, s in rows) > 1e-9
    good = [(i, s, t) for i, s, t, score in rows if score >= 0.5]
    clean = brute_lines(good)
    components = brute_components(list(clean.items()))
    once = {i: t for i, t in clean.items() if components[i][1] == i}
    windows = {}
    for item in tables["benchmark"].collect():
        words = folded(item.text)
        for i in range(max(1, len(words) - 12) if words else 0):
            windows.setdefault(tuple(words[i : i + 13]), len(words[i : i + 13]))
    kept = []
    for i, text in once.items():
        words, hit = folded(text), set()
        for size in set(windows.values()):
            for at in range(len(words) - size + 1):
                if tuple(words[at : at + size]) in windows:
                    hit.update(range(at, at + size))
        if not (hit and 20 * len(hit) >= len(words)):
            kept.append((i, text))
    assert 0 < len(kept) < len(once) < len(good) < len(rows)
    check_packing(kept, corpus_pipeline.run(spark, SF).collect())
