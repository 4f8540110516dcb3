"""Matching and ranking by the stored index against plain recomputation, chunk by chunk."""

import re

import numpy as np
import pyarrow as pa
import pytest

from groundspark.functions.text import STOP_WORDS
from groundspark.operators import lexical, lexical_index

WORDS = "alpha beta gamma delta epsilon zeta eta theta the of é".split()


def chunk_rows(n=90, seed=2):
    r = np.random.default_rng(seed)
    text = lambda k: " ".join(r.choice(WORDS, k))
    rows = [(f"c#{i}", text(int(r.integers(0, 3))), text(int(r.integers(0, 25)))) for i in range(n)]
    return rows + [("empty", None, None), ("same a", "alpha", "beta alpha-beta"), ("same b", "alpha", "beta alpha-beta"), ("rare", "", "omega alpha beta omega")]


QUESTIONS = [
    "alpha", "alpha beta", '"alpha beta"', '"beta the gamma"', "alpha-beta", "omega", "omega -alpha", "alpha -beta", 'alpha or omega', "omega or zeta beta", "the of", "", "nowhere", "nowhere alpha beta gamma",
    "alpha beta gamma delta epsilon", "-alpha", '-"alpha beta" gamma', "x nowhere y theta", "alpha alpha", '"omega alpha" or "nowhere at" beta', "omega nowhere",
]


def words_of(title, text):
    found = re.findall("[a-z0-9]+", f"{title or ''} {text or ''}".lower())
    return [(i, w) for i, w in enumerate(found) if w not in STOP_WORDS]


def groups_of(question):
    """(kind, group, [(place, word)]) of each part."""
    raws, out, group, joins = re.findall(r'-?"[^"]*"|-?[^\s"]+', question.lower()), [], 0, False
    for i, raw in enumerate(raws):
        if raw == "or":
            joins = True
            continue
        if not (joins and i):
            group += 1
        joins = False
        kind = "not" if raw.startswith("-") else "word"
        words = [(k, w) for k, w in enumerate(re.findall("[a-z0-9]+", raw)) if w not in STOP_WORDS]
        if words:
            out.append((kind, group, words))
    return out


def has(chunk, words):
    there = set(chunk)
    return any(all((at - words[0][0] + p, w) in there for p, w in words) for at, w0 in chunk if w0 == words[0][1])


def covers(chunk, wanted):
    last, left, total = dict.fromkeys(wanted, -1), -1, 0.0
    for at, w in chunk:
        if w in last:
            last[w] = at
            if min(last.values()) > left:
                left = min(last.values())
                total += 1 / (1 + max(0, at - left + 1 - len(wanted)))
    return total


def brute(question, chunks, keep=None):
    parts = groups_of(question)
    needed = {g for k, g, _ in parts if k != "not"}
    full = [c for c, own in chunks.items() if needed and {g for k, g, w in parts if k != "not" and has(own, w)} == needed and not any(k == "not" and has(own, w) for k, _, w in parts)]
    if full:
        wanted = list(dict.fromkeys(w for k, _, ws in parts if k != "not" for _, w in ws))
        scores = {c: covers(chunks[c], wanted) for c in full}
    else:
        loose = {w for w in [w for w in re.findall("[a-z0-9]+", question.lower()) if len(w) >= 2][:12] if w not in STOP_WORDS}
        scores = {c: float(sum(w in loose for _, w in own)) for c, own in chunks.items()}
    scores = {c: s for c, s in scores.items() if s > 0 and (keep is None or c in keep)}
    return set(full), scores, sorted(scores, key=lambda c: (-round(scores[c], 9), c))


@pytest.fixture(scope="module")
def world(spark):
    rows = chunk_rows()
    chunks = spark.createDataFrame(rows, "chunk_id string, title string, text string").repartition(3)
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "question_id long, question string")
    return asked, {c: words_of(t, x) for c, t, x in rows}, lexical_index.stored_index(chunks, block=7), chunks


def test_index_holds_the_postings(spark, world):
    _, own, index, chunks = world
    rows = index.collect()
    ids = {r.block: r.ids for r in rows if r.term == lexical_index.IDS}
    assert all(x == sorted(x) and len(x) <= 7 for x in ids.values()) and sorted(sum(ids.values(), [])) == sorted(own)
    got = sorted((ids[r.block][c], r.term, p) for r in rows for c, p in zip(r.chunks, r.places, strict=True))
    assert got == sorted(map(tuple, lexical.build_postings(chunks).select("chunk_id", "term", "pos").collect())) == sorted((c, w, i) for c, ws in own.items() for i, w in ws)
    assert all(r.best == max(r.chunks.count(c) for c in r.chunks) for r in rows if r.term != lexical_index.IDS)


def test_matches_and_scores(world):
    asked, own, index, _ = world
    matches, scores = {}, {}
    for r in lexical_index.matched(asked, index).collect():
        matches.setdefault(r.question_id, set()).add(r.chunk_id)
    for r in lexical_index.cover_density(asked, index).collect():
        scores.setdefault(r.question_id, {})[r.chunk_id] = r.lex_score
    for k, q in enumerate(QUESTIONS):
        full, want, _ = brute(q, own)
        assert matches.get(k, set()) == full, q
        assert scores.get(k, {}) == pytest.approx(want), q


@pytest.mark.parametrize(("pool", "block", "filtered"), [(1, 100, False), (5, 100, False), (5, 4, True), (1000, 100, True), (0, 100, False)])
def test_best_of_all_blocks(spark, world, pool, block, filtered):
    """Skipped blocks change nothing; filters don't change which questions fall back."""
    asked, own, index, chunks = world
    keep = chunks.where("chunk_id LIKE '%3%' OR chunk_id LIKE 'same%'")
    got = {}
    for r in lexical_index.search(asked, index, pool, keep if filtered else None, block=block).orderBy("rank").collect():
        got.setdefault(r.question_id, []).append(r.chunk_id)
    kept = {r.chunk_id for r in keep.collect()} if filtered else None
    for k, q in enumerate(QUESTIONS):
        assert got.get(k, []) == brute(q, own, kept)[2][:pool], q


def test_no_questions_and_no_chunks(spark, world):
    asked, _, index, chunks = world
    assert lexical_index.search(asked.limit(0), index, 5).count() == 0
    assert lexical_index.search(asked, lexical_index.stored_index(chunks.limit(0)), 5).count() == 0


def test_keys_of_questions_may_be_strings(spark, world):
    _, own, index, _ = world
    asked = spark.createDataFrame([("1:0", "alpha beta"), ("1:1", "omega")], "question_id string, question string")
    got = {}
    for r in lexical_index.search(asked, index, 3).orderBy("rank").collect():
        got.setdefault(r.question_id, []).append(r.chunk_id)
    assert got == {"1:0": brute("alpha beta", own)[2][:3], "1:1": brute("omega", own)[2][:3]}


def test_blocks_below_the_best_scores_are_skipped():
    """A block that can't reach the k-th best score isn't opened."""
    opened = []

    class Counting(lexical_index.Block):
        def counts(self, q):
            opened.append(self.best["a"])
            return super().counts(q)

    def block(n):
        out = Counting()
        out.ids, out.places, out.best = ["x", "y"], {"a": (np.repeat([0, 1], n).astype(np.int32), np.arange(2 * n, dtype=np.int32))}, {"a": n}
        return out

    asked = [lexical_index.Asked(loose=["a"])]
    list(lexical_index.answered(asked, iter([block(5), block(2), block(7), block(4)]), 2, True, False))
    assert opened == [5, 7]


@pytest.mark.parametrize(("pool", "block", "filtered"), [(1, 100, False), (5, 100, False), (5, 4, True), (1000, 100, True)])
def test_many_questions_find_what_few_find(spark, world, monkeypatch, pool, block, filtered):
    """Full matches of all questions at once, the fallback only for those that match nothing."""
    monkeypatch.setattr(lexical_index, "TOGETHER", 0)
    test_best_of_all_blocks(spark, world, pool, block, filtered)


def test_full_matches_of_many_questions_open_few_lists(world, monkeypatch):
    """Words that no chunk has together, and plain matches, cost no step for each question."""
    asked, own, index, _ = world
    opened = []
    monkeypatch.setattr(lexical_index.Block, "matches", lambda self, q, among=None: opened.append(q))
    plain = [q for q in QUESTIONS if "or" not in q.split() and not re.search(r"(^|\s)-", q)]
    parsed = [[words for _, _, words in groups_of(q)] for q in plain]
    questions = [lexical_index.Asked({k: [w] for k, w in enumerate(parts)}, [], list(dict.fromkeys(w for ws in parts for _, w in ws))) for parts in parsed]
    words = sorted({w for q in questions for w in q.wanted})
    rows = index.where(index.term.isin([*words, lexical_index.IDS])).sort("block").toArrow().select(["block", "term", "best", "chunks", "places", "ids"])
    needs = lexical_index._needs(questions, words)
    got = {}
    for which, ids, scores in lexical_index.strict_answers(questions, needs, lexical_index._flat_blocks(iter(rows.to_batches()), needs), 1000, False):
        for k, c, s in zip(which.tolist(), ids.to_pylist(), scores.to_pylist(), strict=True):
            got.setdefault(k, {})[c] = s
    for k, q in enumerate(plain):
        full, want, _ = brute(q, own)
        assert got.get(k, {}) == (pytest.approx(want) if full else {}), q
    assert not opened


def test_many_questions_leave_a_task_with_their_best_only(world):
    """Needs of all questions come from columns; blocks of a task share the best, with scores beyond what a cosine can be."""
    asked, own, index, _ = world
    ids = pa.array(range(len(QUESTIONS)), pa.int64())
    needs, other = lexical_index._needs_of_terms(ids, lexical.query_terms(asked).toArrow())
    rows = index.where(index.term.isin([*needs.terms, lexical_index.IDS])).sort("block").toArrow().select(["block", "term", "best", "chunks", "places", "ids"])
    found = list(lexical_index.strict_answers(other, needs, lexical_index._flat_blocks(iter(rows.to_batches()), needs), 2, False))
    assert len(index.select("block").distinct().collect()) > 2 and all(chunk.null_count == len(chunk) for _, chunk, _ in found[:-1])
    got = {}
    for k, c, s in zip(found[-1][0].tolist(), found[-1][1].to_pylist(), found[-1][2].to_pylist(), strict=True):
        got.setdefault(k, {})[c] = s
    for k, q in enumerate(QUESTIONS):
        full, want, order = brute(q, own)
        assert got.get(k, {}) == (pytest.approx({c: want[c] for c in order[:2]}) if full else {}), q
    assert set(other) == {k for k in range(len(QUESTIONS)) if not needs.plain[k]}
    best = lexical_index.Nearest(2, 3)
    best.wait(np.array([2, 1, 1, 1]), np.array([9e4, 5.0, 7.5, 1e5]), np.array([b"a", b"b", b"c", b"d"]))
    best.settle()
    assert set(zip(best.question.tolist(), best.chunk.tolist())) == {(1, b"c"), (1, b"d"), (2, b"a")}
