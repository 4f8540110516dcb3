"""SentencePiece ids and texts by distinct marked words against the library on whole texts."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from test_text_operators import prose

from groundspark.llm import pieces

SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
MODEL = pieces.Model(pieces.default_model())
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [
    None, "", " ", "  ", "     ", "a", " a", "a ", " a  b   ", "\n", "a\nb\n\n c", "\tx\r\ny ", "▁", "▁▁a b▁c ▁", "ﬁ ① é é ÅΩ", "日本 語の　テスト", "\U0001f600 \U0001f468‍\U0001f469", "a\x00b \x01",
    "<s> </s> <unk> <0x0A>", "x" * 20_000, " " * 3_000, "word " * 3_000, "a  b  a  b", "for (int i = 0; i < 10; i++) {\r\n\treturn;\r\n}", "�", prose(31, 300), prose(32, 40_000, 3000), "same same", "same same",
]


def rows():
    return [(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None, None), (3, "again 3", None, None, 0)]


def whole(text):
    return SP.encode(text or "", add_bos=True, add_eos=True)


@pytest.mark.parametrize("bounds", [(10**6, 10**9), (20, 10**9), (0, 0), (10**6, 600)])
def test_ids_and_texts(spark, bounds):
    """The table broadcast whole, in part, or not at all: always the library's ids and text."""
    t = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = pieces.encode(t, most_words=bounds[0], most_bytes=bounds[1]).collect()
    assert len(got) == len(rows())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.text is None) for r in got) == sorted((i is None, i or 0, t or "", t is None) for i, t, *_ in rows())
    for r in got:
        assert r.pieces == whole(r.text) and r.decoded == SP.decode(whole(r.text))


def test_query(spark):
    t = spark.createDataFrame(rows(), SCHEMA)
    got = sorted(map(tuple, pieces.report(t).collect()), key=str)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(whole(t)), digest(np.array(whole(t), "<u4").tobytes()), digest(SP.decode(whole(t)).encode())) for i, t, *_ in rows()]
    assert got == sorted(want, key=str)


def test_query_over_documents(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in pieces.report(t).collect()}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    own = t.collect()
    assert len(got) == len(own)
    for r in own:
        ids = whole(r.text)
        assert got[r.doc_id] == (len(ids), digest(np.array(ids, "<u4").tobytes()), digest(SP.decode(ids).encode()))


def test_empty_table_and_clashing_names(spark):
    assert pieces.report(spark.createDataFrame([], SCHEMA)).collect() == []
    t = spark.createDataFrame([(1, "a b a b", "x", 7, "y")], "doc_id long, text string, pieces string, word long, Decoded string")
    for bounds in ((10, 1000), (0, 0)):
        out = pieces.encode(t, most_words=bounds[0], most_bytes=bounds[1])
        assert out.columns == ["doc_id", "text", "pieces", "word", "Decoded", "_pieces", "_decoded"]
        assert tuple(out.first()) == (1, "a b a b", "x", 7, "y", whole("a b a b"), "a b a b")


def test_each_repeated_word_is_in_the_table_once(spark):
    t = spark.createDataFrame([("b a b", 1), ("a  c", 2), (None, 3)], "text string, n int").repartition(3)
    counts = {r.word: r.n for r in pieces.word_counts(t, "text").collect()}
    assert counts == {"a": 2, "b": 2, " c": 1}
    table = pieces.word_table(pieces.word_counts(t, "text"), pieces.default_model()).collect()
    assert sorted(r.word for r in table) == [" c", "a", "b"]
    assert all(np.frombuffer(r.ids, "<u4").tolist() == SP.encode(r.word) and r.spelled is None for r in table)


def test_the_table_holds_the_most_frequent_words(spark):
    counts = spark.createDataFrame([(f"w{k}", 2**k) for k in range(1, 11)], "word string, n long")
    assert [pieces.bounded_rank(counts, n, 10**6) for n in (0, 1, 3, 10, 99)] == [1 << 62, 1024, 256, 2, 2]
    assert pieces.bounded_rank(counts, 99, 2 * (16 + 15)) == 512


def test_a_task_forgets_its_oldest_words(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    monkeypatch.setattr(pieces, "SEGMENTED", 2)
    words = pieces.Words(MODEL, {"a": MODEL.segment(["a"])[0]}, {})
    for text in ("a b c d e", "f g", "b a f", "x", "e"):
        ((ids, told),) = words.texts([pieces.marked_words(text)])
        assert np.frombuffer(ids, "<u4").tolist() == SP.encode(text) and told == text
    assert len(words.own) + len(words.older) <= 12


def test_decoding_any_ids(spark):
    r = np.random.default_rng(5)
    lists = [r.integers(0, 32_000, n).tolist() for n in (1, 2, 5, 40, 400)] + [r.integers(0, 300, 200).tolist() for _ in range(5)]
    mark = SP.piece_to_id("▁")
    lists += [None, [], [1], [1, 2], [1, 1, mark, mark, 1, mark], [mark], [2, 264], [1, 3, 200, 264], [*whole(" a  b "), *whole("x y")], *map(whole, TEXTS)]
    got = pieces.decode(spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "decoded long, pieces array<int>")).collect()
    assert {g.decoded: g._decoded for g in got} == {i: None if x is None else SP.decode(x) for i, x in enumerate(lists)}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" ▁a bcé\n\t\x00日Åﬁ<>0\r{});\U0001f600")))
def test_words_give_what_whole_texts_give(text):
    words = pieces.marked_words(text)
    ids = MODEL.segment(words)
    assert np.frombuffer(b"".join(ids), "<u4").tolist() == SP.encode(text)
    assert " ".join(MODEL.spell(ids)) == SP.decode(SP.encode(text))
