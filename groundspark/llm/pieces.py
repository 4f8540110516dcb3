"""SentencePiece ids of whole texts, and texts of ids, by tables of distinct marked words.

A text's marked words are its runs of whitespace markers with what follows up to the next run; the library puts one
marker in front of a text. Where no piece of the vocabulary holds a marker behind another character, no merge crosses
from one marked word into the next, so a text's ids are those of its marked words one after another.

All words are counted, with partial sums. The most frequent ones, as many as may be broadcast, form the table: Spark
segments and decodes each of them once, and tasks join them back by position. The rest (in natural text a few per cent
of the places, most of them words that occur once or twice) gets a table of its own in each task, from which words go in
the order in which they came. So texts aren't shuffled, and nothing of a text is written.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundspark.llm.common import Scratch, annotate, fresh_names, small_batches

MARK = "▁"
#: Words, and bytes of words and ids, that may be broadcast.
BROADCAST_WORDS, BROADCAST_BYTES = 400_000, 40 << 20
#: Words that a task counts before it hands them on, segments at a time, and keeps in either half of its own table.
COUNTED, SEGMENTED, REMEMBERED = 100_000, 10_000, 100_000
#: What a normaliser would change: compatibility forms, case, runs of blanks, blanks at the ends, controls.
_PROBE = "  ﬁ Å ①  A\t\x01　​ İ "


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Model:
    """A SentencePiece model whose pieces don't cross markers; others are refused."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces of this model cross whitespace markers")
        if self.sp.normalize(_PROBE) != MARK + _PROBE.replace(" ", MARK):
            raise ValueError("this model changes texts before it splits them")
        self.mark = array("I", [self.sp.piece_to_id(MARK)]).tobytes()

    def segment(self, words: list[str]) -> list[bytes]:
        """Ids of marked words (without their first marker, which the library adds) as unsigned 32-bit bytes."""
        ids = self.sp.encode(words, num_threads=1)
        return [array("I", x).tobytes() if w else self.mark for w, x in zip(words, ids, strict=True)]

    def spell(self, ids: list[bytes]) -> list[str]:
        """The library's text for the ids of each marked word; it drops the first marker."""
        return self.sp.decode([np.frombuffer(x, "<u4").tolist() for x in ids], num_threads=1)


def marked_words(text: str) -> list[str]:
    """The text's marked words, each without its first marker (one stands in front of the text); none if it is empty."""
    if not text:
        return []
    text = text.replace(MARK, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [w[1:] for w in re.findall(" +[^ ]*", f" {text}")]
    return text.split(" ")


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """word, n: how often each marked word occurs. Tasks count first; null and empty texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(marked_words(text or ""))
                if len(counts) > COUNTED:
                    yield told()
        yield told()

    return docs.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_table(words: DataFrame, model: str) -> DataFrame:
    """word, n, ids (binary), spelled (what decoding gives, null where that is the word itself)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(model)
        for batch in batches:
            for at in range(0, batch.num_rows, SEGMENTED):
                part = batch.slice(at, SEGMENTED)
                found = part.column(0).to_pylist()
                ids = own.segment(found)
                spelled = [None if s == w else s for s, w in zip(own.spell(ids), found, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.binary()), pa.array(spelled, pa.string())], names=["word", "n", "ids", "spelled"])

    return words.mapInArrow(run, "word string, n long, ids binary, spelled string")


class Words:
    """Ids and text of marked words: those of the broadcast table, and a task's own, of which the older half goes."""

    def __init__(self, model: Model, table: dict[str, bytes], spelled: dict[str, str]) -> None:
        self.model, self.table, self.spelled, self.other = model, table, spelled, dict(spelled)
        self.own: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, documents: list[list[str]]) -> None:
        """Segment and decode the distinct words of some documents that aren't known."""
        if len(self.own) > REMEMBERED:
            self.own, self.older = {}, self.own
            self.other = self.spelled | {w: t for w, t in self.other.items() if w in self.older}
        own, older = self.own, self.older
        missing = {w for words in documents for w in set(words).difference(self.table) if w not in own}
        own.update((w, older[w]) for w in missing if w in older)
        new = [w for w in missing if w not in own]
        for at in range(0, len(new), SEGMENTED):
            part = new[at : at + SEGMENTED]
            ids = self.model.segment(part)
            own.update(zip(part, ids, strict=True))
            self.other.update((w, t) for w, t in zip(part, self.model.spell(ids), strict=True) if t != w)

    def texts(self, documents: list[list[str]]) -> list[tuple[bytes, str]]:
        """Ids and decoded text of documents given as marked words."""
        self.learn(documents)
        table, own, other = self.table, self.own, self.other
        out = []
        for words in documents:
            ids = b"".join([table.get(w) or own[w] for w in words])
            out.append((ids, " ".join([other.get(w, w) for w in words] if other else words)))
        return out


def bounded_rank(counts: DataFrame, most_words: int, most_bytes: int) -> int:
    """The least count, a power of two from 2 on, from which on the words fit both bounds with their ids. The driver gets
    a row for each power of two."""
    size = 5 * F.octet_length("word") + 16  # four bytes of ids for each of the word's, at most
    levels = counts.groupBy(F.floor(F.log2(F.col("n").cast("double"))).alias("level")).agg(F.count("*").alias("words"), F.sum(size).alias("bytes")).collect()
    words, total, least = 0, 0, 1 << 62
    for r in sorted(levels, key=lambda r: -r["level"]):
        words, total = words + r["words"], total + r["bytes"]
        if words > most_words or total > most_bytes:
            break
        least = 1 << r["level"]
    return max(2, least)


def encode(docs: DataFrame, text_col: str = "text", model: str | None = None, fields: list[tuple[str, str]] | None = None, make: Callable | None = None, most_words: int = BROADCAST_WORDS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with pieces (array<int>: the ids of the whole text, with begin and end id) and decoded (their text).

    Exactly the library's ids, without sampling, and its decode(ids). A null text counts as empty: begin and end id,
    decoded to an empty text. Repeated rows each stay; columns of the same names get the new ones with underscores. An
    empty table gives an empty one. fields and make replace the two columns: make(begin, end) gives a function from a
    list of (ids as unsigned 32-bit bytes, decoded text) to Arrow arrays, one for each of fields.

    A model whose pieces cross markers, or that changes texts first, raises ValueError.
    """
    spark, path = docs.sparkSession, model or default_model()
    Model(path)  # refuse here, not in a task
    small_batches(spark)
    scratch = Scratch(spark, "pieces")
    counts = scratch.write(word_counts(docs, text_col).where("n > 1"), "counts")
    frequent = counts.where(F.col("n") >= bounded_rank(counts, most_words, most_bytes))
    table = word_table(frequent, path).select("word", "ids", "spelled").toArrow()
    scratch.drop("counts")
    words, ids, spelled = (table[c].to_pylist() for c in ("word", "ids", "spelled"))
    known = spark.sparkContext.broadcast((dict(zip(words, ids, strict=True)), {w: s for w, s in zip(words, spelled, strict=True) if s is not None}))
    if fields is None:
        fields, make = list(zip(fresh_names(docs, ["pieces", "decoded"]), ["array<int>", "string"], strict=True)), _plain

    def run() -> Callable:
        own = Words(Model(path), *known.value)
        tell = make(*(array("I", [i]).tobytes() for i in (own.model.sp.bos_id(), own.model.sp.eos_id())))
        return lambda texts, _: tell(own.texts([marked_words(t or "") for t in texts]))

    return annotate(docs, text_col, fields, run)


def _plain(begin: bytes, end: bytes) -> Callable:
    def tell(rows: list[tuple[bytes, str]]) -> list[pa.Array]:
        ids = [np.frombuffer(begin + x + end, "<i4") for x, _ in rows]
        ends = np.cumsum([0, *map(len, ids)])
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))), pa.array([t for _, t in rows], pa.string())]

    return tell


def _digests(begin: bytes, end: bytes) -> Callable:
    def tell(rows: list[tuple[bytes, str]]) -> list[pa.Array]:
        ids = [begin + x + end for x, _ in rows]
        digest = lambda parts: pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), digest(ids), digest(t.encode() for _, t in rows)]

    return tell


def decode(rows: DataFrame, ids_col: str = "pieces", model: str | None = None) -> DataFrame:
    """rows with decoded: the library's text for a column of ids, whatever they are; null for null ids, empty for none.

    Ids are cut before every piece that begins with a marker. A task decodes each distinct cut once, with a marker in
    front that decoding drops instead of the cut's own, and joins the texts in order. The first cut, with begin ids and
    the like in front of it, is decoded as it stands. Ids outside the vocabulary raise.
    """
    path = model or default_model()
    (name,) = fresh_names(rows, ["decoded"])
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])
    at, names = rows.columns.index(ids_col), [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = Model(path).sp
        kinds = range(sp.get_piece_size())
        begins, silent = np.array([sp.id_to_piece(i).startswith(MARK) for i in kinds]), np.array([sp.is_control(i) for i in kinds])
        mark, known = [sp.piece_to_id(MARK)], {}
        for batch in batches:
            ids = [None if x is None else np.array(x, np.int64) for x in batch.column(at).to_pylist()]
            cuts = []
            for x in ids:
                x = np.zeros(0, np.int64) if x is None else x
                lead = int(silent[x].argmin()) if len(x) and not silent[x].all() else len(x)
                ends = [0, *(np.flatnonzero(begins[x[lead + 1 :]]) + lead + 1).tolist(), len(x)]
                cuts.append([x[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)])
            if len(known) > COUNTED:
                known.clear()
            new = list({c for own in cuts for c in own[1:] if c not in known})
            known.update(zip(new, sp.decode([mark + np.frombuffer(c, np.int64).tolist() for c in new], num_threads=1), strict=True))
            heads = sp.decode([np.frombuffer(own[0], np.int64).tolist() for own in cuts], num_threads=1)
            texts = [None if x is None else head + "".join(map(known.__getitem__, own[1:])) for x, head, own in zip(ids, heads, cuts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return rows.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """Rows of query op13: doc_id, n_tokens, ids_sha256, decoded_sha256; texts leave no task."""
    fields = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    return encode(docs.select("doc_id", "text"), fields=fields, make=_digests).drop("text")
