"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j); the pairs cost linear time, since they equal
half of sum over factors of (sum v_if x_i)^2 - sum (v_if x_i)^2. The machine is fitted on a bounded sample of labelled
rows (SAMPLE_ROWS); every row is scored on its whole text in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.llm.common import annotate, crc32_of_id, fresh_names, sampled

#: Labelled rows that the machine is fitted on, about; of more, those with the smallest hashes of their id.
SAMPLE_ROWS = 6000
WORDS = 1 << 15
FACTORS = 8
LEVELS = 16
#: Shares of byte classes, then of words: see structure().
STATS = 13
FEATURES = WORDS + STATS * LEVELS
EPOCHS = 12
_CLASS = np.zeros(256, np.uint8)
for _c in range(256):
    _ch = chr(_c)
    _CLASS[_c] = 7 if _c >= 128 else 1 if _ch.islower() else 2 if _ch.isupper() else 3 if _ch.isdigit() else 4 if _ch == "\n" else 0 if _ch.isspace() else 5 if _ch in ".,;:'\"-()?" else 6


class _Slots(dict):
    """Word -> feature number; forgotten when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = slot = crc32(word) % WORDS
        return slot


def structure(raw: bytes, slots: np.ndarray, distinct: int, n_chars: int | None) -> list[int]:
    """One feature number for each statistic: its level."""
    n = max(1, len(raw))
    share = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8)[1:8] / n
    words = max(1, len(slots))
    again = float((slots[1:] == slots[:-1]).mean()) if len(slots) > 1 else 0.0
    top = float(np.bincount(slots).max() / words) if len(slots) else 0.0
    ratios = [*np.sqrt(share), distinct / words, np.sqrt(again), np.sqrt(top)]
    levels = [min(LEVELS - 1, int(r * LEVELS)) for r in ratios]
    levels.append(min(LEVELS - 1, int(np.log2(words + 1))))
    levels.append(min(LEVELS - 1, int(len(raw) / words)))
    levels.append(LEVELS - 1 if n_chars is None or n_chars < 0 else min(LEVELS - 2, int(np.log2(n_chars + 1) * 0.8)))
    return [WORDS + i * LEVELS + level for i, level in enumerate(levels)]


def values_of(numbers: np.ndarray) -> np.ndarray:
    """A row's values: words, and statistics behind them, each share a length of 1."""
    words = len(numbers) - STATS
    return np.concatenate([np.full(words, 1 / np.sqrt(max(1, words))), np.full(STATS, 1 / np.sqrt(STATS))])


def features(texts: list[str | None], n_chars: list[int | None], slots: _Slots) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows as starts, feature numbers and values; each has its statistics at least."""
    starts, numbers, values, at = [], [], [], 0
    for text, chars in zip(texts, n_chars, strict=True):
        raw = (text or "").encode("utf-8", "replace")
        words = raw.lower().split()
        own = np.fromiter(map(slots.__getitem__, words), np.int64, len(words))
        kinds = np.unique(own)
        stats = structure(raw, own, len(kinds), chars)
        starts.append(at)
        at += len(kinds) + len(stats)
        numbers += [kinds, np.array(stats, np.int64)]
        values.append(values_of(np.concatenate(numbers[-2:])))
    return np.array(starts, np.int64), np.concatenate(numbers), np.concatenate(values)


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, starts: np.ndarray, numbers: np.ndarray, values: np.ndarray) -> np.ndarray:
        sums = np.add.reduceat(self.factors[numbers] * values[:, None], starts, axis=0)
        squares = np.add.reduceat((self.factors**2).sum(1)[numbers] * values**2, starts)
        return self.bias + np.add.reduceat(self.weights[numbers] * values, starts) + 0.5 * ((sums**2).sum(1) - squares)

    def scores(self, *rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(*rows), -500, 500)))


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """AdaGrad on the log loss in mini-batches; each class has half of the weight. Without rows every score is 0.5."""
    if not rows:
        return Machine(0.0, np.zeros(FEATURES), np.zeros((FEATURES, FACTORS)))
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(FEATURES), rng.normal(0, 0.05, (FEATURES, FACTORS)), 0.0
    gw, gv, gb, rate, decay = np.full(FEATURES, 1e-3), np.full((FEATURES, FACTORS), 1e-3), 1e-3, 0.15, 1e-5
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3) if len(labels) else 0.5
    cost = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for some in np.array_split(order, max(1, len(rows) // 64)):
            if not len(some):
                continue
            lengths = np.array([len(rows[i][0]) for i in some])
            starts = np.cumsum(lengths) - lengths
            numbers, values = (np.concatenate([rows[i][k] for i in some]) for k in (0, 1))
            machine = Machine(bias, w, v)
            error = (machine.scores(starts, numbers, values) - labels[some]) * cost[some] / len(some)
            owner = np.repeat(np.arange(len(some)), lengths)
            sums = np.add.reduceat(v[numbers] * values[:, None], starts, axis=0)
            each = error[owner] * values
            kinds, back = np.unique(numbers, return_inverse=True)
            dw = np.bincount(back, each, len(kinds)) + decay * w[kinds]
            pair = each[:, None] * (sums[owner] - v[numbers] * values[:, None])
            dv = np.stack([np.bincount(back, pair[:, f], len(kinds)) for f in range(FACTORS)], 1) + decay * v[kinds]
            gw[kinds] += dw**2
            gv[kinds] += dv**2
            gb += error.sum() ** 2
            w[kinds] -= rate * dw / np.sqrt(gw[kinds])
            v[kinds] -= rate * dv / np.sqrt(gv[kinds])
            bias -= rate * error.sum() / np.sqrt(gb)
    return Machine(bias, w, v)


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", chars_col: str | None = "n_chars", sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Fit on about sample_rows labelled rows for which learn_from (over id_col) holds.

    The sample is taken by a hash of the id at a rate set from the count of labelled ids, so it is the same at every run
    and its ids are bounded; it is broadcast to the documents, and its features' numbers come to the driver (66 kB an id
    at most; of several rows with one id, the one of the greatest numbers). Rows with a null id or label aren't used; an
    id with several labels counts as its mean, at least a half as 1.
    """
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isNotNull())
    if learn_from is not None:
        rows = rows.withColumnRenamed("_id", id_col).where(learn_from).withColumnRenamed(id_col, "_id")
    count = rows.select("_id").distinct().count()
    rate = min(1.0, sample_rows / max(1, count))
    rows = rows.where(sampled(F.col("_id"), rate)).groupBy("_id").agg((F.avg("_y") >= 0.5).cast("int").alias("_y"))
    chars = F.col(chars_col).cast("long") if chars_col and chars_col in docs.columns else F.lit(None).cast("long")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), chars.alias("_chars"))
    sample = texts.join(F.broadcast(rows), "_id").select("_id", "_text", "_chars", "_y")

    def make():
        slots = _Slots()

        def rows_of(texts: list[str | None], part: pa.RecordBatch) -> list[pa.Array]:
            starts, numbers, _ = features(texts, part.column(2).to_pylist(), slots)
            ends = [*starts.tolist(), len(numbers)]
            return [pa.array([numbers[a:b].astype("<u2").tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary())]

        return rows_of

    # two bytes for each distinct feature: a row has FEATURES of them at most, however long its text
    found = annotate(sample, "_text", [("_numbers", "binary")], make).groupBy("_id", "_y").agg(F.max("_numbers").alias("_numbers")).toArrow()
    raws = found["_numbers"].to_pylist()
    order = np.lexsort((np.array([len(x) for x in raws]), np.array(found["_id"].to_pylist(), dtype=object).astype(str))) if found.num_rows else np.array([], np.int64)
    data = [np.frombuffer(raws[int(i)], "<u2") for i in order]
    return fit_rows([(x.astype(np.int64), values_of(x)) for x in data], np.array(found["_y"].to_pylist(), float)[order] if found.num_rows else np.zeros(0))


def score(docs: DataFrame, machine: Machine, text_col: str = "text", chars_col: str | None = "n_chars") -> tuple[DataFrame, str]:
    """Append the score (0 to 1) of every whole text; returns the table and the column's name.

    Null and empty texts are scored by their statistics; a null n_chars is a level of its own. Without labelled rows
    every score is 0.5.
    """
    (name,) = fresh_names(docs, ["score"])
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(chars_col) if chars_col and chars_col in docs.columns else None

    def make():
        slots, own = _Slots(), sent.value

        def scores(texts: list[str | None], part: pa.RecordBatch) -> list[pa.Array]:
            chars = part.column(at).to_pylist() if at is not None else [None] * len(texts)
            return [pa.array(own.scores(*features(texts, chars, slots)), pa.float64())]

        return scores

    return annotate(docs, text_col, [(name, "double")], make), name


def learning_rows(id_col: str = "doc_id") -> Column:
    """Rows that may be learned from: crc32 of the id as text, modulo 3, isn't 1."""
    return F.pmod(crc32_of_id(F.col(id_col)), F.lit(3)) != 1


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document, in the form of query op2. A row without id was not held out."""
    machine = fit(docs, labels, learning_rows())
    scored, _ = score(docs.select("doc_id", "text", "n_chars"), machine)
    held_out = F.coalesce(~learning_rows(), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score at least the threshold, with their columns.

    Null, empty and very long texts are scored like all others, rows of equal or null ids each by their own text. Without
    labelled rows every score is 0.5; an empty table stays empty.
    """
    machine = fit(docs, labels, learning_rows())
    scored, name = score(docs, machine)
    return scored.where(F.col(name) >= threshold).select(*docs.columns)
