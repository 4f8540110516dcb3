"""Language identification by error-correcting output codes.

Each language has a codeword; binary n-gram classifiers (logistic regressions) predict its bits from hashed byte
n-grams of the whole text. Decoding weighs every bit's loss by how well that bit separates the language on the
training sample and takes the codeword with the least loss; a narrow margin flags the text as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.llm.common import annotate, crc32_of_id, fresh_names

#: Rows that the classifiers are fitted on, about, and of each language at least (where it has them); of more, those
#: with the smallest hashes of their id. Every language is learned: the driver holds about 32 kB for each of these rows.
SAMPLE_ROWS, LEAST_ROWS = 3000, 8
#: Languages whose rates are broadcast (a name and a number each); beyond, rows are joined by a shuffle.
BROADCAST_LANGUAGES = 100_000
GRAMS = 1 << 12
#: Below this lead of the best codeword's probability over the second's a text is ambiguous.
MARGIN = 0.2
#: A letter: of \w neither a digit nor a number sign such as a fraction.
_LETTER = regex.compile(r"\p{L}")
#: ASCII letters folded; digits, punctuation and controls are all a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def grams(text: str) -> np.ndarray:
    """Unit vector of square roots of counts of hashed byte pairs and triples, spaces collapsed."""
    raw = b" " + b" ".join(text.encode("utf-8", "replace").translate(_FOLD).split()) + b" "
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    pairs = ((a[:-1] * 2654435761 + a[1:] * 40503) >> 7) % (GRAMS // 4)
    counts = np.zeros(GRAMS)
    counts[: GRAMS // 4] = np.bincount(pairs, minlength=GRAMS // 4)
    if len(a) > 2:
        triples = ((a[:-2] * 2246822519 + a[1:-1] * 3266489917 + a[2:] * 668265263) >> 9) % (GRAMS - GRAMS // 4)
        counts[GRAMS // 4 :] = np.bincount(triples, minlength=GRAMS - GRAMS // 4)
    out = np.sqrt(counts)
    return (out / max(1e-9, np.sqrt((out**2).sum()))).astype(np.float32)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n rows of +1 and -1: all splits of the languages where these are few, else the best of random codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        columns = [[1 if (s >> i) & 1 else -1 for i in range(n)] for s in range(1, 2 ** (n - 1))]
        return np.array(columns).T
    rng, length = np.random.default_rng(seed), max(15, int(np.ceil(8 * np.log2(n))))
    best, far = None, -1
    for _ in range(max(3, 20_000 // n)):
        code = rng.choice([-1, 1], (n, length))
        alike = code.astype(np.float32) @ code.T.astype(np.float32)
        np.fill_diagonal(alike, -length)
        apart = int(length - alike.max()) // 2
        if apart > far and (np.abs(code.sum(0)) < n).all():
            best, far = code, apart
    return best if best is not None else rng.choice([-1, 1], (n, length))


@dataclass
class Codes:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For rows of grams: language number, probability, lead over the second."""
        bits = x @ self.weights + self.bias
        losses = np.logaddexp(0, -self.code[None] * bits[:, None, :])
        loss = (self.trust[None] * losses).sum(2)
        p = np.exp(-(loss - loss.min(1, keepdims=True)) * self.code.shape[1])
        p /= p.sum(1, keepdims=True)
        order = np.sort(p, 1)
        return loss.argmin(1), order[:, -1], order[:, -1] - (order[:, -2] if p.shape[1] > 1 else 0)


def sample_text(text: str) -> list[str]:
    """A text as it is learned from: whole, and a short piece of it."""
    return [text, " ".join(text.split()[2:10]) or text]


def fit_codes(rows: np.ndarray, langs: list[str], steps: int = 100) -> Codes:
    """Fit all bits at once by gradient descent with momentum on rows of grams and their languages."""
    languages = sorted(set(langs))
    code = codewords(len(languages))
    if not len(rows):
        return Codes([], code, np.zeros((GRAMS, 1)), np.zeros(1), code)
    x, number = rows, {v: i for i, v in enumerate(languages)}
    y = np.array([number[v] for v in langs])
    size = np.bincount(y, minlength=len(languages))
    cost = (1 / size)[y][:, None] / len(languages)
    target = code[y].astype(np.float32)
    w, b = np.zeros((GRAMS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    mw, mb, rate = np.zeros_like(w), np.zeros_like(b), 60.0
    for _ in range(steps):
        slope = (-cost * target / (1 + np.exp(np.clip(target * (x @ w + b), -50, 50)))).astype(np.float32)
        mw, mb = 0.9 * mw + x.T @ slope + 1e-6 * w, 0.9 * mb + slope.sum(0)
        w, b = w - rate * mw, b - rate * 0.05 * mb
    right = (np.sign(x @ w + b) == target).astype(float)
    trust = np.stack([right[y == i].mean(0) for i in range(len(languages))])
    return Codes(languages, code, w.astype(np.float32), b, trust / np.maximum(1e-9, trust.sum(1, keepdims=True)))


def fit(docs: DataFrame, learn_from: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Codes:
    """Fit on about sample_rows rows with text and language for which learn_from holds; the same rows at every run.

    The rows' grams are counted in tasks; texts don't come to the driver. Of several rows with one id and language, one is
    learned (by a hash of the text), so that a repeated id brings no more than that. A table without such rows teaches
    nothing.
    """
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    if learn_from is not None:
        rows = rows.where(learn_from)
    per = rows.groupBy(F.col(lang_col).alias("_lang")).agg(F.count("*").alias("_n"))
    n = per.count()
    wanted = F.greatest(F.lit(sample_rows) / F.lit(max(1, n)), F.lit(LEAST_ROWS))
    rates = per.select("_lang", F.least(F.lit(1.0), wanted / F.col("_n")).alias("_rate"))
    chosen = F.pmod(F.xxhash64(id_col), F.lit(1 << 52)) < F.col("_rate") * (1 << 52)
    rows = rows.select(F.col(text_col), F.col(id_col), F.col(lang_col))
    some = rows.join(F.broadcast(rates) if n <= BROADCAST_LANGUAGES else rates, F.col(lang_col) == F.col("_lang")).where(chosen)
    some = some.select(F.col(text_col).alias("text"), F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"))

    def make():
        def counted(texts: list[str], _: pa.RecordBatch) -> list[pa.Array]:
            found = [[g for x in sample_text(t) for g in (grams(x),)] if _LETTER.search(t) else [] for t in texts]
            sparse = [[(np.flatnonzero(g).astype("<u2").tobytes(), g[g != 0].tobytes()) for g in own] for own in found]
            return [pa.array([[x for pair in own for x in pair] for own in sparse], pa.list_(pa.binary()))]

        return counted

    found = annotate(some, "text", [("grams", "array<binary>")], make).where("size(grams) > 0").groupBy("id", "lang").agg(F.max_by("grams", F.xxhash64("text")).alias("grams")).toArrow()
    order = sorted(range(found.num_rows), key=lambda i: (found["id"][i].as_py(), found["lang"][i].as_py()))
    rows_, langs = np.zeros((2 * len(order), GRAMS), np.float32), [found["lang"][i].as_py() for i in order]
    for k, i in enumerate(order):
        own = found["grams"][i].as_py()
        for half in range(2):
            rows_[k + half * len(order), np.frombuffer(own[2 * half], "<u2")] = np.frombuffer(own[2 * half + 1], np.float32)
    return fit_codes(rows_, langs * 2)


def identify(docs: DataFrame, codes: Codes, text_col: str = "text", unknown: str = "und", margin: float = MARGIN) -> tuple[DataFrame, list[str]]:
    """Append lang_pred, score (0 to 1) and ambiguous for every whole text; returns the table and the columns' names.

    A null text, one without a letter, and every text where nothing was learned get `unknown` with score 0, ambiguous.
    """
    names = fresh_names(docs, ["lang_pred", "score", "ambiguous"])
    sent = docs.sparkSession.sparkContext.broadcast(codes)

    def make():
        own = sent.value

        def judge(texts: list[str | None], _: pa.RecordBatch) -> list[pa.Array]:
            langs, scores, unsure = [unknown] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            known = [i for i, t in enumerate(texts) if t and own.languages and _LETTER.search(t)]
            for at in range(0, len(known), 256):
                some = known[at : at + 256]
                best, p, lead = own.decode(np.stack([grams(texts[i]) for i in some]))
                for i, k in zip(some, best, strict=True):
                    langs[i] = own.languages[k]
                scores[some], unsure[some] = np.clip(p, 0, 1), lead < margin
            return [pa.array(langs), pa.array(scores, pa.float64()), pa.array(unsure)]

        return judge

    return annotate(docs, text_col, list(zip(names, ["string", "double", "boolean"], strict=True)), make), names


def learning_rows(id_col: str = "doc_id") -> Column:
    """Rows that may be learned from: crc32 of the id as text, modulo 5, isn't 0."""
    return F.pmod(crc32_of_id(F.col(id_col)), F.lit(5)) != 0


def report(docs: DataFrame) -> DataFrame:
    """One row per document, in the form of query op9. A row without id was not held out."""
    codes = fit(docs.select("doc_id", "text", "lang"), learning_rows())
    out, _ = identify(docs.select("doc_id", "text"), codes)
    return out.select("doc_id", F.coalesce(~learning_rows(), F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
