"""Column functions on vectors (arrays of numbers)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundspark.functions.cutting import between_blanks

#: Words whose hashes a task remembers.
REMEMBERED = 200_000


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length; 1 for a zero vector."""
    length = F.sqrt(dot(a, a))
    return F.when(length == 0, 1.0).otherwise(length)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero vector's length counts as 1."""
    return dot(a, b) / (norm(a) * norm(b))


class _FirstBytes(dict):
    """Word -> first byte of its sha256; forgotten when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = first = hashlib.sha256(word.encode()).digest()[0]
        return first


_FIRST = _FirstBytes()


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _hashed_counts(texts: pa.Array, width: pa.Array) -> pa.Array:
    """How many of each text's words have each first byte (modulo the width), scaled to length 1. Words that repeat in a
    batch are hashed once."""
    n = width[0].as_py() if len(width) else 1
    words, sizes = between_blanks(texts)
    coded = words.dictionary_encode()
    first = np.array([_FIRST[w] for w in coded.dictionary.to_pylist()], np.int64) % n
    bucket = first[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * n + bucket, minlength=n * len(sizes)).reshape(-1, n).astype(float)
    length = np.sqrt((counts**2).sum(1, keepdims=True))
    scaled = (counts / np.where(length == 0, 1, length)).astype(np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * n, pa.int32()), pa.array(scaled.ravel()))


def hash_embedding(text: Column, width: int = 64) -> Column:
    """Words (lower case, between white space) counted by the first byte of their sha256, scaled to length 1.

    Words are cut, hashed and counted by the batch.
    """
    return _hashed_counts(F.lower(text), F.lit(width))
