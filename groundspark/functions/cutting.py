"""Words of a batch of texts, cut by NumPy on the batch's bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of white space that is one byte, and of `[a-z0-9]`.
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_ALNUM = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))
#: White space of more bytes, as (?U)\s has it: first bytes, then the last one. U+0085, 00A0, 1680, 2000 to 200A, 2028, 2029, 202F, 205F, 3000.
_WIDE_BLANKS = [
    (b"\xc2", [0x85, 0xA0]), (b"\xe1\x9a", [0x80]), (b"\xe2\x80", [*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF]), (b"\xe2\x81", [0x9F]), (b"\xe3\x80", [0x80]),
]


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where each text begins and the last one ends. A null is empty."""
    texts = texts.fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    held = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held is not None and held.size else np.zeros(0, np.uint8)
    return data, ends.astype(np.int64) - ends[0]


def _in_words(data: np.ndarray) -> np.ndarray:
    """Which bytes aren't white space."""
    keep = ~_BLANK[data]
    for head, last in _WIDE_BLANKS:
        at = np.flatnonzero(data == head[0])
        at = at[at + len(head) < len(data)]
        if len(head) == 2 and len(at):
            at = at[data[at + 1] == head[1]]
        if len(at):
            at = at[np.isin(data[at + len(head)], last)]
            for k in range(len(head) + 1):
                keep[at + k] = False
    return keep


def _starts(keep: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where words begin; none goes on from one text to the next."""
    start = keep.copy()
    start[1:] &= ~keep[:-1]
    first = ends[:-1][ends[:-1] < len(keep)]
    start[first] = keep[first]
    return np.flatnonzero(start)


def _cut(data: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    first = _starts(keep, ends)
    upto = np.cumsum(keep, dtype=np.int32)
    offsets = np.append(upto[first] - 1, upto[-1] if len(upto) else 0).astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data[keep]))
    return tokens, np.diff(np.searchsorted(first, ends))


def between_blanks(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """The words between white space of all texts, and how many each text has."""
    data, ends = _bytes(texts)
    return _cut(data, ends, _in_words(data))


def letters_and_digits(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """The words `[a-z0-9]+` of all texts, and how many each text has."""
    data, ends = _bytes(texts)
    return _cut(data, ends, _ALNUM[data])


@F.arrow_udf(T.ArrayType(T.StringType()))
def windows(texts: pa.Array, target: pa.Array, step: pa.Array) -> pa.Array:
    """Windows of `target` words, `step` words apart, with one blank between words; no words, no windows."""
    size, step_ = (x[0].as_py() if len(x) else 1 for x in (target, step))
    data, ends = _bytes(texts)
    keep = _in_words(data)
    first = _starts(keep, ends)
    fin = keep.copy()
    fin[:-1] &= ~keep[1:]
    end = ends[1:][ends[1:] > 0] - 1
    fin[end] = keep[end]
    last, own = np.flatnonzero(fin), np.searchsorted(first, ends)
    # a blank behind each word but the last one of a text, which no window ends with
    also = np.zeros(len(keep), bool)
    also[1:] = keep[:-1] & ~keep[1:]
    also[ends[:-1][ends[:-1] < len(keep)]] = False
    there = keep | also
    at = np.cumsum(there, dtype=np.int32)
    begins, stops = at[first] - 1, at[last]
    plain = memoryview(np.where(keep, data, 32).astype(np.uint8)[there])
    n = np.diff(own)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - size) // step_)), 0)
    row = np.repeat(np.arange(len(n)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    lo = own[:-1][row] + place * step_
    hi = np.minimum(lo + size, own[1:][row]) - 1
    a, z = begins[lo], stops[hi]
    pieces = pa.py_buffer(b"".join([plain[i:j] for i, j in zip(a.tolist(), z.tolist(), strict=True)]))
    offsets = np.append(0, np.cumsum(z.astype(np.int64) - a))
    if offsets[-1] < 1 << 31:
        found = pa.StringArray.from_buffers(len(row), pa.py_buffer(offsets.astype(np.int32)), pieces)
    else:
        found = pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(offsets), pieces)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), found)


def single_spaced(text: Column) -> Column:
    """The words between white space with one blank between them."""
    return F.coalesce(F.get(windows(text, F.lit(1 << 30), F.lit(1)), F.lit(0)), F.lit(""))
