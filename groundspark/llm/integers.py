"""Embeddings as exact whole numbers: floor(1024 * component), with partial sums that never round."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 1024
#: Scaled components up to this size: squared distances and squared lengths of vectors of 128 such differences fit a long.
LIMIT = 1 << 27


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, width: int | None = None) -> DataFrame:
    """id, x (array<long>): the vectors of one width as floor(SCALE * component).

    Left out are vectors that are null, empty, of another width, or that hold null or non-finite components, or
    components from LIMIT / SCALE (131,072) on, whose squares don't fit a long. Without a width it is the one that most
    other vectors have (the larger one of equals). Rows are neither grouped nor told apart by their id, which may be null.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    odd = F.exists("vec", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LIMIT / SCALE))
    v = v.where(F.col("vec").isNotNull() & (F.size("vec") > 0) & ~odd)
    if width is None:
        found = v.groupBy(F.size("vec").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
        width = found["w"] if found else 0
    return v.where(F.size("vec") == width).select("id", F.transform("vec", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def exact_sums(partial: DataFrame, keys: list[str]) -> dict[tuple, int]:
    """Sums of `value` (long) by the keys, as Python's whole numbers. There must be few keys, whatever the table's size."""
    rows = partial.groupBy(*keys).agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    return {tuple(r[k] for k in keys): int(r["value"]) for r in rows}
