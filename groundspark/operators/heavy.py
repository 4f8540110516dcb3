"""Frequent keys with bounded state: summaries that merge, as a batch aggregate and as a stream's state.

A summary holds at most `capacity` keys with counts. Where there are more, the largest count that doesn't fit is taken
off all of them (`lost`), and those at 0 go: a key's true number lies between its count and its count plus all that was
lost, and a key that isn't there has occurred at most `lost` times. Of n rows at most n / (capacity + 1) are lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.sources.scratch import written

CAPACITY = 10_000


def shortened(counts: pd.Series, capacity: int) -> tuple[pd.Series, int]:
    """Counts by key without those that don't fit, and what was lost."""
    if len(counts) <= capacity:
        return counts, 0
    lost = int(counts.nlargest(capacity + 1).iloc[-1])
    counts = counts - lost
    return counts[counts > 0], lost


def summary(rows: DataFrame, key: Column, capacity: int = CAPACITY) -> DataFrame:
    """key, n: the sums of the tasks' summaries; the row of a null key has what they have lost. Null keys don't count.

    A task hands on `capacity` rows at most, however many keys it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, lost = pd.Series(dtype="int64"), 0
        for batch in batches:
            found = pd.Series(batch.column(0).to_pylist(), dtype=object).value_counts()
            counts, gone = shortened(counts.add(found, fill_value=0).astype("int64"), capacity)
            lost += gone
        yield pa.RecordBatch.from_arrays([pa.array([None, *counts.index], pa.string()), pa.array([lost, *counts.tolist()], pa.int64())], names=["key", "n"])

    return rows.select(key.alias("key")).where("key IS NOT NULL").mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))


def candidates(rows: DataFrame, key: Column, top: int, capacity: int = CAPACITY) -> DataFrame | None:
    """The keys (key) that can be among the `top` most frequent ones; None if the summaries can't tell, since more was
    lost than the last of the top has."""
    found = written(summary(rows, key, capacity), "heavy")
    lost = found.where("key IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    best = [r["n"] for r in found.where("key IS NOT NULL").orderBy(F.desc("n")).limit(top).collect()]
    least = best[-1] if len(best) == top else 0
    return found.where(F.col("key").isNotNull() & (F.col("n") + lost >= least)).select("key") if lost == 0 or lost < least else None
