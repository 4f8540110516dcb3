"""What the operators share: columns computed from whole texts, tables in the shared folder, samples."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundspark.sources.scratch import deleted, shared_folder, written  # noqa: F401 - also for the other modules

#: Bytes of text that a Python task holds as words at a time; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: Rows of an Arrow batch: with texts of some kB, a few MB.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the rows and bytes of an Arrow batch, since a row can be a long text."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have SLICE_BYTES at most, or one row."""
    sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)]
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)


def fresh_names(df: DataFrame, names: list[str]) -> list[str]:
    """The names, with underscores in front where the table has them already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def annotate(df: DataFrame, text_col: str, fields: list[tuple[str, str]], make: Callable[[], Callable]) -> DataFrame:
    """Append columns computed from whole texts, in Arrow slices.

    make() runs once in a task and returns a function from the slice's texts (list of str or None) and the
    slice itself to a list of Arrow arrays, one for each of fields (name, DDL type).
    Rows keep all their columns; nothing is shuffled. Null texts are passed as None.
    """
    small_batches(df.sparkSession)
    added = [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields]
    schema = T.StructType([*df.schema.fields, *added])
    at, names = df.columns.index(text_col), [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in batches:
            for part in slices(batch, at):
                new = score(part.column(at).to_pylist(), part)
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=names)

    return df.mapInArrow(run, schema)


def flat_rows(df: DataFrame, text_col: str, schema: str, make: Callable[[], Callable]) -> DataFrame:
    """Rows made from whole texts: make()'s function returns an Arrow batch of any length for each slice."""
    small_batches(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = make()
        for batch in batches:
            for part in slices(batch, at):
                yield rows(part.column(at).to_pylist(), part)

    return df.mapInArrow(run, schema)


class Scratch:
    """Tables in the shared folder that an operator writes on its way, deleted as soon as later tables stand."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            deleted(self.spark, f"{self.folder}/{name}")


def sampled(column: Column, rate: float) -> Column:
    """A share of the rows, chosen by a hash of the column: the same rows at every run, and of any table size."""
    return F.pmod(F.xxhash64(column), F.lit(1 << 52)) < F.lit(rate * (1 << 52))


def crc32_of_id(column: Column) -> Column:
    return F.crc32(column.cast("string").cast("binary"))
