"""Running values over ordered rows of keys that may hold any share of the table: scans in two levels.

Rows are dealt by ranges of key and order, so a frequent key lies in several slices, one after another. A slice computes
its own running values; what earlier slices of the same key bring is carried in. Only keys that cross the border of a
slice need that, so there are fewer carries than slices, and they are broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundspark.sources.scratch import written

_ADD = {"sum": F.sum, "max": F.max}
SLICE = "_slice"


class Slices:
    """A table in slices of ranges of keys and order, written once; its rows can be given running values.

    `order` must not have ties within a key that the values depend on. Null keys are a key of their own; without keys
    the whole table is one.
    """

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str], slices: int | None = None) -> None:
        n = slices or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartitionByRange(n, *keys, *order).withColumn(SLICE, F.spark_partition_id())
        self.keys, self.order, self.rows = keys, order, written(dealt, "slices")

    def running(self, name: str, value: Column, how: str = "sum", before: bool = False) -> Slices:
        """Append the sum or maximum of a value over a key's rows up to each row, or before it; null where there is none."""
        add, unbounded = _ADD[how], Window.unboundedPreceding
        local = Window.partitionBy(SLICE, *self.keys).orderBy(*self.order).rowsBetween(unbounded, -1 if before else Window.currentRow)
        totals = self.rows.withColumn("_v", value).groupBy(SLICE, *self.keys).agg(add("_v").alias("_v"))
        earlier = Window.partitionBy(*self.keys).orderBy(SLICE).rowsBetween(unbounded, -1)
        carries = totals.withColumn("_carry", add("_v").over(earlier)).where("_carry IS NOT NULL")
        carries = carries.select(F.col(SLICE).alias("_s"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)), "_carry")
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)], F.col(SLICE) == F.col("_s"))
        own = self.rows.withColumn("_own", add(value).over(local)).join(F.broadcast(carries), same, "left")
        both = F.greatest("_own", "_carry") if how == "max" else F.coalesce(F.col("_own") + F.col("_carry"), "_own", "_carry")
        out = Slices.__new__(Slices)
        out.keys, out.order, out.rows = self.keys, self.order, own.select(*self.rows.columns, both.alias(name))
        return out
