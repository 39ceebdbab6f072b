"""Places of rows in one order over a whole table, and digests that depend on it.

Two phases, so no task sees the table: rows are range-partitioned and sorted, numbered inside their
partition and written; the counts of the partitions, a row each, give every partition's
offset.  Only these counts meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.storage import written


def numbered(rows: DataFrame, *order: str | Column, name: str = "n") -> DataFrame:
    """rows with ``name``, their place from 0 in the given order.

    The result is a written table, so places stay.  Rows that are alike in the order get places
    next to each other, in any order; as they lie in one partition, give an order that tells rows apart.
    """
    local = F.monotonically_increasing_id()  # the partition above 33 bits, the row in it below
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    table = written(sorted_.withColumn("__at", local))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = table.groupBy(part.alias("__part")).agg((F.max(place) + 1).alias("__count"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__count").over(before), F.lit(0)).alias("__offset"))  # a row a partition
    return table.join(F.broadcast(offsets), part == F.col("__part")).withColumn(name, place + F.col("__offset")).drop("__at", "__part", "__offset")


def digest(rows: DataFrame, *order: str, of: str) -> str:
    """A digest of the column ``of`` in the given order: the count and a sum of hashes of place and value, added up in any order."""
    n, total = numbered(rows, *order).agg(F.count("*"), F.sum(F.xxhash64("n", of).cast("decimal(38,0)"))).first()
    return f"{n}-{total}"
