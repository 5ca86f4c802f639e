"""Numbers in a global order, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.session import staged


def numbered(rows: DataFrame, order: Sequence[Column], name: str = "number") -> DataFrame:
    """`rows` with their place, from 0, in `order`, which must tell rows apart: rows equal in it stand in any order and, where they are many, in one task.

    Rows are dealt by ranges of the order; the sizes of the ranges, one number a partition, give each range's first place.
    """
    ranged = staged(rows.repartitionByRange(*order).withColumn("__tm_part", F.spark_partition_id()), "ranges")
    sizes = sorted((r["__tm_part"], r["n"]) for r in ranged.groupBy("__tm_part").agg(F.count("*").alias("n")).collect())
    starts, at = [], 0
    for part, n in sizes:
        starts.append((part, at))
        at += n
    before = F.broadcast(rows.sparkSession.createDataFrame(starts, "__tm_part int, __tm_before long"))  # one row a partition
    place = F.row_number().over(Window.partitionBy("__tm_part").orderBy(*order)) - 1
    return ranged.join(before, "__tm_part").withColumn(name, F.col("__tm_before") + place).drop("__tm_part", "__tm_before")
