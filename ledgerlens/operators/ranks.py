"""Places in a whole table's order, without the table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import discard, stored


def placed(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place, from 1, in an order that tells any two rows apart; the column must be new.

    Rows are dealt into ranges of the order; a row's place is its place in its range
    and the sizes of the ranges before.
    """
    part = f"_range_{name}"
    kept = stored(rows, "ranks-rows")  # the ranges are cut from a sample, which reads the rows once more
    ranges = stored(kept.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranks-ranges")
    discard(kept)
    sizes = ranges.groupBy(part).agg(F.count("*").alias("n"))  # a row each
    before = sizes.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return ranges.withColumn(name, own).join(F.broadcast(before), part).select(*rows.columns, (F.col(name) + F.col("before")).alias(name))
