"""Numbering all rows in an order without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.sources.store import materialised


def running(rows: DataFrame, order: list[Column | str], amount: Column, name: str) -> DataFrame:
    """rows with the sum of `amount` over all rows up to each in the order, which should have no ties.

    Ranges of the order are summed by themselves; then the sums of the ranges before are added, of which there
    are as many as shuffle partitions.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialised(rows.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("__range").agg(F.sum(amount).alias("__sum"))
    before = sums.select("__range", (F.sum("__sum").over(W.orderBy("__range")) - F.col("__sum")).alias("__before"))
    inside = F.sum(amount).over(W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return ranged.withColumn(name, inside).join(F.broadcast(before), "__range").withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__before")


def numbered(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """rows with their place in the order, from 1."""
    return running(rows, order, F.lit(1), name)
