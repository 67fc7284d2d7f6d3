"""Whole-table orders without a task that holds the whole table: rows are dealt by ranges, each range is worked through alone,
and what the ranges before it add up to is joined on: one number a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept


def _ranges(df: DataFrame, *order: Column) -> DataFrame:
    """df with __p, the range that a row is in, ranges in the order of the columns. Written once: ranges are drawn by a sample,
    and may not change between uses."""
    dealt = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
    return kept(dealt.withColumn("__p", F.spark_partition_id()))


def running_sum(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """df with the sum of value over all rows up to each, in the order of the columns, ties included as rows come."""
    rows = _ranges(df, *order)
    own = F.sum(value).over(Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sums = rows.groupBy("__p").agg(F.sum(value).alias("__s"))
    before = sums.alias("a").join(sums.alias("b"), F.expr("b.__p < a.__p"), "left").groupBy("a.__p").agg(F.coalesce(F.sum("b.__s"), F.lit(0)).alias("__before"))
    return rows.withColumn(name, own).join(F.broadcast(before), "__p").withColumn(name, F.col(name) + F.col("__before")).drop("__p", "__before")


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): the different values numbered from 0 in their order."""
    found = running_sum(df.select(column).distinct(), [F.col(column).asc()], F.lit(1), name)
    return found.select(column, (F.col(name) - 1).alias(name))
