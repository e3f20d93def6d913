"""Running sums and carried values over long groups, in blocks.

A plain window would put a whole group into one task. Here a group is cut into blocks of its order column: blocks are
aggregated first, the few block rows are prefixed, and rows are finished within their block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Width of a block in units of the order column.
BLOCK = 4096


def _blocks(df: DataFrame, group: str, order: str, block: int) -> DataFrame:
    return df.withColumn("__block", F.floor(F.col(order) / block))


def _attach(rows: DataFrame, heads: DataFrame, group: str) -> DataFrame:
    heads = heads.withColumnRenamed(group, "__group").withColumnRenamed("__block", "__b")
    return rows.join(heads, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__block") == F.col("__b")), "left").drop("__group", "__b")


def running_sum(df: DataFrame, group: str, order: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """``df`` with the inclusive sum of ``value`` (null counts 0) up to each row. ``order`` must be numeric and unique."""
    rows = _blocks(df.withColumn("__v", F.coalesce(value, F.lit(0)).cast("bigint")), group, order, block)
    sums = rows.groupBy(group, "__block").agg(F.sum("__v").alias("__s"))
    before = F.sum("__s").over(Window.partitionBy(group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    heads = sums.select(group, "__block", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.sum("__v").over(Window.partitionBy(group, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return _attach(rows.withColumn(name, inside), heads, group).withColumn(name, F.col(name) + F.col("__before")).drop("__v", "__block", "__before")


def carried(df: DataFrame, group: str, order: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """``df`` with the last non-null ``value`` up to each row, null before the first. ``order`` as in ``running_sum``."""
    rows = _blocks(df, group, order, block)
    lasts = rows.groupBy(group, "__block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("__l"))
    before = F.last("__l", True).over(Window.partitionBy(group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    heads = lasts.select(group, "__block", before.alias("__before"))
    inside = F.last(value, True).over(Window.partitionBy(group, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return _attach(rows.withColumn(name, inside), heads, group).withColumn(name, F.coalesce(F.col(name), F.col("__before"))).drop("__block", "__before")
