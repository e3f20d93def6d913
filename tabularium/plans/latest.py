"""Latest row of each key, without moving the payload."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tabularium.plans.staging import staged


def stale_rows(df: DataFrame, keys: list[str], order: list[Column], row: str) -> DataFrame:
    """The values of ``row`` that are not the latest of their ``keys``.

    Only keys and order columns are shuffled; a key that occurs once costs one partial aggregate row. Nulls in
    ``order`` sort before every value, so an undated row loses against a dated one; null keys form one group.
    """
    newest = (
        df.groupBy(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)])
        .agg(F.max(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(row).alias("r"))).alias("__top"), F.count(F.lit(1)).alias("__n"))
        .where("__n > 1")
        .select(*[f"__key{i}" for i in range(len(keys))], F.col("__top.r").alias("__keep"))
    )
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)])
    return df.join(newest, match & (F.col(row) != F.col("__keep")), "inner").select(row)


def latest_rows(df: DataFrame, keys: list[str], order: list[Column], row: str) -> DataFrame:
    """Rows of ``df`` that are the latest of their keys; ``row`` must be unique.

    Re-deliveries are the exception in delivery logs, so the stale minority is anti-joined away. It is staged first:
    its size is then known when the join is planned, and the payload is only shuffled where it can't be broadcast.
    """
    return df.join(staged(stale_rows(df, keys, order, row), "stale"), row, "left_anti")
