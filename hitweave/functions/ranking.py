"""Ranking inside groups that may be very large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_rank(
    df: DataFrame, group: str, position: str, bucket: int, rank: str = "rank", total: str | None = None
) -> DataFrame:
    """1-based rank by an integer ``position`` in each group, without one big window per group.

    Rows are ranked inside (group, position bucket); totals of the buckets,
    summed over the earlier buckets, give the offset. Positions must be unique
    inside a group.
    """
    b = df.withColumn("_b", F.floor(F.col(position) / bucket))
    sizes = b.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(group).orderBy("_b")
    offsets = sizes.select(
        group,
        "_b",
        (F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy(group)).alias("_total"),
    )
    local = F.row_number().over(Window.partitionBy(group, "_b").orderBy(position))
    out = b.withColumn("_r", local).join(offsets, [group, "_b"])
    out = out.withColumn(rank, (F.col("_r") + F.col("_before")).cast("int"))
    if total:
        out = out.withColumn(total, F.col("_total").cast("int"))
    return out.drop("_b", "_r", "_before", "_total")


def top_rank(df: DataFrame, by: list[str], order: list[Column], k: Column | int, rank: str = "ord") -> DataFrame:
    """First ``k`` rows per key; Catalyst cuts each partition to k before the exchange."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def explode_rows(df: DataFrame, keep: list, array: Column, pos: str = "_i", value: str = "_c") -> DataFrame:
    """One row per array element.

    A plain explode makes Catalyst infer ``size(array) > 0`` and push it to the
    scan, which would evaluate an expensive array expression a second time.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, value)).where(F.col(pos).isNotNull())
