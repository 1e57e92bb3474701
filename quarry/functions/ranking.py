"""Numbering rows within keys without bringing a hot key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, key: str, order: str, name: str, width: int = 4096) -> DataFrame:
    """df plus `name`: 1, 2, ... within each key by the integer column `order` (unique in its key). Rows are counted by
    ranges of `width` order values, ranges get running sums, and rows are numbered inside their range."""
    rows = df.withColumn("_range", F.floor(F.col(order) / width))
    counts = rows.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = counts.select(F.col(key).alias("_key"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(key, "_range").orderBy(order))
    joined = rows.withColumn(name, place).join(offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_key", "_r", "_before")


def top_k(df: DataFrame, k: int, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """The k first rows of each group with their rank."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)
