"""Analytic functions whose definitions differ from Spark's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(df: DataFrame, value: str, keys: list[str], out: str, pct: bool = True) -> DataFrame:
    """Rank within keys, equal values sharing their mean rank; ``pct``: over the count of known values. Null stays null.

    Ranks come from counts of distinct values, so a hot key costs its distinct values, not its rows.
    """
    sizes = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.coalesce(F.sum("_n").over(w), F.lit(0)) + (F.col("_n") + 1) / 2.0
    if pct:
        rank = rank / F.sum("_n").over(Window.partitionBy(*keys))
    return df.join(sizes.select(*keys, value, rank.alias(out)), [*keys, value], "left")


def z_score(df: DataFrame, value: str, keys: list[str], out: str) -> DataFrame:
    """(x - mean) / sd within keys; null where the sd is null or 0. The moments are a small table joined back."""
    m = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return df.join(m, keys).withColumn(out, (F.col(value) - F.col("_m")) / F.nullif("_s", F.lit(0.0))).drop("_m", "_s")


def last_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def run_lengths(df: DataFrame, keys: list[str], step: str) -> DataFrame:
    """Unbroken runs of consecutive integers: keys, first, last, length (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(step)
    island = df.select(*keys, step).distinct().withColumn("_i", F.col(step) - F.row_number().over(w))
    return island.groupBy(*keys, "_i").agg(F.min(step).alias("first"), F.max(step).alias("last"), F.count(F.lit(1)).alias("length")).drop("_i")


def equal_season_weight(season: str, n_seasons: Column) -> Column:
    """1 / (seasons x rows of the season): every season weighs the same."""
    return 1.0 / (n_seasons * F.count(F.lit(1)).over(Window.partitionBy(season)))


def best_distinct(df: DataFrame, content: str, own: list, order: list, most: int, out: str) -> DataFrame:
    """The ``most`` first rows by ``order`` among one row a content (the first by ``own``), numbered from 0 in ``out``."""
    w = Window.partitionBy(content).orderBy(*own)
    first = df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").orderBy(*order).limit(most)
    return first.withColumn(out, (F.row_number().over(Window.orderBy(*order)) - 1).cast("int"))  # of ``most`` rows
