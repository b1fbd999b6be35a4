"""Series statistics that hold under ANSI mode and constant input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(value: Column, *by: str) -> Column:
    """Rank of ``value`` within ``by``; ties share the mean of their ranks."""
    ordered = Window.partitionBy(*by).orderBy(value)
    tied = Window.partitionBy(*by, value)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(tied) - 1) / 2


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; null for a constant series."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def spearman(df: DataFrame, by: list[str], x: str, y: str, to: str = "rho") -> DataFrame:
    """One row per ``by`` with Spearman's rho of two columns; null where either is constant."""
    ranked = df.withColumn("_rx", average_rank(F.col(x), *by)).withColumn("_ry", average_rank(F.col(y), *by))
    return ranked.groupBy(*by).agg(safe_corr(F.col("_rx"), F.col("_ry")).alias(to))
