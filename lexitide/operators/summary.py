"""Result shapes: long and wide statistics, group means with confidence intervals."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.config import MIN_COSINES


def long_form(stats: DataFrame) -> DataFrame:
    """(word, is_neologism, min_cos, statistic, value): one row a statistic, nulls dropped."""
    cells = F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).cast("double").alias("value")) for s in ("density", "slope", "monotonicity")])
    return stats.select("word", "is_neologism", "min_cos", F.inline(cells)).where("value is not null")


def wide_form(stats: DataFrame, min_cosines: Sequence[float] = MIN_COSINES) -> DataFrame:
    """One row a word with three columns a radius, in a fixed order whatever the data."""
    columns = []
    for r in min_cosines:
        for s in ("density", "monotonicity", "slope"):
            columns.append(F.max(F.when(F.col("min_cos") == r, F.col(s))).alias(f"{s}_{round(r * 1000)}"))
    return stats.groupBy("word", "is_neologism").agg(*columns)


def bootstrap_intervals(long: DataFrame, draws: int = 1000, level: float = 0.95, seed: int = 7) -> DataFrame:
    """(is_neologism, min_cos, statistic, mean, low, high): means with bootstrap intervals.

    Groups are of target words and controls, which a study bounds; each is resampled by one task, with a seed of its own.
    """

    def resample(part: pd.DataFrame) -> pd.DataFrame:
        first = part.iloc[0]
        x = np.sort(part["value"].to_numpy())
        name = f"{first['is_neologism']}|{first['min_cos']}|{first['statistic']}"
        rng = np.random.default_rng([seed, *name.encode()])
        means = np.concatenate([rng.choice(x, (min(100, draws), len(x))).mean(1) for _ in range(-(-draws // 100))])
        low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
        return pd.DataFrame([[first["is_neologism"], first["min_cos"], first["statistic"], x.mean(), low, high]], columns=["is_neologism", "min_cos", "statistic", "mean", "low", "high"])

    return long.groupBy("is_neologism", "min_cos", "statistic").applyInPandas(resample, "is_neologism int, min_cos double, statistic string, mean double, low double, high double")


