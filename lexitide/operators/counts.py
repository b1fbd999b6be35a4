"""Token counts: per step, merged genres, totals, shares, the wide matrix."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexitide.runtime import materialize, parallelism


def count_tokens(df: DataFrame, tokens: Column, *by: str) -> DataFrame:
    """(by..., word, n): an explode and one hash aggregation with map-side partial counts."""
    return df.select(*by, F.explode(tokens).alias("word")).groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"))


def counted_word() -> Column:
    """The word of a counted row; as it reads the count too, a filter on it isn't moved below the count, to every single token."""
    return F.when(F.col("n") > 0, F.col("word"))


def count_kept_tokens(df: DataFrame, tokens: Column, keep: Callable[[Column], Column], *by: str) -> DataFrame:
    """(by..., word, n) of the tokens that ``keep`` holds for, in lower case.

    Tokens are counted as written first; the costly tests then see each different token once a group, and what differs only
    in letter case is added up at the end, over these few rows.
    """
    raw = count_tokens(df, tokens, *by)
    return raw.where(keep(counted_word())).groupBy(*by, F.lower("word").alias("word")).agg(F.sum("n").alias("n"))


def merge_steps(timestep: Column, merged: Column, to: str = "modern") -> Column:
    """A step label in which all genres that ``merged`` names are one step."""
    return F.when(merged, F.lit(to)).otherwise(timestep)


def merge_shards(counts: DataFrame) -> DataFrame:
    """(word, timestep, n) of counts that came in shards; a row delivered again counts once, null words and counts not at all."""
    once = counts.where("word is not null and count is not null").groupBy("word", "timestep", "shard_no").agg(F.max("count").alias("n"))
    return once.groupBy("word", "timestep").agg(F.sum("n").alias("n"))


def count_matrix(counts: DataFrame, steps: Sequence[str], prefix: str = "y") -> DataFrame:
    """One row per word with a column a step; null where the word wasn't seen. Steps are given, so no extra job finds them."""
    wide = counts.groupBy("word").pivot("timestep", list(steps)).agg(F.sum("n"))
    return wide.select("word", *[F.col(f"`{s}`").alias(f"{prefix}{s}") for s in steps])


def row_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("word").agg(F.sum("n").alias("total"))


def step_totals(counts: DataFrame) -> DataFrame:
    """Totals over all words, taken before any vocabulary filter."""
    return counts.groupBy("timestep").agg(F.sum("n").alias("total"))


def period_shares(counts: DataFrame, historical: Sequence[str]) -> DataFrame:
    """(word, historical_n, modern_n, historical_share, modern_share): period sums over each period's grand total."""
    old = F.col("timestep").isin(list(historical))
    per = counts.where("timestep is not null").groupBy("word").agg(
        F.coalesce(F.sum(F.when(old, F.col("n"))), F.lit(0)).alias("historical_n"), F.coalesce(F.sum(F.when(~old, F.col("n"))), F.lit(0)).alias("modern_n")
    )
    h, m = counts.where("timestep is not null").agg(F.sum(F.when(old, F.col("n"))), F.sum(F.when(~old, F.col("n")))).first()  # two numbers
    return per.select(
        "word", "historical_n", "modern_n", F.try_divide(F.col("historical_n").cast("double"), F.lit(h)).alias("historical_share"), F.try_divide(F.col("modern_n").cast("double"), F.lit(m)).alias("modern_share")
    )


def positions(counts: DataFrame, parts: int | None = None) -> DataFrame:
    """(word, n, position, size): each word's place from 1 by descending count, ties by name, and the number of words.

    A global order without a one-task window: rows are range-partitioned by the order, ranked inside each range, and offset by the sizes
    of the ranges before it (one small row a range).
    """
    n = parts or parallelism(counts.sparkSession)
    ranged = counts.select("word", "n").repartitionByRange(n, F.desc("n"), "word").withColumn("_p", F.spark_partition_id())
    ranged = materialize(ranged, "ranked")  # partition numbers must not change between the two uses
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = sizes.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy()).alias("size"))  # one row a range
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(F.desc("n"), "word"))
    return ranged.withColumn("_r", inside).join(F.broadcast(before), "_p").select("word", "n", (F.col("_before") + F.col("_r")).alias("position"), "size")


def relative_rank(counts: DataFrame, parts: int | None = None) -> DataFrame:
    """(word, n, rel_rank): (1 + position from 0 by descending count) / vocabulary size."""
    return positions(counts, parts).select("word", "n", (F.col("position") / F.col("size")).alias("rel_rank"))
