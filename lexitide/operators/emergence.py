"""Emerging words from their time series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexitide.config import Settings
from lexitide.functions.statistics import safe_corr

DEFAULT = Settings()


def first_popular_use(counts: DataFrame, settings: Settings = DEFAULT, default_step: int = 2007) -> DataFrame:
    """(word, total, first_popular_use) of words over the minimum total.

    The first step at which the running count reaches the popular share of the word's total; steps without a count are passed over.
    """
    years = counts.where("word is not null and n is not null").select("word", F.col("timestep").try_cast("int").alias("year"), "n").where("year is not null")
    by_word = Window.partitionBy("word")
    running = years.withColumn("total", F.sum("n").over(by_word)).withColumn("so_far", F.sum("n").over(by_word.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)))
    reached = F.min(F.when(F.col("so_far") >= F.col("total") * F.lit(settings.popular_share), F.col("year")))
    return running.where(F.col("total") > settings.min_total).groupBy("word", "total").agg(F.coalesce(reached, F.lit(default_step)).alias("first_popular_use"))


def emerging_words(counts: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return first_popular_use(counts, settings).where(F.col("first_popular_use") >= settings.emerged_from)


def complete_series(counts: DataFrame, steps: Sequence[str]) -> DataFrame:
    """(word, step_idx, n) with 0 for steps a word wasn't seen in: the counts of one aggregation, then one explode."""
    wide = counts.where(F.col("timestep").isin(list(steps))).groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("timestep", "n"))).alias("_m"))
    cells = F.array(*[F.struct(F.lit(k).alias("step_idx"), F.coalesce(F.col("_m")[s], F.lit(0)).alias("n")) for k, s in enumerate(steps, 1)])
    return wide.select("word", F.inline(cells))


def sparse_series_filter(counts: DataFrame, steps: Sequence[str], settings: Settings = DEFAULT) -> DataFrame:
    """(word, dense_steps, last_n, rho, kept): drops words whose use doesn't grow.

    With few steps of more than ``sparse_count`` uses a word is kept if its last step has any; otherwise if the Spearman
    correlation of its counts with time isn't below ``min_rho``. An undefined correlation keeps the word.
    """
    series = complete_series(counts, steps)
    tied = Window.partitionBy("word", "n")
    ranked = series.withColumn("_r", F.rank().over(Window.partitionBy("word").orderBy("n")) + (F.count(F.lit(1)).over(tied) - 1) / 2)
    per = ranked.groupBy("word").agg(
        F.sum((F.col("n") > settings.sparse_count).cast("int")).alias("dense_steps"), F.max_by("n", "step_idx").alias("last_n"), safe_corr(F.col("_r"), F.col("step_idx")).alias("rho")
    )
    sparse = F.col("dense_steps") <= settings.sparse_steps
    kept = F.when(sparse, F.col("last_n") > 0).otherwise(F.coalesce(F.col("rho") >= settings.min_rho, F.lit(True)))
    return per.withColumn("kept", kept)


def shape_tag(token: Column) -> Column:
    """A stand-in part of speech by a token's shape; any (Column) -> Column tagger fits in its place."""
    return (
        F.when(token.rlike(r"\p{N}"), "CD").when(token.rlike(r"[^\x00-\x7f]"), "FW").when(token.rlike(r"^\p{Lu}"), "NNP")
        .when(~token.rlike(r"\p{L}"), "NFP").when(token.rlike(r"(?i)s$"), "NNS").otherwise("NN")
    )


def tag_counts(tagged: DataFrame) -> DataFrame:
    """(word, tag, n, first_seen) from rows (word, tag, seen): how often, and where each tag came first."""
    return tagged.groupBy("word", "tag").agg(F.count(F.lit(1)).alias("n"), F.min("seen").alias("first_seen"))


def tag_mode_filter(tags: DataFrame, settings: Settings = DEFAULT, strict_ties: bool = False) -> DataFrame:
    """(word, top_tag, removed): a word goes when its commonest tag is a removed one.

    Tags are ordered by count, then by first sight. Among tags that tie with the first, those from the second to the last but one
    also remove the word; with ``strict_ties`` the very last counts too. Words without tags aren't in the result.
    """
    bad = F.col("tag").isin(list(settings.removed_tags))
    order = Window.partitionBy("word").orderBy(F.desc("n"), "first_seen", "tag")
    ranked = tags.withColumn("_r", F.row_number().over(order)).withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy("word"))).withColumn("_top", F.max("n").over(Window.partitionBy("word")))
    last = F.col("_k") if strict_ties else F.col("_k") - 1
    hit = bad & ((F.col("_r") == 1) | ((F.col("n") == F.col("_top")) & (F.col("_r") <= last)))
    return ranked.groupBy("word").agg(F.max(F.when(F.col("_r") == 1, F.col("tag"))).alias("top_tag"), F.max(hit).alias("removed"))


def keep_unflagged(candidates: DataFrame, flagged: DataFrame) -> DataFrame:
    """Candidates without those a filter removed; candidates the filter never saw stay."""
    return candidates.join(flagged.where("removed").select("word"), "word", "left_anti")
