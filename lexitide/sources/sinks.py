"""Writers of the pipeline's tables and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.config import MIN_COSINES
from lexitide.operators.summary import wide_form


def token_table(df: DataFrame, path: str) -> None:
    """Sentence tokens as Parquet, one directory a time step; rows of a step are brought together so that it has few files."""
    df.repartition("timestep", F.pmod(F.xxhash64("doc_id"), F.lit(16))).write.mode("overwrite").partitionBy("timestep").parquet(path)


def token_rows(df: DataFrame, path: str) -> None:
    lines = df.select(F.concat_ws("\t", "doc_id", F.col("sentence_id").cast("string"), F.array_join("tokens", " ")).alias("value"))
    lines.write.mode("overwrite").text(path)


def count_matrix(wide: DataFrame, path: str) -> None:
    wide.write.mode("overwrite").csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def tag_counts(df: DataFrame, path: str) -> None:
    """One JSON object a word: its tags in the order first seen."""
    ordered = F.array_sort(F.collect_list(F.struct("first_seen", "tag", "n")))
    rows = df.groupBy("word").agg(ordered.alias("o")).select("word", F.map_from_entries(F.transform("o", lambda x: F.struct(x["tag"], x["n"]))).alias("pos_counts_in_sample"))
    rows.write.mode("overwrite").json(path)


def word_list(words: DataFrame, path: str) -> None:
    words.select("word").write.mode("overwrite").text(path)


def index(occurrences: DataFrame, path: str) -> None:
    occurrences.write.mode("overwrite").partitionBy("year").parquet(path)


def sampled_ids(df: DataFrame, path: str) -> None:
    df.select("word", "year", "tweet_id", "sentence_id").write.mode("overwrite").csv(path, sep="\t", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def contexts(df: DataFrame, path: str, parts: int = 10) -> None:
    df.repartition(parts, "word").write.mode("overwrite").parquet(path)


def vectors(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def pairs(df: DataFrame, path: str) -> None:
    """One file: pairs are as many as target words at most."""
    df.select("neologism", "control").orderBy("neologism").coalesce(1).write.mode("overwrite").csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def result_table(stats: DataFrame, min_cosines: Sequence[float] = MIN_COSINES) -> DataFrame:
    """The wide result under the column names of result files: a word, its kind, then three numbers a radius."""
    wide = wide_form(stats, min_cosines)
    names = {"density": "Density", "monotonicity": "GrowthMonotonicity", "slope": "GrowthSlope"}
    cells = [F.col(f"{s}_{round(r * 1000)}").alias(f"{title}AtRadius{r:.3f}") for r in min_cosines for s, title in names.items()]
    return wide.select(F.col("word").alias("Word"), F.col("is_neologism").alias("IsNeologism"), *cells)


def results(stats: DataFrame, path: str, min_cosines: Sequence[float] = MIN_COSINES) -> None:
    """The result table with undefined values as ``NaN``; one file, a row a target or control word."""
    rows = result_table(stats, min_cosines)
    rows.orderBy("IsNeologism", "Word").coalesce(1).write.mode("overwrite").csv(path, header=True, nullValue="NaN")


def message_parts(messages: DataFrame, path: str, parts: int = 100) -> None:
    """Sampled messages as JSON lines in a stated number of parts, by a hash of their number."""
    messages.repartition(parts, "tweet_id").write.mode("overwrite").json(path)
