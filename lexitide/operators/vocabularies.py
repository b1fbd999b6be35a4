"""Set operations between vocabularies and word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vocabulary(counts: DataFrame, *by: str) -> DataFrame:
    return counts.where("word is not null").select(*by, "word").distinct()


def overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    """(word, in_first, in_second) of all words of either, from one aggregation rather than three set operations."""
    tagged = first.select("word", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(second.select("word", F.lit(0).alias("a"), F.lit(1).alias("b")))
    return tagged.groupBy("word").agg(F.max("a").alias("in_first"), F.max("b").alias("in_second"))


def only_words(df: DataFrame, words: DataFrame) -> DataFrame:
    return df.join(words.select("word").distinct(), "word", "left_semi")


def without_words(df: DataFrame, words: DataFrame) -> DataFrame:
    return df.join(words.where("word is not null").select("word").distinct(), "word", "left_anti")


def loaded_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs as a mapping: the last row (by ``line_no``) of each emerging word stays."""
    return pairs.groupBy("neologism").agg(F.max_by("control", "line_no").alias("control"))
