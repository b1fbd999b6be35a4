"""Where target words occur: occurrences, samples, context rows and positions."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType


def occurrences(sentences: DataFrame, tokens: Column, words: DataFrame, *by: str) -> DataFrame:
    """Distinct (by..., word) of sentences that hold a target word.

    A word list below the session's broadcast threshold is broadcast by the planner, a larger one is shuffled.
    """
    exploded = sentences.select(*by, F.explode(F.array_distinct(tokens)).alias("word"))
    return exploded.join(words.select("word").distinct(), "word", "left_semi").distinct().select(*by, "word")


def texts_with_any(texts: DataFrame, tokens: Column, words: DataFrame, key: str) -> DataFrame:
    """Rows of ``texts`` that hold any target word: an early semi-join on exploded distinct tokens."""
    hits = texts.select(key, F.explode(F.array_distinct(tokens)).alias("word")).join(words.select("word").distinct(), "word", "left_semi").select(key).distinct()
    return texts.join(hits, key, "left_semi")


def sample_per_word(df: DataFrame, n: int, key: list[str], seed: str = "1234", word: str = "word") -> DataFrame:
    """At most ``n`` rows a word, uniformly and reproducibly: the least by md5 of seed, word and key; all where there are no more.

    Two steps keep a hot word off one task: each salt of a word first keeps its own n least, then these few are ranked. Keys that
    repeat count once.
    """
    lot = F.md5(F.concat_ws("|", F.lit(seed), F.col(word), *[F.col(k).cast("string") for k in key]))
    rows = df.select(word, *key).distinct().withColumn("_lot", lot).withColumn("_salt", F.substring("_lot", 1, 1))
    local = F.row_number().over(Window.partitionBy(word, "_salt").orderBy("_lot", *key))
    some = rows.withColumn("_r", local).where(F.col("_r") <= n)
    overall = F.row_number().over(Window.partitionBy(word).orderBy("_lot", *key))
    return some.withColumn("_r", overall).where(F.col("_r") <= n).select(word, *key)


def sentences_of_contexts(messages: DataFrame, sampled: DataFrame, sentences: Column) -> DataFrame:
    """Sampled (word, tweet_id, sentence_id) with the sentence looked up in its message; null beyond the last sentence.

    Messages are first reduced to sampled ones by a semi-join, and split into sentences only then.
    """
    few = messages.join(sampled.select("tweet_id").distinct(), "tweet_id", "left_semi").select("tweet_id", sentences.alias("_s"))
    found = sampled.join(few, "tweet_id")
    return found.select("word", "tweet_id", "sentence_id", F.when(F.col("sentence_id") >= 1, F.get("_s", F.col("sentence_id") - 1)).alias("sentence"))


def sentence_groups(contexts: DataFrame, key: list[str]) -> DataFrame:
    """One row per sentence with its (word, position) rows, so that a sentence is encoded once."""
    return contexts.groupBy(*key).agg(F.min("sentence").alias("sentence"), F.sort_array(F.collect_set(F.struct("word", "position"))).alias("words"))


def kept_numbers(sentences: DataFrame, doc: str, order: str) -> DataFrame:
    """Numbers over kept sentences only, from 1 in each document."""
    return sentences.withColumn("kept_no", F.row_number().over(Window.partitionBy(doc).orderBy(order)))


def span(haystack: Column, needle: Column, limit: int = 512) -> Column:
    """0-based positions of the first place where ``needle`` lies in ``haystack``; null where nowhere, or beyond ``limit``.

    Both arrays are bound once, by a lambda over a single struct, so their expressions aren't evaluated at every place anew.
    """

    def search(h: Column, n: Column) -> Column:
        last = F.size(h) - F.size(n)
        places = F.when((F.size(n) >= 1) & (last >= 0), F.sequence(F.lit(0), last))
        return F.get(F.filter(places, lambda i: (F.get(h, i) == F.get(n, F.lit(0))) & (F.slice(h, i + 1, F.size(n)) == n)), F.lit(0))

    at = F.transform(F.array(F.struct(haystack.alias("h"), needle.alias("n"))), lambda s: F.struct(search(s["h"], s["n"]).alias("at"), F.size(s["n"]).alias("n")))
    found = F.transform(at, lambda s: F.when(s["at"] + s["n"] <= limit, F.sequence(s["at"], s["at"] + s["n"] - 1)))
    return F.get(found, F.lit(0))


def span_of_either(haystack: Column, bare: Column, spaced: Column, limit: int = 512) -> Column:
    """The earlier of the spans of two forms of a word (bare, or with a blank before it); at one place the bare form wins."""
    a, b = span(haystack, bare, limit), span(haystack, spaced, limit)
    return F.when(a.isNull(), b).when(b.isNull(), a).when(F.get(a, F.lit(0)) <= F.get(b, F.lit(0)), a).otherwise(b)


def bpe_ids(path: str):
    """A pandas UDF text -> token ids of a public byte-level tokenizer whose file is given; loaded once per Python worker."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encoder = Tokenizer.from_file(path)
        encoder.encode_special_tokens = True
        for part in parts:
            texts = ["" if x is None else x for x in part]
            yield pd.Series([None if x is None else e.ids for x, e in zip(part, encoder.encode_batch(texts, add_special_tokens=False))])

    return ids
