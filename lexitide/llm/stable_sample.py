"""Problem 1: a sample per word that is the same in every run and keeps what it chose as data grow.

Nested hash buckets. A key (word, message, sentence) belongs for ever to one of 2^20 fine buckets, given by a hash of the
key alone. One fixed permutation orders the buckets, and the sample holds the keys of the first buckets in that order: a list
that is only ever appended to. Whether a key is chosen depends on the key and on its word's list, on nothing else in
the data, so rows added later, earlier, in the same load or without a load number never drop a chosen key, and the
share is alike in all loads.

All words share the list of ``listed`` buckets. A word may have a longer list of its own, kept as a small table (word, buckets) that
``append_lists`` lengthens, never shortens, so that words with few keys have enough. This table is state: it can't be computed
anew from the data each time, since a rule that gives a word of one key that key, whatever it is, and never drops a key,
must choose everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 20  # five hexadecimal digits of the hash
LISTED = BUCKETS // 4  # buckets in the list all words share
STEP, START = 387_420_489, 11  # odd step: position = (bucket * STEP + START) mod BUCKETS is a permutation


def bucket_position(*key: Column, seed: str = "1234") -> Column:
    """The place of a key's bucket in the fixed order, the same in every run and engine."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in key]))
    bucket = F.conv(F.substring(digest, 1, 5), 16, 10).cast("long")
    return F.pmod(bucket * F.lit(STEP) + F.lit(START), F.lit(BUCKETS))


def stable_sample(
    df: DataFrame, word: str = "word", message: str = "tweet_id", sentence: str = "sentence_id", load: str = "load_no",
    listed: int = LISTED, lists: DataFrame | None = None, seed: str = "1234",
) -> DataFrame:
    """(word, message, sentence, first_load, rate): the sample of each word.

    A key that comes several times counts once; ``first_load`` is the least load number it came with, null if it had none. Rows without
    a word, message or sentence number can't be identified and are ignored. ``lists`` (word, buckets) gives words longer lists
    than ``listed``; entries that are shorter, or null, change nothing, and of several the longest counts. ``rate`` is the share of
    buckets in the word's list; its reciprocal weighs a row in estimates. Keys outside the list are dropped before anything is
    shuffled, and a hot word is spread by its keys. An empty table gives an empty sample.
    """
    named = df.select(F.col(word).alias(word), F.col(message).alias(message), F.col(sentence).alias(sentence), F.col(load).alias("first_load"))
    named = named.where(F.col(word).isNotNull() & F.col(message).isNotNull() & F.col(sentence).isNotNull())
    place = bucket_position(F.col(word), F.col(message), F.col(sentence), seed=seed)
    if lists is None:
        length = F.lit(min(listed, BUCKETS))
        chosen = named.where(place < length)
    else:
        longer = lists.where(F.col(word).isNotNull() & (F.col("buckets") > listed)).groupBy(F.col(word).alias("_w")).agg(F.max("buckets").alias("_b"))
        length = F.least(F.greatest(F.col("_b"), F.lit(listed)), F.lit(BUCKETS))
        chosen = named.join(longer, F.col(word) == F.col("_w"), "left").where(place < length)
    keys = chosen.groupBy(word, message, sentence, (length / F.lit(float(BUCKETS))).alias("rate")).agg(F.min("first_load").alias("first_load"))
    return keys.select(word, message, sentence, "first_load", "rate")


def append_lists(
    df: DataFrame, per_word: int, lists: DataFrame | None = None, word: str = "word", message: str = "tweet_id", sentence: str = "sentence_id", listed: int = LISTED
) -> DataFrame:
    """(word, buckets): the lists, longer where a word's keys need it for about ``per_word`` of them; never shorter than ``lists``.

    Only words with lists longer than ``listed`` have a row, so the table is small beside the data: at most the words with fewer
    than ``per_word * BUCKETS / listed`` keys, and those that once had so few.
    """
    keys = df.select(word, message, sentence).where(F.col(word).isNotNull() & F.col(message).isNotNull() & F.col(sentence).isNotNull()).distinct()
    needed = F.least(F.lit(BUCKETS), F.ceil(F.lit(BUCKETS * per_word) / F.count(F.lit(1)))).cast("long")
    wanted = keys.groupBy(word).agg(needed.alias("buckets"))
    if lists is not None:
        wanted = wanted.unionByName(lists.select(word, F.col("buckets").cast("long").alias("buckets")).where(F.col(word).isNotNull()))
    return wanted.groupBy(word).agg(F.max("buckets").alias("buckets")).where(F.col("buckets") > listed)
