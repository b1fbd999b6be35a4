"""Queries on occurrences, samples and contexts of target words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.config import Settings
from lexitide.functions import structure, tokens
from lexitide.operators import contexts
from lexitide.plans.text_queries import MESSAGES, _held, _low, _q, _strip, _toks, messages
from lexitide.runtime import table

N = Settings().contexts_historical


def _contexts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "tweet_roberta_tokenized")


def word_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct (year, message, target word) over all messages."""
    found = tokens.tweet_tokens(F.lower("text"))
    return contexts.occurrences(messages(spark, sf), found, table(spark, sf, "target_words"), "year", "tweet_id")


def texts_with_targets(spark: SparkSession, sf: str) -> DataFrame:
    return contexts.texts_with_any(messages(spark, sf), tokens.tweet_tokens(F.lower("text")), table(spark, sf, "target_words"), "tweet_id").select("tweet_id", "year")


def dedup_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    """Contexts without repeated (message, sentence, word)."""
    return _contexts(spark, sf).select("word", "tweet_id", "sentence_id").where("word is not null").distinct()


def sample_per_word(spark: SparkSession, sf: str) -> DataFrame:
    rows = _contexts(spark, sf).where("word is not null and tweet_id is not null and sentence_id is not null")
    return contexts.sample_per_word(rows, N, ["tweet_id", "sentence_id"])


def sampled_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Messages that a sampled context needs."""
    return messages(spark, sf).join(sample_per_word(spark, sf).select("tweet_id").distinct(), "tweet_id", "left_semi").select("tweet_id", "year")


def context_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Sampled contexts with their sentence, looked up in the message by its number."""
    split = structure.simple_sentences(F.col("text"))
    return contexts.sentences_of_contexts(messages(spark, sf).select("tweet_id", "text"), sample_per_word(spark, sf), split)


def sentence_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Each sentence of a message once, with how many words and positions it serves."""
    rows = _contexts(spark, sf).where("tweet_id is not null and sentence_id is not null and word is not null and position is not null")
    return contexts.sentence_groups(rows, ["tweet_id", "sentence_id"]).select("tweet_id", "sentence_id", "sentence", F.size("words").cast("long").alias("n_words"))


def span_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Where each context's word lies among the blank-separated tokens of its sentence."""
    rows = _contexts(spark, sf).where("word is not null and sentence is not null").select("word", "tweet_id", "sentence_id", "load_no", "sentence").distinct()
    place = contexts.span(tokens.space_tokens(F.col("sentence")), tokens.space_tokens(F.col("word")))
    return rows.select("word", "tweet_id", "sentence_id", "load_no", "sentence", F.get(place, F.lit(0)).cast("long").alias("first_position"), F.size(place).cast("long").alias("n_positions"))


def kept_sentence_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers over the sentences that hold a context, from 1 in each message."""
    rows = _contexts(spark, sf).where("tweet_id is not null and sentence_id is not null").select("tweet_id", "sentence_id").distinct()
    return contexts.kept_numbers(rows, "tweet_id", "sentence_id")


def found_words(spark: SparkSession, sf: str) -> DataFrame:
    """How many target words occur at all, and in how many messages."""
    return word_occurrences(spark, sf).agg(F.countDistinct("word").alias("words"), F.count(F.lit(1)).alias("occurrences"))


def encoded_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Mean vectors of contexts by a deterministic stand-in encoder (16 wide)."""
    from lexitide.operators import zscore

    rows = _contexts(spark, sf).where("word is not null and sentence is not null").select("word", tokens.space_tokens(F.col("sentence")).alias("tokens"))
    rows = rows.withColumn("position", contexts.span(F.col("tokens"), tokens.space_tokens(F.col("word"))))
    encoded = zscore.encode_contexts(rows, zscore.hashing_encoder(16))
    return zscore.zscored_means(encoded)


_OCC = f"""{MESSAGES},
o AS (SELECT DISTINCT year, tweet_id, word FROM (SELECT year, tweet_id, unnest(regexp_extract_all({_low('text')}, {_q(tokens.TWEET_TOKEN)})) AS word FROM m) WHERE word IN (SELECT word FROM target_words))"""
_SAMPLE = f"""k AS (SELECT DISTINCT word, tweet_id, sentence_id FROM tweet_roberta_tokenized WHERE word IS NOT NULL AND tweet_id IS NOT NULL AND sentence_id IS NOT NULL),
p AS (SELECT word, tweet_id, sentence_id FROM k QUALIFY row_number() OVER (PARTITION BY word ORDER BY md5('1234|' || word || '|' || tweet_id || '|' || sentence_id), tweet_id, sentence_id) <= {N})"""
_HELD = _held(_held("text"))
_CUT = f"regexp_replace({_HELD}, {_q(structure.BOUNDARY)}, '\\1' || chr(1), 'g')"
_SENT = f"list_filter(list_transform(string_split(replace({_CUT}, chr(2), ' '), chr(1)), lambda x: {_strip('x')}), lambda x: x <> '')"
_ALL = (word_occurrences, texts_with_targets, dedup_occurrences, sample_per_word, sampled_messages, context_sentences, sentence_groups, span_positions, kept_sentence_numbers, found_words, encoded_contexts)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE = {
    "word_occurrences": f"WITH {_OCC} SELECT * FROM o",
    "texts_with_targets": f"WITH {_OCC} SELECT tweet_id, year FROM m WHERE tweet_id IN (SELECT tweet_id FROM o)",
    "dedup_occurrences": "SELECT DISTINCT word, tweet_id, sentence_id FROM tweet_roberta_tokenized WHERE word IS NOT NULL",
    "sample_per_word": f"WITH {_SAMPLE} SELECT * FROM p",
    "sampled_messages": f"WITH {MESSAGES}, {_SAMPLE} SELECT tweet_id, year FROM m WHERE tweet_id IN (SELECT tweet_id FROM p)",
    "context_sentences": f"WITH {MESSAGES}, {_SAMPLE}, s AS (SELECT tweet_id, {_SENT} AS s FROM m) SELECT word, tweet_id, sentence_id, CASE WHEN sentence_id >= 1 THEN s[sentence_id] END AS sentence FROM p JOIN s USING (tweet_id)",
    "sentence_groups": """SELECT tweet_id, sentence_id, min(sentence) AS sentence, count(DISTINCT (word, "position")) AS n_words FROM tweet_roberta_tokenized
WHERE tweet_id IS NOT NULL AND sentence_id IS NOT NULL AND word IS NOT NULL AND "position" IS NOT NULL GROUP BY ALL""",
    "span_positions": f"""WITH r AS (SELECT DISTINCT word, tweet_id, sentence_id, load_no, sentence FROM tweet_roberta_tokenized WHERE word IS NOT NULL AND sentence IS NOT NULL),
t AS (SELECT *, {_toks(_low('sentence'))} AS h, {_toks(_low('word'))} AS d FROM r),
a AS (SELECT *, CASE WHEN len(d) > 0 AND len(h) >= len(d) THEN list_filter(range(0, len(h) - len(d) + 1), lambda i: h[i + 1 : i + len(d)] = d)[1] END AS f FROM t)
SELECT word, tweet_id, sentence_id, load_no, sentence, CASE WHEN f + len(d) <= 512 THEN f END AS first_position, CASE WHEN f + len(d) <= 512 THEN len(d) END AS n_positions FROM a""",
    "kept_sentence_numbers": """SELECT tweet_id, sentence_id, row_number() OVER (PARTITION BY tweet_id ORDER BY sentence_id)::INT AS kept_no
FROM (SELECT DISTINCT tweet_id, sentence_id FROM tweet_roberta_tokenized WHERE tweet_id IS NOT NULL AND sentence_id IS NOT NULL)""",
    "found_words": f"WITH {_OCC} SELECT count(DISTINCT word) AS words, count(*) AS occurrences FROM o",
}
