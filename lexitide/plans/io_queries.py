"""Queries that write each format of the pipeline from the test tables, read it again and return what came back.

Files go to the application's folder of the shared folder, which goes when the application ends.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.config import MIN_COSINES
from lexitide.functions import tokens
from lexitide.operators import contexts, counts, emergence, subwords, zscore
from lexitide.plans import series_queries, vector_queries
from lexitide.plans.context_queries import _OCC, _SAMPLE, sample_per_word, word_occurrences
from lexitide.plans.text_queries import MESSAGES, _q, _toks, messages
from lexitide.runtime import materialize, table, work_dir
from lexitide.sources import readers, sinks

TOKENIZER = os.environ.get("LEXITIDE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")  # a public byte-level tokenizer


def _place(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _contexts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "tweet_roberta_tokenized")


def _flat(c: str) -> Column:
    """A text as one line without tabs, as lines of these formats hold it."""
    return F.regexp_replace(c, r"[\x00-\x1f\x7f\x{85}\x{2028}\x{2029}]", " ")


def read_token_table(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of the documents as Parquet by time step, the steps read from the folders' names."""
    docs = table(spark, sf, "documents").where("timestep is not null").select("timestep", F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("sentence_id"), tokens.space_tokens(F.col("text")).alias("tokens"))
    path = _place(spark, "tokens")
    sinks.token_table(docs, path)
    return spark.read.schema("doc_id string, sentence_id int, tokens array<string>, timestep string").parquet(path).select("timestep", "doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


def read_token_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Tokenised sentences as tab-separated lines."""
    path = _place(spark, "rows")
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("sentence_id"), tokens.space_tokens(_flat("text")).alias("tokens"))
    sinks.token_rows(docs.where(F.size("tokens") > 0), path)
    return readers.token_rows(spark, path).select("doc_id", "sentence_id", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


def read_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Messages as JSON lines, with the text a message has: ``full_text``, else ``text``."""
    path = _place(spark, "messages")
    table(spark, sf, "tweets").select("id", "full_text", "text").write.json(path)
    return readers.tweets(spark, path)


def read_sampled_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of sampled contexts, written in parts and read again."""
    path = _place(spark, "parts")
    needed = sample_per_word(spark, sf).select("tweet_id").distinct()
    sinks.message_parts(messages(spark, sf).select("tweet_id", "text").join(needed, "tweet_id", "left_semi"), path, 10)
    return spark.read.schema("tweet_id bigint, text string").json(path)


def read_decade_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as decade files (three lines, texts between NULs in the third), a file a document."""
    path = _place(spark, "decades")
    body = F.concat(F.lit("@@"), F.col("doc_id").cast("string"), F.lit("\n\n"), F.regexp_replace("text", r"[\n\r]", " "), F.lit("\u0000second"))
    table(spark, sf, "documents").select(body.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return readers.decade_texts(spark, path).groupBy("text_no").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.length("text")).alias("signs"))


def read_genre_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as genre files, one a part: a header line, then a line a text with its id token first."""
    path = _place(spark, "genre")
    lines = table(spark, sf, "documents").select(F.spark_partition_id().alias("p"), F.concat(F.lit("##"), F.col("doc_id").cast("string"), F.lit(" "), F.trim(_flat("text"))).alias("value"))
    lines = materialize(lines, "lines")  # partition numbers must not change between the two uses
    heads = lines.select("p", F.lit("").alias("value")).distinct()  # an empty line sorts first
    lines.unionByName(heads).repartition("p").sortWithinPartitions("p", F.col("value") != "").write.partitionBy("p").text(path)
    return readers.genre_texts(spark, path).groupBy(F.trim("text").alias("text")).agg(F.count(F.lit(1)).alias("n"))


def read_count_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The wide count file; words such as ``null`` stay words, unseen steps stay null."""
    path = _place(spark, "matrix")
    wide = counts.count_matrix(series_queries._counts(spark, sf), series_queries.STEPS, prefix="")
    sinks.count_matrix(wide, path)
    back = readers.count_matrix(spark, path, wide.columns[1:])
    return back.select("word", *[F.col(f"`{c}`").cast("long").alias(f"y{c}") for c in back.columns[1:]])


def read_tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tags a word as JSON objects, in the order first seen."""
    path = _place(spark, "tags")
    sinks.tag_counts(series_queries.tag_counts(spark, sf), path)
    return readers.tag_counts(spark, path).select("word", "tag", "n", F.col("first_seen").cast("long").alias("place"))


def read_word_list(spark: SparkSession, sf: str) -> DataFrame:
    path = _place(spark, "words")
    sinks.word_list(table(spark, sf, "target_words").where("word is not null"), path)
    return readers.word_list(spark, path)


def read_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs as a file with a header, read as a mapping."""
    path = _place(spark, "pairs")
    sinks.pairs(vector_queries.asked_pairs(spark, sf).select(F.col("neologism").cast("string"), F.col("control").cast("string")), path)
    return readers.pairs(spark, path)


def read_index(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences by year as Parquet, one directory a year."""
    path = _place(spark, "index")
    sinks.index(word_occurrences(spark, sf).where("year is not null"), path)
    return spark.read.parquet(path).select("year", "word", "tweet_id")


def read_sampled_ids(spark: SparkSession, sf: str) -> DataFrame:
    path = _place(spark, "ids")
    sinks.sampled_ids(sample_per_word(spark, sf).withColumn("year", F.lit(2012)), path)
    return readers.sampled_ids(spark, path)


def read_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Context rows as tab-separated lines with a header; rows with a missing field are dropped, positions come back as arrays."""
    path = _place(spark, "contexts")
    rows = _contexts(spark, sf).select("word", F.to_json("position").alias("position"), F.col("tweet_id").cast("string").alias("doc_id"), "sentence_id", F.trim(_flat("sentence")).alias("sentence"))
    rows.where("word <> '' and sentence <> ''").distinct().write.csv(path, sep="\t", header=True, quote="", escapeQuotes=False)
    back = readers.contexts(spark, path)
    return back.select("word", F.size("position").cast("long").alias("n_positions"), F.get("position", F.lit(0)).cast("long").alias("first_position"), "doc_id", "sentence_id", "sentence")


def read_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as Parquet, read again, one row a number."""
    path = _place(spark, "vectors")
    sinks.vectors(vector_queries.words(spark, sf), path)
    return readers.vectors(spark, path).select("word", F.posexplode("vector").alias("dim", "x")).select("word", "dim", F.col("x").cast("double").alias("x"))


def read_results(spark: SparkSession, sf: str) -> DataFrame:
    """The result file with its 29 columns, undefined values written as ``NaN``."""
    path = _place(spark, "results")
    sinks.results(vector_queries.pair_statistics(spark, sf), path)
    back = readers.results(spark, path)
    return back.select(F.col("Word").cast("long").alias("Word"), *[F.round(F.col(f"`{c}`"), 9).alias(c.replace(".", "_")) if "Radius" in c else F.col(c) for c in back.columns[1:]])


def trained_model(spark: SparkSession, sf: str) -> DataFrame:
    """A saved skip-gram model read again: its words, with their places by count."""
    from pyspark.ml.feature import Word2VecModel

    from lexitide.operators import alignment

    path = _place(spark, "model")
    docs = table(spark, sf, "documents").select(tokens.space_tokens(F.col("text")).alias("tokens"))
    made = alignment.train_vectors(docs, size=4, save=path).select("word", "idx", "count")
    return made.join(Word2VecModel.load(path).getVectors().select("word"), "word", "left_semi")


def tag_sample(spark: SparkSession, sf: str) -> DataFrame:
    """At most 100 messages of each target word, whose words are tagged."""
    seen = word_occurrences(spark, sf).select("word", "tweet_id")
    return contexts.sample_per_word(seen, emergence.DEFAULT.tag_sample, ["tweet_id"])


def exact_encoding(spark: SparkSession, sf: str) -> DataFrame:
    """Mean vectors a word by an encoder of whole numbers, which SQL can repeat (4 wide)."""
    rows = _contexts(spark, sf).where("word is not null and sentence is not null").select("word", tokens.space_tokens(F.col("sentence")).alias("tokens"))
    rows = rows.withColumn("position", contexts.span(F.col("tokens"), tokens.space_tokens(F.col("word")))).where(F.size("position") == 1)
    encoded = materialize(zscore.encode_contexts(rows, zscore.arithmetic_encoder(4)), "encoded")
    long = encoded.select("word", F.posexplode("vector").alias("dim", "x"))
    return long.groupBy("word", "dim").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("long")).alias("total"))


def subword_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Where each context's word lies among the ids of its sentence, by a public tokenizer."""
    found = subwords.subword_contexts(_contexts(spark, sf), TOKENIZER, ["tweet_id", "sentence_id"])
    return found.select("word", "tweet_id", "sentence_id", "sentence", F.size("tokens").cast("long").alias("n_tokens"), "position")


def subword_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """z-scored mean vectors of words, encoded at their subword positions (8 wide)."""
    found = subwords.subword_contexts(_contexts(spark, sf), TOKENIZER, ["tweet_id", "sentence_id"])
    return zscore.zscored_means(zscore.encode_contexts(found, zscore.arithmetic_encoder(8), decoder=subwords.decoder(TOKENIZER)))


_ALL = [
    read_token_table, read_token_rows, read_messages, read_sampled_messages, read_decade_texts, read_genre_texts, read_count_matrix, read_tag_counts, read_word_list, read_pairs, read_index,
    read_sampled_ids, read_contexts, read_vectors, read_results, trained_model, tag_sample, exact_encoding,
]
if os.path.exists(TOKENIZER):
    _ALL += [subword_positions, subword_vectors]
QUERIES = {f.__name__: f for f in _ALL}

_FLAT = lambda c: f"regexp_replace({c}, {_q(chr(91) + r'\x00-\x1f\x7f\x{85}\x{2028}\x{2029}]')}, ' ', 'g')"


def _renamed(sql: str, names: dict[str, str]) -> str:
    return f"SELECT {', '.join(f'{a} AS {b}' for a, b in names.items())} FROM ({sql})"


_RESULT_NAMES = {"word": '"Word"', "is_neologism": '"IsNeologism"'} | {
    f"round({s}_{round(r * 1000)}, 9)": f'"{title}AtRadius{f"{r:.3f}".replace(".", "_")}"' for r in MIN_COSINES for s, title in (("density", "Density"), ("monotonicity", "GrowthMonotonicity"), ("slope", "GrowthSlope"))
}
_TOK = _toks("lower(replace(text, 'İ', 'i' || chr(775)))")
_FTOK = _toks(f"lower(replace({_FLAT('text')}, 'İ', 'i' || chr(775)))")
_SPAN = """list_filter(range(0, len(h)), lambda i: h[i + 1] = d[1])[1]"""
ORACLE = {
    "read_token_table": f"SELECT timestep, doc_id::VARCHAR AS doc_id, len({_TOK}) AS n_tokens, array_to_string({_TOK}, ' ') AS tokens FROM documents WHERE timestep IS NOT NULL",
    "read_token_rows": f"SELECT doc_id::VARCHAR AS doc_id, 1 AS sentence_id, len({_FTOK}) AS n_tokens, array_to_string({_FTOK}, ' ') AS tokens FROM documents WHERE len({_FTOK}) > 0",
    "read_messages": """SELECT try_cast(regexp_replace(id, '^\\s+|\\s+$', '', 'g') AS BIGINT) AS tweet_id, coalesce(full_text, text) AS text FROM tweets
WHERE regexp_full_match(regexp_replace(id, '^\\s+|\\s+$', '', 'g'), '[+-]?[0-9]+') AND coalesce(full_text, text) IS NOT NULL""",
    "read_sampled_messages": f"WITH {MESSAGES}, {_SAMPLE} SELECT tweet_id, text FROM m WHERE tweet_id IN (SELECT tweet_id FROM p)",
    "read_index": f"WITH {_OCC} SELECT year, word, tweet_id FROM o WHERE year IS NOT NULL",
    "read_sampled_ids": f"WITH {_SAMPLE} SELECT word, 2012 AS year, tweet_id, sentence_id FROM p",
    "tag_sample": f"WITH {_OCC}, w AS (SELECT DISTINCT word, tweet_id FROM o) SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY word ORDER BY md5('1234|' || word || '|' || tweet_id), tweet_id) <= 100",
    "trained_model": f"""WITH c AS (SELECT word, count(*) AS n FROM (SELECT unnest({_TOK}) AS word FROM documents) GROUP BY word HAVING count(*) >= 5)
SELECT word, (row_number() OVER (ORDER BY n DESC, word) - 1)::INT AS idx, n AS "count" FROM c""",
    "read_decade_texts": "SELECT k AS text_no, count(*) AS texts, sum(length(t))::BIGINT AS signs FROM (SELECT unnest([0, 1]) AS k, unnest([regexp_replace(text, '[\\n\\r]', ' ', 'g'), 'second']) AS t FROM documents) GROUP BY k",
    "read_genre_texts": f"SELECT trim({_FLAT('text')}, ' ') AS text, count(*) AS n FROM documents GROUP BY ALL",
    "read_count_matrix": series_queries.ORACLE["count_matrix"],
    "read_tag_counts": series_queries.ORACLE["tag_counts"].replace("SELECT * FROM t", "SELECT word, tag, n, row_number() OVER (PARTITION BY word ORDER BY first_seen, tag, n) - 1 AS place FROM t"),
    "read_word_list": "SELECT trim(word) AS word FROM target_words WHERE trim(word) <> ''",
    "read_pairs": f"{vector_queries._STATS} SELECT neologism::VARCHAR AS neologism, control::VARCHAR AS control FROM pr",
    "read_vectors": f"WITH {vector_queries._E} SELECT word, generate_subscripts(v, 1) - 1 AS dim, unnest(v) AS x FROM e",
    "read_results": _renamed(vector_queries.ORACLE["statistics_wide"], _RESULT_NAMES),
    "read_contexts": f"""SELECT DISTINCT word, len("position") AS n_positions, "position"[1]::BIGINT AS first_position, tweet_id::VARCHAR AS doc_id, sentence_id, trim({_FLAT('sentence')}, ' ') AS sentence
FROM tweet_roberta_tokenized WHERE word <> '' AND trim({_FLAT('sentence')}, ' ') <> '' AND "position" IS NOT NULL AND tweet_id IS NOT NULL AND sentence_id IS NOT NULL""",
    "exact_encoding": f"""
WITH r AS (SELECT word, {_toks("lower(replace(sentence, 'İ', 'i' || chr(775)))")} AS h, {_toks("lower(replace(word, 'İ', 'i' || chr(775)))")} AS d FROM tweet_roberta_tokenized WHERE word IS NOT NULL AND sentence IS NOT NULL),
s AS (SELECT word, h, {_SPAN} AS i FROM r WHERE len(d) = 1 AND word = d[1]),
x AS (SELECT word, k AS dim, i, ('0x' || substr(md5(h[i + 1]), 1, 6))::BIGINT % 997 AS t FROM s, (SELECT unnest(range(0, 4)) AS k) WHERE i < 512)
SELECT word, dim::INT AS dim, count(*) AS n, sum((t * (dim + 1) + 13 * i) % 1009)::BIGINT AS total FROM x GROUP BY ALL""",
}
