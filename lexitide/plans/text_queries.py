"""Queries on tokens, predicates and text structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.functions import structure, tokens
from lexitide.operators import counts
from lexitide.operators.deliveries import number_id
from lexitide.runtime import spread, table


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """(tweet_id, year, text), a message once: ``full_text`` before ``text``."""
    t = table(spark, sf, "tweets").select(number_id(F.col("id")).alias("tweet_id"), F.coalesce("full_text", "text").alias("text"), "full_text", "year")
    rows = t.where("tweet_id is not null and text is not null")
    full = F.max(F.col("full_text"))
    return rows.groupBy("tweet_id").agg(F.coalesce(full, F.max("text")).alias("text"), F.max("year").alias("year"))


def _documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Columns of the documents, spread over all cores where there are fewer files than cores."""
    return spread(table(spark, sf, "documents").select(*columns))


def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf, "timestep", "text")
    return counts.count_tokens(docs, tokens.space_tokens(F.col("text")), "timestep")


def token_counts_clean(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf, "timestep", "text")
    return counts.count_kept_tokens(docs, tokens.space_tokens(F.col("text"), lower=False), tokens.keep_token, "timestep")


def token_predicates(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf, "text").select(F.explode(tokens.space_tokens(F.col("text"), lower=False)).alias("token"))
    words = docs.distinct()
    return words.select("token", *[c.alias(n) for n, c in tokens.predicates(F.col("token")).items()])


def control_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates for control words: clean tokens that aren't target words, with their counts."""
    docs = _documents(spark, sf, "text")
    counted = counts.count_tokens(docs, tokens.space_tokens(F.col("text"))).where(tokens.control_token(counts.counted_word()))
    return counted.join(table(spark, sf, "target_words").where("word is not null").select("word"), "word", "left_anti")


def sentence_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of all documents: fragments, paragraphs, clitics joined, one number series a document; empty ones dropped."""
    docs = _documents(spark, sf, "doc_id", "text")
    joined = F.transform(structure.paragraphs(structure.strip_leading_id(F.col("text"))), structure.join_clitics)
    sentences = F.flatten(F.transform(joined, structure.simple_sentences))
    rows = docs.select("doc_id", F.inline(structure.numbered(sentences)))
    toks = tokens.space_tokens(F.col("sentence"))
    return rows.select("doc_id", "sentence_no", F.size(toks).cast("long").alias("n_tokens"), F.array_join(toks, " ").alias("tokens")).where("n_tokens > 0")


def tweet_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Filtered tweet tokens by year: tokenise, count, filter the token as written, lower-case, add up."""
    return counts.count_kept_tokens(messages(spark, sf), tokens.tweet_tokens(F.col("text")), tokens.keep_token, "year")


def html_clean(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).select("tweet_id", structure.clean_html(F.col("text")).alias("clean"))


def genre_merge(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf, "timestep", "source", "text").select(counts.merge_steps(F.col("timestep"), F.lower(F.trim("source")).startswith("genre")).alias("step"), "text")
    return counts.count_tokens(docs, tokens.space_tokens(F.col("text")), "step").groupBy("step").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("total"))


_S = tokens.SPACE
MESSAGES = r"""m AS (SELECT tweet_id, coalesce(max(full_text), max(text)) AS text, max(year) AS year FROM (
  SELECT try_cast(regexp_replace(id, '^\s+|\s+$', '', 'g') AS BIGINT) AS tweet_id, full_text, coalesce(full_text, text) AS text, year FROM tweets
  WHERE regexp_full_match(regexp_replace(id, '^\s+|\s+$', '', 'g'), '[+-]?[0-9]+'))
  WHERE tweet_id IS NOT NULL AND text IS NOT NULL GROUP BY tweet_id)"""


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _low(c: str) -> str:
    """SQL's lower() with the one letter whose full lower case is two signs."""
    return f"lower(replace({c}, 'İ', 'i' || chr(775)))"


def _toks(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, {_q(_S + '+')}), lambda x: x <> '')"


def _rl(c: str, name: str) -> str:
    return f"regexp_matches({c}, {_q(tokens.patterns()[name])})"


def _keep(c: str) -> str:
    dropped = f"starts_with({c}, '#') OR {_rl(c, 'all_numbers_hyphens')} OR {_rl(c, 'all_emoji_punct_space_control')} OR {_rl(c, 'url')}"
    return f"NOT ({dropped}) AND {_rl(c, 'all_alnum_hyphen_emoji')} AND length({c}) BETWEEN 2 AND 50"


def _held(c: str) -> str:
    return f"regexp_replace({c}, {_q(structure.PROTECT)}, '\\1\\2.' || chr(2), 'g')"


def _oracle() -> dict[str, str]:
    p = tokens.patterns()
    trim_ = f"regexp_replace(token, {_q(f'^{_S}+|{_S}+$')}, '', 'g')"
    names = {
        "has_number": f"regexp_matches(token, {_q('[' + tokens.digit_class() + ']')}) AND NOT contains(token, '-')",
        "all_punctuation": f"regexp_matches({trim_}, {_q(p['all_punctuation'])})",
        "hashtag": "starts_with(token, '#')",
        **{n: _rl("token", n) for n in p if n != "all_punctuation"},
    }
    parts = lambda c, mark: f"list_filter(list_transform(string_split({c}, '{mark}'), lambda x: {_strip('x')}), lambda x: x <> '')"
    clitics = _q(" (" + "|".join(structure.CLITICS) + ")")
    strip_id = r"CASE WHEN contains(text, ' ') THEN regexp_replace(text, '^[^ ]+ ', ' ') ELSE text END"
    held = _held(_held("p"))
    cut = f"regexp_replace({held}, {_q(structure.BOUNDARY)}, '\\1' || chr(1), 'g')"
    return {
        "token_counts": f"SELECT timestep, word, count(*) AS n FROM (SELECT timestep, unnest({_toks(_low('text'))}) AS word FROM documents) GROUP BY ALL",
        "token_counts_clean": f"SELECT timestep, {_low('token')} AS word, count(*) AS n FROM (SELECT timestep, unnest({_toks('text')}) AS token FROM documents) WHERE {_keep('token')} GROUP BY ALL",
        "token_predicates": f"SELECT token, {', '.join(f'{e} AS {n}' for n, e in names.items())} FROM (SELECT DISTINCT unnest({_toks('text')}) AS token FROM documents)",
        "control_tokens": f"""SELECT word, count(*) AS n FROM (SELECT unnest({_toks(_low('text'))}) AS word FROM documents)
WHERE {_rl('word', 'all_alnum_hyphen')} AND NOT {_rl('word', 'all_numbers_hyphens')} AND word NOT IN (SELECT word FROM target_words WHERE word IS NOT NULL) GROUP BY word""",
        "sentence_rows": f"""
WITH f AS (SELECT doc_id, unnest({parts(f'({strip_id})', '@')}) AS f, generate_subscripts({parts(f'({strip_id})', '@')}, 1) AS a FROM documents),
g AS (SELECT doc_id, a, unnest({parts('f', '<p>')}) AS p0, generate_subscripts({parts('f', '<p>')}, 1) AS b FROM f),
h AS (SELECT doc_id, a, b, regexp_replace(p0, {clitics}, '\\1', 'g') AS p FROM g),
s AS (SELECT doc_id, a, b, unnest(string_split(replace({cut}, chr(2), ' '), chr(1))) AS s0, generate_subscripts(string_split(replace({cut}, chr(2), ' '), chr(1)), 1) AS c FROM h),
n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a, b, c) AS sentence_no, {_toks(_low('s0'))} AS t FROM s WHERE {_strip('s0')} <> '')
SELECT doc_id, sentence_no, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM n WHERE len(t) > 0""",
        "tweet_token_counts": f"WITH {MESSAGES} SELECT year, {_low('token')} AS word, count(*) AS n FROM (SELECT year, unnest(regexp_extract_all(text, {_q(tokens.TWEET_TOKEN)})) AS token FROM m) WHERE {_keep('token')} GROUP BY ALL",
        "html_clean": f"WITH {MESSAGES} SELECT tweet_id, {_strip(_unescaped('text'))} AS clean FROM m",
        "genre_merge": f"""WITH c AS (SELECT CASE WHEN starts_with(lower(trim(source)), 'genre') THEN 'modern' ELSE timestep END AS step, unnest({_toks(_low('text'))}) AS word FROM documents)
SELECT step, count(*) AS words, sum(n)::BIGINT AS total FROM (SELECT step, word, count(*) AS n FROM c GROUP BY ALL) GROUP BY step""",
    }


def _strip(c: str) -> str:
    return f"regexp_replace({c}, {_q(f'^{_S}+|{_S}+$')}, '', 'g')"


def _unescaped(c: str) -> str:
    """Literal entities only; the operator decodes all."""
    for a, b in (("&apos;", ""), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        c = f"replace({c}, '{a}', '{b}')"
    return f"replace(translate({c}, chr(10) || chr(9), '  '), chr(13), '')"


_ALL = (token_counts, token_counts_clean, token_predicates, control_tokens, sentence_rows, tweet_token_counts, html_clean, genre_merge)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE = _oracle()
