"""The problems' queries over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.llm import languages, lookalike, mixing, neighbours, packing, sentences, stable_sample, term_counts
from lexitide.operators.deliveries import number_id
from lexitide.runtime import table


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    """One row per message and text: the text is null or the same in all copies of an id."""
    tweets = table(spark, sf, "tweets").select(number_id(F.col("id")).alias("id"), "full_text")
    return tweets.where("id is not null and full_text is not null").distinct()


def p1_sample(spark: SparkSession, sf: str) -> DataFrame:
    return stable_sample.stable_sample(table(spark, sf, "tweet_roberta_tokenized"))


def _additions(rows: DataFrame) -> dict[str, DataFrame]:
    """What the table was before rows of four kinds were added to it."""
    return {
        "later loads": rows.where("load_no <= 2"),
        "earlier loads": rows.where("load_no > 2"),
        "rows without a load": rows.where("load_no is not null"),
        "the same loads": rows.where("sentence_id > 1"),
    }


def p1_kept(spark: SparkSession, sf: str) -> DataFrame:
    """For each kind of addition, how many keys were chosen before it, and how many of them it dropped: always none."""
    rows = table(spark, sf, "tweet_roberta_tokenized")
    key = ["word", "tweet_id", "sentence_id"]
    tagged = [stable_sample.stable_sample(before).select(F.lit(name).alias("added"), *key) for name, before in _additions(rows).items()]
    before = reduce(DataFrame.unionByName, tagged)
    after = stable_sample.stable_sample(rows).select(*key, F.lit(1).alias("kept"))
    return before.join(after, key, "left").groupBy("added").agg(F.count(F.lit(1)).alias("chosen_before"), F.count_if(F.col("kept").isNull()).alias("dropped"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.neighbour_pairs(table(spark, sf, "historical_embeddings_zscored"), width=768)


def _delivered(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "tweets").select(number_id(F.col("id")).alias("id"), "full_text")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.same_look_pairs(_delivered(spark, sf))


def p3_classes(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.look_classes(_delivered(spark, sf))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.with_sentences(_messages(spark, sf)).select("id", "start_pos").distinct()


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return term_counts.term_frequencies(table(spark, sf, "token_counts")).where("mark is not null").select(F.col("term").alias("word"), "mark")


def p6_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return term_counts.term_frequencies(table(spark, sf, "token_counts"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_containers(table(spark, sf, "documents")).where("n_pieces > 1").select("doc_id").distinct()


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(packing.fill_containers(table(spark, sf, "documents")))


def p7_room(spark: SparkSession, sf: str) -> DataFrame:
    """What SQL can say of any good filling: all tokens are placed, nothing is overfull or divided without need, little room is left."""
    placed = packing.fill_containers(table(spark, sf, "documents"))
    vain = (F.col("n_pieces") > 1) & (F.col("piece_no") == F.col("n_pieces")) & (F.col("start_token") + F.col("n_tokens") <= packing.CAPACITY)
    per = placed.groupBy("container").agg(F.sum("n_tokens").alias("n"), F.count_if(vain).alias("vain"))
    fill = F.sum("n") / F.count(F.lit(1)) / packing.CAPACITY
    return per.agg(F.sum("n").alias("tokens"), (F.max("n") > packing.CAPACITY).alias("overfull"), F.sum("vain").alias("divided_in_vain"), (fill >= 0.95).alias("well_filled"))


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    targets = table(spark, sf, "mix_targets")
    return mixing.mix_shares(mixing.mix(table(spark, sf, "documents"), targets), targets)


def p8_checked(spark: SparkSession, sf: str) -> DataFrame:
    """What SQL can say of any mixture at its default size: every source that has documents meets its share, none is used too often."""
    documents, targets = table(spark, sf, "documents"), table(spark, sf, "mix_targets")
    shares = mixing.mix_shares(mixing.mix(documents, targets), targets)
    name = mixing.source_name(F.col("source"))
    there = documents.where(F.octet_length("text") > 0).groupBy(name.alias("source")).agg(F.max(F.octet_length("text")).alias("largest"))
    caps = targets.select(name.alias("source"), F.coalesce("max_repeats", F.lit(1)).alias("m")).groupBy("source").agg(F.max("m").alias("m"))
    rows = shares.join(there, "source", "left").join(caps, "source")
    wanted = F.when(F.col("largest").isNotNull() & (F.col("target_share") > 0), F.col("target_share"))
    whole, total = rows.agg(F.sum(wanted), F.sum("tokens")).first()  # of a row a source
    off = F.abs(F.col("tokens") - wanted / F.lit(whole) * F.lit(total))
    met = F.coalesce(off <= F.lit(0.01 * (total or 0)) + F.col("largest"), F.lit(False))  # to a percent, and the one document that can't be cut
    return rows.select("source", "target_share", met.alias("met"), (F.col("most_copies") <= F.col("m")).alias("within_cap"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    found = languages.language_segments(table(spark, sf, "documents"))
    case = (F.col("n_segments") > 1) | F.col("label").isNull() | (F.col("label") != F.col("lang"))
    return found.where((F.col("n_segments") > 0) & case).select("doc_id", F.col("segment_no").cast("long").alias("segment_no"), "lang").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (p1_sample, p1_kept, p2_found, p3_found, p3_classes, p4_found, p6_found, p6_frequencies, p7_found, p7_report, p7_room, p8_mixture, p8_shares, p8_checked, p9_found)
    return {f.__name__: f for f in made}


_CHOSEN = f"""word IS NOT NULL AND tweet_id IS NOT NULL AND sentence_id IS NOT NULL AND
  (('0x' || substr(md5('1234|' || word || '|' || tweet_id || '|' || sentence_id), 1, 5))::BIGINT * {stable_sample.STEP} + {stable_sample.START}) % {stable_sample.BUCKETS} < {stable_sample.LISTED}"""
_TERMS = r"""
WITH once AS (SELECT word, timestep, shard_no, max("count") AS n FROM token_counts WHERE word IS NOT NULL GROUP BY ALL),
per_record AS (
  SELECT lower(regexp_replace(word, '^\s+|\s+$', '', 'g')) AS term, timestep, shard_no, sum(coalesce(n, 0)) AS n FROM once GROUP BY ALL),
terms AS (SELECT term, sum(n)::BIGINT AS occurrences, count(*) FILTER (WHERE n > 0) AS records FROM per_record WHERE term <> '' GROUP BY term),
marked AS (SELECT *, CASE WHEN occurrences < 5 THEN 'rare' WHEN occurrences >= 0.01 * (SELECT sum(occurrences) FROM terms) THEN 'common' END AS mark FROM terms)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_sample": f"SELECT word, tweet_id, sentence_id, min(load_no) AS first_load, {stable_sample.LISTED / stable_sample.BUCKETS}::DOUBLE AS rate FROM tweet_roberta_tokenized WHERE {_CHOSEN} GROUP BY ALL",
        "p1_kept": f"""
WITH k AS (SELECT a AS added, word, tweet_id, sentence_id FROM (
  SELECT *, unnest(['later loads', 'earlier loads', 'rows without a load', 'the same loads']) AS a, unnest([load_no <= 2, load_no > 2, load_no IS NOT NULL, sentence_id > 1]) AS there
  FROM tweet_roberta_tokenized WHERE {_CHOSEN}) WHERE there GROUP BY ALL)
SELECT added, count(*) AS chosen_before, 0::BIGINT AS dropped FROM k GROUP BY added""",
        "p2_found": """
WITH rows AS (SELECT DISTINCT word, vector FROM historical_embeddings_zscored
  WHERE word IS NOT NULL AND len(vector) = 768 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.word AS a, b.word AS b, list_cosine_similarity(a.vector, b.vector) AS c FROM rows a, rows b WHERE a.word <> b.word),
best AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY round(c, 6) DESC, b) AS r FROM pairs WHERE c >= 0.6)
SELECT DISTINCT least(a, b) AS word_a, greatest(a, b) AS word_b FROM best WHERE r <= 10""",
        "p6_found": _TERMS + "SELECT term AS word, mark FROM marked WHERE mark IS NOT NULL",
        "p6_frequencies": _TERMS + "SELECT term, occurrences, records, mark FROM marked",
        "p7_room": "SELECT sum(coalesce(strlen(text), 0))::BIGINT AS tokens, false AS overfull, 0::BIGINT AS divided_in_vain, true AS well_filled FROM documents",
        "p8_checked": r"""
WITH t AS (SELECT regexp_replace(lower(trim(source)), '[\s_-]+', '_', 'g') AS source, sum(coalesce(target_weight, 0)) AS w FROM mix_targets GROUP BY 1),
d AS (SELECT DISTINCT regexp_replace(lower(trim(source)), '[\s_-]+', '_', 'g') AS source FROM documents WHERE strlen(text) > 0)
SELECT source, round(w / sum(w) OVER (), 6) AS target_share, w > 0 AND source IN (SELECT source FROM d WHERE source IS NOT NULL) AS met, true AS within_cap FROM t QUALIFY source IS NOT NULL""",
        "p7_found": "SELECT DISTINCT doc_id FROM documents WHERE strlen(text) > 4096",
    }
