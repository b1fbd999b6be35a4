"""Queries on counts over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.config import TWITTER, Settings
from lexitide.functions import tokens
from lexitide.operators import counts, emergence, vocabularies
from lexitide.plans.text_queries import MESSAGES, _low, _q, messages
from lexitide.runtime import table

STEPS = list(TWITTER.steps)
FEW = Settings(min_total=20)  # the test tables are small
OLD = list(TWITTER.historical)


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return counts.merge_shards(table(spark, sf, "token_counts"))


def merged_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(spark, sf)


def count_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return counts.count_matrix(_counts(spark, sf), STEPS)


def row_totals(spark: SparkSession, sf: str) -> DataFrame:
    return counts.row_totals(_counts(spark, sf))


def step_totals(spark: SparkSession, sf: str) -> DataFrame:
    return counts.step_totals(_counts(spark, sf))


def period_share(spark: SparkSession, sf: str) -> DataFrame:
    return counts.period_shares(_counts(spark, sf), OLD)


def first_popular_use(spark: SparkSession, sf: str) -> DataFrame:
    return emergence.first_popular_use(_counts(spark, sf), FEW)


def emerging_words(spark: SparkSession, sf: str) -> DataFrame:
    return emergence.emerging_words(_counts(spark, sf), FEW)


def part_word_years(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of the words of part names by shipping year: a natural time series."""
    words = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.explode(tokens.space_tokens(F.col("p_name"))).alias("word"))
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"), F.year("l_shipdate").cast("string").alias("timestep"))
    per_part = lines.groupBy("k", "timestep").agg(F.count(F.lit(1)).alias("c"))  # before the words multiply the rows
    return per_part.join(words, "k").groupBy("word", "timestep").agg(F.sum("c").alias("n"))


def emerging_part_words(spark: SparkSession, sf: str) -> DataFrame:
    return emergence.first_popular_use(part_word_years(spark, sf), FEW, 1992)


def sparse_series_filter(spark: SparkSession, sf: str) -> DataFrame:
    return emergence.sparse_series_filter(_counts(spark, sf), STEPS)


def tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tags of all tokens of all messages; the place a tag was first seen is its message and position."""
    rows = messages(spark, sf).select("tweet_id", F.posexplode(tokens.tweet_tokens(F.col("text"))).alias("pos", "token"))
    seen = F.format_string("%022d:%06d", F.col("tweet_id"), F.col("pos"))
    return emergence.tag_counts(rows.select(F.lower("token").alias("word"), emergence.shape_tag(F.col("token")).alias("tag"), seen.alias("seen")))


def tag_mode_filter(spark: SparkSession, sf: str) -> DataFrame:
    return emergence.tag_mode_filter(tag_counts(spark, sf))


def tag_mode_filter_strict(spark: SparkSession, sf: str) -> DataFrame:
    return emergence.tag_mode_filter(tag_counts(spark, sf), strict_ties=True)


def final_words(spark: SparkSession, sf: str) -> DataFrame:
    """Emerging words that neither the tag filter nor the series filter drops."""
    candidates = emergence.emerging_words(_counts(spark, sf), FEW)
    kept = emergence.keep_unflagged(candidates, tag_mode_filter(spark, sf))
    series = sparse_series_filter(spark, sf).where(~F.col("kept")).select("word")
    return kept.join(series, "word", "left_anti")


def rel_rank(spark: SparkSession, sf: str) -> DataFrame:
    return counts.relative_rank(counts.row_totals(_counts(spark, sf)).withColumnRenamed("total", "n"))


def vocab_setops(spark: SparkSession, sf: str) -> DataFrame:
    """Which words are in the historical vocabulary, the modern one, or both."""
    c = _counts(spark, sf).where("timestep is not null")
    old = F.col("timestep").isin(OLD)
    return vocabularies.overlap(c.where(old).select("word"), c.where(~old).select("word"))


def vocab_intersection(spark: SparkSession, sf: str) -> DataFrame:
    c = _counts(spark, sf)
    return c.where(F.col("timestep").isin(OLD)).select("word").intersect(c.where(~F.col("timestep").isin(OLD)).select("word"))


def vocab_difference(spark: SparkSession, sf: str) -> DataFrame:
    c = _counts(spark, sf)
    return c.where(~F.col("timestep").isin(OLD)).select("word").distinct().exceptAll(c.where(F.col("timestep").isin(OLD)).select("word").distinct())


def vocab_union(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the target list or of the counts."""
    return _counts(spark, sf).select("word").union(table(spark, sf, "target_words").where("word is not null").select("word")).distinct()


def vocab_bag(spark: SparkSession, sf: str) -> DataFrame:
    """How often each word stands in the two lists put together."""
    both = _counts(spark, sf).select("word").unionByName(table(spark, sf, "target_words").where("word is not null").select("word"))
    return both.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def target_counts(spark: SparkSession, sf: str) -> DataFrame:
    return vocabularies.only_words(_counts(spark, sf), table(spark, sf, "target_words"))


def other_counts(spark: SparkSession, sf: str) -> DataFrame:
    return vocabularies.without_words(_counts(spark, sf), table(spark, sf, "target_words"))


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts by day over the event table read as a stream, open windows included, deliveries within the watermark once."""
    from lexitide.streaming import token_counts

    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if not _is_dir(spark, path) else spark.readStream.schema(schema).parquet(path)
    stream = stream.withColumn("at", F.col("ts").cast("timestamp"))
    counted = token_counts.windowed_counts(stream.select("event_id", "at", "event_type"), tokens.space_tokens(F.col("event_type")), "at", "1 day", "1 day", key="event_id")
    return token_counts.run_once(spark, counted, "events")


def _is_dir(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()


_M = """c AS (SELECT word, timestep, sum(n)::BIGINT AS n FROM (SELECT word, timestep, shard_no, max("count") AS n FROM token_counts
  WHERE word IS NOT NULL AND "count" IS NOT NULL GROUP BY ALL) GROUP BY ALL)"""
_OLD = "(" + ", ".join(_q(s) for s in OLD) + ")"
_FIRST = """y AS (SELECT word, try_cast(timestep AS INT) AS year, n FROM c WHERE try_cast(timestep AS INT) IS NOT NULL),
r AS (SELECT word, year, sum(n) OVER (PARTITION BY word) AS total, sum(n) OVER (PARTITION BY word ORDER BY year ROWS UNBOUNDED PRECEDING) AS so_far FROM y),
f AS (SELECT word, total::BIGINT AS total, coalesce(min(CASE WHEN so_far >= total * (1 / 300.0::DOUBLE) THEN year END), 2007) AS first_popular_use FROM r WHERE total > 20 GROUP BY ALL)"""
_SERIES = f"""g AS (SELECT word, s.k AS step_idx, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT word FROM c WHERE timestep IN ({', '.join(_q(s) for s in STEPS)})) w
  CROSS JOIN (SELECT unnest([{', '.join(_q(s) for s in STEPS)}]) AS s, unnest(range(1, {len(STEPS) + 1})) AS k) s LEFT JOIN c USING (word) WHERE false),
w AS (SELECT DISTINCT word FROM c WHERE timestep IN ({', '.join(_q(s) for s in STEPS)})),
s AS (SELECT unnest([{', '.join(_q(s) for s in STEPS)}]) AS timestep, unnest(range(1, {len(STEPS) + 1})) AS step_idx),
d AS (SELECT w.word, s.step_idx, coalesce(c.n, 0) AS n FROM w CROSS JOIN s LEFT JOIN c ON c.word = w.word AND c.timestep = s.timestep),
k AS (SELECT *, rank() OVER (PARTITION BY word ORDER BY n) + (count(*) OVER (PARTITION BY word, n) - 1) / 2.0 AS r FROM d),
q AS (SELECT word, sum((n > 5)::INT)::BIGINT AS dense_steps, max_by(n, step_idx) AS last_n,
  CASE WHEN min(n) <> max(n) THEN covar_pop(r, step_idx) / (stddev_pop(r) * stddev_pop(step_idx)) END AS rho FROM k GROUP BY word),
z AS (SELECT *, CASE WHEN dense_steps <= 3 THEN last_n > 0 ELSE coalesce(rho >= 0.5, true) END AS kept FROM q)"""
_SERIES = _SERIES[_SERIES.index("w AS (SELECT DISTINCT word FROM c") :]
_TAGS = rf"""{MESSAGES},
x AS (SELECT tweet_id, unnest(regexp_extract_all(text, {_q(tokens.TWEET_TOKEN)})) AS token, generate_subscripts(regexp_extract_all(text, {_q(tokens.TWEET_TOKEN)}), 1) - 1 AS pos FROM m),
u AS (SELECT {_low('token')} AS word, CASE WHEN regexp_matches(token, '\p{{N}}') THEN 'CD' WHEN regexp_matches(token, '[^\x00-\x7f]') THEN 'FW' WHEN regexp_matches(token, '^\p{{Lu}}') THEN 'NNP'
  WHEN NOT regexp_matches(token, '\p{{L}}') THEN 'NFP' WHEN regexp_matches(token, '(?i)s$') THEN 'NNS' ELSE 'NN' END AS tag, format('{{:022d}}:{{:06d}}', tweet_id, pos) AS seen FROM x),
t AS (SELECT word, tag, count(*) AS n, min(seen) AS first_seen FROM u GROUP BY ALL),
tr AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, first_seen, tag) AS r, count(*) OVER (PARTITION BY word) AS k, max(n) OVER (PARTITION BY word) AS top FROM t)"""
_MODE = "tm AS (SELECT word, max(CASE WHEN r = 1 THEN tag END) AS top_tag, bool_or(tag IN ('NNP','CD','FW','NFP','NNPS') AND (r = 1 OR (n = top AND r <= k{last}))) AS removed FROM tr GROUP BY word)"

_ALL = (
    merged_counts, count_matrix, row_totals, step_totals, period_share, first_popular_use, emerging_words, part_word_years, emerging_part_words, sparse_series_filter,
    tag_counts, tag_mode_filter, tag_mode_filter_strict, final_words, rel_rank, vocab_setops, vocab_intersection, vocab_difference, vocab_union, vocab_bag, target_counts, other_counts, event_windows,
)
QUERIES = {f.__name__: f for f in _ALL}
_PW = r"""pw AS (SELECT p_partkey AS k, unnest(list_filter(regexp_split_to_array(lower(p_name), '\s+'), lambda x: x <> '')) AS word FROM part),
c AS (SELECT word, year(l_shipdate)::VARCHAR AS timestep, count(*) AS n FROM lineitem JOIN pw ON l_partkey = k GROUP BY ALL)"""
ORACLE = {
    "merged_counts": f"WITH {_M} SELECT * FROM c",
    "count_matrix": f"WITH {_M} SELECT word, {', '.join(f'sum(n) FILTER (WHERE timestep = {_q(s)})::BIGINT AS y{s}' for s in STEPS)} FROM c GROUP BY word",
    "row_totals": f"WITH {_M} SELECT word, sum(n)::BIGINT AS total FROM c GROUP BY word",
    "step_totals": f"WITH {_M} SELECT timestep, sum(n)::BIGINT AS total FROM c GROUP BY timestep",
    "period_share": f"""WITH {_M}, p AS (SELECT word, coalesce(sum(n) FILTER (WHERE timestep IN {_OLD}), 0)::BIGINT AS historical_n, coalesce(sum(n) FILTER (WHERE timestep NOT IN {_OLD}), 0)::BIGINT AS modern_n
FROM c WHERE timestep IS NOT NULL GROUP BY word) SELECT *, historical_n / sum(historical_n) OVER () AS historical_share, modern_n / sum(modern_n) OVER () AS modern_share FROM p""",
    "first_popular_use": f"WITH {_M}, {_FIRST} SELECT * FROM f",
    "emerging_words": f"WITH {_M}, {_FIRST} SELECT * FROM f WHERE first_popular_use >= 2011",
    "part_word_years": f"WITH {_PW} SELECT * FROM c",
    "emerging_part_words": f"WITH {_PW}, {_FIRST} SELECT * FROM f",
    "sparse_series_filter": f"WITH {_M}, {_SERIES} SELECT * FROM z",
    "tag_counts": f"WITH {_TAGS} SELECT * FROM t",
    "tag_mode_filter": f"WITH {_TAGS}, {_MODE.format(last=' - 1')} SELECT * FROM tm",
    "tag_mode_filter_strict": f"WITH {_TAGS}, {_MODE.format(last='')} SELECT * FROM tm",
    "final_words": f"WITH {_M}, {_FIRST}, {_SERIES}, {_TAGS.replace('m AS (', 'm AS (', 1)}, {_MODE.format(last=' - 1')} SELECT f.* FROM f WHERE first_popular_use >= 2011 AND word NOT IN (SELECT word FROM tm WHERE removed) AND word NOT IN (SELECT word FROM z WHERE NOT kept)",
    "rel_rank": f"WITH {_M}, v AS (SELECT word, sum(n)::BIGINT AS n FROM c GROUP BY word) SELECT word, n, row_number() OVER (ORDER BY n DESC, word) / count(*) OVER () AS rel_rank FROM v",
    "vocab_setops": f"WITH {_M} SELECT word, max((timestep IN {_OLD})::INT) AS in_first, max((timestep NOT IN {_OLD})::INT) AS in_second FROM c WHERE timestep IS NOT NULL GROUP BY word",
    "vocab_intersection": f"WITH {_M} SELECT word FROM c WHERE timestep IN {_OLD} INTERSECT SELECT word FROM c WHERE timestep NOT IN {_OLD}",
    "vocab_difference": f"WITH {_M} SELECT word FROM c WHERE timestep NOT IN {_OLD} EXCEPT SELECT word FROM c WHERE timestep IN {_OLD}",
    "vocab_union": f"WITH {_M} SELECT word FROM c UNION SELECT word FROM target_words WHERE word IS NOT NULL",
    "vocab_bag": f"WITH {_M} SELECT word, count(*) AS n FROM (SELECT word FROM c UNION ALL SELECT word FROM target_words WHERE word IS NOT NULL) GROUP BY word",
    "target_counts": f"WITH {_M} SELECT * FROM c WHERE word IN (SELECT word FROM target_words)",
    "other_counts": f"WITH {_M} SELECT * FROM c WHERE word NOT IN (SELECT word FROM target_words WHERE word IS NOT NULL)",
    "event_windows": r"""WITH e AS (SELECT DISTINCT ON (event_id) ts, event_type FROM events WHERE ts IS NOT NULL AND event_id IS NOT NULL ORDER BY event_id, ts),
a AS (SELECT * FROM e UNION ALL SELECT ts, event_type FROM events WHERE ts IS NOT NULL AND event_id IS NULL),
t AS (SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, unnest(list_filter(regexp_split_to_array(lower(event_type), '\s+'), lambda x: x <> '')) AS word FROM a)
SELECT window_start, word, count(*) AS n FROM t GROUP BY ALL""",
}
