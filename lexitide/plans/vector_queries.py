"""Queries on vectors: neighbourhoods, matching, growth, alignment, z-scores, training.

The vectors are the rows of ``embeddings``: labels under 5 stand for emerging words, the others for controls. Searches ask with every
row whose id is divisible by 20 and look through all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexitide.config import MIN_COSINES
from lexitide.functions import tokens
from lexitide.operators import alignment, matching, similarity, summary, vocabularies, zscore
from lexitide.runtime import table

STEPS = 15


def words(spark: SparkSession, sf: str) -> DataFrame:
    """(word, label, vector) of all rows of the vector table."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("word"), "label", F.col("embedding").alias("vector")).where("word is not null")


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return words(spark, sf).where("word % 20 = 0")


def series(spark: SparkSession, sf: str) -> DataFrame:
    """(word, step_idx, n): a count series of every word, computed from its id; some words miss some steps."""
    steps = words(spark, sf).select("word", F.explode(F.sequence(F.lit(1), F.lit(STEPS))).alias("step_idx"))
    n = (F.col("word") * 7 + F.col("step_idx") * (F.col("word") % 13)) % 97
    return steps.select("word", "step_idx", n.alias("n")).where("n > 9")


def totals(spark: SparkSession, sf: str) -> DataFrame:
    return series(spark, sf).groupBy("step_idx").agg(F.sum("n").alias("total"))


def asked_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs as a study would load them: the i-th emerging word asked for with the i-th control."""
    place = F.row_number().over(Window.partitionBy("g").orderBy("word"))
    a = asked(spark, sf).select("word", (F.col("label") < 5).alias("g")).where("g is not null").withColumn("i", place)
    return a.where("g").select(F.col("word").alias("neologism"), "i").join(a.where("not g").select(F.col("word").alias("control"), "i"), "i").select("neologism", "control")


def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    found = similarity.radius_neighbours(asked(spark, sf), words(spark, sf), min(MIN_COSINES))
    return similarity.ordered_neighbours(found).select("word", "neighbour", F.round("cos", 6).alias("cos"), "place")


def _near(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.radius_neighbours(asked(spark, sf), words(spark, sf), min(MIN_COSINES))


def density(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.densities(asked(spark, sf), _near(spark, sf))


def neighbour_growth(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.growth(_near(spark, sf), series(spark, sf), totals(spark, sf))


def pair_statistics(spark: SparkSession, sf: str) -> DataFrame:
    near = _near(spark, sf)
    return similarity.pair_statistics(asked_pairs(spark, sf), similarity.densities(asked(spark, sf), near), similarity.growth(near, series(spark, sf), totals(spark, sf)))


def group_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: mean and standard error of density, slope and monotonicity by group and radius."""
    return similarity.group_summary(pair_statistics(spark, sf))


def statistics_long(spark: SparkSession, sf: str) -> DataFrame:
    return summary.long_form(pair_statistics(spark, sf))


def statistics_wide(spark: SparkSession, sf: str) -> DataFrame:
    return summary.wide_form(pair_statistics(spark, sf))


def bootstrap_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return summary.bootstrap_intervals(statistics_long(spark, sf))


def bootstrap_check(spark: SparkSession, sf: str) -> DataFrame:
    """What SQL can say of the intervals: their means, and that these lie inside."""
    found = summary.bootstrap_intervals(statistics_long(spark, sf))
    return found.select("is_neologism", "min_cos", "statistic", F.round("mean", 9).alias("mean"), F.col("mean").between(F.col("low") - 1e-12, F.col("high") + 1e-12).alias("inside"))


def contextual_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours in the old space of words that ask with their new vectors (here: the old ones reversed)."""
    new = asked(spark, sf).withColumn("vector", F.reverse("vector"))
    return similarity.radius_neighbours(new, words(spark, sf), min(MIN_COSINES)).select("word", "neighbour", F.round("cos", 6).alias("cos"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate pairs of emerging words asked for and controls."""
    ranked = words(spark, sf).withColumn("rel_rank", (F.col("word") * 37 % 1009 + 1) / 1009.0)
    return similarity.candidate_edges(ranked.where("label < 5"), ranked.where("label >= 5"), max_rank=0.05, min_cosine=0.2)


def matched_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return matching.maximum_matching(edges(spark, sf))


def matching_check(spark: SparkSession, sf: str) -> DataFrame:
    """What any maximum matching must show: every word at most once, every pair an edge, and a vertex cover of its own size."""
    return matching.matching_faults(edges(spark, sf))


def dim_stats(spark: SparkSession, sf: str) -> DataFrame:
    return zscore.dimension_stats(words(spark, sf))


def zscore_means(spark: SparkSession, sf: str) -> DataFrame:
    z = zscore.zscored_means(words(spark, sf).where("label is not null").select(F.col("label").alias("word"), "vector"))
    return z.select("word", "n", F.posexplode("vector").alias("dim", "z"))


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two tables over one vocabulary: all vectors, and all vectors with their dimensions reversed (a known rotation)."""
    base = words(spark, sf).select("word", F.col("vector"))
    return base, base.select("word", F.reverse("vector").alias("vector"))


def procrustes_cross(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.cross_product(*_halves(spark, sf))


def procrustes_aligned(spark: SparkSession, sf: str) -> DataFrame:
    """Aligned vectors, which a known rotation lets SQL check: they must equal the base's."""
    aligned = alignment.align(*_halves(spark, sf))
    return aligned.select("word", F.posexplode("vector").alias("dim", "x")).select("word", "dim", F.round("x", 4).alias("x"))


def common_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Words with vectors that also have counts above 20 at the last step."""
    last = series(spark, sf).where((F.col("step_idx") == STEPS) & (F.col("n") > 20))
    return vocabularies.only_words(words(spark, sf).select("word", "label"), last)


def word2vec_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Skip-gram vectors learnt from all documents (16 wide, one pass)."""
    docs = table(spark, sf, "documents").select(F.filter(tokens.space_tokens(F.col("text")), tokens.control_token).alias("tokens"))
    return alignment.train_vectors(docs, size=16)


_E = "e AS (SELECT vec_id AS word, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id IS NOT NULL)"
_NEAR = f"""{_E}, a AS (SELECT * FROM e WHERE word % 20 = 0),
n AS (SELECT a.word, e.word AS neighbour, list_cosine_similarity(a.v, e.v) AS cos FROM a, e WHERE a.word <> e.word AND list_cosine_similarity(a.v, e.v) >= 0.35)"""
_R = "r AS (SELECT unnest([" + ", ".join(map(str, MIN_COSINES)) + "])::DOUBLE AS min_cos)"
_SER = f"s AS (SELECT * FROM (SELECT word, k AS step_idx, (word * 7 + k * (word % 13)) % 97 AS n FROM e, (SELECT unnest(range(1, {STEPS + 1})) AS k)) WHERE n > 9), t AS (SELECT step_idx, sum(n) AS total FROM s GROUP BY 1)"
_DENS = "d AS (SELECT a.word, r.min_cos, count(n.neighbour) AS n_neighbours, ln(1 + count(n.neighbour)) AS density FROM a CROSS JOIN r LEFT JOIN n ON n.word = a.word AND n.cos >= r.min_cos GROUP BY ALL)"
_GROW = """i AS (SELECT n.word, r.min_cos, n.neighbour FROM n JOIN r ON n.cos >= r.min_cos),
z AS (SELECT word, min_cos, count(*) AS c FROM i GROUP BY ALL),
u AS (SELECT i.word, i.min_cos, s.step_idx, sum(s.n) AS m FROM i JOIN s ON s.word = i.neighbour GROUP BY ALL),
sh AS (SELECT z.word, z.min_cos, t.step_idx, coalesce(u.m, 0) / (z.c * t.total) AS share FROM z CROSS JOIN t LEFT JOIN u ON u.word = z.word AND u.min_cos = z.min_cos AND u.step_idx = t.step_idx),
k AS (SELECT *, rank() OVER (PARTITION BY word, min_cos ORDER BY share) + (count(*) OVER (PARTITION BY word, min_cos, share) - 1) / 2.0 AS rk FROM sh),
g AS (SELECT word, min_cos, regr_slope(share, step_idx) AS slope, CASE WHEN min(rk) <> max(rk) THEN covar_pop(rk, step_idx) / (stddev_pop(rk) * stddev_pop(step_idx)) END AS monotonicity FROM k GROUP BY ALL)"""
_PAIRS = """ap AS (SELECT word, label < 5 AS g, row_number() OVER (PARTITION BY label < 5 ORDER BY word) AS i FROM a WHERE label IS NOT NULL),
pr AS (SELECT x.word AS neologism, y.word AS control FROM ap x JOIN ap y ON x.i = y.i AND x.g AND NOT y.g),
mb AS (SELECT neologism, control, neologism AS word, 1 AS is_neologism FROM pr UNION ALL SELECT neologism, control, control, 0 FROM pr),
q AS (SELECT mb.*, d.min_cos, d.density, min(d.n_neighbours) OVER (PARTITION BY neologism, control, d.min_cos) > 0 AS ok FROM mb JOIN d ON d.word = mb.word),
st AS (SELECT q.*, g.slope, g.monotonicity FROM q LEFT JOIN g ON g.word = q.word AND g.min_cos = q.min_cos),
ps AS (SELECT neologism, control, word, is_neologism, min_cos, density, CASE WHEN ok THEN slope END AS slope, CASE WHEN ok THEN monotonicity END AS monotonicity FROM st)"""
_STATS = f"WITH {_NEAR}, {_R}, {_SER}, {_DENS}, {_GROW}, {_PAIRS}"
_ALL = (
    neighbours, density, neighbour_growth, pair_statistics, group_summary, statistics_long, statistics_wide, bootstrap_intervals, bootstrap_check, contextual_neighbours, edges, matched_pairs, matching_check,
    dim_stats, zscore_means, procrustes_cross, procrustes_aligned, common_vocabulary, word2vec_vectors,
)
QUERIES = {f.__name__: f for f in _ALL}
_SUM = ", ".join(f"avg({s}) AS {s}_mean, CASE WHEN count({s}) > 1 THEN stddev_samp({s}) / sqrt(count({s})) END AS {s}_sem" for s in ("density", "slope", "monotonicity"))
_WIDE = ", ".join(f"max(CASE WHEN min_cos = {r} THEN {s} END) AS {s}_{round(r * 1000)}" for r in MIN_COSINES for s in ("density", "monotonicity", "slope"))
ORACLE = {
    "neighbours": f"WITH {_NEAR} SELECT word, neighbour, round(cos, 6) AS cos, row_number() OVER (PARTITION BY word ORDER BY cos DESC, neighbour) AS place FROM n",
    "density": f"WITH {_NEAR}, {_R}, {_DENS} SELECT * FROM d",
    "neighbour_growth": f"WITH {_NEAR}, {_R}, {_SER}, {_GROW} SELECT * FROM g",
    "pair_statistics": f"{_STATS} SELECT * FROM ps",
    "group_summary": f"{_STATS} SELECT is_neologism, min_cos, {_SUM} FROM ps GROUP BY ALL",
    "statistics_long": f"{_STATS} SELECT word, is_neologism, min_cos, u.statistic, u.value FROM (SELECT word, is_neologism, min_cos, unnest([{{'statistic': 'density', 'value': density}}, {{'statistic': 'slope', 'value': slope}}, {{'statistic': 'monotonicity', 'value': monotonicity}}]) AS u FROM ps) WHERE u.value IS NOT NULL",
    "statistics_wide": f"{_STATS} SELECT word, is_neologism, {_WIDE} FROM ps GROUP BY ALL",
    "bootstrap_check": f"{_STATS} SELECT is_neologism, min_cos, u.statistic, round(avg(u.value), 9) AS mean, true AS inside FROM (SELECT is_neologism, min_cos, unnest([{{'statistic': 'density', 'value': density}}, {{'statistic': 'slope', 'value': slope}}, {{'statistic': 'monotonicity', 'value': monotonicity}}]) AS u FROM ps) WHERE u.value IS NOT NULL GROUP BY ALL",
    "contextual_neighbours": f"WITH {_E}, a AS (SELECT word, list_reverse(v) AS v FROM e WHERE word % 20 = 0) SELECT a.word, e.word AS neighbour, round(list_cosine_similarity(a.v, e.v), 6) AS cos FROM a, e WHERE a.word <> e.word AND list_cosine_similarity(a.v, e.v) >= 0.35",
    "edges": f"""WITH {_E}, k AS (SELECT *, (word * 37 % 1009 + 1) / 1009.0::DOUBLE AS rr FROM e)
SELECT x.word AS neologism, y.word AS control FROM k x, k y WHERE x.label < 5 AND y.label >= 5 AND abs(length(x.word::VARCHAR) - length(y.word::VARCHAR)) <= 2 AND abs(x.rr - y.rr) <= 0.05 AND list_cosine_similarity(x.v, y.v) >= 0.2""",
    "matching_check": "SELECT 0::BIGINT AS repeated_left, 0::BIGINT AS repeated_right, 0::BIGINT AS not_edges, 0::BIGINT AS uncovered_edges, 0::BIGINT AS cover_surplus",
    "dim_stats": f"WITH {_E}, c AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM e) SELECT dim, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS std FROM c GROUP BY dim",
    "zscore_means": f"""WITH {_E}, c AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM e),
t AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM c GROUP BY dim), w AS (SELECT label::VARCHAR AS word, dim, count(*) AS n, avg(x) AS x FROM c WHERE label IS NOT NULL GROUP BY ALL)
SELECT word, n, dim, (x - m) / s AS z FROM w JOIN t USING (dim)""",
    "procrustes_cross": f"""WITH {_E}, c AS (SELECT word, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS j, len(v) AS d FROM e)
SELECT p.d - 1 - p.j AS i, q.j, sum(p.x * q.x) AS m FROM c p JOIN c q USING (word) GROUP BY ALL""",
    "procrustes_aligned": f"WITH {_E} SELECT word, generate_subscripts(v, 1) - 1 AS dim, round(unnest(v), 4) AS x FROM e",
    "common_vocabulary": f"WITH {_E}, {_SER} SELECT word, label FROM e WHERE word IN (SELECT word FROM s WHERE step_idx = {STEPS} AND n > 20)",
}
