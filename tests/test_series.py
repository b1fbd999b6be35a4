import random

import pytest
from pyspark.sql import functions as F

from lexitide.config import Settings
from lexitide.functions.statistics import spearman
from lexitide.operators import counts, emergence, vocabularies


def _series(spark, rows):
    return spark.createDataFrame(rows, "word string, timestep string, n bigint")


def test_minimum_total_and_first_popular_use(spark):
    rows = [("a", "2007", 500), ("b", "2007", 501), ("c", "2007", 1), ("c", "2011", 1), ("c", "2012", 598), ("null", "2012", 700), ("d", None, 900)]
    got = {r["word"]: r["first_popular_use"] for r in emergence.first_popular_use(_series(spark, rows)).collect()}
    assert got == {"b": 2007, "c": 2011, "null": 2012}
    assert {r["word"] for r in emergence.emerging_words(_series(spark, rows)).collect()} == {"c", "null"}


def test_tag_ties(spark):
    rows = [("a", "NNP", 5, 0), ("a", "NN", 5, 1), ("b", "NN", 5, 0), ("b", "NNP", 5, 1), ("c", "NN", 5, 0), ("c", "NNP", 5, 1), ("c", "VB", 1, 2)]
    df = spark.createDataFrame(rows, "word string, tag string, n bigint, first_seen int")
    flags = lambda strict: {r["word"]: r["removed"] for r in emergence.tag_mode_filter(df, strict_ties=strict).collect()}
    assert flags(False) == {"a": True, "b": False, "c": True}
    assert flags(True) == {"a": True, "b": True, "c": True}
    words = spark.createDataFrame([("a",), ("b",), ("z",)], "word string")
    assert {r[0] for r in emergence.keep_unflagged(words, emergence.tag_mode_filter(df)).collect()} == {"b", "z"}


def test_sparse_series(spark):
    steps = [str(y) for y in range(2007, 2022)]
    dense = [("up", s, k + 6) for k, s in enumerate(steps)]
    rows = dense + [("late", "2021", 3), ("gone", "2007", 9), ("down", "2007", 90), ("down", "2008", 80), ("down", "2009", 70), ("down", "2010", 60)] + [("flat", s, 9) for s in steps]
    got = {r["word"]: (r["kept"], r["rho"]) for r in emergence.sparse_series_filter(_series(spark, rows), steps).collect()}
    assert {w: k for w, (k, _) in got.items()} == {"up": True, "late": True, "gone": False, "down": False, "flat": True}
    assert got["up"][1] == pytest.approx(1) and got["flat"][1] is None


def test_spearman_with_ties_and_constants(spark):
    df = spark.createDataFrame([("a", x, y) for x, y in [(1, 1), (2, 1), (3, 2)]] + [("b", 1, 5), ("b", 2, 5)], "g string, x int, y int")
    got = {r["g"]: r["rho"] for r in spearman(df, ["g"], "x", "y").collect()}
    assert got["a"] == pytest.approx(0.8660254) and got["b"] is None


def test_shards_matrix_shares(spark):
    df = spark.createDataFrame([("a", "2007", 0, 3), ("a", "2007", 0, 3), ("a", "2007", 1, 2), ("b", "2011", 0, None), (None, "2007", 0, 9), ("b", "2011", 1, 5), ("null", "2007", 2, 5)], "word string, timestep string, shard_no int, count bigint")
    merged = counts.merge_shards(df)
    assert {(r.word, r.timestep, r.n) for r in merged.collect()} == {("a", "2007", 5), ("b", "2011", 5), ("null", "2007", 5)}
    wide = {r["word"]: (r["y2007"], r["y2011"]) for r in counts.count_matrix(merged, ["2007", "2011"]).collect()}
    assert wide == {"a": (5, None), "b": (None, 5), "null": (5, None)}
    shares = {r["word"]: (r["historical_share"], r["modern_share"]) for r in counts.period_shares(merged, ["2007"]).collect()}
    assert shares == {"a": (0.5, 0.0), "b": (0.0, 1.0), "null": (0.5, 0.0)}


def test_relative_rank_is_the_global_order(spark):
    random.seed(1)
    rows = [(f"w{k}", random.randrange(20)) for k in range(200)]
    got = {r["word"]: r["rel_rank"] for r in counts.relative_rank(spark.createDataFrame(rows, "word string, n bigint"), 7).collect()}
    for k, (w, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        assert got[w] == pytest.approx(k / 200)


def test_vocabularies_and_pairs(spark):
    a, b = (spark.createDataFrame([(w,) for w in ws], "word string") for ws in ("xyy", "yz"))
    assert {tuple(r) for r in vocabularies.overlap(a, b).collect()} == {("x", 1, 0), ("y", 1, 1), ("z", 0, 1)}
    pairs = spark.createDataFrame([("n", "a", 1), ("n", "b", 2)], "neologism string, control string, line_no int")
    assert [tuple(r) for r in vocabularies.loaded_pairs(pairs).collect()] == [("n", "b")]


def test_tag_counts_keep_first_sight(spark):
    df = spark.createDataFrame([("a", "NN", 3), ("a", "NN", 1), ("a", "VB", 2)], "word string, tag string, seen int")
    assert {tuple(r) for r in emergence.tag_counts(df).collect()} == {("a", "NN", 2, 1), ("a", "VB", 1, 2)}
    assert Settings().min_total == 500
    assert df.select(emergence.shape_tag(F.lit("Ab"))).first()[0] == "NNP"
