import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexitide.operators import alignment, matching, similarity, summary, zscore


def _vectors(spark, rows):
    return spark.createDataFrame([(w, None if v is None else [float(x) for x in v]) for w, v in rows], "word string, vector array<double>")


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 8))
    rows = [(f"w{k}", v) for k, v in enumerate(x)] + [("none", None), ("short", [1, 2]), ("zero", [0] * 8), ("nan", [float("nan")] * 8), (None, [1] * 8)]
    vocabulary = _vectors(spark, rows)
    asked = vocabulary.where("word in ('w1', 'w2', 'zero', 'none')")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(f"w{a}", f"w{b}") for a in (1, 2) for b in range(60) if a != b and u[a] @ u[b] >= 0.35}
    for block in (64, 1 << 20):  # one query a block, and all in one
        got = similarity.radius_neighbours(asked, vocabulary, 0.35, block_bytes=block).collect()
        assert {(r.word, r.neighbour) for r in got} == want
    places = similarity.ordered_neighbours(similarity.radius_neighbours(asked, vocabulary, 0.35)).where("word = 'w1'").orderBy("place").collect()
    assert [r.cos for r in places] == sorted((r.cos for r in places), reverse=True)
    assert similarity.radius_neighbours(asked.limit(0), vocabulary, 0.35).count() == 0


def test_edges_at_their_limits(spark):
    t = spark.createDataFrame([("abcd", 0.5, [1.0, 0.0])], "word string, rel_rank double, vector array<double>")
    at = lambda c: [c, (1 - c * c) ** 0.5]
    rows = [("ok", 0.5, at(0.41)), ("length", 0.5, at(0.9)), ("toolongx", 0.5, at(0.9)), ("rank", 0.509, at(0.9)), ("far", 0.5101, at(0.9)), ("dark", 0.5, at(0.39)), ("zero", 0.5, [0.0, 0.0]), ("abcd", 0.5, [1.0, 0.0])]
    c = spark.createDataFrame(rows, "word string, rel_rank double, vector array<double>")
    assert {r.control for r in similarity.candidate_edges(t, c).collect()} == {"ok", "length", "rank"}
    assert {r.control for r in similarity.candidate_edges(t, c, block_rows=2).collect()} == {"ok", "length", "rank"}
    odd = spark.createDataFrame([(None, 0.5, [1.0, 0.0]), ("none", 0.5, None), ("hole", 0.5, [None, 1.0]), ("wide", 0.5, [1.0, 0.0, 0.0]), ("lost", None, [1.0, 0.0])], "word string, rel_rank double, vector array<double>")
    assert {r.control for r in similarity.candidate_edges(t, c.unionByName(odd)).collect()} == {"ok", "length", "rank"}
    assert similarity.candidate_edges(t.limit(0), c).count() == similarity.candidate_edges(t, c.limit(0)).count() == 0
    assert "NestedLoop" not in similarity.candidate_edges(t, c)._jdf.queryExecution().toString()


def test_density_growth_and_pairs(spark):
    near = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.4), ("b", "x", 0.36)], "word string, neighbour string, cos double")
    words = spark.createDataFrame([("a",), ("b",)], "word string")
    d = {(r.word, r.min_cos): r for r in similarity.densities(words, near, min_cosines=(0.45, 0.35)).collect()}
    assert d["a", 0.35].density == pytest.approx(np.log(3)) and d["b", 0.45].density == 0
    counts = spark.createDataFrame([("x", 1, 10), ("x", 2, 30)], "word string, step_idx int, n bigint")  # y has no counts, yet counts as a neighbour
    totals = spark.createDataFrame([(1, 100), (2, 100)], "step_idx int, total bigint")
    g = {(r.word, r.min_cos): r for r in similarity.growth(near, counts, totals, min_cosines=(0.45, 0.35)).collect()}
    assert g["a", 0.35].slope == pytest.approx(0.1) and g["a", 0.45].slope == pytest.approx(0.2) and g["a", 0.35].monotonicity == pytest.approx(1)
    pairs = spark.createDataFrame([("a", "b"), ("a", "missing")], "neologism string, control string")
    stats = similarity.pair_statistics(pairs, similarity.densities(words, near, min_cosines=(0.45, 0.35)), similarity.growth(near, counts, totals, min_cosines=(0.45, 0.35)))
    rows = {(r.word, r.min_cos): r for r in stats.collect()}
    assert len(rows) == 4 and rows["a", 0.45].slope is None and rows["a", 0.45].density > 0 and rows["a", 0.35].slope is not None
    wide = {r["word"]: r for r in summary.wide_form(stats, (0.45, 0.35)).collect()}
    assert wide["a"]["slope_450"] is None and wide["b"]["density_450"] == 0
    assert summary.long_form(stats).count() == 4 + 2 + 2
    assert similarity.group_summary(stats).where("is_neologism = 1 and min_cos = 0.35").first()["density_sem"] is None


def test_standard_error_skips_nulls(spark):
    df = spark.createDataFrame([(1, 0.5, float(x) if x is not None else None, None, None) for x in (1, 3, None)], "is_neologism int, min_cos double, density double, slope double, monotonicity double")
    r = similarity.group_summary(df).first()
    assert r["density_sem"] == pytest.approx(np.std([1, 3], ddof=1) / 2**0.5) and r["slope_mean"] is None


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 5), st.integers(0, 5)), max_size=14))
def test_matching_is_maximum(edges):
    named = [(f"n{a}", f"c{b}") for a, b in edges]
    best = 0
    for k in range(min(6, len(named)), 0, -1):
        if any(len({a for a, _ in s}) == k and len({b for _, b in s}) == k for s in itertools.combinations(named, k)):
            best = k
            break
    found = matching.hopcroft_karp(named)
    assert len(found) == best and set(found.items()) <= set(named) and len(set(found.values())) == best


def test_matching_of_components(spark):
    rows = [("a", "x"), ("b", "x"), ("c", "x"), ("d", "y"), ("e", "y"), ("e", "z"), (None, "q"), ("a", "x")]  # a star; a path of four
    got = matching.maximum_matching(spark.createDataFrame(rows, "neologism string, control string")).collect()
    assert len(got) == 3 and {r.control for r in got} == {"x", "y", "z"}
    assert matching.maximum_matching(spark.createDataFrame([], "neologism string, control string")).count() == 0
    chain = spark.createDataFrame([(f"n{k:03d}", f"c{k + d:03d}") for k in range(150) for d in (0, 1)], "neologism string, control string")
    faults = matching.matching_faults(chain).first()
    assert set(faults) == {0} and matching.maximum_matching(chain).count() == 150  # one long component


@settings(max_examples=100, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=30))
def test_covers_prove_matchings(pairs):
    links = [(f"a{a}", f"b{b}") for a, b in pairs]
    found = matching.hopcroft_karp(links)
    left, right = matching.vertex_cover(links, found)
    assert len(left) + len(right) == len(found) and all(a in left or b in right for a, b in links)


def test_alignment_recovers_a_rotation(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 6))
    q, _ = np.linalg.qr(rng.standard_normal((6, 6)))
    b = _vectors(spark, [(f"w{k}", v) for k, v in enumerate(base)])
    o = _vectors(spark, [(f"w{k}", v) for k, v in reversed(list(enumerate(base @ q)))] + [("extra", np.ones(6))])
    turn = alignment.rotation(alignment.cross_product(b, o))
    assert np.allclose(turn @ turn.T, np.eye(6)) and np.allclose(turn, q.T)
    got = {r.word: r.vector for r in alignment.align(b, o).collect()}
    assert all(np.allclose(got[f"w{k}"], base[k]) for k in range(40)) and "extra" in got
    listed = alignment.common_vocabulary(b, o, spark.createDataFrame([("w1",), ("zz",)], "word string"))
    assert [r.word for r in listed.collect()] == ["w1"]


def test_zscores_equal_the_pooled_result(spark):
    rng = np.random.default_rng(2)
    rows = [("a", v) for v in rng.standard_normal((7, 4))] + [("b", v) for v in rng.standard_normal((2, 4)) + 1]
    df = _vectors(spark, rows + [("c", None), (None, [1] * 4)]).repartition(3)
    x = np.array([v for _, v in rows])
    z = (x - x.mean(0)) / x.std(0)
    got = {r.word: r for r in zscore.zscored_means(df.where("word is not null")).collect()}
    assert np.allclose(got["a"].vector, z[:7].mean(0)) and np.allclose(got["b"].vector, z[7:].mean(0)) and got["a"].n == 7
    stats = zscore.dimension_stats(df.where("word is not null")).orderBy("dim").collect()
    assert np.allclose([r["std"] for r in stats], x.std(0))


def test_encoder_and_training(spark):
    df = spark.createDataFrame([("a", ["x", "a"], [1]), ("a", ["a"], [4]), ("b b", ["b", "b"], [0, 1]), ("c", ["b", "c"], [0])], "word string, tokens array<string>, position array<int>")
    got = zscore.encode_contexts(df, zscore.hashing_encoder(8)).collect()
    assert sorted(r.word for r in got) == ["a", "b b"] and len(got[0].vector) == 8
    sents = spark.createDataFrame([(["u", "v", "w"],)] * 30 + [(["u", "v", "u"],), ([],)], "tokens array<string>")
    words = alignment.train_vectors(sents, size=4, min_count=2, max_vocabulary=2).orderBy("idx").collect()
    assert [r.word for r in words] == ["u", "v"] and words[0]["count"] == 32
    assert df.select(similarity.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))).first()[0] == 11


def test_word2vec_query_keeps_every_word(spark, tmp_path):
    """More words than any cap the query once had, all at the minimum count: each gets a vector."""
    from lexitide.plans import vector_queries

    letters = "abcdefghijklmnopqr"
    words = ["".join(p) for p in itertools.islice(itertools.product(letters, repeat=4), 5200)]
    rows = [(k, " ".join(words[k * 520 : (k + 1) * 520] * 5)) for k in range(10)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = vector_queries.word2vec_vectors(spark, str(tmp_path)).select("word", "count").collect()
    assert {(r.word, r["count"]) for r in got} == {(w, 5) for w in words}
