import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexitide import cli, pipeline
from lexitide.config import Domain, Settings
from lexitide.functions import tokens
from lexitide.runtime import materialize
from lexitide.sources import readers, sinks
from lexitide.streaming import token_counts


def _write(path, name, text):
    path.mkdir(exist_ok=True)
    (path / name).write_bytes(text.encode())


def test_decade_files_of_exactly_three_lines(spark, tmp_path):
    d = tmp_path / "d"
    for name, text in {"two.txt": "a\nb", "three.txt": "a\nb\nx\0y", "threeplus.txt": "a\nb\nz\n", "four.txt": "a\nb\nc\nd", "other.dat": "a\nb\nc"}.items():
        _write(d, name, text)
    assert sorted(r.text for r in readers.decade_texts(spark, str(d)).collect()) == ["x", "y", "z"]


def test_genre_files(spark, tmp_path):
    d = tmp_path / "g"
    _write(d, "g.txt", "header\n##1 a <p> b\0c\n##2 d @ e\n")
    texts = readers.genre_texts(spark, str(d))
    assert [r.paragraph for r in readers.text_paragraphs(texts, "line_no", "text_no").orderBy("line_no", "text_no", "paragraph_no").collect()] == ["a", "b", "c", "d", "e"]


def test_tweets_precedence_and_bad_rows(spark, tmp_path):
    d = tmp_path / "t"
    rows = [{"id": 1, "full_text": "full", "text": "cut"}, {"id": "02", "text": "only"}, {"id": "x", "text": "no"}, {"id": 3}]
    _write(d, "t.jsonl", "\n".join(map(json.dumps, rows)) + "\n{broken\n")
    assert {tuple(r) for r in readers.tweets(spark, str(d)).collect()} == {(1, "full"), (2, "only")}


def test_round_trips(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    toks = spark.createDataFrame([("2007", "d1", 1, ["a", "b"]), ("2008", "d2", 1, ["null"])], "timestep string, doc_id string, sentence_id int, tokens array<string>")
    sinks.token_table(toks, p("tok"))
    assert readers.split_sentences(spark.read.parquet(p("tok")), ["2007"]).select("doc_id").collect()[0][0] == "d1"
    sinks.token_rows(toks, p("tsv"))
    assert {(r.doc_id, tuple(r.tokens)) for r in readers.token_rows(spark, p("tsv")).collect()} == {("d1", ("a", "b")), ("d2", ("null",))}
    wide = spark.createDataFrame([("null", 1.0, None), ("a", None, 2.0)], "word string, `2007` double, `2008` double")
    sinks.count_matrix(wide, p("csv"))
    assert {r.word for r in readers.count_matrix(spark, p("csv"), ["2007", "2008"]).collect()} == {"null", "a"}
    assert {r.word for r in readers.count_matrix(spark, p("csv"), ["2007", "2008"], compat_na=True).collect()} == {"a"}
    pairs = spark.createDataFrame([("n", "c")], "neologism string, control string")
    sinks.pairs(pairs, p("pairs"))
    assert [tuple(r) for r in readers.pairs(spark, p("pairs")).collect()] == [("n", "c")]
    sinks.word_list(spark.createDataFrame([("w",)], "word string"), p("words"))
    assert [r.word for r in readers.word_list(spark, p("words")).collect()] == ["w"]
    tags = spark.createDataFrame([("w", "VB", 2, 1), ("w", "NN", 5, 0)], "word string, tag string, n bigint, first_seen int")
    sinks.tag_counts(tags, p("tags"))
    assert {(r.tag, r.n, r.first_seen) for r in readers.tag_counts(spark, p("tags")).collect()} == {("NN", 5, 0), ("VB", 2, 1)}
    ids = spark.createDataFrame([("w", 2007, 5, 1)], "word string, year int, tweet_id bigint, sentence_id int")
    sinks.sampled_ids(ids, p("ids"))
    assert tuple(readers.sampled_ids(spark, p("ids")).first()) == ("w", 2007, 5, 1)
    _write(tmp_path / "ctx", "c.tsv", "word\tposition\tdoc_id\tsentence_id\tsentence\nw\t[1, 2]\td\t1\ta b c\nw\t[1]\td\t\tx\n")
    assert [r.position for r in readers.contexts(spark, p("ctx")).collect()] == [[1, 2]]
    sinks.index(ids, p("index"))
    sinks.contexts(ids, p("contexts"), 2)
    assert spark.read.parquet(p("index")).count() == spark.read.parquet(p("contexts")).count() == 1
    stats = spark.createDataFrame([("w", 1, 0.35, 0.5, None, None)], "word string, is_neologism int, min_cos double, density double, slope double, monotonicity double")
    sinks.results(stats, p("res"), (0.35,))
    assert "NaN" in "".join(r.value for r in spark.read.text(p("res")).collect())


def test_materialize_uses_the_named_folder(spark):
    df = spark.range(5).withColumn("x", F.lit("a"))
    got = materialize(df, "t")
    assert got.count() == 5 and got.dtypes == df.dtypes and "lexitide" in got.inputFiles()[0]


def test_stream_counts_late_and_repeated(spark, tmp_path):
    d = tmp_path / "s"
    d.mkdir()
    rows = [("1", "2020-01-01 00:10:00", "a b"), ("1", "2020-01-01 00:10:00", "a b"), ("2", "2020-01-01 00:20:00", "a"), ("9", "2020-01-02 00:00:00", "z")]
    schema = "id string, at timestamp, text string"
    df = spark.createDataFrame(rows, "id string, at string, text string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(d / "in"))
    stream = spark.readStream.schema(schema).parquet(str(d / "in"))
    counted = token_counts.windowed_counts(stream, tokens.space_tokens(F.col("text")), "at", "1 hour", "1 hour", key="id")
    assert {(r.word, r.n) for r in token_counts.run_once(spark, counted).collect()} >= {("a", 2), ("b", 1)}


def test_stream_emits_open_windows(spark, tmp_path):
    """Windows after the watermark, counts that grow from batch to batch, and messages without a key are all there."""
    rows = [("1", "2020-01-01 00:10:00", "a b"), ("1", "2020-01-01 00:10:00", "a b"), ("2", "2020-01-01 00:20:00", "a"), (None, "2020-01-01 00:30:00", "a"), (None, "2020-01-01 00:30:00", "a"), ("9", "2020-01-02 00:00:00", "z")]
    for part in (rows, [("1", "2020-01-01 00:10:00", "late"), ("10", "2020-01-02 00:30:00", "z"), ("9", "2020-01-02 00:00:00", "z")]):
        spark.createDataFrame(part, "id string, at string, text string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, at timestamp, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counted = token_counts.windowed_counts(stream, tokens.space_tokens(F.col("text")), "at", "1 hour", "1 hour", key="id")
    assert sorted((r.word, r.n) for r in token_counts.run_once(spark, counted).collect()) == [("a", 4), ("b", 1), ("z", 2)]


def test_analysis_end_to_end(spark, tmp_path):
    rng = np.random.default_rng(3)
    steps_old, steps_new = ("2007", "2008"), ("2011",)
    words = [f"w{k:02d}" for k in range(30)]
    base = rng.standard_normal((30, 5))
    q, _ = np.linalg.qr(rng.standard_normal((5, 5)))
    old = spark.createDataFrame([(w, v.tolist()) for w, v in zip(words, base)], "word string, vector array<double>")
    new = spark.createDataFrame([(w, (v @ q).tolist()) for w, v in zip(words, base)], "word string, vector array<double>")
    counts = spark.createDataFrame([(w, s, 5 + 3 * k + 7 * (s == "2008") * (k % 2)) for k, w in enumerate(words) for s in (*steps_old, *steps_new)], "word string, timestep string, n int")
    domain = Domain("test", steps_old, steps_new, Settings(match_rank=0.2, match_cosine=0.1))
    targets = spark.createDataFrame([("w03",), ("w10",)], "word string")
    out = pipeline.analyse(domain, counts, targets, old, new)
    pairs = {r.neologism: r.control for r in out.pairs.collect()}
    assert set(pairs) <= {"w03", "w10"} and pairs and not set(pairs.values()) & {"w03", "w10"}
    assert out.statistics.count() == 2 * 9 * len(pairs) and out.summary.count() == 18
    given = spark.createDataFrame([("w03", "w04")], "neologism string, control string")
    assert pipeline.analyse(domain, counts, targets, old, old, given, contextual=True).statistics.where("word = 'w03' and min_cos = 0.35").count() == 1
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["main", "nowhere"])


def test_tweets_to_final_words(spark):
    messages = spark.createDataFrame([(1, "Hello Wörld! #tag 12"), (2, "!!! ..."), (3, "One. Two")], "tweet_id bigint, text string")
    got = {(r.doc_id, r.sentence_id, tuple(r.tokens)) for r in pipeline.tweet_sentences(messages, "2007").collect()}
    assert got == {("1", 1, ("hello", "wörld")), ("3", 1, ("one",)), ("3", 2, ("two",))}
    rows = [("new", str(y), 10 * (y - 2010)) for y in range(2011, 2022)] + [("old", "2007", 900)]
    domain = Domain("t", tuple(map(str, range(2007, 2011))), tuple(map(str, range(2011, 2022))))
    counts = spark.createDataFrame(rows, "word string, timestep string, n bigint")
    tags = spark.createDataFrame([("new", "NN", 3, 0)], "word string, tag string, n bigint, first_seen int")
    assert [r.word for r in pipeline.final_words(counts, domain, tags).collect()] == ["new"]
    assert pipeline.final_words(counts, domain, tags.selectExpr("word", "'CD' as tag", "n", "first_seen")).count() == 0
