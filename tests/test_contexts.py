from pyspark.sql import functions as F

from lexitide.operators import contexts
from lexitide.operators.deliveries import one_per_message


def test_sample_sizes_and_stability(spark):
    rows = [(w, i, 1) for w, n in (("a", 4), ("b", 5), ("c", 6)) for i in range(n)]
    df = spark.createDataFrame(rows, "word string, tweet_id bigint, sentence_id int")
    sample = lambda d: {tuple(r) for r in contexts.sample_per_word(d, 5, ["tweet_id", "sentence_id"]).collect()}
    got = sample(df)
    assert [sum(w == x[0] for x in got) for w in "abc"] == [4, 5, 5] and got <= set(rows)
    assert sample(df.unionByName(df).repartition(3, "tweet_id")) == got


def _span(spark, hay, *needles, limit=512):
    df = spark.createDataFrame([(hay, *needles)], "h array<int>, " + ", ".join(f"n{k} array<int>" for k in range(len(needles))))
    cols = [F.col(f"n{k}") for k in range(len(needles))]
    e = contexts.span(F.col("h"), cols[0], limit) if len(cols) == 1 else contexts.span_of_either(F.col("h"), *cols, limit)
    return df.select(e).first()[0]


def test_spans(spark):
    assert _span(spark, [5, 6, 7, 6, 7], [6, 7]) == [1, 2]
    assert _span(spark, [5], [5, 6]) is None and _span(spark, [5], []) is None and _span(spark, [], [1]) is None
    assert _span(spark, [9] * 512 + [1], [1]) is None and _span(spark, [9] * 511 + [1], [1]) == [511]
    assert _span(spark, [4, 3], [3], [4]) == [0] and _span(spark, [3, 4, 3], [3], [4]) == [0]


def test_occurrences_and_semi_joins(spark):
    texts = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["c"]), (3, [])], "tweet_id bigint, t array<string>")
    words = spark.createDataFrame([("a",), ("a",), (None,)], "word string")
    assert [tuple(r) for r in contexts.occurrences(texts, F.col("t"), words, "tweet_id").collect()] == [(1, "a")]
    assert [r.tweet_id for r in contexts.texts_with_any(texts, F.col("t"), words, "tweet_id").collect()] == [1]


def test_sentences_of_contexts(spark):
    messages = spark.createDataFrame([(1, "x. y."), (2, "z.")], "tweet_id bigint, text string")
    asked = spark.createDataFrame([("w", 1, 2), ("w", 1, 3), ("w", 1, 0), ("w", 9, 1)], "word string, tweet_id bigint, sentence_id int")
    got = {(r.tweet_id, r.sentence_id, r.sentence) for r in contexts.sentences_of_contexts(messages, asked, F.split("text", " ")).collect()}
    assert got == {(1, 2, "y."), (1, 3, None), (1, 0, None)}


DELIVERY = "id string, full_text string, received_at string, batch_no int, line_no bigint, n_deliveries int"


def test_one_row_per_message(spark):
    rows = [
        ("7", "t", "b", 1, 1, 9), (" 007\t", "t", "a", 2, 2, 9), ("+7", "t", None, 0, 0, 9), ("8", None, "a", 1, 1, 9), ("8", None, "a", 1, 1, 9),
        ("id9", "x", "a", 1, 1, 9), ("", "x", "a", 1, 1, 9), (None, "x", "a", 1, 1, 9), ("99999999999999999999999", "x", "a", 1, 1, 9), ("9", "tie1", "a", 1, 1, 9), ("9", "tie2", "a", 1, 1, 9),
    ]
    df = spark.createDataFrame(rows, DELIVERY)
    got = {r.id: r for r in one_per_message(df).collect()}
    assert set(got) == {7, 8, 9}
    assert (got[7].received_at, got[7].n_deliveries) == ("a", 3) and got[8].n_deliveries == 2
    again = {r.id: r for r in one_per_message(df.repartition(5, "full_text").orderBy(F.desc("full_text"))).collect()}
    assert again == got
    assert one_per_message(df.limit(0)).count() == 0
    few = {r.id: r for r in one_per_message(df, columns=("line_no",)).collect()}
    assert {k: (r.line_no, r.n_deliveries) for k, r in few.items()} == {k: (r.line_no, r.n_deliveries) for k, r in got.items()}
    assert {r.id for r in one_per_message(df, columns=()).collect()} == set(got)
    assert one_per_message(df.select("id")).orderBy("id").collect()[0].n_deliveries == 3
    clash = df.withColumn("_number", F.lit("x")).withColumn("_row", F.lit("y"))
    assert {r.id: (r._number, r._row) for r in one_per_message(clash).collect()} == {k: ("x", "y") for k in got}
    assert one_per_message(df).columns == ["id", "full_text", "received_at", "batch_no", "line_no", "n_deliveries"]


def test_hot_message_and_long_text(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("5")).otherwise(F.col("id").cast("string")).alias("id"), F.repeat(F.lit("x"), F.lit(2000)).alias("full_text"), F.col("id").alias("line_no"))
    got = {r.id: r.n_deliveries for r in one_per_message(df).select("id", "n_deliveries").collect()}
    assert got[5] == 1001 and len(got) == 2000
