import unicodedata

import regex
from pyspark.sql import functions as F

from lexitide.functions import structure, tokens

TOKENS = ["#tag", "12-3", "²³", "!!", "http://x", "x", "a" * 50, "a" * 51, "don't", "don’t", "@u", "a_b", "Ab", "", "😂", "😂👍", "3rd", "-", "a😂", "555-123-4567", "(555) 123 4567", "123.4567", "12-34567", "‍", " ", "...", "x http", None]


def _by(spark, expr, rows):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string")
    return [r[0] for r in df.orderBy("k").select(expr(F.col("t"))).collect()]


def test_tweet_filter_keeps_the_stated_tokens(spark):
    kept = _by(spark, tokens.keep_token, TOKENS)
    assert [t for t, k in zip(TOKENS, kept) if k] == ["a" * 50, "don't", "Ab", "3rd", "a😂"]


def test_predicates_against_plain_python(spark):
    emoji = regex.compile(r"\p{Emoji}")
    is_emoji = lambda c: ord(c) > 0x7F and bool(emoji.match(c))
    cat = lambda c, kinds: unicodedata.category(c)[0] in kinds
    spec = {
        "has_number": lambda t: any(c.isdigit() for c in t) and "-" not in t,
        "all_numbers_hyphens": lambda t: all(c.isdigit() or c == "-" for c in t),
        "all_punctuation": lambda t: all(cat(c, "P") for c in t.strip()),
        "single_emoji": lambda t: len(t) == 1 and is_emoji(t),
        "all_emoji": lambda t: all(is_emoji(c) or c == "‍" for c in t),
        "some_emoji": lambda t: any(map(is_emoji, t)),
        "all_punct_space_control": lambda t: all(cat(c, "PZC") for c in t),
        "all_emoji_punct_space_control": lambda t: all(is_emoji(c) or cat(c, "PZC") for c in t),
        "all_alnum_hyphen": lambda t: all(c.isalnum() or c in "-'" for c in t),
        "all_alnum_hyphen_emoji": lambda t: all(c.isalnum() or c in "-'" or is_emoji(c) for c in t),
        "url": lambda t: bool(regex.search(r"http\S+", t)),
        "hashtag": lambda t: t.startswith("#"),
        "phone": lambda t: bool(regex.search(r"\d{3}[-.\s]?\d{4}", t)),
    }
    real = [t for t in TOKENS if t is not None]
    for name, check in spec.items():
        assert _by(spark, lambda c, n=name: tokens.predicates(c)[n], real) == [check(t) for t in real], name


def test_space_tokens_split_at_any_blank(spark):
    assert _by(spark, tokens.space_tokens, ["A b\x1cC　d ", "", None]) == [["a", "b", "c", "d"], [], None]


def test_tweet_tokens(spark):
    assert _by(spark, tokens.tweet_tokens, ["@u see http://x.y/z :) well-known #tag don't 1,250.75!"]) == [["@u", "see", "http://x.y/z", ":)", "well-known", "#tag", "don't", "1,250.75", "!"]]


def test_paragraphs_and_nul(spark):
    df = spark.createDataFrame([("a@@ b <p> <p>c\u0000d",)], "t string")
    got = df.select(F.explode(structure.nul_texts(F.col("t"))).alias("x")).select(F.explode(structure.paragraphs(F.col("x")))).collect()
    assert [r[0] for r in got] == ["a", "b", "c", "d"]


def test_clitics_ids_and_html(spark):
    assert _by(spark, structure.join_clitics, ["do n't it 's a 'dark"]) == ["don't it's a'dark"]
    assert _by(spark, structure.strip_leading_id, ["##12 A b", "alone"]) == [" A b", "alone"]
    assert _by(spark, structure.clean_html, ["a &amp; b\n&lt;c&gt;\td\r &eacute; ", None]) == ["a & b <c> d é", None]


def test_simple_sentences(spark):
    got = _by(spark, structure.simple_sentences, ["Mr. Smith left. He saw J. R. Brown!  “Yes.” End", "", None])
    assert got == [["Mr. Smith left.", "He saw J. R. Brown!", "“Yes.”", "End"], [], None]


def test_sentence_lookup(spark):
    df = spark.createDataFrame([(["a", "b"], n) for n in (0, 1, 2, 3, None)], "s array<string>, n int")
    assert [r[0] for r in df.select(structure.sentence_at(F.col("s"), F.col("n"))).collect()] == [None, "a", "b", None, None]
