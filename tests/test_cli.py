"""The command line from raw files to results, both domains."""

import json

import numpy as np
import pytest

from lexitide import cli
from lexitide.operators import subwords
from lexitide.plans.io_queries import TOKENIZER

WORDS = ["alpha", "bravo", "delta", "gamma", "omega", "sigma", "don't"]


@pytest.fixture
def corpus(tmp_path):
    (tmp_path / "old").mkdir()
    (tmp_path / "new").mkdir()
    text = "Alpha bravo sat. I do n't delta @ omega here. <p> Gamma bravo alpha. Nothing else.\0Sigma alpha bravo."
    (tmp_path / "old" / "a.txt").write_bytes(f"one\ntwo\n{text}\n".encode())
    (tmp_path / "old" / "bad.txt").write_bytes(b"one\ntwo\n")
    (tmp_path / "new" / "g.txt").write_bytes(b"header\n##11 Alpha beats bravo. Then omega.\n##12 sigma @ gamma <p> delta\n")
    (tmp_path / "words" / "all").mkdir(parents=True)
    (tmp_path / "words" / "strict").mkdir()
    (tmp_path / "words" / "all" / "w.txt").write_text("alpha\ndon't\n")
    (tmp_path / "words" / "strict" / "w.txt").write_text("alpha\n")
    rows = [{"id": 1, "full_text": "Alpha is new. So bravo &amp; alpha"}, {"id": "2", "text": "delta #tag Alpha"}]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, rows)))
    return lambda name: str(tmp_path / name)


def test_published_domain(spark, corpus):
    p = corpus
    run = lambda *args: cli.main(list(map(str, args)))
    run("tokenize", "published_writing", p("old"), "1810s", p("tok_old"))
    run("tokenize", "published_writing", p("new"), "fiction", p("tok_new"))
    old = {(r.sentence_id, " ".join(r.tokens)) for r in spark.read.parquet(p("tok_old")).collect()}
    assert (2, "i do n't delta") in old and (1, "sigma alpha bravo.") in old and len(old) == 6
    both = spark.read.parquet(p("tok_old")).unionByName(spark.read.parquet(p("tok_new")))
    both.write.parquet(p("tok"))
    run("counts", "published_writing", p("tok"), p("counts"))
    counts = {(r.timestep, r.word): r.n for r in spark.read.parquet(p("counts")).collect()}
    assert counts["modern", "alpha"] == 1 and counts["1810s", "bravo"] == 2 and counts["1810s", "bravo."] == 1 and {s for s, _ in counts} == {"1810s", "modern"}
    run("matrix", "published_writing", p("counts"), p("matrix"))
    assert spark.read.csv(p("matrix"), header=True).where("word = 'alpha'").first()["modern"] == "1"
    run("contexts", "published_writing", "historical", p("old"), p("words"), p("ctx_old"))
    got = {(r.word, r.sentence_id, r.sentence) for r in spark.read.parquet(p("ctx_old")).collect()}
    assert ("alpha", 1, "Alpha bravo sat.") in got and ("alpha", 1, "Sigma alpha bravo.") in got and len(got) == 3
    assert ("don't", 2, "I don't delta") in got  # clitics are joined; its paragraph is read as it holds ``alpha``
    run("contexts", "published_writing", "modern", p("new"), p("words"), p("ctx_new"))
    assert [(r.word, r.sentence) for r in spark.read.parquet(p("ctx_new")).collect()] == [("alpha", "Alpha beats bravo.")]
    run("encode", p("ctx_old"), p("vec"))
    run("average", p("vec"), p("z"))
    assert spark.read.parquet(p("z")).count() == 2 and len(spark.read.parquet(p("z")).first().vector) == 64
    rng = np.random.default_rng(2)
    vectors = spark.createDataFrame([(w, rng.standard_normal(4).tolist()) for w in WORDS], "word string, vector array<double>")
    vectors.write.parquet(p("v"))
    spark.createDataFrame([("alpha", "x"), ("alpha", "bravo")], "neologism string, control string").coalesce(1).write.csv(p("pairs"), header=True)
    run("main", "published_writing", p("counts"), p("words"), p("v"), p("v"), p("out"), "--pairs", p("pairs"), "--contextual", "--strict")
    result = spark.read.csv(p("out/results"), header=True)
    assert len(result.columns) == 29 and {r.Word for r in result.collect()} == {"alpha", "bravo"} and "GrowthSlopeAtRadius0.350" in result.columns
    with pytest.raises(SystemExit):
        run("main", "published_writing", p("counts"), p("words"), p("v"), p("v"), p("out"), "--contextual")


def test_twitter_domain(spark, corpus):
    p = corpus
    cli.main(["tokenize", "twitter", p("t.jsonl"), "2012", p("tok")])
    cli.main(["counts", "twitter", p("tok"), p("counts")])
    assert {(r.timestep, r.word, r.n) for r in spark.read.parquet(p("counts")).where("word = 'alpha'").collect()} == {("2012", "alpha", 3)}
    cli.main(["contexts", "twitter", "modern", p("t.jsonl"), p("words"), p("ctx")])
    assert {(r.doc_id, r.sentence_id, r.sentence) for r in spark.read.parquet(p("ctx")).collect()} == {("1", 1, "Alpha is new."), ("1", 2, "So bravo & alpha"), ("2", 1, "delta #tag Alpha")}
    series = [(f"{w}", str(y), 200 * (y - 2010)) for w in ("alpha", "bravo") for y in range(2011, 2022)]
    spark.createDataFrame(series, "word string, timestep string, n bigint").write.parquet(p("c"))
    cli.main(["tag-sample", p("c"), p("t.jsonl"), p("sample")])
    assert {tuple(r) for r in spark.read.parquet(p("sample")).collect()} == {("alpha", 1), ("alpha", 2), ("bravo", 1)}
    cli.main(["tag-counts", p("sample"), p("t.jsonl"), p("tags")])
    cli.main(["emerging", p("c"), p("found"), "--tags", p("tags")])
    assert [r.value for r in spark.read.text(p("found")).collect()] == ["bravo"]  # alpha is mostly written as a name


@pytest.mark.skipif(not __import__("os").path.exists(TOKENIZER), reason="no public tokenizer")
def test_subword_spans_against_a_loop(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    ids = lambda x: t.encode(x, add_special_tokens=False).ids
    rows = [("hello", 1, "Hello there hello"), ("hello", 2, "say hello, hello"), ("naïve", 3, "a Naïve view"), ("gone", 4, "not here"), ("end", 5, "x " * 600 + "end"), (None, 6, "a"), ("a", None, "a"), ("a", 7, None), ("the", 8, "bathe the")]
    rows += rows[:2]
    df = spark.createDataFrame(rows, "word string, k int, sentence string")
    want = {}
    for word, k, sentence in rows:
        if None in (word, k, sentence):
            continue
        whole = ids(" " + sentence)
        for form in dict.fromkeys(x for x in sentence.split() if x.lower() == word):
            two = [ids(form), ids(" " + form)]
            at = next(((i, len(n)) for i in range(len(whole)) for n in two if whole[i : i + len(n)] == n), None)
            if at and sum(at) <= 512 and t.decode(whole[at[0] : sum(at)]).strip().lower() == word:
                want[word, k] = list(range(at[0], sum(at)))
                break
    got = {(r.word, r.k): r.position for r in subwords.subword_contexts(df, TOKENIZER, ["k"]).collect()}
    assert got == want and ("hello", 1) in got and ("end", 5) not in got
    assert subwords.subword_contexts(df.limit(0), TOKENIZER, ["k"]).count() == 0
