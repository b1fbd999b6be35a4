"""Command line: the pipeline's stages on files. DOMAIN is twitter or published_writing; tables are Parquet unless named otherwise.

    python -m lexitide.cli tokenize DOMAIN TEXTS STEP OUT          messages (JSON lines); decade or genre files
    python -m lexitide.cli counts DOMAIN TOKENS OUT                counts a step; genres count as ``modern``
    python -m lexitide.cli matrix DOMAIN COUNTS OUT                the wide count file (CSV)
    python -m lexitide.cli tag-sample COUNTS MESSAGES OUT          at most 100 messages of every candidate word
    python -m lexitide.cli tag-counts SAMPLE MESSAGES OUT          tags of the sampled words (JSON)
    python -m lexitide.cli emerging COUNTS OUT [--tags TAGS_JSON] [--domain DOMAIN]
    python -m lexitide.cli train TOKENS OUT [--domain DOMAIN --split historical|modern] [--embed-dim 300] [--vocab-size N]
    python -m lexitide.cli project BASE OTHER OUT                  OTHER turned into BASE's space
    python -m lexitide.cli contexts DOMAIN SPLIT TEXTS WORDS OUT [--tokenizer FILE] [--step STEP]
    python -m lexitide.cli encode CONTEXTS OUT [--tokenizer FILE]
    python -m lexitide.cli average VECTORS OUT
    python -m lexitide.cli main DOMAIN COUNTS WORDS VECTORS_OLD VECTORS_NEW OUT [--pairs PAIRS_CSV] [--contextual] [--strict]

With ``--strict`` WORDS is a folder that holds the lists ``all`` and ``strict``, and the latter is used (else ``all``, where there is one).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide import pipeline
from lexitide.config import DOMAINS
from lexitide.functions.tokens import space_tokens
from lexitide.operators import alignment, contexts, counts, emergence, subwords, summary, zscore
from lexitide.runtime import build_session, has_path
from lexitide.sources import readers, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexitide", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, **options) -> None:
        c = sub.add_parser(name)
        for one in positional:
            c.add_argument(one, **({"choices": sorted(DOMAINS)} if one == "domain" else {"choices": ("historical", "modern")} if one == "split" else {}))
        for flag, how in options.items():
            c.add_argument("--" + flag.replace("_", "-"), **how)

    text = {"default": None}
    domain = {"choices": sorted(DOMAINS), "default": None}
    command("tokenize", "domain", "texts", "step", "out")
    command("counts", "domain", "tokens", "out")
    command("matrix", "domain", "counts", "out")
    command("tag-sample", "counts", "messages", "out")
    command("tag-counts", "sample", "messages", "out")
    command("emerging", "counts", "out", tags=text, domain={**domain, "default": "twitter"})
    command("train", "tokens", "out", domain=domain, split={"choices": ("historical", "modern")}, embed_dim={"type": int, "default": 300}, vocab_size={"type": int}, save=text)
    command("project", "base", "other", "out")
    command("contexts", "domain", "split", "texts", "words", "out", tokenizer=text, step=text)
    command("encode", "contexts", "out", tokenizer=text)
    command("average", "vectors", "out")
    flag = {"action": "store_true"}
    command("main", "domain", "counts", "words", "vectors_old", "vectors_new", "out", pairs=text, contextual={**flag, "help": "vectors share one space already; pairs must be given"}, strict=flag)
    return p


def _words(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    if strict or has_path(spark, f"{path}/all"):
        path = f"{path}/{'strict' if strict else 'all'}"
    return readers.word_list(spark, path)


def _contexts(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    domain = DOMAINS[args.domain]
    s = domain.settings
    texts = readers.tweets(spark, args.texts) if args.domain == "twitter" else pipeline.published_texts(spark, args.texts, args.split == "historical")
    rows = pipeline.context_rows(texts, _words(spark, args.words), s.contexts_historical if args.split == "historical" else s.contexts_modern, s, published=args.domain != "twitter", decades=args.split == "historical")
    if args.tokenizer:
        return subwords.subword_contexts(rows, args.tokenizer, ["doc_id", "sentence_id"], s.span_limit)
    placed = rows.withColumn("tokens", space_tokens(F.col("sentence")))
    return placed.withColumn("position", contexts.span(F.col("tokens"), space_tokens(F.col("word")), s.span_limit)).where("position is not null")


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = build_session("lexitide")
    parquet = spark.read.parquet
    if args.command == "tokenize":
        if args.domain == "twitter":
            rows = pipeline.tweet_sentences(readers.tweets(spark, args.texts), args.step)
        else:
            old = args.step in DOMAINS[args.domain].historical
            rows = pipeline.published_sentences(pipeline.published_texts(spark, args.texts, old), args.step)
        sinks.token_table(rows, args.out)
    elif args.command == "counts":
        sinks.vectors(pipeline.domain_counts(parquet(args.tokens), DOMAINS[args.domain]), args.out)
    elif args.command == "matrix":
        sinks.count_matrix(counts.count_matrix(parquet(args.counts), DOMAINS[args.domain].steps, prefix=""), args.out)
    elif args.command == "tag-sample":
        candidates = emergence.emerging_words(parquet(args.counts), DOMAINS["twitter"].settings)
        sinks.vectors(pipeline.tag_sample(readers.tweets(spark, args.messages), candidates, DOMAINS["twitter"].settings), args.out)
    elif args.command == "tag-counts":
        sinks.tag_counts(pipeline.sample_tags(readers.tweets(spark, args.messages), parquet(args.sample)), args.out)
    elif args.command == "emerging":
        found = pipeline.final_words(parquet(args.counts), DOMAINS[args.domain], readers.tag_counts(spark, args.tags) if args.tags else None)
        sinks.word_list(found, args.out)
    elif args.command == "train":
        rows = parquet(args.tokens)
        if args.split:
            domain = DOMAINS[args.domain or "twitter"]
            rows = readers.split_sentences(rows, domain.historical) if args.split == "historical" else rows.where(~F.col("timestep").isin(list(domain.historical)))
        sinks.vectors(alignment.train_vectors(rows, args.embed_dim, max_vocabulary=args.vocab_size, save=args.save), args.out)
    elif args.command == "project":
        sinks.vectors(alignment.align(parquet(args.base), parquet(args.other)), args.out)
    elif args.command == "contexts":
        sinks.contexts(_contexts(spark, args), args.out)
    elif args.command == "encode":
        rows = parquet(args.contexts)
        if "tokens" not in rows.columns:
            rows = rows.withColumn("tokens", space_tokens(F.col("sentence")))
        sinks.vectors(zscore.encode_contexts(rows, decoder=subwords.decoder(args.tokenizer) if args.tokenizer else None), args.out)
    elif args.command == "average":
        sinks.vectors(zscore.zscored_means(parquet(args.vectors)), args.out)
    else:
        if args.contextual and not args.pairs:
            raise SystemExit("contextual vectors need --pairs")
        given = readers.pairs(spark, args.pairs) if args.pairs else None
        result = pipeline.analyse(DOMAINS[args.domain], parquet(args.counts), _words(spark, args.words, args.strict), parquet(args.vectors_old), parquet(args.vectors_new), given, args.contextual)
        sinks.results(result.statistics, f"{args.out}/results")
        sinks.pairs(result.pairs, f"{args.out}/pairs")
        result.summary.coalesce(1).write.mode("overwrite").csv(f"{args.out}/summary", header=True, nullValue="NaN")
        summary.bootstrap_intervals(summary.long_form(result.statistics)).coalesce(1).write.mode("overwrite").csv(f"{args.out}/bars", header=True)


if __name__ == "__main__":
    main()
