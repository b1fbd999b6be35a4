"""The main analysis as one plan: align, match, neighbourhoods, growth, summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.config import Domain, Settings
from lexitide.functions.structure import clean_html, join_clitics, paragraphs, simple_sentences, strip_leading_id
from lexitide.functions.tokens import control_token, keep_token, space_tokens, tweet_tokens
from lexitide.operators import alignment, contexts, counts, emergence, matching, similarity, vocabularies
from lexitide.runtime import materialize
from lexitide.sources import readers


@dataclass
class Analysis:
    pairs: DataFrame
    statistics: DataFrame
    summary: DataFrame


def tweet_sentences(messages: DataFrame, timestep: str, shortest: int = Settings.token_min, longest: int = Settings.token_max) -> DataFrame:
    """Sentence tokens of messages (tweet_id, text): numbered over all sentences, those without a token left dropped."""
    rows = messages.select(F.lit(timestep).alias("timestep"), F.col("tweet_id").cast("string").alias("doc_id"), F.posexplode(simple_sentences(F.col("text"))).alias("k", "s"))
    kept = F.transform(F.filter(tweet_tokens(F.col("s")), lambda x: keep_token(x, shortest, longest)), F.lower)
    return rows.select("timestep", "doc_id", (F.col("k") + 1).alias("sentence_id"), kept.alias("tokens")).where(F.size("tokens") > 0)


def published_texts(spark: SparkSession, path: str, decades: bool) -> DataFrame:
    """(path, doc_id, text) of decade or genre files; texts count on through a file."""
    if decades:
        return readers.decade_texts(spark, path).select("path", F.format_string("%s:%d", F.col("path"), F.col("text_no")).alias("doc_id"), "text")
    texts = readers.genre_texts(spark, path, strip_id=False)
    return texts.select("path", F.format_string("%s:%d:%d", F.col("path"), F.col("line_no"), F.col("text_no")).alias("doc_id"), "text")


def published_sentences(texts: DataFrame, timestep: str) -> DataFrame:
    """Sentence tokens of published texts: fragments, paragraphs, sentences; blank-separated tokens in lower case."""
    sentences = F.flatten(F.transform(paragraphs(F.col("text")), simple_sentences))
    rows = texts.select("doc_id", F.posexplode(sentences).alias("k", "s"))
    return rows.select(F.lit(timestep).alias("timestep"), "doc_id", (F.col("k") + 1).alias("sentence_id"), space_tokens(F.col("s")).alias("tokens"))


def domain_counts(token_rows: DataFrame, domain: Domain) -> DataFrame:
    """(timestep, word, n) of sentence tokens; steps that are none of the domain's, such as genres, are its modern one where it has one."""
    step = F.col("timestep").cast("string")  # a folder name that is a number is read as one
    if len(domain.modern) == 1:
        step = counts.merge_steps(step, ~step.isin(list(domain.historical)), domain.modern[0])
    return counts.count_tokens(token_rows.select(step.alias("timestep"), "tokens"), F.col("tokens"), "timestep")


def context_rows(texts: DataFrame, words: DataFrame, n: int, settings: Settings, published: bool, decades: bool = False) -> DataFrame:
    """(word, doc_id, sentence_id, sentence): at most ``n`` sampled sentences of each word.

    Published texts: paragraphs without any target word, as written, are passed over; in decades clitics are joined then; sentences that hold
    a word are numbered from 1 in each text. Messages: sentences are numbered as they come, and looked up by their number.
    """
    if published:
        parts = texts.select("doc_id", F.posexplode(paragraphs(F.col("text") if decades else strip_leading_id(F.col("text")))).alias("p", "paragraph")).withColumn("key", F.concat_ws(":", "doc_id", "p"))
        hit = contexts.texts_with_any(parts, space_tokens(F.col("paragraph")), words, "key")
        body = join_clitics(F.col("paragraph")) if decades else F.col("paragraph")
        rows = hit.select("doc_id", F.posexplode(simple_sentences(body)).alias("k", "sentence"), "p").select("doc_id", F.format_string("%09d:%09d", "p", "k").alias("at"), "sentence")
        found = contexts.occurrences(rows, space_tokens(F.col("sentence")), words, "doc_id", "at", "sentence")
        numbers = contexts.kept_numbers(found.select("doc_id", "at").distinct(), "doc_id", "at").withColumnRenamed("kept_no", "sentence_id")
        found = found.join(numbers, ["doc_id", "at"])
    else:
        rows = texts.select(F.col("tweet_id").cast("string").alias("doc_id"), F.posexplode(simple_sentences(F.col("text"))).alias("k", "sentence")).withColumn("sentence_id", F.col("k") + 1)
        found = contexts.occurrences(rows, tweet_tokens(F.lower("sentence")), words, "doc_id", "sentence_id", "sentence")
    sampled = contexts.sample_per_word(found, n, ["doc_id", "sentence_id"], settings.seed)
    sentence = found.select("word", "doc_id", "sentence_id", "sentence").distinct().join(sampled, ["word", "doc_id", "sentence_id"], "left_semi")
    return sentence if published else sentence.withColumn("sentence", clean_html(F.col("sentence")))


def tag_sample(messages: DataFrame, candidates: DataFrame, settings: Settings) -> DataFrame:
    """(word, tweet_id): at most ``tag_sample`` messages of every candidate word."""
    seen = contexts.occurrences(messages, tweet_tokens(F.lower("text")), candidates, "tweet_id")
    return contexts.sample_per_word(seen, settings.tag_sample, ["tweet_id"], settings.seed)


def sample_tags(messages: DataFrame, sample: DataFrame) -> DataFrame:
    """(word, tag, n, first_seen) of the sampled words in their sampled messages; each message is tagged once."""
    some = messages.join(sample.select("tweet_id").distinct(), "tweet_id", "left_semi")
    rows = some.select("tweet_id", F.posexplode(tweet_tokens(F.col("text"))).alias("pos", "token"))
    tagged = rows.select(F.lower("token").alias("word"), emergence.shape_tag(F.col("token")).alias("tag"), F.format_string("%022d:%06d", F.col("tweet_id"), F.col("pos")).alias("seen"))
    return emergence.tag_counts(tagged.join(sample.select("word").distinct(), "word", "left_semi"))


def final_words(count_rows: DataFrame, domain: Domain, tags: DataFrame | None = None) -> DataFrame:
    """Emerging words, the commonest first, without those the tag and series filters drop."""
    s = domain.settings
    found = emergence.emerging_words(count_rows, s)
    if tags is not None:
        found = emergence.keep_unflagged(found, emergence.tag_mode_filter(tags, s))
    dropped = emergence.sparse_series_filter(count_rows, domain.steps, s).where(~F.col("kept")).select("word")
    return found.join(dropped, "word", "left_anti").orderBy(F.desc("total"), "word")


def find_pairs(domain: Domain, count_rows: DataFrame, words: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Matched (neologism, control): targets by their new vectors and ranks, controls from the old vocabulary."""
    s = domain.settings
    is_old = F.col("timestep").isin(list(domain.historical))
    rank = lambda rows: counts.relative_rank(counts.row_totals(rows).withColumnRenamed("total", "n")).select("word", "rel_rank")
    targets = vocabularies.only_words(new.select("word", "vector"), words).join(rank(count_rows.where(~is_old)), "word")
    controls = vocabularies.without_words(old.select("word", "vector"), words).where(control_token(F.col("word"))).join(rank(count_rows.where(is_old)), "word")
    return matching.maximum_matching(similarity.candidate_edges(targets, controls, s.match_length, s.match_rank, s.match_cosine))


def analyse(domain: Domain, count_rows: DataFrame, words: DataFrame, old: DataFrame, new: DataFrame, pairs: DataFrame | None = None, contextual: bool = False) -> Analysis:
    """``count_rows`` (word, timestep, n); ``old`` and ``new`` (word, vector); ``words`` the emerging words.

    Static vectors are first turned into the old space; contextual ones share a space and come with pairs. Neighbourhoods are taken in the old
    vocabulary: an emerging word asks with its new vector, a control with its old one.
    """
    s = domain.settings
    old, new = old.select("word", "vector"), new.select("word", "vector")
    turned = new if contextual else alignment.align(old, new)
    pairs = materialize(find_pairs(domain, count_rows, words, old, turned) if pairs is None else pairs.select("neologism", "control"), "pairs")
    asked = turned.join(pairs.select(F.col("neologism").alias("word")), "word", "left_semi").unionByName(old.join(pairs.select(F.col("control").alias("word")), "word", "left_semi"), allowMissingColumns=True)
    asked = materialize(asked, "asked")
    near = materialize(similarity.radius_neighbours(asked, old, min(s.min_cosines)), "near")
    known = count_rows.where(F.col("timestep").isin(list(domain.historical)))
    step = F.array_position(F.array(*[F.lit(x) for x in domain.historical]), F.col("timestep")).cast("int")
    totals = known.groupBy(step.alias("step_idx")).agg(F.sum("n").alias("total"))
    grown = similarity.growth(near, known.select("word", step.alias("step_idx"), "n"), totals, min_cosines=s.min_cosines)
    stats = similarity.pair_statistics(pairs, similarity.densities(asked, near, min_cosines=s.min_cosines), grown)
    return Analysis(pairs, stats, similarity.group_summary(stats))
