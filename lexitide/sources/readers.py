"""Readers of the corpus formats; every schema is explicit."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide import schemas
from lexitide.functions.structure import nul_texts, paragraphs, strip_leading_id
from lexitide.operators.deliveries import number_id
from lexitide.operators.vocabularies import loaded_pairs


def _whole_files(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(path, lines): a final line break adds no line."""
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.input_file_name().alias("path"), F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n").alias("lines"))


def decade_texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(path, text_no, text) of decade files: only files of exactly three lines, whose third holds texts between NULs."""
    valid = _whole_files(spark, path, pattern).where(F.size("lines") == 3)
    return valid.select("path", F.posexplode(nul_texts(F.get("lines", F.lit(2)))).alias("text_no", "text"))


def _body_lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, line_no, line) without each file's first line; ``line_no`` rises through a file, by bytes before the split and lines in it.

    Files are read in splits, so a large one is many tasks' work. Only the split that starts a file holds its header.
    """
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path)
    placed = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = None, 0
        for batch in batches:
            numbers, keep = [], []
            for at in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                split, seen = at, (seen + 1 if at == split else 0)
                numbers.append(at[1] + seen)
                keep.append(at[1] + seen > 0)
            made = pa.RecordBatch.from_arrays([batch.column("path"), pa.array(numbers, pa.int64()), batch.column("line")], ["path", "line_no", "line"])
            yield made.filter(pa.array(keep, pa.bool_()))

    return placed.mapInArrow(number, "path string, line_no bigint, line string")


def genre_texts(spark: SparkSession, path: str, pattern: str = "*.txt", strip_id: bool = True) -> DataFrame:
    """(path, line_no, text_no, text) of genre files: the header line dropped, each line's id token stripped, texts between NULs."""
    lines = _body_lines(spark, path, pattern)
    body = strip_leading_id(F.col("line")) if strip_id else F.col("line")
    return lines.select("path", "line_no", F.posexplode(nul_texts(body)).alias("text_no", "text"))


def text_paragraphs(texts: DataFrame, *by: str) -> DataFrame:
    return texts.select(*by, F.posexplode(paragraphs(F.col("text"))).alias("paragraph_no", "paragraph"))


def tweets(spark: SparkSession, path: str) -> DataFrame:
    """(tweet_id, text) of JSON lines: ``full_text`` if there, else ``text``; broken lines and ids that are no number are dropped.

    Files are split by Spark's text source, so every line is read exactly once whatever its bytes.
    """
    rows = spark.read.schema(schemas.TWEET).json(path)
    return rows.select(number_id(F.col("id")).alias("tweet_id"), F.coalesce("full_text", "text").alias("text")).where("tweet_id is not null and text is not null")


def token_rows(spark: SparkSession, path: str) -> DataFrame:
    """Tokenised sentences from tab-separated files of exactly three columns."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), "\t").alias("c")).where(F.size("c") == 3)
    return lines.select(F.col("c")[0].alias("doc_id"), F.col("c")[1].try_cast("int").alias("sentence_id"), F.filter(F.split(F.col("c")[2], r"\s+"), lambda x: x != "").alias("tokens"))


def count_matrix(spark: SparkSession, path: str, steps: Sequence[str], compat_na: bool = False) -> DataFrame:
    """A wide count file; words that read like a missing value stay words unless ``compat_na``."""
    schema = "word string, " + ", ".join(f"`{s}` double" for s in steps)
    rows = spark.read.csv(path, header=True, schema=schema, nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return rows.where(~F.col("word").isin("null", "nan", "NA", "NaN", "None")) if compat_na else rows


def word_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''")


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """(neologism, control) of a pair file, read as a mapping: of several rows of an emerging word the last counts."""
    rows = spark.read.csv(path, header=True, schema=schemas.PAIRS)
    line = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return loaded_pairs(rows.select("neologism", "control", line.alias("line_no")).where("neologism is not null"))


def sampled_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schemas.SAMPLED_IDS)


def contexts(spark: SparkSession, path: str) -> DataFrame:
    """Context rows with a header line; rows with a missing field are dropped; positions become an array."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="", schema="word string, position string, doc_id string, sentence_id int, sentence string").na.drop()
    return rows.withColumn("position", F.from_json("position", "array<int>"))


def tag_counts(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("word string, pos_counts_in_sample map<string, bigint>").json(path)
    return rows.select("word", F.posexplode(F.map_entries("pos_counts_in_sample")).alias("first_seen", "e")).select("word", F.col("e.key").alias("tag"), F.col("e.value").alias("n"), "first_seen")


def results(spark: SparkSession, path: str) -> DataFrame:
    """A result file; ``NaN`` is read as null."""
    rows = spark.read.csv(path, header=True, nullValue="NaN")
    return rows.select("Word", F.col("IsNeologism").cast("int").alias("IsNeologism"), *[F.col(f"`{c}`").cast("double").alias(c) for c in rows.columns[2:]])


def vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def split_sentences(token_table: DataFrame, steps: Sequence[str]) -> DataFrame:
    """The sentences of one split: with files partitioned by step, only these partitions are read."""
    return token_table.where(F.col("timestep").isin(list(steps)))
