"""Where a word lies among the ids of a subword tokenizer, whose file is a parameter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexitide.functions.tokens import space_tokens
from lexitide.operators.contexts import bpe_ids, span_of_either


def bpe_text(path: str) -> Callable[[Column], Column]:
    """A pandas UDF token ids -> text, trimmed and in lower case."""

    @F.pandas_udf(StringType())
    def text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decode = decoder(path)()
        for part in parts:
            yield part.map(lambda ids: None if ids is None else decode(ids))

    return text.asNondeterministic()  # evaluated once, apart from the filter on it


def decoder(path: str) -> Callable[[], Callable]:
    """A loader, run once per Python worker, of a function ids -> trimmed text in lower case."""

    def load() -> Callable:
        from tokenizers import Tokenizer

        known = Tokenizer.from_file(path)
        return lambda ids: known.decode([int(x) for x in ids], skip_special_tokens=False).strip().lower()

    return load


def subword_contexts(contexts: DataFrame, path: str, key: list[str], limit: int = 512) -> DataFrame:
    """(word, key..., sentence, tokens, position): contexts with the ids of their sentence and the places of the word among them.

    The sentence is read with a blank before it. Occurrences are its blank-separated tokens that are the word in lower case; each is
    looked for in its bare form and with a blank before it, whichever comes first, and counts if it lies below ``limit`` and its ids
    read as the word again. The first occurrence that counts gives the row; a context without any gives none. Repeated contexts give one row;
    a context with a null in the word, the key or the sentence gives none. A sentence is tokenised once, however often the word is in it.
    """
    ids = bpe_ids(path).asNondeterministic()  # so the planner evaluates it once a sentence
    rows = contexts.select("word", *key, "sentence").dropna().distinct()
    rows = rows.withColumn("_o", F.array_distinct(F.filter(space_tokens(F.col("sentence"), lower=False), lambda x: F.lower(x) == F.col("word")))).where(F.size("_o") > 0)
    read = rows.withColumn("tokens", ids(F.concat(F.lit(" "), F.col("sentence"))))
    each = read.select("word", *key, "sentence", "tokens", F.posexplode("_o").alias("_k", "_form"))
    forms = each.withColumn("_bare", ids(F.col("_form"))).withColumn("_led", ids(F.concat(F.lit(" "), F.col("_form"))))
    placed = forms.withColumn("position", span_of_either(F.col("tokens"), F.col("_bare"), F.col("_led"), limit)).where("position is not null")
    inside = F.slice("tokens", F.get("position", F.lit(0)) + 1, F.size("position"))
    good = placed.withColumn("_text", bpe_text(path)(inside)).where(F.col("_text") == F.col("word"))
    return good.groupBy("word", *key, "sentence").agg(F.min_by(F.struct("tokens", "position"), "_k").alias("_p")).select("word", *key, "sentence", "_p.tokens", "_p.position")
