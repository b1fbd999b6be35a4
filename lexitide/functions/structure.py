"""Text structure: fragments, paragraphs, sentences and clean-up, as Column expressions.

The sentence splitter here is one documented regular expression that runs in the JVM and that an SQL engine can repeat. A
fuller splitter for many languages is among the training-data operators; any function of (Column) -> array Column fits in its place.
"""

from __future__ import annotations

import html
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexitide.functions.tokens import trimmed

# --- Fixed values: abbreviations after which a sentence goes on, and clitics written apart ------------------------
ABBREVIATIONS = "Mr|Mrs|Ms|Dr|Prof|Gen|Lt|Col|St|Sr|Sra|No|Fig|vs|cf|approx|i\\.e|e\\.g|Mme|Hr|Fr|Nr|p"
CLITICS = ("n't", "'s", "’s", "'re", "'ve", "'d", "'ll", "'m")
# ------------------------------------------------------------------------------------------------------------------
HOLD, CUT = "\x02", "\x01"
PROTECT = rf"(^|[^\p{{L}}\p{{N}}_])({ABBREVIATIONS}|[A-Z])\. "
BOUNDARY = r"([.!?…]+[\"'”’»)]*)\s+"


def parts(c: Column, mark: str) -> Column:
    """Non-empty trimmed parts between literal marks."""
    return F.filter(F.transform(F.split(c, mark), trimmed), lambda x: x != "")


def nul_texts(c: Column) -> Column:
    return F.split(c, "\u0000")


def paragraphs(c: Column) -> Column:
    """Paragraphs of a text: cut at '@' into fragments, these at '<p>'."""
    return F.flatten(F.transform(parts(c, "@"), lambda x: parts(x, "<p>")))


def strip_leading_id(c: Column) -> Column:
    """Without the id token at the start of a genre line; a line without a blank is left alone."""
    return F.regexp_replace(c, r"^[^ ]+(?= )", "")


def join_clitics(c: Column) -> Column:
    """Clitics written apart (``do n't``) joined to the word before them."""
    return F.regexp_replace(c, f" ({'|'.join(CLITICS)})", "$1")


def simple_sentences(c: Column) -> Column:
    """Sentences by one regular expression: an end mark and a blank, but not after an abbreviation or initial."""
    held = F.regexp_replace(F.regexp_replace(c, PROTECT, f"$1$2.{HOLD}"), PROTECT, f"$1$2.{HOLD}")  # twice, as neighbours overlap
    cut = F.regexp_replace(held, BOUNDARY, f"$1{CUT}")
    return F.filter(F.transform(F.split(F.translate(cut, HOLD, " "), CUT), trimmed), lambda x: x != "")


@F.pandas_udf(StringType())
def _unescape(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in rows:
        yield part.map(lambda x: html.unescape(x) if isinstance(x, str) and "&" in x else x)


def clean_html(c: Column) -> Column:
    """Entities decoded, line breaks and tabs as blanks, carriage returns and stray apostrophe entities dropped, trimmed."""
    plain = F.regexp_replace(_unescape(F.replace(c, F.lit("&apos;"), F.lit(""))), "\r", "")
    return trimmed(F.translate(plain, "\n\t", "  "))


def numbered(sentences: Column) -> Column:
    """(sentence_no from 1, sentence) structs."""
    return F.transform(sentences, lambda x, i: F.struct((i + 1).alias("sentence_no"), x.alias("sentence")))


def sentence_at(sentences: Column, number: Column) -> Column:
    """The sentence of a 1-based number, null beyond either end."""
    return F.when(number >= 1, F.get(sentences, number - 1))


Splitter = Callable[[Column], Column]
