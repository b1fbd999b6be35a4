"""Problem 9: the language of every document and of every stretch of it, by word-first backoff.

A known word is scored by its log frequency in each language; an unseen word falls back to the longest character
n-grams that are known, four signs down to one. Sentence scores are then joined into segments by a Viterbi pass in
which a change of language has a price, so a foreign word, name or quotation inside a sentence makes no segment.

The frequencies are learnt from a bounded sample of labelled documents: ``docs_per_language`` documents of each
language, chosen by a hash of their id. Labels are noisy and documents mixed, so a first model labels the sentences
of the sample anew and a second model is counted from those. The model is of the ``top_words`` commonest words and
``top_grams`` commonest n-grams of each order a language, and therefore has a fixed size bound when it is broadcast: these are
parameters of the fit, like the count and length from which a word counts as known (``least_count``, ``longest_word``). All words of
all documents are scored by it, known or not.

A stretch whose words give too little evidence for any language the model knows (``least_evidence`` nats a word; a language sure
of all its words gives about 7) is ``und``, undetermined, with confidence 0: another language, or no language at all.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexitide.llm.sentences import sentence_starts
from lexitide.runtime import materialize, spread

# --- Fixed values: languages and the ways their names are written -------------------------------------------------
LANGUAGES = ["en", "es", "pt", "fr", "it", "de", "nl", "ru", "uk", "tr", "el", "ar", "hi", "ja", "zh", "ko", "th"]
NAMES = {
    "en": "eng english anglais englisch inglés",
    "es": "spa spanish español castellano castilian",
    "pt": "por portuguese português",
    "fr": "fra fre french français",
    "it": "ita italian italiano",
    "de": "deu ger german deutsch",
    "nl": "nld dut dutch nederlands flemish",
    "ru": "rus russian русский",
    "uk": "ukr ukrainian українська",
    "tr": "tur turkish türkçe",
    "el": "ell gre greek ελληνικά",
    "ar": "ara arabic العربية",
    "hi": "hin hindi हिन्दी",
    "ja": "jpn japanese 日本語",
    "zh": "zho chi chinese mandarin 中文 cmn",
    "ko": "kor korean 한국어",
    "th": "tha thai ไทย",
}
# ------------------------------------------------------------------------------------------------------------------

ORDERS = (4, 3, 2, 1)
SWITCH = 6.0  # price of a change of language between two sentences, in nats
OTHER = "und"  # none of the languages
LEAST_EVIDENCE = 0.35  # nats a word
BACKGROUND = 0.01  # share of the all-language frequency mixed into each language's own
WORD = regex.compile(r"[\p{L}\p{M}]+")
SCAN = regex.compile(r"https?://\S+|www\.\S+|[#@]+\w+|&#?\w{1,8};|([\p{L}\p{M}]+)", regex.I)
QUOTING = re.compile(r"[“„«「『\"]")
QUOTED = re.compile(r"“[^“”\n]*”|„[^“”„\n]*[“”]|«[^«»\n]*»|「[^「」\n]*」|『[^『』\n]*』|\"[^\"\n]*\"")
MARKUP = regex.compile(r"<p>|(?<!\S)@(?!\S)")


def label_code(label: Column) -> Column:
    """The two-letter code a label names in any spelling, or null: codes, region variants, ISO codes, names."""
    key = F.regexp_extract(F.lower(F.trim(label)), r"^([^\s_,;()-]+)", 1)
    names = {name: code for code, row in NAMES.items() for name in [code, *row.split()]}
    table = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    return F.try_element_at(table, key)


def readable(text: str) -> str:
    """The text with paragraph and redaction marks blanked, position for position."""
    return MARKUP.sub(lambda m: "\n  " if m[0] == "<p>" else " ", text)


def words_of(text: str, starts: list[int]) -> list[list[str]]:
    """The words of each sentence, as written; what a sentence quotes counts only where too little else is left.

    Links, tags, handles and entities are no words.
    """
    ends = starts[1:] + [len(text)]
    if not QUOTING.search(text):
        return [[w for w in SCAN.findall(text, a, b) if w] for a, b in zip(starts, ends)]
    out = []
    for a, b in zip(starts, ends):
        row = [w for w in SCAN.findall(text, a, b) if w]
        if QUOTING.search(text, a, b):
            outside = [w for w in SCAN.findall(QUOTED.sub(" ", text[a:b])) if w]
            if len(outside) >= 2 or sum(map(len, outside)) >= 6:
                row = outside
        out.append(row)
    return out


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Model:
    """Log frequencies, one row of 17 for each word and n-gram, mixed with a background."""

    def __init__(self, counts: pd.DataFrame, least_evidence: float = LEAST_EVIDENCE):
        """``counts``: lang, n (0 for words), gram, cnt."""
        self.least_evidence = least_evidence
        self.ids: list[dict[str, int]] = [{} for _ in range(5)]
        rows = []
        at = {lang: k for k, lang in enumerate(LANGUAGES)}
        for n in range(5):
            part = counts[counts["n"] == n]
            ids, base = self.ids[n], len(rows)
            for gram in part["gram"].drop_duplicates():
                ids[gram] = base + len(ids)
            table = np.zeros((len(ids), len(LANGUAGES)))
            if len(part):
                table[[ids[g] - base for g in part["gram"]], [at[x] for x in part["lang"]]] = part["cnt"].to_numpy(float)
            sums = table.sum(0, keepdims=True)
            floor = np.median(sums[sums > 0]) if sums.any() else 1  # else few counts would weigh as much as many
            own = table / np.maximum(floor, sums)
            alike = own.mean(1, keepdims=True) if len(ids) else np.zeros((0, 1))
            mixed = np.log((1 - BACKGROUND) * own + BACKGROUND * alike + 1e-12)
            rows.extend(mixed - mixed.mean(1, keepdims=True) if len(ids) else [])
        self.rows = np.array(rows, dtype=np.float32).reshape(-1, len(LANGUAGES))
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.known = np.zeros((1024, len(LANGUAGES)), dtype=np.float32)

    def _score(self, word: str) -> np.ndarray:
        """Known words by their own frequency, others by the longest n-grams of which at least half are known."""
        known = self.ids[0].get(word)
        if known is not None:
            return self.rows[known]
        for n in ORDERS:
            pieces = grams(word, n)
            seen = [k for g in pieces if (k := self.ids[n].get(g)) is not None]
            if seen and 2 * len(seen) >= len(pieces):
                return self.rows[seen].sum(0) / n
        return np.zeros(len(LANGUAGES), dtype=np.float32)

    def _place(self, word: str) -> int:
        """The row of ``known`` that holds a word's score, which is worked out the first time the word is met."""
        place = len(self.memo)
        if place == len(self.known):
            self.known = np.concatenate([self.known, np.zeros_like(self.known)])
        self.known[place] = self._score(word.lower())
        self.memo[word] = place
        return place

    def sentences(self, text: str) -> tuple[list[int], list[list[str]], np.ndarray]:
        """Starts, words and scores (one row each) of the sentences of ``text``."""
        plain = readable(text)
        starts = sentence_starts(plain)
        words = words_of(plain, starts)
        scores = np.zeros((len(starts), len(LANGUAGES)), dtype=np.float32)
        if len(self.memo) > 200_000:
            self._forget()
        memo = self.memo
        flat = [p if (p := memo.get(w)) is not None else self._place(w) for row in words for w in row]
        if flat:
            sizes = np.array([len(row) for row in words])
            full = np.flatnonzero(sizes)
            scores[full] = np.add.reduceat(self.known[flat], np.concatenate([[0], np.cumsum(sizes[full])[:-1]]), axis=0)
        return starts, words, scores

    @staticmethod
    def path(scores: np.ndarray) -> np.ndarray:
        """The best language of each sentence when a change has a price."""
        best = scores.argmax(1)
        if len(best) < 2 or (best == best[0]).all():
            return best
        total, back = scores[0].copy(), np.zeros(scores.shape, dtype=np.int16)
        for k in range(1, len(scores)):
            top = total.argmax()
            moved = total[top] - SWITCH
            back[k] = np.where(total >= moved, np.arange(len(total)), top)
            total = np.maximum(total, moved) + scores[k]
        out = np.empty(len(scores), dtype=np.int64)
        out[-1] = total.argmax()
        for k in range(len(scores) - 1, 0, -1):
            out[k - 1] = back[k][out[k]]
        return out

    def segments(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(start, end, language, confidence) of each run of sentences in one language; [] without words.

        The confidence is the posterior of the language under the mean evidence a word, as if there were at most
        two words, so it doesn't rise to 1 just because a text is long.
        """
        if not text:
            return []
        starts, words, scores = self.sentences(text)
        sized = np.array([len(w) for w in words])
        with_words = np.flatnonzero(sized)
        if not len(with_words):
            return []
        chosen = self.path(scores[with_words])
        runs: list[list[int]] = []
        for k, lang in zip(with_words, chosen):
            if runs and runs[-1][0] == lang:
                runs[-1].append(k)
            else:
                runs.append([lang, k])
        out = []
        for r, (lang, *members) in enumerate(runs):
            begin = starts[members[0]] if r else starts[0]
            end = starts[runs[r + 1][1]] if r + 1 < len(runs) else len(text)
            n_words = sized[members].sum()
            evidence = scores[members].sum(0) / n_words
            if evidence[lang] < self.least_evidence:
                out.append((begin, end, OTHER, 0.0))
                continue
            share = np.exp((evidence - evidence.max()) * min(2, n_words))
            out.append((begin, end, LANGUAGES[lang], float(share[lang] / share.sum())))
        return out


def _count(sample: DataFrame, model: "Model | None", longest_word: int) -> DataFrame:
    """(lang, n, gram, cnt) over the sample, by its labels or, given a model, by the model's sentence languages."""

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, Counter] = {}
        for part in parts:
            for label, text in zip(part["code"], part["text"]):
                if model is None:
                    seen.setdefault(label, Counter()).update(w.lower() for w in words_of(readable(text), [0])[0])
                    continue
                _, words, scores = model.sentences(text)
                for lang, row in zip(model.path(scores) if len(words) else [], words):
                    seen.setdefault(LANGUAGES[lang], Counter()).update(w.lower() for w in row)
        for lang, words in seen.items():
            counts: Counter = Counter()
            for word, times in words.items():
                if len(word) <= longest_word:
                    counts[0, word] += times
                for order in ORDERS:
                    for gram in grams(word, order):
                        counts[order, gram] += times
            yield pd.DataFrame([(lang, *k, times) for k, times in counts.items()], columns=["lang", "n", "gram", "cnt"])

    return sample.mapInPandas(partial, "lang string, n int, gram string, cnt long").groupBy("lang", "n", "gram").agg(F.sum("cnt").alias("cnt"))


def _bounded(counts: DataFrame, top_words: int, top_grams: int, least_count: int) -> pd.DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("cnt"), "gram"))
    kept = counts.where(F.col("cnt") >= least_count).withColumn("_r", rank).where(F.col("_r") <= F.when(F.col("n") == 0, top_words).otherwise(top_grams))
    return kept.drop("_r").toPandas()


def train(
    df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", docs_per_language: int = 300, top_words: int = 6000, top_grams: int = 4000, least_evidence: float = LEAST_EVIDENCE,
    least_count: int = 2, longest_word: int = 20,
) -> Model:
    """A model from a bounded, hash-chosen sample of the labelled rows of ``df``. Without labelled rows it is empty, and all is undetermined.

    A word seen fewer than ``least_count`` times in the sample, or longer than ``longest_word`` signs (a run without blanks, in some
    scripts), isn't taken for a known word: it says too little of its language by itself, and is scored by its n-grams.
    """
    coded = df.select(F.col(key).alias("k"), F.col(text).alias("text"), label_code(F.col(label)).alias("code")).where("code is not null and text is not null")
    sizes = {r["code"]: r["count"] for r in coded.groupBy("code").count().collect()}  # at most one row a language
    if not sizes:
        return Model(pd.DataFrame({"lang": [], "n": [], "gram": [], "cnt": []}), least_evidence)
    rates = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, docs_per_language / n))])
    lot = F.pmod(F.xxhash64(F.col("k"), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = materialize(coded.where(lot < F.element_at(rates, F.col("code"))), "langsample")
    sample = spread(sample)
    fit = lambda model: _bounded(_count(sample, model, longest_word), top_words, top_grams, least_count)
    return Model(fit(Model(fit(None))), least_evidence)


def main_language(df: DataFrame, model: Model) -> Callable[[Column], Column]:
    """A function of a text column: the language of the longest stretch of each text in one language; null for a text without words."""
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(StringType())
    def longest(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            sizes: Counter = Counter()
            for begin, end, lang, _ in held.value.segments(text):
                sizes[lang] += end - begin
            out.append(max(sorted(sizes), key=sizes.get, default=None))
        return pd.Series(out, dtype=object)

    return longest.asNondeterministic()  # so the planner evaluates it once


SEGMENT = "doc_id long, label string, n_segments int, segment_no int, start_pos int, end_pos int, lang string, confidence double"


def language_segments(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", model: Model | None = None, **bounds: int) -> DataFrame:
    """One row per segment of each document: its place, language and confidence, beside the label as a code.

    ``end_pos`` is exclusive; positions are code points. A document without words (null, empty, digits, links only)
    gives one row with segment 0, no language and confidence 0; a stretch in none of the languages has ``und``. Repeated rows stay repeated; other columns of ``df``
    are not read.
    """
    model = model or train(df, key, text, label, **bounds)
    held = df.sparkSession.sparkContext.broadcast(model)

    def segment(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = held.value
        for part in parts:
            rows = []
            for k, body, code in zip(part["k"], part["body"], part["code"]):
                found = scorer.segments(body)
                rows += [(k, code, len(found), i, *s) for i, s in enumerate(found, 1)] or [(k, code, 0, 0, 0, len(body or ""), None, 0.0)]
            yield pd.DataFrame(rows, columns=["doc_id", "label", "n_segments", "segment_no", "start_pos", "end_pos", "lang", "confidence"])

    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("body"), label_code(F.col(label)).alias("code"))
    return spread(rows).mapInPandas(segment, SEGMENT)
