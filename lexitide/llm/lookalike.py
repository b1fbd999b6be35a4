"""Problem 3: one form for text that looks the same but differs in its characters.

A *compiled longest-match transducer* reads a text once, grapheme cluster by grapheme cluster. Inside a
cluster (canonically decomposed, with an end sign) the longest key of a trie wins and its image is emitted; a sign
that no key starts with stays. All rules are keys of that one trie, compiled before the first text is read: a small,
plain table of look-alike signs; the classes that Unicode's own data give by rule (widths, ligatures, presentation
forms, blanks, signs that show nothing); and, as longer keys that win over these, the contexts in which a sign that shows
nothing by itself changes what is drawn. The whole table is checked when it is compiled: no key has two images, and every
image is rewritten to itself, so the form is idempotent.

What stays visible stays different: letter case, accents, number forms (raised, lowered, circled, fractions, Roman),
and the emoji shown. A joiner therefore stays inside an emoji sequence, after a virama, and after an Arabic letter.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexitide.runtime import materialize

# --- Fixed values: signs drawn like another one, and that sign, in rows of one script or kind -------------------
LOOK_ALIKE = (
    ("АВЕЅІЈКМНОРСТУХԚԜѴҮԌаеоріјсѕухһԁԛԝѵӀӏ", "ABESIJKMHOPCTYXQWVYGaeopijcsyxhdqwvIl"),  # Cyrillic
    ("ӔӕӘә", "ÆæƏə"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳϹͿ", "ABEZHIKMNOPTYXovcjCJ"),  # Greek
    ("ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "HIKMNOPCTYXopc"),  # Coptic
    ("օսհոցզյՕՍՏ", "ouhngqjOUS"),  # Armenian
    ("ꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜꓮ", "BCDEFGHIJKLMNOPRSTUVWXYZA"),  # Lisu
    ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"),  # Cherokee
    ("ɑɡĐƉ", "agÐÐ"),  # Latin
    ("⁄∕⧸․ꓸ։∶׃꞉ꓽǃꞏ‧⋅ʼʻµ∆", "///..:::::!···’‘μΔ"),  # signs
    ("‐‑﹣－", "----"),
)
SHOWN_NOTHING = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"  # not in category Cf
SHOWN_FORMAT = "؀؁؂؃؄؅۝܏࢐࢑࣢"  # Cf, yet drawn
BLANK_EXTRA = "⠀"
NAMED_FLAGS = ("gbeng", "gbsct", "gbwls")  # drawn by a black flag and these letters as tags
# ----------------------------------------------------------------------------------------------------------------

ZWJ, ZWNJ, EMOJI_STYLE = "\u200d", "\u200c", "\ufe0f"
END = "\U0010ffff"  # a noncharacter: the end of a cluster
LIGATURES = range(0xFB00, 0xFB18)
SIGNS = [*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000), *range(0xE0000, 0xE0200)]  # not ideographs, syllables, surrogates, private use
ARABIC_FORMS = (range(0xFB50, 0xFE00), range(0xFE70, 0xFEFD))

# Runs of signs that stay as they are and aren't joined to what follows; anything else, cluster by cluster.
UNMOVED = r"\x20-\x7eÀ-ďđ-ƈƊ-ǂǄ-ɏ“”„‘’«»…–—、。「」ぁ-ゖァ-ヺー一-鿿가-힣ء-غف-ي؟،"
TOKEN = regex.compile(rf"([{UNMOVED}]+(?![\p{{M}}\p{{Cf}}ᄀ-ᇿﾞﾟ]))|(\X)", regex.DOTALL)


def is_blank(ch: str) -> bool:
    return ch.isspace() or ch in BLANK_EXTRA


def shows_nothing(ch: str) -> bool:
    """Signs without a drawing of their own: formats, joiners, fillers, variation selectors, other controls."""
    if ch in SHOWN_FORMAT:
        return False
    kind = unicodedata.category(ch)
    return kind == "Cf" or ch in SHOWN_NOTHING or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF or (kind == "Cc" and not ch.isspace())


def by_rule(ch: str) -> str | None:
    """The image that Unicode's data give for one sign, or None where the sign stays as it is."""
    if is_blank(ch):
        return " "
    if shows_nothing(ch):
        return ""
    tag, _, rest = unicodedata.decomposition(ch).partition("> ")
    if not rest:
        return None
    whole = "".join(chr(int(x, 16)) for x in rest.split())
    code = ord(ch)
    if tag in ("<wide", "<narrow") or code in LIGATURES or ch in "ำຳ":
        return whole
    if tag in ("<initial", "<medial", "<final", "<isolated") and any(code in r for r in ARABIC_FORMS):
        return whole
    return None


def in_context() -> Iterator[tuple[str, str]]:
    """Keys of several signs, of which one by itself shows nothing but here changes what is drawn."""
    of = {name: regex.compile(rule) for name, rule in {
        "arabic": r"\p{Script=Arabic}", "picture": r"\p{Extended_Pictographic}", "text": r"(?V1)[\p{Emoji}--\p{Emoji_Presentation}]",
    }.items()}
    for ch in map(chr, SIGNS):
        if unicodedata.combining(ch) == 9:  # a virama
            yield from ((ch + joiner, ch + joiner) for joiner in (ZWJ, ZWNJ))
        if of["arabic"].match(ch):
            yield ch + ZWNJ, ch + ZWNJ
        if of["picture"].match(ch):
            yield ZWJ + ch, ZWJ + ch  # within a cluster this follows another picture
        if of["text"].match(ch):
            yield ch + EMOJI_STYLE, ch + EMOJI_STYLE  # drawn in colour, not as a text sign
            yield ch + EMOJI_STYLE + ZWJ, ch + ZWJ  # a sequence is in colour anyway
            yield ch + EMOJI_STYLE + ZWJ + END, ch + EMOJI_STYLE  # nothing follows that is joined
    for name in NAMED_FLAGS:
        flag = "\U0001f3f4" + "".join(chr(0xE0000 + ord(x)) for x in name) + "\U000e007f"
        yield flag, flag


def compiled_table() -> dict[str, str]:
    """Every key and its image, in canonical decomposition, checked as a whole.

    One image a key; by rule, an image may hold keys (a full-width form of a look-alike), which are rewritten here, once.
    """
    table: dict[str, str] = {}

    def add(key: str, image: str) -> None:
        if table.setdefault(key, image) != image:
            raise ValueError(f"two images for {key!r}")

    for like, look in LOOK_ALIKE:
        if len(like) != len(look):
            raise ValueError(f"rows of different length: {like}")
        for key, image in zip(like, look):
            add(unicodedata.normalize("NFD", key), unicodedata.normalize("NFD", image))
    for key, image in in_context():
        add(key, image)
    for ch in map(chr, SIGNS):
        if ch not in table and unicodedata.normalize("NFD", ch) == ch and (image := by_rule(ch)) is not None:
            image = unicodedata.normalize("NFD", image)
            add(ch, "".join(table.get(c) or (by_rule(c) if by_rule(c) is not None else c) for c in image) if image != " " else " ")
    return table


class Transducer:
    """Longest-match rewriting of grapheme clusters; images of clusters seen before are kept, up to a bound."""

    KEPT = 200_000

    def __init__(self, table: dict[str, str]):
        self.trie: dict = {}
        self.images: dict[str, str] = {}
        whole = regex.compile(rf"[{UNMOVED}]*")
        for key, image in table.items():
            node = self.trie
            for ch in key:
                node = node.setdefault(ch, {})
            node[""] = image
            if key != " " and whole.fullmatch(key):
                raise ValueError(f"{key!r} is among the signs that stay")
        for key, image in table.items():
            image += "\U0001f469" if key[-1] == ZWJ else ""  # such a key is for a picture that follows
            if self._rewrite(image) != image:
                raise ValueError(f"{image!r}, the image of {key!r}, isn't its own image")

    def _rewrite(self, text: str) -> str:
        """One pass of longest matches over a decomposed cluster."""
        text += END
        out, at, end = [], 0, len(text) - 1
        while at < end:
            node, to, image = self.trie, at + 1, text[at]
            for k in range(at, end + 1):
                node = node.get(text[k])
                if node is None:
                    break
                if "" in node:
                    to, image = k + 1, node[""]
            out.append(image)
            at = to
        return "".join(out)

    def image(self, cluster: str) -> str:
        image = self.images.get(cluster)
        if image is None:
            if len(self.images) >= self.KEPT:
                self.images.clear()
            image = self.images[cluster] = unicodedata.normalize("NFC", self._rewrite(unicodedata.normalize("NFD", cluster)))
        return image

    def __call__(self, text: str) -> str:
        if text.isascii() and text.isprintable():
            return text.strip(" ")
        out, known, image = [], self.images.get, self.image
        for unmoved, token in TOKEN.findall(text):
            if unmoved:
                out.append(unmoved)
            else:
                out.append(x if (x := known(token)) is not None else image(token))
        form = "".join(out).strip(" ")
        if form != text and not form.isascii() and form != (again := unicodedata.normalize("NFC", form)):
            form = again  # a mark that stood behind a removed sign
        return form


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer(compiled_table())


def look_form(text: str | None) -> str | None:
    """The one form of all texts that look like ``text``; None for None, '' for a text that shows nothing."""
    return None if text is None else transducer()(text)


@F.pandas_udf(StringType())
def _look_form(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    rewrite = transducer()
    for part in parts:
        yield part.map(lambda t: None if t is None else rewrite(t))


_look_form = _look_form.asNondeterministic()  # so the planner neither repeats it nor moves filters on it below a shuffle


def with_look_form(df: DataFrame, text: str = "full_text", to: str = "look_form") -> DataFrame:
    """``df`` with one more column: the consistent form of ``text``.

    Null gives null; an empty text, or one of signs that show nothing, gives ''. A column already called ``to``
    is replaced. Texts are read whole, whatever their length. Rows are neither dropped nor merged.
    """
    return df.withColumn(to, _look_form(F.col(text)))


FORM, TEXT = ["f1", "f2"], ["t1", "t2"]
CLASS_BLOCK = 2048  # texts of one look that a task pairs with the others of that look


def _hashes(column: str, names: list[str]) -> list[Column]:
    """128 bits of a text, as two numbers."""
    return [F.xxhash64(column).alias(names[0]), F.xxhash64(F.lit(names[1]), F.col(column), F.length(column)).alias(names[1])]


def _looks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, hashes of the form, hashes of the text) of every row, each text read and rewritten once; only these numbers go on."""
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")
    return materialize(with_look_form(rows, "t", "form").select("k", *_hashes("form", FORM), *_hashes("t", TEXT)), "looks")


def _several(looks: DataFrame) -> DataFrame:
    """The forms that more than one text as stored has."""
    spread = [F.min(c).alias(f"{c}a") for c in TEXT] + [F.max(c).alias(f"{c}b") for c in TEXT]
    return looks.groupBy(*FORM).agg(*spread).where("t1a <> t1b or t2a <> t2b").select(*FORM)


def look_classes(df: DataFrame, key: str = "id", text: str = "full_text") -> DataFrame:
    """(key, look_class, n_links): for every key with a text, the least key of its look, and how many keys look the same but are stored otherwise.

    One row a key (a key with several texts goes by each look). Copies aren't paired: links are counted by sums over texts and looks.
    """
    looks = _looks(df, key, text)
    texts = looks.groupBy("k", *FORM, *TEXT).agg(F.lit(1).alias("one")).drop("one")
    per_text = texts.groupBy(*FORM, *TEXT).agg(F.count(F.lit(1)).alias("same"), F.min("k").alias("least"))
    per_form = per_text.groupBy(*FORM).agg(F.sum("same").alias("all"), F.min("least").alias("look_class"))
    sized = per_text.join(per_form, FORM).select(*FORM, *TEXT, "look_class", (F.col("all") - F.col("same")).alias("n_links"))
    return texts.join(sized, FORM + TEXT).select(F.col("k").alias(key), "look_class", "n_links").distinct()


def same_look_pairs(df: DataFrame, key: str = "id", text: str = "full_text") -> DataFrame:
    """Pairs of keys (a < b) whose texts differ as stored but look the same.

    Texts never travel, only hashes of 128 bits. Different texts of one look are paired first, those of a look with very many
    texts in blocks; then each pair of texts takes the keys that have them. So copies of one text never meet each other.
    Repeated rows count once; null keys and texts take no part; an empty table gives no pairs.
    """
    looks = _looks(df, key, text)
    members = materialize(looks.join(_several(looks), FORM, "left_semi").distinct(), "alike")
    texts = members.select(*FORM, *TEXT).distinct()
    blocks = texts.groupBy(*FORM).agg(F.ceil(F.count(F.lit(1)) / F.lit(CLASS_BLOCK)).cast("int").alias("n"))
    sized = texts.join(blocks, FORM)
    a = sized.select(*FORM, *[F.col(t).alias(f"a{t}") for t in TEXT], F.pmod("t1", "n").cast("int").alias("block"))
    b = sized.select(*FORM, *[F.col(t).alias(f"b{t}") for t in TEXT], F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"))
    pairs = a.join(b, [*FORM, "block"]).where("at1 < bt1 or (at1 = bt1 and at2 < bt2)")
    with_a = pairs.join(members.select(*FORM, F.col("t1").alias("at1"), F.col("t2").alias("at2"), F.col("k").alias("ka")), [*FORM, "at1", "at2"])
    both = with_a.join(members.select(*FORM, F.col("t1").alias("bt1"), F.col("t2").alias("bt2"), F.col("k").alias("kb")), [*FORM, "bt1", "bt2"]).where("ka <> kb")
    return both.select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b")).distinct()
