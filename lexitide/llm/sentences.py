"""Problem 4: sentence boundaries by cascading segmentation rule tables.

A rule is a pair of regular expressions, one for what stands before a position and one for what follows, and says
break or no break. At an end mark the tables of the text's language come first, then those of its script and the common
ones, at a blank that of line breaks and of blanks between Thai words; the first rule that matches decides, and where none
matches there is no break. Candidates are end marks (with closing quotes and brackets), line breaks, and blanks after Thai.
A table of spans (links, quotations, brackets) names stretches that no end mark inside breaks. Tables are chosen by script
and, where languages share one, by frequent words and letter n-grams; languages that come close lend their abbreviations.

Rules read a *shadow* of the text, its look-alike form (see ``lookalike``), so that abbreviations written with
foreign look-alikes, full-width signs or invisible signs are recognised; positions are mapped back to the text as stored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lexitide.llm.lookalike import TOKEN, transducer


class Rule(NamedTuple):
    breaks: bool
    before: str
    after: str


# --- Fixed values: abbreviations that are always followed by the rest of their sentence, by language -------------
LEADING = {
    "common": "dr prof mr mrs ms gen lt col sgt capt rev hon fig figs vs cf ca approx i.e e.g viz vol p pp st ste nr",
    "en": "no nos ave av dept gov sen rep mt ft eq sec ch ed eds messrs v",
    "es": "sr sra srta dra d dña núm pág págs art av avda p.ej aprox ud uds cap lic ing",
    "pt": "sr sra srta dra p.ex pág págs av art núm aprox eng profa cap",
    "fr": "m mm mme mlle env art av p.ex chap no mgr",
    "it": "sig sig.ra dott dott.ssa pag pagg p.es art avv ing n cap",
    "de": "hr fr str z.b d.h vgl bzw v u.a s abs art bd inkl geb evtl",
    "nl": "dhr mevr mw ir ing blz bijv d.w.z v o.a",
    "tr": "sn bkz örn yak cad sok no av doç",
    "ru": "г ул им проф стр см т.е т.к др рис д р н напр гл акад пр",
    "uk": "ім вул проф див стор напр р м ст рис акад др т.зв",
    "el": "κ κα δρ αρ σελ π.χ δηλ βλ καθ αγ λεωφ",
    "hi": "डॉ क्र श्री प्रो पृ सं",
    "ar": "د م أ ص ق.م",
    "ko": "약",
}
# Short frequent words by which the tables of one language are chosen where several share a script.
FREQUENT = {
    "en": "the of and to in is that it was for on are as with they at be this from have or by but not what all were we when you he she",
    "es": "el la los las de que y en un una por con del se su es más muy pero como al me ya sin",
    "pt": "o os as de que e do da em um uma não para com por mais no na seu ao é mas eu já sem",
    "fr": "le la les des et en un une du est que qui dans pour pas sur au ne se avec il elle je nous sans",
    "it": "il lo la gli le di che e un una del della per non con è nel sono più i al in mi io",
    "de": "der die das und ist nicht ein eine den dem zu mit auf für von im sich des auch es ich in am er sie war",
    "nl": "de het een van en in is dat op te zijn met voor niet aan er door naar om ook ik wat bij",
    "tr": "bir ve bu da de için ile çok ama gibi ne o daha olarak her ben şu ya ise",
    "ru": "и в не на что он с как это по но из у за от же так бы она его",
    "uk": "і в не на що він з як це та до але за від у й так є вона його",
}
# Letters and letter groups by which they are told apart too.
GRAMS = {
    "en": "th wh ght ing ck ee oo sh ow ea",
    "es": "ción ñ ¿ ¡ ll rr ue ía ado uy",
    "pt": "ção ções nh lh ã õ ê ss ei",
    "fr": "eau aux ç è ê ou ai eu qu",
    "it": "zz zione gli cch à è ì tt gn",
    "de": "sch ich ei ß ä ö ü cht ung tz ach",
    "nl": "ij aa oe ee sch uu cht ui",
    "tr": "ı ğ ş lar ler yor ü ö",
    "ru": "ы э ъ ё",
    "uk": "ї є ґ",
}
CONTINUES = "and or but e y und et и і й та ve en och of ou och και o oder ma mais pero и но"
REPORTS = (
    "she said|he said|they said|said|she asked|he asked|dijo|preguntó|disse|perguntou|dit-|demanda|chiese|sagte|fragte|zei|vroeg|dedi|diye sordu"
    "|сказал|спросил|сказала|сказав|спитав|είπε|ρώτησε|उसने कहा|उसने पूछा|라고|하고|قال|سأل|と言|と聞|と叫|她说|他说|她問|他問|她问|他问|เธอ|เขา"
)
SCRIPTS = {
    "th": r"\p{Thai}", "ko": r"\p{Hangul}", "ja": r"[\p{Hiragana}\p{Katakana}]", "zh": r"\p{Han}", "hi": r"\p{Devanagari}", "ar": r"\p{Arabic}",
}
# -----------------------------------------------------------------------------------------------------------------

LATIN, CYRILLIC = ("en", "es", "pt", "fr", "it", "de", "nl", "tr"), ("ru", "uk")
WEIGHT = 2520  # of a letter group, shared among its languages; a word has eight times as much
ENOUGH = 5 * 8 * WEIGHT  # of words alone: as much as five of one language
CLOSE = 0.5  # share of the best language's evidence from which another one lends its abbreviations
LINE = r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
LINE_SIGNS = frozenset("\n\r\x0b\x0c\x85\u2028\u2029") | {"\r\n"}
URL = regex.compile(r"(?:https?://|www\.)\S*[\w/]|\b[\w.+-]+@\w[\w-]*\.[\w.-]*\w", regex.I)
_MAY_URL = re.compile(r"://|www\.|\w@\w", re.I)
_MAY_QUOTE = re.compile(r"[“„«「『\"(\[]")
_CAPITAL = regex.compile(r"(?<![\p{L}\p{N}@#/._])\p{Lu}\p{M}*(?:[\p{Ll}'’]|\s)")  # a word in capitals alone says nothing
EMOJI = r"(?:\p{Extended_Pictographic}|\p{Regional_Indicator}|\p{Emoji_Modifier}|[‍️⃣]|[\U000e0020-\U000e007f])+"
TAIL = regex.compile(rf"(?:[^\S\n\r]*(?:[#@][\w]+|(?:https?://|www\.)\S+|{EMOJI}))+")
_LINE_OR_END = rf"(?P<line>{LINE}\s*)|(?P<end>[.!?…‥。؟۔।॥;·]+(?: ?[.!?…]+(?![\w.]))*)"
MARKS = re.compile(rf"{_LINE_OR_END}|(?P<thai>(?!))")
THAI_MARKS = regex.compile(rf"{_LINE_OR_END}|(?P<thai>(?<=\p{{Thai}}\S*) +)")
THAI = re.compile("[\u0e00-\u0e7f]")
CLOSERS = r"[\"'”’»)\]」』“›]*"
QUOTES = regex.compile(r"“[^“”\n]*”|„[^“”„\n]*[“”]|«[^«»\n]*»|「[^「」\n]*」|『[^『』\n]*』|\"[^\"\n]*\"|\([^()\n]*\)|\[[^\[\]\n]*\]")


def _words(names: str) -> str:
    """An alternation of abbreviations in their look-alike form, the longest first."""
    forms = {transducer()(x) for x in names.split()}
    return "|".join(regex.escape(x) for x in sorted(forms, key=lambda x: (-len(x), x)))


NO_WORD_BEFORE = r"(?<![\p{L}\p{N}\p{M}.])"


def _leading(names: str) -> list[Rule]:
    """No break after an abbreviation; one of several parts may be written with blanks, and has no break inside either."""
    inside = []
    for name in names.split():
        parts = transducer()(name).split(".")
        for k in range(1, len(parts)):
            before, rest = (r"\. ?".join(regex.escape(x) for x in some) for some in (parts[:k], parts[k:]))
            inside.append(rf"{before}\.(?= ?{rest} ?\.)")
    rules = [Rule(False, rf"{NO_WORD_BEFORE}(?i:{_words(names)}) ?\.", r"(?=\s*\S)")]
    return rules + ([Rule(False, rf"{NO_WORD_BEFORE}(?i:{'|'.join(inside)})", "")] if inside else [])


def lent(lang: str) -> list[Rule]:
    """What a language that comes close in a text too short to tell lends: its abbreviations, but for such as may be words of one vowel."""
    rules = _leading(" ".join(x for x in LEADING[lang].split() if x not in {*"aeiouyаеиоу"}))
    return rules + ([Rule(False, r"(?<![\p{L}\p{N}.,])\d{1,2}\.", r" +\p{L}")] if lang == "de" else [])


BLANKS = [Rule(True, rf"{LINE}\s*", r""), Rule(True, r"\p{Thai}\S* +", r"")]  # the table of line breaks and of blanks, for all languages


def tables(lang: str, cased: bool) -> tuple[list[Rule], list[Rule]]:
    """The cascade for one language at end marks: its own table; the tables of its script and the common one."""
    upper = r"\p{Lu}\p{Lt}"
    own = []
    if lang == "de":
        own.append(Rule(False, r"(?<![\p{L}\p{N}.,])\d{1,2}\.", r" +\p{L}"))
        own.append(Rule(False, rf"\p{{L}}(?i:{_words('str')})\.", r" *\d"))
    if lang in LEADING:
        own += _leading(LEADING[lang])
    if lang == "ru":
        own.insert(0, Rule(True, rf"(?i:{_words('и')}) (?i:{_words('др пр')})\.", rf" +[{upper}]"))
    script = _leading(LEADING["common"]) if lang in LATIN or lang not in SCRIPTS else _leading("dr prof mr mrs no fig vs cf approx i.e e.g")
    common = [
        Rule(False, r"(?<![\p{L}\p{N}\p{M}.-])\p{Lu} ?\.", rf" *(?:[{upper}] ?\.|[{upper}][\p{{L}}\p{{M}}'’-]+)"),
        Rule(False, r"(?<![\p{L}\p{N}\p{M}.-])\p{Lu} ?\.", r" +\p{Lo}") if lang in SCRIPTS else Rule(False, r"\p{Lu}\.(?=\p{Lu}\.)", ""),
        Rule(False, r"[\"”’»」』“]", r" *[,:،、—–-]"),
        Rule(False, r"[.!?…。؟।][\"”’»」』“]", rf"[ ,]*(?i:{'|'.join(transducer()(x) for x in REPORTS.split('|'))})"),
    ]
    if cased:
        common.append(Rule(False, r"", r"[ \"'“„«(\[¿¡]*\p{Ll}"))
    else:
        common.append(Rule(False, r"(?<![\p{L}\p{N}\p{M}.-])\p{Ll} ?\.", r" \p{Ll} ?\. "))
        common.append(Rule(False, r"(?<![\p{L}\p{N}\p{M}.-])\p{Ll} ?\. \p{Ll} ?\.", r" \p{Ll}"))
        common.append(Rule(False, r"(?:…|\.\.)", rf" (?:{_words(CONTINUES)})\b") if lang not in SCRIPTS else Rule(False, r"…", r"[和与而但及]"))
    if lang != "el":
        common.append(Rule(False, r"[;·]", r""))  # question mark and colon of Greek alone
    common += [
        Rule(True, rf"[.!?…‥。؟۔।॥;·]{CLOSERS}", r"(?:\s|$)"),
        Rule(True, rf"[。؟۔।॥]{CLOSERS}", r""),
        Rule(True, rf"[!?…‥]{CLOSERS}", r"\p{Lo}") if lang in ("zh", "ja", "th") else Rule(True, rf"[\p{{L}}\p{{M}}\p{{N}}\"”»)][!?]+{CLOSERS}", r"[\p{L}\"“«„¿¡]"),
        Rule(True, rf"\p{{L}}\p{{M}}*\p{{L}}\p{{M}}*[.…]+{CLOSERS}", r"\p{Lu}(?:\p{Ll}|\s)" if cased else r"\p{L}{3}"),
    ]
    return own, script + common


Compiled = list[tuple[bool, regex.Pattern, list[tuple[regex.Pattern, regex.Pattern]]]]


def _compile(rules: list[Rule]) -> Compiled:
    """Runs of rules that say the same: one expression for all of a run where nothing stands between its two sides, and the rules one by one."""
    runs = [(breaks, list(run)) for breaks, run in groupby(rules, key=lambda r: r.breaks)]
    joint = lambda run: regex.compile("|".join(f"(?<={r.before})(?={r.after})" for r in run))
    return [(breaks, joint(run), [(regex.compile(f"(?<={r.before})"), regex.compile(r.after)) for r in run]) for breaks, run in runs]


def _matches(joint: regex.Pattern, single: list[tuple[regex.Pattern, regex.Pattern]], text: str, pos: int, nxt: int) -> bool:
    if pos == nxt:
        return joint.match(text, pos) is not None
    return any(before.match(text, pos) and after.match(text, nxt) for before, after in single)


@lru_cache(maxsize=64)
def _compiled_parts(lang: str, cased: bool) -> tuple[Compiled, Compiled]:
    first, last = tables(lang, cased)
    return _compile(first), _compile(last)


@lru_cache(maxsize=64)
def _compiled_lent(lang: str) -> Compiled:
    return _compile(lent(lang))


@lru_cache(maxsize=1)
def compiled_blanks() -> Compiled:
    return _compile(BLANKS)


@lru_cache(maxsize=4096)
def compiled(lang: str, close: tuple[str, ...], cased: bool) -> Compiled:
    """The cascade of a text at end marks: its language, close languages, script and common rules."""
    first, last = _compiled_parts(lang, cased)
    return first + [rule for one in close for rule in _compiled_lent(one)] + last


@lru_cache(maxsize=1)
def _evidence() -> tuple[dict[str, list[str]], dict[str, list[str]], re.Pattern]:
    """Frequent words and letter groups (longest first in the pattern) with the languages they speak for."""
    words: dict[str, list[str]] = {}
    groups: dict[str, list[str]] = {}
    for source, by in ((FREQUENT, words), (GRAMS, groups)):
        for lang, names in source.items():
            for name in names.split():
                by.setdefault(transducer()(name), []).append(lang)
    return words, groups, re.compile("|".join(sorted(map(re.escape, groups), key=lambda x: (-len(x), x))))


_SCRIPT_OF = [(lang, regex.compile(p)) for lang, p in SCRIPTS.items()]
_NOT_LATIN = re.compile("[\u0370-\u1dff\u3040-\ud7ff]")
_LETTER, _GREEK, _CYRILLIC = regex.compile(r"\p{L}"), regex.compile(r"\p{Greek}"), regex.compile(r"\p{Cyrillic}")
_LOWER = regex.compile(r"\p{Ll}")
_NAMES = regex.compile(rf"{URL.pattern}|[#@]\w+", regex.I)
_WORD = re.compile(r"\w+")


def guess_script(text: str) -> tuple[str | None, tuple[str, ...]]:
    """The language whose tables are used where the script tells it, else None; and the languages of the script."""
    if text.isascii() or not _NOT_LATIN.search(text):
        return None, LATIN
    counts = {lang: len(p.findall(text)) for lang, p in _SCRIPT_OF}
    lang, most = max(counts.items(), key=lambda x: x[1])
    letters = len(_LETTER.findall(text))
    if counts["ja"] * 8 > counts["zh"] > 0 or most == counts["ja"] > 0:
        lang, most = "ja", counts["ja"] + counts["zh"]
    if most * 3 > letters:
        return lang, ()
    if len(_GREEK.findall(text)) * 3 > letters:
        return "el", ()
    return None, CYRILLIC if len(_CYRILLIC.findall(text)) * 3 > letters else LATIN


def guess_alphabet(shadow: str, languages: tuple[str, ...]) -> tuple[str, tuple[str, ...]]:
    """Of languages that share a script, the one that frequent words and letter groups speak for; and those that come close to it."""
    words, groups, pattern = _evidence()
    lower, score = shadow.lower(), dict.fromkeys(languages, 0)

    def add(weight: int, known: dict[str, list[str]], found: Counter) -> tuple[str, tuple[str, ...]]:
        for name in known.keys() & found.keys():
            for lang in known[name]:
                if lang in score:
                    score[lang] += weight // len(known[name]) * found[name]  # whole numbers, so the order of sums is no matter
        best = max(score, key=score.get)
        return best, tuple(lang for lang in score if lang != best and score[lang] >= CLOSE * score[best])

    best, close = add(8 * WEIGHT, words, Counter(_WORD.findall(lower)))
    if close or score[best] < ENOUGH:  # words leave a doubt
        best, close = add(WEIGHT, groups, Counter(pattern.findall(lower)))
    return best, close


_PLAIN_CONTROLS = str.maketrans("\n\t\r", "   ")
_PLAIN_CONTROLS_KEPT = str.maketrans("\t\r", " \n")


def _shadow(text: str) -> tuple[str, list[int], list[int]]:
    """The look-alike form with line breaks kept, and the starts of its pieces there and in the text."""
    rewrite, parts, here, there = transducer(), [], [], []
    if text.isascii() and (text.isprintable() or text.translate(_PLAIN_CONTROLS).isprintable()):
        return text.translate(_PLAIN_CONTROLS_KEPT), [0], [0]
    at = to = 0
    for unmoved, token in TOKEN.findall(text):
        if unmoved:
            image = token = unmoved
        elif token in LINE_SIGNS:
            image = "\n"
        else:
            image = rewrite.images.get(token)
            if image is None:
                image = rewrite.image(token)
        if image:
            here.append(to)
            there.append(at)
            parts.append(image)
            to += len(image)
        at += len(token)
    return "".join(parts), here, there


def _back(pos: int, here: list[int], there: list[int], text: str) -> int:
    k = bisect_right(here, pos) - 1
    off = pos - here[k]  # inside a run of signs that stay; a cluster's image has no sentence start but its first sign
    return there[k] + off


def sentence_starts(text: str | None) -> list[int]:
    """Positions, in code points of ``text``, of the first sign of each sentence that is not blank.

    None, an empty text and a text of blanks have no sentence. Texts are read whole.
    """
    if not text:
        return []
    shadow, here, there = _shadow(text)
    n = len(shadow)
    first = 0
    while first < n and shadow[first].isspace():
        first += 1
    if first == n:
        return []
    lang, languages = guess_script(text)
    safe = [m.span() for m in URL.finditer(shadow)] if _MAY_URL.search(shadow) else []
    cased = bool(_CAPITAL.search(shadow)) or not _LOWER.search(_NAMES.sub(" ", shadow))
    rules = compiled(lang or languages[0], (), cased)  # languages of one script differ in rules for full stops alone
    quotes = [m.span() for m in QUOTES.finditer(shadow)] if _MAY_QUOTE.search(shadow) else []
    safe_from, quote_from = [a for a, _ in safe], [a for a, _ in quotes]
    starts, at = [first], first
    for m in (THAI_MARKS if not shadow.isascii() and THAI.search(shadow) else MARKS).finditer(shadow):
        mark, pos = m.span()
        if pos <= at:
            continue
        nxt, kind = pos, m.lastgroup
        if kind != "line":
            k = bisect_right(safe_from, mark) - 1 if safe else -1
            if k >= 0 and mark < safe[k][1] and (kind == "thai" or pos < safe[k][1]):
                continue
            k = bisect_right(quote_from, mark) - 1 if quotes else -1
            if k >= 0 and mark < quotes[k][1] and pos <= quotes[k][1]:
                close = quotes[k][1]
                if kind == "thai" or shadow[quotes[k][0]] in "([" or shadow[pos : close - 1].strip():
                    continue
                pos = nxt = close
            if tail := TAIL.match(shadow, mark if kind == "thai" else pos):
                nxt = tail.end()
        begin = nxt
        while begin < n and shadow[begin].isspace():
            begin += 1
        if begin >= n:
            break  # only tags, links and emoji are left, if anything
        if lang is None and "." in m[0]:
            lang, close = guess_alphabet(shadow, languages)
            rules = compiled(lang, close, cased)
        for breaks, joint, single in rules if kind == "end" else compiled_blanks():
            if _matches(joint, single, shadow, pos, nxt):
                break
        else:
            continue
        if not breaks:
            continue
        nxt = begin
        if kind == "line" and (only := TAIL.match(shadow, nxt)) and not shadow[only.end() :].strip():
            break  # nothing but tags, links and emoji: they belong to the sentence before
        if nxt > at:
            starts.append(nxt)
            at = nxt
    return [_back(p, here, there, text) for p in starts]


def split_sentences(text: str | None) -> list[tuple[int, str]]:
    starts = sentence_starts(text)
    return [(a, text[a:b].rstrip()) for a, b in zip(starts, starts[1:] + [len(text or "")])]


SENTENCES = ArrayType(StructType([StructField("start_pos", IntegerType()), StructField("sentence", StringType())]))
STARTS = ArrayType(IntegerType())


@F.pandas_udf(STARTS)
def _starts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(sentence_starts)


_starts = _starts.asNondeterministic()  # so the planner neither repeats it nor moves a filter on it below a shuffle


def with_sentences(df: DataFrame, text: str = "full_text") -> DataFrame:
    """One row per sentence, with all columns of ``df`` and ``sentence_no`` (from 1), ``start_pos`` and ``sentence``.

    A row whose text is null, empty or blank gives no rows. Columns of those names in ``df`` are replaced. Repeated
    rows stay repeated. Only the text goes to Python, and only positions come back; sentences are cut in the JVM.
    """
    made = {"sentence_no", "start_pos", "sentence"}
    kept = [c for c in df.columns if c not in made or c == text]
    spans = df.select(*kept, F.col(text).alias("_text")).withColumn("_starts", _starts(F.col("_text"))).where(F.size("_starts") > 0)
    rows = spans.select(*kept, "_text", "_starts", F.posexplode("_starts").alias("_k", "_from"))
    until = F.coalesce(F.get("_starts", F.col("_k") + 1), F.length("_text"))
    body = F.rtrim(F.substring("_text", F.col("_from") + 1, until - F.col("_from")))
    kept = [c for c in kept if c not in made]
    return rows.select(*kept, (F.col("_k") + 1).alias("sentence_no"), F.col("_from").cast("long").alias("start_pos"), body.alias("sentence"))
