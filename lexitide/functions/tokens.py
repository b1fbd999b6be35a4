"""Token predicates and tokenisers as Column expressions, all JVM-side (lambdas over arrays are interpreted, the rest is generated code).

Every predicate about *all* signs of a token is true of the empty token. Lengths count code points.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _ranges(codes: list[int]) -> str:
    """A character class body, in a notation that Java and RE2 both read."""
    out, start = [], None
    for k, code in enumerate(codes):
        start = code if start is None else start
        if k + 1 == len(codes) or codes[k + 1] != code + 1:
            out.append(f"\\x{{{start:x}}}" + (f"-\\x{{{code:x}}}" if code > start else ""))
            start = None
    return "".join(out)


@lru_cache(maxsize=1)
def emoji_class() -> str:
    """All signs with Unicode's Emoji property outside ASCII, by rule."""
    is_emoji = regex.compile(r"\p{Emoji}")
    return _ranges([c for c in range(0x80, 0x1FB00) if not 0xD800 <= c < 0xE000 and is_emoji.match(chr(c))])


@lru_cache(maxsize=1)
def digit_class() -> str:
    """Decimal digits and the other signs that stand for one digit (raised, circled ...), by rule."""
    return r"\p{Nd}" + _ranges([c for c in range(0x80, 0x1FB00) if not 0xD800 <= c < 0xE000 and chr(c).isdigit() and unicodedata.category(chr(c)) == "No"])


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


# A local number of three and four digits; longer forms with an area code end in one, so a search finds them too.
PHONE = rf"\p{{Nd}}{{3}}(?:[-.]|{SPACE})?\p{{Nd}}{{4}}"


def patterns() -> dict[str, str]:
    """The predicates' regular expressions; the same text serves Java and RE2."""
    e, d = emoji_class(), digit_class()
    return {
        "all_numbers_hyphens": rf"^[{d}-]*$",
        "all_punctuation": r"^\p{P}*$",
        "single_emoji": rf"^[{e}]$",
        "all_emoji": rf"^[{e}\x{{200d}}]*$",
        "some_emoji": rf"[{e}]",
        "all_punct_space_control": r"^[\p{P}\p{Z}\p{C}]*$",
        "all_emoji_punct_space_control": rf"^[{e}\p{{P}}\p{{Z}}\p{{C}}]*$",
        "all_alnum_hyphen": r"^[\p{L}\p{N}'-]*$",
        "all_alnum_hyphen_emoji": rf"^[\p{{L}}\p{{N}}'{e}-]*$",
        "url": rf"http[^{SPACE[1:-1]}]",
        "phone": PHONE,
    }


def predicates(c: Column) -> dict[str, Column]:
    """The thirteen token predicates by name."""
    p = patterns()
    out = {name: c.rlike(p[name]) for name in p if name != "all_punctuation"}
    return {
        "has_number": c.rlike(rf"[{digit_class()}]") & ~c.contains("-"),
        "all_punctuation": trimmed(c).rlike(p["all_punctuation"]),
        "hashtag": c.startswith("#"),
        **out,
    }


def keep_token(c: Column, shortest: int = 2, longest: int = 50) -> Column:
    """The filter of tweet tokens, on the token as written (lower-casing comes afterwards)."""
    is_ = predicates(c)
    dropped = is_["hashtag"] | is_["all_numbers_hyphens"] | is_["all_emoji_punct_space_control"] | is_["url"]
    return ~dropped & is_["all_alnum_hyphen_emoji"] & F.length(c).between(shortest, longest)


def control_token(c: Column) -> Column:
    """The filter of control candidates: letters, digits, hyphens; not only digits and hyphens."""
    is_ = predicates(c)
    return is_["all_alnum_hyphen"] & ~is_["all_numbers_hyphens"]


def space_tokens(c: Column, lower: bool = True) -> Column:
    """Tokens between any Unicode blanks, in lower case, without empty ones."""
    return F.filter(F.split(F.lower(c) if lower else c, rf"{SPACE}+"), lambda x: x != "")


# Links, emoticons, handles, tags, words with inner hyphens and apostrophes, numbers, any other sign.
TWEET_TOKEN = (
    r"https?://[^\s]+|[<>]?[:;=8][-o*']?[)\](\[dDpP/\\|@{}]|@\w+|#[\p{L}\p{N}_]+|[\p{L}\p{M}]+(?:['’\-][\p{L}\p{M}]+)+|[+-]?\d+(?:[,.:/-]\d+)*[+-]?|[\p{L}\p{M}\p{N}_]+|\.(?:\s*\.)+|[^\s]"
)


def tweet_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TWEET_TOKEN), F.lit(0))
