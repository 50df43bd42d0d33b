"""Format patterns and character composition of text values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of a value that its pattern shows.
PATTERN_LENGTH = 20

#: name, regular expression (the same in Java and RE2), whether one value or all values must match.
FLAGS = (
    ("has_blank", r"\s", "any"),
    ("has_dash", "-", "any"),
    ("has_dot", r"\.", "any"),
    ("has_at", "@", "any"),
    ("has_alpha", "[a-zA-Z]", "any"),
    ("has_kor", "[가-힣]", "any"),
    ("has_num", "[0-9]", "any"),
    ("has_bracket", r"[\[\](){}]", "any"),
    ("has_minus", "^-", "any"),
    ("has_only_alpha", r"^[a-zA-Z]+\z", "all"),
    ("has_only_num", r"^[0-9]+\z", "all"),
    ("has_only_kor", r"^[가-힣]+\z", "all"),
    ("has_only_alphanum", r"^[a-zA-Z0-9]+\z", "all"),
    ("has_broken_kor", r"\x{FFFD}", "any"),
    ("has_special", r"[^a-zA-Z0-9가-힣\s]", "any"),
    ("has_unicode", r"[^\x00-\x7F]", "any"),
    ("has_unicode2", r"[\x{10000}-\x{10FFFF}]", "any"),
    ("has_chinese", r"[\x{4E00}-\x{9FFF}]", "any"),
    ("has_japanese", r"[\x{3040}-\x{30FF}]", "any"),
    ("has_tab", r"\t", "any"),
    ("has_cr", r"\r", "any"),
    ("has_lf", r"\n", "any"),
)
FIRST_CHARACTERS = (("first_kor", "^[가-힣]"), ("first_num", "^[0-9]"), ("first_alpha", "^[a-zA-Z]"))

#: Steps of the pattern encoder, in the one order in which no step meets what an earlier one wrote.
STEPS = (
    (r"\p{Ll}", "a"),
    (r"\p{Lu}", "A"),
    (r"[^aA0-9가-힣(){}\[\]\-=. :@/]", "s"),
    ("[가-힣]", "K"),
    ("[0-9]", "n"),
)


#: ASCII characters and what the steps make of each.
ASCII = "".join(map(chr, range(128)))
CODES = "".join("n" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c if c in "(){}[]-=. :@/" else "s" for c in ASCII)


def format_pattern(value: Column) -> Column:
    """n, K, A, a, a kept punctuation mark or s for each of the first 20 characters; a trailing '.0' is left out first."""
    shown = F.substring(F.when(value.endswith(".0"), F.left(value, F.length(value) - 2)).otherwise(value), 1, PATTERN_LENGTH)
    out = shown
    for pattern, by in STEPS:
        out = F.regexp_replace(out, pattern, by)
    return F.when(F.octet_length(shown) == F.length(shown), F.translate(shown, ASCII, CODES)).otherwise(out)


#: Digits but 0 and Latin letters but T (of times), each for its class.
ALIKE = ("123456789bcdefghijklmnopqrstuvwxyzBCDEFGHIJKLMNOPQRSUVWXYZ", "1" * 9 + "a" * 25 + "A" * 24)


def alike(value: Column) -> Column:
    """One text for all that have the same classes of characters at the same places: FLAGS, FIRST_CHARACTERS and the shapes of dates and numbers say the same of them."""
    return F.translate(value, *ALIKE)


def format_pattern_sql(value: str) -> str:
    out = f"substr(regexp_replace({value}, '\\.0\\z', ''), 1, {PATTERN_LENGTH})"
    for pattern, by in STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return out


def edge(value: Column, side: str, n: int) -> Column:
    """The first or last n characters."""
    return F.substring(value, 1, n) if side == "first" else F.when(F.length(value) <= n, value).otherwise(F.substring(value, -n, n))
