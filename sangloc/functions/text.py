"""Text cleaning, repair and tokenising as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Java's \s is ASCII only; \p{Z} adds the no-break and other Unicode spaces.
SPACE = r"[\s\p{Z}]"

# Characters that count as special, in removal order.
SPECIAL_CHARS = "!#$%^*?&{}|_+=@[]:;<>/()"

# Everything a title may not contain in the "index" profile.
INDEX_SPECIAL = r'[!@#$%^&*()?":;{}|<>_=/+]'

# Characters allowed by `strip_special`.
NOT_ALLOWED = r"[^\\/\p{L}\p{N}_\s\p{Z},.;<>]+"

# Punctuation blanked by `standardize_text`.
STANDARD_PUNCT = ",.;“:”\"'!?-"

_MARK = "\x01"
# All begin with `<`, so that other characters are passed by one test.
_TAGS = (
    r"(?is)<(?:script\b[^>]*>.*?</script\s*>"
    r"|style\b[^>]*>.*?</style\s*>"
    r"|!--.*?-->"
    r"|![a-z][^>]*>"
    r"|[a-z/][^>]*>)"
)
_ENTITY = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);?"


# What `bare_tokens` trims off words, and what lies between two bare words: white space, and what is trimmed on both sides.
_TRIMMED = r"[^\p{L}\p{N}\s\p{Z}]"
_BETWEEN_BARE = rf"{_TRIMMED}*+{SPACE}++{_TRIMMED}*+"


def let(value: Column, result: Callable[[Column], Column]) -> Column:
    """`result` of a value that is evaluated once, also where it is read inside lambdas or branches."""
    return F.transform(F.array(value), result)[0]


def trim_space(c: Column) -> Column:
    """Strip every kind of white space at both ends (`trim` only drops blanks)."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def squeeze_space(c: Column) -> Column:
    return trim_space(F.regexp_replace(c, rf"{SPACE}+", " "))


def _named_entities() -> Column:
    def quoted(text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    return F.expr("map(" + ", ".join(f"{quoted(n)}, {quoted(chr(c))}" for n, c in name2codepoint.items()) + ")")


def decode_entities(c: Column) -> Column:
    """Decode named and numeric character references; unknown ones stay."""
    named = _named_entities()

    def piece(p: Column, i: Column) -> Column:
        name = F.regexp_extract(p, _ENTITY, 1)
        code = (
            F.when(name.startswith("#x") | name.startswith("#X"), F.conv(F.substring(name, 3, 8), 16, 10))
            .when(name.startswith("#"), F.substring(name, 2, 8))
            .try_cast("int")
        )
        # surrogates and values past U+10FFFF are no characters
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        numeric = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        char = F.coalesce(F.try_element_at(named, name), numeric)
        decoded = F.concat(char, F.regexp_replace(p, _ENTITY, ""))
        return F.when(i == 0, p).otherwise(F.coalesce(decoded, F.concat(F.lit("&"), p)))

    return F.array_join(F.transform(F.split(c, "&"), piece), "")


def _if_holds(c: Column, mark: str, changed: Callable[[Column], Column]) -> Column:
    """`changed` of a text that holds a mark, without which it would stay as it is."""
    return let(c, lambda t: F.when(F.contains(t, F.lit(mark)), changed(t)).otherwise(t))


def html_to_text(c: Column) -> Column:
    """Text nodes joined by newlines; scripts, styles, comments and doctype dropped.

    A text that holds no `<` or no `&` is not searched for what begins with it.
    """
    marked = _if_holds(c, "<", lambda t: F.regexp_replace(t, _TAGS, _MARK))
    joined = _if_holds(
        marked, _MARK, lambda t: F.regexp_replace(F.regexp_replace(t, "^\x01+|\x01+$", ""), "\x01+", "\n")
    )
    return _if_holds(joined, "&", decode_entities)


@F.pandas_udf(T.StringType())
def compose_unicode(s: pd.Series) -> pd.Series:
    """Decomposed accented letters to composed ones (NFC); Spark has no built-in."""
    return s.str.normalize("NFC")


def _accent_table() -> tuple[str, str]:
    """Letters of the Latin blocks whose canonical base is an ASCII letter, plus đ."""
    src, dst = "Đđ", "Dd"
    for start, stop in ((0xC0, 0x250), (0x1E00, 0x1F00)):
        for code in range(start, stop):
            base = unicodedata.normalize("NFD", chr(code))[0]
            if base.isascii() and base != chr(code):
                src += chr(code)
                dst += base
    return src, dst


ACCENTED, UNACCENTED = _accent_table()


def fold_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, UNACCENTED)


def strip_phrase(c: Column, phrase: str) -> Column:
    """Delete a phrase, ignoring case; squeeze what is left only if it occurred.

    `c` is read three times, so it should be a plain column.
    """
    pattern = rf"(?iu){phrase}"
    return F.when(c.rlike(pattern), squeeze_space(F.regexp_replace(c, pattern, ""))).otherwise(c)


def strip_special(c: Column) -> Column:
    return F.regexp_replace(c, NOT_ALLOWED, "")


def special_count(c: Column) -> Column:
    return F.length(c) - F.length(F.translate(c, SPECIAL_CHARS, ""))


def special_kinds_to_drop(joined: Column, ratio: float = 0.05) -> Column:
    """How many kinds of special characters must go, in list order, to get below `ratio`.

    Running totals over the per-kind counts give the answer without editing the text
    once per kind.  If no prefix of the list suffices, all kinds go.
    """
    counts = F.array(
        *[F.length(joined) - F.length(F.replace(joined, F.lit(ch), F.lit(""))) for ch in SPECIAL_CHARS]
    )
    start = F.struct(
        special_count(joined).alias("specials"),
        F.length(joined).alias("chars"),
        F.lit(0).alias("dropped"),
    )

    def enough(acc: Column) -> Column:
        return (acc.chars == 0) | (F.try_divide(acc.specials.cast("double"), acc.chars) < ratio)

    def step(acc: Column, n: Column) -> Column:
        return F.when(enough(acc), acc).otherwise(
            F.struct(
                (acc.specials - n).alias("specials"),
                (acc.chars - n).alias("chars"),
                (acc.dropped + 1).alias("dropped"),
            )
        )

    return F.aggregate(counts, start, step, lambda acc: acc.dropped)


def drop_special_kinds(c: Column, kinds: Column) -> Column:
    return F.call_function("translate", c, F.substring(F.lit(SPECIAL_CHARS), F.lit(1), kinds), F.lit(""))


def standardize_text(c: Column) -> Column:
    return F.lower(trim_space(F.translate(c, STANDARD_PUNCT, " " * len(STANDARD_PUNCT))))


def wrap_html(c: Column) -> Column:
    return F.concat(F.lit("<p>"), F.replace(c, F.lit("\n"), F.lit("<br />")), F.lit("</p>"))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, rf"{SPACE}+"), lambda x: x != "")


def sentences(c: Column) -> Column:
    # that hold more than white space
    return F.filter(F.split(c, r"[.!?\n]+"), lambda x: x.rlike(r"[^\s\p{Z}]"))


def word_terms(c: Column, drop: tuple[str, ...] = ()) -> Column:
    """Lower-case runs of two or more word characters, without `drop`."""
    parts = F.split(F.lower(c), r"[^\p{L}\p{N}_]+")
    return F.filter(parts, lambda x: (F.length(x) >= 2) & ~x.isin(*drop) if drop else F.length(x) >= 2)


def bare_tokens(c: Column) -> Column:
    """Lower-case tokens with punctuation trimmed; positions are those of `tokens`.

    One split trims all words, as what is trimmed belongs to what lies between them; a blank at both ends gives the first and
    the last word the same surroundings, and an empty part outside of them.
    """
    parts = F.split(F.concat(F.lit(" "), F.lower(c), F.lit(" ")), _BETWEEN_BARE)
    return let(parts, lambda p: F.slice(p, F.lit(2), F.size(p) - 2))
