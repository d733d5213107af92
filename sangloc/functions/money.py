"""Pay amounts in free text.

`amounts` turns one text into an array of ``(kind, unit, low, high)`` structs.  Two
alternations (range, single) stand for the many listed spellings; ranges are blanked
before singles are looked for, so an amount is never counted twice.  The unit behind a range holds for both of its ends
(`25-30k/h`, `7-10tr`), unless the first has one of its own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sangloc.functions.text import SPACE, let, tokens

# Money words that survive `drop_noise_words`.
MONEY_WORDS = ("tr", "triệu", "triệu/tháng", "tr/tháng", "tr/", "triệu/")

# Number and unit shapes (grouped dong, short number, million or dollar unit).
GROUPED = r"[0-9]{1,3}(?:[.,][0-9]{3}){2}"
SHORT = r"[0-9]{1,2}[.,][0-9]{1,3}|[0-9]{1,5}"
UNIT = r"triệu|trieu|tr|m|usd|k/giờ|k/h|k/ngày"
DONG = r"(?:vnđ|vnd|đ|d)?"
TO = r"(?:-|đến)(?:vnd)?"

# All begin with a digit; where none is, no alternative is tried.
RANGE = (
    rf"(?=[0-9])(?:({GROUPED}){DONG}{TO}({GROUPED}){DONG}"
    rf"|({SHORT})({UNIT}|k)?{TO}({SHORT})({UNIT})"
    rf"|({SHORT})({UNIT}){TO}({SHORT}))"
)
SINGLE = rf"(?=[0-9])(?:({GROUPED})|({SHORT})(triệu|trieu|tr|m|usd|k/giờ|k/h|k/ngày)([0-9]{{1,3}})?)"
LONG_DIGITS = r"[0-9]{9,}"
# `[0-9]{2}k/(h|giờ)` in a text whose white space does not count.
HOURLY = rf"[0-9]{SPACE}*+[0-9]{SPACE}*+k{SPACE}*+/{SPACE}*+(?:h|g{SPACE}*+i{SPACE}*+ờ)"

# A word that `drop_noise_words` deletes, with the white space before it: no digit, `tr` or `m` somewhere, and no money word.
_IN_WORD, _NO_DIGIT, _NO_MARK = r"[^\s\p{Z}]", r"[^\s\p{Z}0-9]", r"[^\s\p{Z}0-9tm]"
_MONEY_WORD = rf"[().,:]*+(?:{'|'.join(map(re.escape, ('m', *MONEY_WORDS)))})[().,:]*+(?!{_IN_WORD})"
NOISE_WORD = rf"{SPACE}(?={_NO_MARK}*+(?:t(?!r){_NO_MARK}*+)*+(?:tr|m))(?!{_MONEY_WORD}){_NO_DIGIT}++(?!{_IN_WORD})"

NEGOTIABLE = "Thỏa thuận"


def drop_noise_words(c: Column) -> Column:
    """Delete words holding `tr` or `m` without a digit, other than the money words."""

    def keep(w: Column) -> Column:
        core = F.trim(F.translate(w, "().,:", "     "))
        noisy = F.contains(w, F.lit("tr")) | F.contains(w, F.lit("m"))
        return ~noisy | w.rlike("[0-9]") | core.isin("m", *MONEY_WORDS)

    return F.array_join(F.filter(tokens(c), keep), " ")


def _dollars(c: Column) -> Column:
    return F.replace(c, F.lit("$"), F.lit("usd"))


def _dashes(c: Column) -> Column:
    """Arrows and long dashes as `-`."""
    for sign in ("->", "–", "~"):
        c = F.replace(c, F.lit(sign), F.lit("-"))
    return c


def _spaceless(c: Column) -> Column:
    """Blanks go first, which takes no pattern."""
    return F.regexp_replace(F.replace(c, F.lit(" "), F.lit("")), rf"{SPACE}+", "")


def squash_money_text(c: Column) -> Column:
    return _dashes(_spaceless(F.lower(_dollars(c))))


def money_text(c: Column) -> Column:
    """What amounts are searched in: noise words out, then squashed, long digit runs out.

    Noise words are deleted in place, since the squashed text has no white space that would tell the others apart.
    """
    kept = F.regexp_replace(F.concat(F.lit(" "), F.lower(c)), NOISE_WORD, "")
    return F.regexp_replace(_dashes(_dollars(_spaceless(kept))), LONG_DIGITS, " ")


def is_hourly(c: Column) -> Column:
    """Pay by the hour; the signs that `squash_money_text` replaces are no part of it, and a text without a slash names none."""
    return F.contains(c, F.lit("/")) & F.lower(c).rlike(HOURLY)


def _number(text: Column, unit: Column, fraction: Column | None = None) -> Column:
    """Digits -> decimal in dong or dollars; `,` and `.` group or split by unit."""
    whole = F.regexp_replace(text, r"[.,]", "").try_cast("decimal(18,3)")
    point = F.translate(text, ",", ".")
    if fraction is not None:
        point = F.when(fraction != "", F.concat_ws(".", F.regexp_replace(text, r"[.,]", ""), fraction)).otherwise(point)
    millions = point.try_cast("decimal(18,3)") * F.lit(1_000_000)
    value = (
        F.when(unit.isin("triệu", "trieu", "tr", "m"), millions)
        .when(unit.startswith("k"), whole * F.lit(1_000))
        .otherwise(whole)
    )
    return value.try_cast("decimal(18,2)")


def _unit(unit: Column) -> Column:
    return (
        F.when(unit == "usd", "usd")
        .when(unit.isin("k/h", "k/giờ"), "vnd/hour")
        .when(unit == "k/ngày", "vnd/day")
        .otherwise("vnd")
    )


def _range(m: Column) -> Column:
    def group(i: int) -> Column:
        return F.regexp_extract(m, RANGE, i)

    grouped = group(1) != ""
    both = group(5) != ""
    unit = F.when(grouped, "").when(both, group(6)).otherwise(group(8))
    left_unit = F.when(both & (group(4) != ""), group(4)).otherwise(unit)
    left = F.when(grouped, group(1)).when(both, group(3)).otherwise(group(7))
    right = F.when(grouped, group(2)).when(both, group(5)).otherwise(group(9))
    return F.struct(
        F.lit("range").alias("kind"),
        _unit(unit).alias("unit"),
        _number(left, left_unit).alias("low"),
        _number(right, unit).alias("high"),
    )


def _single(m: Column) -> Column:
    grouped = F.regexp_extract(m, SINGLE, 1)
    unit = F.regexp_extract(m, SINGLE, 3)
    text = F.when(grouped != "", grouped).otherwise(F.regexp_extract(m, SINGLE, 2))
    value = _number(text, unit, F.regexp_extract(m, SINGLE, 4))
    return F.struct(
        F.lit("single").alias("kind"), _unit(unit).alias("unit"), value.alias("low"), value.alias("high")
    )


def amounts(squashed: Column) -> Column:
    """All ranges, then all single amounts, of a `money_text`.

    A figure below two with the unit `m` is a height or a distance, not pay.
    """

    def found(ranges: Column) -> Column:
        rest = F.when(F.size(ranges) == 0, squashed).otherwise(F.regexp_replace(squashed, RANGE, " "))
        singles = F.filter(
            F.regexp_extract_all(rest, F.lit(SINGLE), F.lit(0)),
            lambda m: ~m.rlike(r"^[01]([.,][0-9]+)?m"),
        )
        return F.concat(F.transform(ranges, _range), F.transform(singles, _single))

    return let(F.regexp_extract_all(squashed, F.lit(RANGE), F.lit(0)), found)


def of_kind(found: Column, kind: str) -> Column:
    return F.filter(found, lambda a: a["kind"] == kind)
