"""Vietnamese address normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Administrative unit words and short forms -> one-letter codes, in order.
UNIT_CODES = [
    ("tỉnh ", ""),
    ("thành phố ", "t "),
    ("thị xã ", "x "),
    ("quận ", "q "),
    ("huyện ", "h "),
    ("phường ", "p "),
    ("tx.", "x "),
    ("tp.", "t "),
    ("tp", "t "),
    ("tx", "x "),
    ("q.", "q "),
    ("p.", "p "),
    (".", ","),
]

# Spellings of the same word that both occur in addresses.
SPELLINGS = [("toà", "tòa"), ("thủy", "thuỷ")]

UNIT_WORDS = r"quận|q |q\.|thành phố|tp|thị xã|tx|huyện"


def _replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def normalize_address(c: Column) -> Column:
    """Lower case, unit words as codes, dots and dashes as commas, `q1` as `q 1`."""
    c = _replace_all(F.lower(c), UNIT_CODES)
    c = F.regexp_replace(c, r" *[,–-] *", ",")
    c = F.regexp_replace(c, r" +", " ")
    return F.regexp_replace(c, r"(^|[, ])q([0-9]{1,2})", "$1q $2")


def unit_code(c: Column) -> Column:
    """A district name in the coded form used inside normalised addresses."""
    return F.regexp_replace(_replace_all(F.lower(c), UNIT_CODES[1:5]), r"^q([0-9]{1,2})$", "q $1")


def bare_name(coded: Column) -> Column:
    """Coded district name without its code; numbered districts keep it."""
    return F.when(coded.rlike(r"^q [0-9]+$"), coded).otherwise(F.regexp_replace(coded, r"^[txqh] ", ""))


def strip_place_suffix(addr: Column, province: Column, district: Column) -> Column:
    """Drop the posting's own district, province and the country from a normalised address.

    `addr` is read several times, so it should be a plain column.
    """
    prov = F.lower(province)
    dist = unit_code(district)
    # the bare district name counts only where the address uses no unit words at all
    bare = F.when(~addr.rlike(r"(^|[, ])[qxh] ") & (F.length(dist) > 3), F.substring(dist, F.lit(3), F.length(dist)))

    def drop(c: Column, *parts: Column) -> Column:
        for part in parts:
            c = F.replace(c, F.coalesce(part, F.lit("")), F.lit(""))
        return c

    def after(prefix: str, name: Column) -> Column:
        return F.when(name != "", F.concat(F.lit(prefix), name))

    listed = drop(
        addr, after(",t ", prov), after(",", prov), F.lit(",t hcm"), F.lit(",t hn"),
        after(",", dist), after(",", bare), F.lit(",việt nam"),
    )
    plain = drop(addr, after("t ", prov), prov, dist, bare, F.lit("việt nam"))
    known = ~(F.contains(prov, F.lit(",")) & F.contains(dist, F.lit(","))) & ((prov != "") | (dist != ""))
    return F.when(known, F.when(F.contains(addr, F.lit(",")), listed).otherwise(plain)).otherwise(addr)
