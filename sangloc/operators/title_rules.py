"""Rules R9: phone numbers, symbols, branch, places and pay in titles.

Each rule reads and repairs `title_fixed`, so the rules form a chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sangloc.functions.text import (
    INDEX_SPECIAL,
    NOT_ALLOWED,
    bare_tokens,
    squeeze_space,
    strip_phrase,
    strip_special,
    tokens,
)
from sangloc.operators.lexicon import count_kind, drop_matches, greedy_matches, phrase_hits
from sangloc.operators.rules import Dictionaries, rule, with_violation

# Phone shapes, pay patterns and messages of the title rules.
PHONES = (
    "[0-9]{10}",
    "[0-9]{5} [0-9]{5}",
    "[0-9]{4} [0-9]{3} [0-9]{3}",
    "[0-9]{4}-[0-9]{3}-[0-9]{3}",
    "[0-9]{3}-[0-9]{3}-[0-9]{4}",
)
BIG_NUMBER = "[0-9]{7,8}|[0-9] [0-9]{6}|[0-9]{1,2}[ .,][0-9]{3}[ .,][0-9]{3}"
TITLE_PAY = (
    BIG_NUMBER,
    "[0-9]{1,2} ?(triệu|tr|m)(/ ?tháng)?",
    "[0-9]{2} ?k( ?/ ?(giờ|h))?",
    "thu nhập",
    "part[ -]?time|partime",
    "lương( cứng)?",
    "hoa hồng",
    "thưởng",
)
# Amounts without a unit, or with one of millions; an `m` counts where the word ends.
INDEX_TITLE_PAY = (BIG_NUMBER, "[0-9]{1,2} ?(triệu|tr|m($|[ ,.;!/)]))")
BRANCH = "chi nhánh"
MSG_PHONE = "Tiêu đề chứa số điện thoại"
MSG_SPECIAL = "Tiêu đề chứa ký tự đặc biệt. --Đã sửa lại--"
MSG_BRANCH = "Chi nhánh trong tiêu đề"
MSG_TITLE_PROVINCE = "Tỉnh trong tiêu đề"
MSG_TITLE_DISTRICT = "Huyện trong tiêu đề"
MSG_TITLE_PAY = "Lương trong tiêu đề"
MSG_TITLE_INDEX = "Tiêu đề không hợp lệ"


def _hits(c: Column, patterns: tuple[str, ...]) -> Column:
    return sum((c.rlike(f"(?iu){p}").cast("int") for p in patterns), F.lit(0))


def _title() -> Column:
    return F.coalesce(F.col("title_fixed"), F.lit(""))


@rule("title_phone", repairs=("title_fixed",))
def rule_title_phone(df: DataFrame) -> DataFrame:
    df = with_violation(df, "title_phone", _hits(_title(), PHONES), MSG_PHONE)
    fixed = F.regexp_replace(_title(), "|".join(PHONES), "")
    return df.withColumn("title_fixed", F.when(F.col("title_phone_count") > 0, fixed).otherwise(_title()))


@rule("title_special", repairs=("title_fixed",))
def rule_title_special(df: DataFrame) -> DataFrame:
    df = with_violation(df, "title_special", _title().rlike(NOT_ALLOWED), MSG_SPECIAL)
    return df.withColumn("title_fixed", strip_special(_title()))


@rule("title_branch", repairs=("title_fixed",))
def rule_title_branch(df: DataFrame) -> DataFrame:
    df = with_violation(df, "title_branch", F.contains(F.lower(_title()), F.lit(BRANCH)), MSG_BRANCH)
    return df.withColumn("title_fixed", strip_phrase(_title(), BRANCH))


@rule("title_place", repairs=("title_fixed",))
def rule_title_place(df: DataFrame, dims: Dictionaries, key: str = "post_id") -> DataFrame:
    """Provinces and districts among the title's words; the matched words are removed."""
    places = dims.places.where(F.col("kind").isin("province", "district"))
    df = phrase_hits(df, key, bare_tokens(_title()), places, "_hits")
    df = df.withColumn("_matches", greedy_matches(F.col("_hits"))).withColumn("_title_words", tokens(_title()))
    found = F.array_distinct(F.transform("_matches", lambda h: F.struct(h["kind"].alias("kind"), h["words"].alias("words"))))
    message = F.concat_ws(
        "\n",
        F.when(count_kind(found, "province") > 0, F.lit(MSG_TITLE_PROVINCE)),
        F.when(count_kind(found, "district") > 0, F.lit(MSG_TITLE_DISTRICT)),
    )
    df = with_violation(df, "title_place", F.size(found), message)
    fixed = F.array_join(drop_matches("_title_words", "_matches"), " ")
    return df.withColumn(
        "title_fixed", F.when(F.col("title_place_count") > 0, fixed).otherwise(_title())
    ).drop("_hits", "_matches", "_title_words")


@rule("title_salary", repairs=("title_fixed",))
def rule_title_salary(df: DataFrame) -> DataFrame:
    """Pay and part-time wording; every kind found counts once and is blanked in turn."""
    count, fixed = F.lit(0), _title()
    df = df.withColumn("_t0", fixed)
    for i, pattern in enumerate(TITLE_PAY):
        df = df.withColumn(f"_t{i + 1}", F.regexp_replace(f"_t{i}", f"(?iu){pattern}", " "))
        count = count + F.col(f"_t{i}").rlike(f"(?iu){pattern}").cast("int")
    df = with_violation(df, "title_salary", count, MSG_TITLE_PAY)
    last = F.col(f"_t{len(TITLE_PAY)}")
    return df.withColumn(
        "title_fixed", F.when(F.col("title_salary_count") > 0, squeeze_space(last)).otherwise(_title())
    ).drop(*[f"_t{i}" for i in range(len(TITLE_PAY) + 1)])


@rule("title_index", "index", reads=("title",))
def rule_title_index(df: DataFrame, dims: Dictionaries, key: str = "post_id") -> DataFrame:
    """Index profile: the same checks on the raw title, nothing repaired."""
    title = F.coalesce(F.col("title"), F.lit(""))
    places = dims.places.where(F.col("kind").isin("province", "district"))
    df = phrase_hits(df, key, bare_tokens(title), places, "_hits")
    names = F.array_distinct(F.transform(greedy_matches(F.col("_hits")), lambda h: h["words"]))
    count = (
        _hits(title, PHONES)
        + title.rlike(INDEX_SPECIAL).cast("int")
        + F.contains(F.lower(title), F.lit(BRANCH)).cast("int")
        + F.size(names)
        + _hits(title, INDEX_TITLE_PAY)
    )
    return with_violation(df, "title_index", count, MSG_TITLE_INDEX).drop("_hits")
