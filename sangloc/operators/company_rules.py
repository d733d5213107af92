"""Rules R3, R7 and R8: employment type and company name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sangloc.operators.rules import rule, text_or_empty, with_violation

# Keywords and messages of the company rules.
PART_TIME_WORDS = ("bán thời gian", "việc làm từ xa", "parttime", "học việc")
BANNED_COMPANY_WORDS = ("tuyển dụng", "tìm việc làm", "việc làm")
COMPANY_FORMS = (
    "công ty cổ phần", "công ty cp", "công ty", "tập đoàn", "trung tâm", "hệ thống",
    "cty", "group", "tnhh", "bất động sản", "shinhan fc", "aliexpress",
)
MSG_FULL_TIME_ONLY = "Chỉ chấp nhận toàn thời gian"
MSG_NO_COMPANY = "Không rõ công ty"
MSG_COMPANY_UNCLEAR = "Tên công ty không rõ ràng"


@rule("employment_type", reads=("employment",))
def rule_employment_type(df: DataFrame) -> DataFrame:
    kind = F.regexp_replace(F.lower(text_or_empty("employment")), r"[^\p{L}\p{N}\s\p{Z}]", "")
    return with_violation(df, "employment_type", kind.rlike("|".join(PART_TIME_WORDS)), MSG_FULL_TIME_ONLY)


def _keywords_in(name, words):
    return sum((F.contains(name, F.lit(w)).cast("int") for w in words), F.lit(0))


@rule("company_banned_words", reads=("company",))
def rule_company_banned_words(df: DataFrame) -> DataFrame:
    """Number of banned words; an empty name counts once and is the only case with a message."""
    name = F.lower(text_or_empty("company"))
    count = _keywords_in(name, BANNED_COMPANY_WORDS) + (name == "").cast("int")
    return with_violation(df, "company_banned_words", count, F.when(name == "", MSG_NO_COMPANY).otherwise(""))


@rule("company_form", reads=("company",))
def rule_company_form(df: DataFrame) -> DataFrame:
    """Fewer than two company-form keywords."""
    name = F.lower(text_or_empty("company"))
    return with_violation(df, "company_form", _keywords_in(name, COMPANY_FORMS) < 2, MSG_COMPANY_UNCLEAR)
