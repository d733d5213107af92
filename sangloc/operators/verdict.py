"""Error count, message map, verdict and repaired fields of a moderated posting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sangloc.operators.generate import inline_rows
from sangloc.operators.rules import numbered_lines

# Labels and texts of the verdict.
LABELS = tuple(f"Điều kiện {i}" for i in range(1, 13))
STATUS_TEXT = {
    0: "Trả lại cho NTD để sửa lại các lỗi ở phần message.",
    1: "Không gặp lỗi gì.",
    2: "Đã sửa lỗi tiêu đề ở điều kiện 9.",
    4: "Đã viết lại Tiêu đê hoặc Mô tả hoặc Quyền lợi hoặc Yêu cầu.",
}
MSG_NO_POSTING = "công ty không tồn tại"

# Label number -> rules under it; rules of one label that are counted at most once together.
RULES_OF_LABEL = {
    1: ("province_code",),
    2: ("nationwide", "address_detail", "multi_address", "address_missing"),
    3: ("employment_type",),
    4: ("hourly_wage",),
    5: ("many_workplaces", "negotiable_but_paid", "salary_absent", "many_salaries"),
    6: ("district_province",),
    7: ("company_banned_words",),
    8: ("company_form",),
    9: ("title_phone", "title_special", "title_branch", "title_place", "title_salary"),
    10: ("special_ratio",),
    11: ("title_body_mismatch",),
    12: ("poor_text",),
}
# The index profile compares pay and places in its own way, and does not repair titles.
LABELS_OF_PROFILE = {
    "posting": RULES_OF_LABEL,
    "index": RULES_OF_LABEL | {5: ("salary_conflict",), 6: ("district_province_index",), 9: ("title_index",)},
}
COUNTED_ONCE = (2, 12)
# Labels of one rule that may have several messages, which are numbered.
NUMBERED = (6,)
FIRST_STAGE = range(1, 9)
SECOND_STAGE = range(9, 13)


def _count(rule: str) -> Column:
    return F.col(f"{rule}_count")


def label_count(label: int, profile: str = "posting") -> Column:
    total = reduce(lambda a, b: a + b, [_count(r) for r in LABELS_OF_PROFILE[profile][label]])
    return F.least(total, F.lit(1)) if label in COUNTED_ONCE else total


def is_returned(profile: str = "posting") -> Column:
    """Sent back to the employer: the first-stage rules that cannot be repaired."""
    broken = reduce(lambda a, b: a | b, [label_count(i, profile) > 0 for i in (2, 3, 4, 5, 8)])
    return broken | (F.coalesce(F.col("company"), F.lit("")) == "")


def short_circuit(df: DataFrame, done: Column, costly, **defaults: Column) -> DataFrame:
    """Run `costly` on the rows that are not `done` and give the others `defaults`.

    For a costly branch with joins or Python; plain expressions need only `when`.  Both
    branches read `df`, so hand in a table or a checkpoint if making it is expensive.
    """
    done = F.coalesce(done, F.lit(False))
    skipped = df.where(done).withColumns(defaults)
    return costly(df.where(~done)).unionByName(skipped)


def status(returned: Column, profile: str = "posting") -> Column:
    """The index profile repairs no title, so a fault there leaves the posting as it is."""
    rewritten = (_count("special_ratio") == 1) | (label_count(11) > 0) | (label_count(12) > 0)
    titled = label_count(9) > 0 if profile == "posting" else F.lit(False)
    return F.when(returned, 0).when(rewritten, 4).when(titled, 2).otherwise(1).cast("int")


def status_text(status_col: Column) -> Column:
    pairs = [x for code, text in STATUS_TEXT.items() for x in (F.lit(code), F.lit(text))]
    return F.try_element_at(F.create_map(*pairs), status_col)


def num_error(returned: Column, profile: str = "posting") -> Column:
    first = reduce(lambda a, b: a + b, [label_count(i, profile) for i in FIRST_STAGE])
    second = reduce(lambda a, b: a + b, [label_count(i, profile) for i in SECOND_STAGE])
    return F.when(returned, first).otherwise(first + second).cast("int")


def message_map(returned: Column, profile: str = "posting") -> Column:
    """Label -> messages; several messages of a label become numbered lines, 9-12 stay empty if returned."""

    def text(label: int) -> Column:
        messages = [F.col(f"{r}_msg") for r in LABELS_OF_PROFILE[profile][label]]
        lines = numbered_lines(messages) if len(messages) > 1 or label in NUMBERED else messages[0]
        return F.when(returned, "").otherwise(lines) if label in SECOND_STAGE else lines

    return F.map_from_arrays(F.array(*map(F.lit, LABELS)), F.array(*[text(i) for i in range(1, 13)]))


def verdict(df: DataFrame, profile: str = "posting") -> DataFrame:
    """Add num_error, status, status_text and messages to a table with all rule columns of the profile."""
    df = df.withColumn("returned", is_returned(profile))
    returned = F.col("returned")
    df = df.withColumns(
        {"num_error": num_error(returned, profile), "status": status(returned, profile), "messages": message_map(returned, profile)}
    )
    return df.withColumn("status_text", status_text(F.col("status")))


REPAIRED = {
    "title": "title_fixed",
    "description": "description_fixed",
    "requirements": "requirements_fixed",
    "benefits": "benefits_fixed",
    "city_codes": "city_codes_fixed",
    "district": "district_fixed",
    "address": "address_fixed",
}


def repaired_fields(df: DataFrame, key: str = "post_id") -> DataFrame:
    """(key, field, original, repaired): one row per field that the rules changed."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(name).alias("field"),
                F.col(name).cast("string").alias("original"),
                F.coalesce(F.col(fixed).cast("string"), F.col(name).cast("string")).alias("repaired"),
            )
            for name, fixed in REPAIRED.items()
            if fixed in df.columns
        ]
    )
    changed = F.filter(pairs, lambda p: ~p["original"].eqNullSafe(p["repaired"]))
    return inline_rows(df, [key], changed, "field")


def violations(df: DataFrame, key: str = "post_id", *keep: str) -> DataFrame:
    """(key, kept columns, rule_id, count, message): the long form, one row per violated rule.

    Of a label that counts once, every violated part is a row; elsewhere the counts of a posting sum up to `num_error`.
    """
    rows = F.array(
        *[
            F.struct(
                F.lit(r).alias("rule_id"), _count(r).alias("count"), F.col(f"{r}_msg").alias("message")
            )
            for r in dict.fromkeys(r for labels in LABELS_OF_PROFILE.values() for rules in labels.values() for r in rules)
            if f"{r}_count" in df.columns
        ]
    )
    return inline_rows(df, [key, *keep], F.filter(rows, lambda x: x["count"] > 0), "rule_id")
