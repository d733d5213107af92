"""Rewriting as table jobs: the queue of texts to rewrite, parsing and merging the answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sangloc.functions.text import strip_special, trim_space, wrap_html
from sangloc.operators.generate import inline_rows

# Prompts, headings of the queue and headings of an answer.
PROMPT_WITH_TITLE = (
    "Bản tin sau gồm các phần Tiêu đề, Mô tả, Yêu cầu, Quyền lợi (có thể thiếu một vài trong các phần do các "
    "phần đó đã đạt yêu cầu) cần được viết lại do nội dung sơ sài, lôm côm. Trong đó phần Tiêu đề và Mô tả đang "
    "không liên quan đến nhau. Hãy viết lại các phần sao ngắn gọn, súc tích và rõ nghĩa, tiêu đề và mô tả phải "
    "liên quan đến nhau và đảm bảo đầy đủ, đúng các thông tin so với bản tin ban đầu:"
)
PROMPT_WITHOUT_TITLE = (
    "Bản tin sau gồm các phần Mô tả, Yêu cầu, Quyền lợi (có thể thiếu một vài trong các phần do các phần đó đã "
    "đạt yêu cầu) cần được viết lại do nội dung sơ sài, lôm côm. Hãy viết lại các phần sao ngắn gọn, súc tích, rõ "
    "nghĩa và đảm bảo đầy đủ, đúng các thông tin so với bản tin ban đầu:"
)
HEADINGS = {"title": "Tiêu đề", "description": "Mô tả", "requirements": "Yêu cầu", "benefits": "Quyền lợi"}
HEADING_NAMES = r"Tiêu\s+đề|Mô\s+tả\s+công\s+việc|Mô\s+tả|Yêu\s+cầu\s+ứng\s+viên|Yêu\s+cầu|Quyền\s+lợi"
HEADING_MARKS = r"(?:\s*\*\*|\s*:\s*\*?\*?)?\s*"
FIELD_OF_HEADING = {
    "tiêu đề": "title",
    "mô tả công việc": "description",
    "mô tả": "description",
    "yêu cầu ứng viên": "requirements",
    "yêu cầu": "requirements",
    "quyền lợi": "benefits",
}
NO_HEADING = "Không tìm thấy bất kỳ phần Tiêu đề/Mô tả/Yêu cầu/Quyền lợi nào trong văn bản."


def rewrite_queue(df: DataFrame, key: str = "post_id") -> DataFrame:
    """(key, with_title, prompt): one row per posting with a failing part.

    `df` holds the four texts and the flags `title_fails` (title does not match the
    description: both go in) and `<section>_poor`.
    """
    with_title = F.col("title_fails")
    wanted = {
        "title": with_title,
        "description": with_title | F.col("description_poor"),
        "requirements": F.col("requirements_poor"),
        "benefits": F.col("benefits_poor"),
    }
    parts = [
        F.when(wanted[f], F.concat(F.lit(f"{HEADINGS[f]}:\n"), F.coalesce(F.col(f), F.lit("")))) for f in HEADINGS
    ]
    needed = wanted["description"] | wanted["requirements"] | wanted["benefits"]
    head = F.when(with_title, PROMPT_WITH_TITLE).otherwise(PROMPT_WITHOUT_TITLE)
    return df.where(needed).select(
        key, with_title.alias("with_title"), F.concat_ws("\n", head, *parts).alias("prompt")
    )


def _cut_after(c: Column, delimiter: str) -> Column:
    head = F.substring_index(c, delimiter, 1)
    return F.when(F.contains(c, F.lit(delimiter)), F.regexp_replace(head, r"\s+$", "")).otherwise(c)


def parse_rewrite(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, pos, heading, content, error): sections of an answer, in order of appearance.

    A later section with the same heading (same spelling) replaces an earlier one.  The
    last heading's content also ends at a blank line.  An answer without headings gives
    one row with an error.
    """
    pattern = rf"(?iu){HEADING_NAMES}"
    full = rf"(?iu)(?:{HEADING_NAMES}){HEADING_MARKS}"
    df = df.withColumn("_names", F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).withColumn(
        "_bodies", F.split(F.col(text), full)
    )
    found = F.transform(
        "_names",
        lambda name, i: F.struct(
            (i + 1).alias("pos"),
            name.alias("heading"),
            strip_special(_cut_after(trim_space(F.get(F.col("_bodies"), i + 1)), "---")).alias("content"),
        ),
    )
    # a repeated heading keeps its first place and takes its last content
    df = df.withColumn("_found", found)
    kept = F.transform(
        F.array_distinct(F.transform("_found", lambda s: s["heading"])),
        lambda h, i: F.struct(
            (i + 1).alias("pos"),
            h.alias("heading"),
            F.element_at(F.filter(F.col("_found"), lambda s: s["heading"] == h), -1)["content"].alias("content"),
        ),
    )
    df = df.withColumn("_kept", kept)
    last = F.size("_kept")
    rows = F.transform(
        "_kept",
        lambda s: F.struct(
            s["pos"].alias("pos"),
            s["heading"].alias("heading"),
            F.when(s["pos"] == last, _cut_after(s["content"], "\n\n")).otherwise(s["content"]).alias("content"),
            F.lit(None).cast("string").alias("error"),
        ),
    )
    none = F.array(
        F.struct(
            F.lit(0).alias("pos"),
            F.lit(None).cast("string").alias("heading"),
            F.lit(None).cast("string").alias("content"),
            F.lit(NO_HEADING).alias("error"),
        )
    )
    return inline_rows(df, list(keys), F.when(last > 0, rows).otherwise(none), "pos")


def rewritten_fields(parsed: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row per posting with the new field values.

    Headings match without regard to case but must start with a capital.  The short
    spelling of a heading (`Mô tả`) wins over the long one (`Mô tả công việc`).  Where a posting has several answers,
    numbered by `order`, a field comes from the latest one that has it.
    """
    latest = F.lit(0) if order is None else F.col(order)
    heading = F.regexp_replace(F.lower("heading"), r"\s+", " ")
    pairs = [x for name, field in FIELD_OF_HEADING.items() for x in (F.lit(name), F.lit(field))]
    usable = parsed.where(F.col("error").isNull() & F.col("heading").rlike(r"^\p{Lu}") & (F.col("content") != ""))
    ranked = usable.select(
        key,
        F.try_element_at(F.create_map(*pairs), heading).alias("field"),
        F.struct(latest.alias("latest"), (-F.length(heading)).alias("short"), (-F.col("pos")).alias("early"), F.col("content")).alias("best"),
    )
    return (
        ranked.groupBy(key)
        .pivot("field", list(HEADINGS))
        .agg(F.max("best")["content"])
    )


def merge_rewrite(df: DataFrame, parsed: DataFrame, key: str = "post_id", order: str | None = None) -> DataFrame:
    """Put rewritten sections back, wrapped as HTML; a missing or empty one keeps the original.

    `order` names the column that numbers a posting's answers, if it may have several.
    """
    fields = list(HEADINGS)
    new = rewritten_fields(parsed, key, order).select(key, *[wrap_html(F.col(f)).alias(f"_{f}") for f in fields])
    merged = df.join(new, key, "left")
    return merged.withColumns({f: F.coalesce(F.col(f"_{f}"), F.col(f)) for f in fields}).drop(*[f"_{f}" for f in fields])
