"""Posting envelopes: nested JSON in, flat rows out; rows without a posting aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sangloc.operators.verdict import MSG_NO_POSTING, STATUS_TEXT

# What a reader keeps of an envelope that is no JSON of the envelope's shape.
CORRUPT = "_corrupt_record"
UNREADABLE = "the envelope is not readable JSON"

# The posting's field names; all are strings or null.
POSTING_FIELDS = (
    "new_id new_title new_alias cat_name new_cat_id new_lv new_addr new_city cit_name new_qh_id new_user_id "
    "new_money new_cap_bac new_exp new_bang_cap new_gioi_tinh new_so_luong new_hinh_thuc new_update_time "
    "new_view_count new_han_nop new_hot new_tgtv new_images new_video new_video_type new_mota new_yeucau "
    "new_quyenloi new_hoahong new_do new_ho_so usc_logo usc_company usc_address usc_create_time chat365_id "
    "nm_type nm_id nm_min_value nm_max_value nm_unit new_create_time new_exp_text new_hinh_thuc_text "
    "new_bang_cap_text cat_name_full new_money_str text_bang_cap key_id new_name_cit new_name_qh "
    "new_quanhuyen_id_ saved applied"
).split()

_STRINGS = T.ArrayType(T.StringType())

POSTING = T.StructType([T.StructField(f, T.StringType()) for f in POSTING_FIELDS])

ENVELOPE = T.StructType(
    [
        T.StructField(
            "data",
            T.StructType(
                [
                    T.StructField("result", T.BooleanType()),
                    T.StructField("message", T.StringType()),
                    T.StructField("data", POSTING),
                    T.StructField("error", T.StringType()),
                ]
            ),
        ),
        *[T.StructField(f, _STRINGS) for f in ("dia_diem", "chuc_danh", "tu_khoa", "list_img", "list_vd", "list_link")],
    ]
)

# Posting fields as the rules name them.
RULE_COLUMNS = {
    "post_id": "new_id",
    "title": "new_title",
    "description": "new_mota",
    "requirements": "new_yeucau",
    "benefits": "new_quyenloi",
    "city_codes": "new_city",
    "province": "cit_name",
    "district": "new_qh_id",
    "place_province": "new_name_cit",
    "place_district": "new_name_qh",
    "address": "usc_address",
    "company": "usc_company",
    "employment": "new_hinh_thuc_text",
    "money_str": "new_money_str",
}


def parse_envelope(df: DataFrame, column: str) -> DataFrame:
    """JSON text -> `has_posting`, the posting's fields and the keyword lists."""
    parsed = df.withColumn("_e", F.from_json(column, ENVELOPE))
    return _flatten(parsed.select(*df.columns, "_e.*"), df.columns).drop(column)


def read_postings(spark: SparkSession, path: str | list[str], format: str = "json") -> DataFrame:
    """One envelope per file (`json`) or per line (`jsonl`, which splits large files) -> one flat row each.

    An unreadable envelope is a row of its own with its text in `corrupt`.
    """
    if format not in ("json", "jsonl"):
        raise ValueError(f"format is json or jsonl, not {format}")
    schema = T.StructType([*ENVELOPE.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", format == "json")
    raw = reader.json(path).withColumns({"file_name": F.col("_metadata.file_name"), "corrupt": F.col(CORRUPT)})
    return _flatten(raw, ["file_name", "corrupt"])


def _flatten(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(
        *keep,
        F.col("data.data").isNotNull().alias("has_posting"),
        "data.data.*",
        "dia_diem",
        "chuc_danh",
        "tu_khoa",
    )


def rule_columns(df: DataFrame) -> DataFrame:
    """Add the rules' column names; the posting's own fields pass through."""
    return df.withColumns({ours: F.col(theirs) for ours, theirs in RULE_COLUMNS.items()})


def quarantine(df: DataFrame, has_posting: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with a posting, result rows for those without).

    `error` tells an unreadable envelope, where the reader has kept one, from one without a posting.
    """
    unreadable = F.col("corrupt").isNotNull() if "corrupt" in df.columns else F.lit(False)
    missing = df.where(~has_posting).withColumns(
        {
            "num_error": F.lit(-1),
            "status": F.lit(0),
            "status_text": F.lit(STATUS_TEXT[0]),
            "message": F.when(~unreadable, MSG_NO_POSTING),
            "error": F.when(unreadable, UNREADABLE),
        }
    )
    return df.where(has_posting), missing
