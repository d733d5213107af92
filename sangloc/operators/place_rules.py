"""Rules R1, R2 and R6: province code, address detail, district and province."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sangloc.functions.address import (
    SPELLINGS,
    _replace_all,
    bare_name,
    normalize_address,
    strip_place_suffix,
    unit_code,
)
from sangloc.functions.text import fold_accents, strip_phrase, tokens
from sangloc.operators.places import (
    district_key,
    district_names,
    district_spellings,
    match_district_of_province,
    match_province_in_address,
    names_mapped,
    province_names,
    resolve_province,
    uses_unit_words,
    with_place_candidates,
)
from sangloc.operators.rules import Dictionaries, rule, step, text_or_empty, with_violation

# Phrases, word lists and messages of the place rules.
NATIONWIDE = "toàn quốc"
NATIONWIDE_ADDRESSES = ("toàn quốc", "tuyển dụng toàn quốc")
NATIONWIDE_PHRASE = "(tuyển dụng )?toàn quốc"
BUILDING_WORDS = "tòa|khu|kcn|cụm|ccn|lô|chung cư|plaza|tầng|lầu|số"
UNIT_NUMBERS = r"(phường|quận|p|q)[ .][0-9]{1,2}"
LOCATION_WORDS = (
    "thành phố|quận|phường|huyện|thị trấn|thị xã|khu phố|tòa nhà|toà nhà|tòa|toà|số nhà|"
    "số|tỉnh|thôn|tầng|lầu|đường|xã|ấp|tổ|tp|q,|p,"
)
MANY_ADDRESS_WORDS = ("và", "hoặc")
MSG_BAD_PROVINCE = "Tỉnh thành không hợp lệ"
MSG_NO_PROVINCE = "Không tồn tại tỉnh thành"
MSG_ADDRESS_NATIONWIDE = "Bản tin không được phép có địa chỉ ở toàn quốc"
MSG_PROVINCE_NATIONWIDE = "Tỉnh thành phải cụ thể, không được là toàn quốc"
MSG_NO_DETAIL = "Địa chỉ không chi tiết"
MSG_MANY_ADDRESSES = "Có nhiều địa chỉ chi tiết"
MSG_NO_ADDRESS = "Không có địa chỉ công ty hoặc địa chỉ không đầy đủ dấu câu"
MSG_MANY_DISTRICTS = "Có nhiều quận huyện"
MSG_NO_PLACE = "Không có quận huyện, không có tỉnh thành"
MSG_UNKNOWN_PROVINCE = "Không có tỉnh thành"
MSG_OTHER_PROVINCE = "Tỉnh không khớp"
MSG_DISTRICT_ABSENT = "Không có quận huyện mục quận huyện trong địa chỉ chi tiết"
MSG_OTHER_DISTRICT = "Vi phạm quận huyện do quận huyện trong mục quận huyện khác trong địa chỉ chi tiết"


@rule("province_code", reads=("province", "city_codes"), makes=("city_codes_fixed",))
def rule_province_code(df: DataFrame, dims: Dictionaries) -> DataFrame:
    """Any code outside 1-63, or none; `city_codes_fixed` takes the named province's id."""
    df = resolve_province(df, F.col("province"), dims.province_alias, "_name", "_id")
    bad = F.size(
        F.filter(
            F.split("city_codes", ","), lambda x: ~F.coalesce(F.trim(x).try_cast("int").between(1, 63), F.lit(False))
        )
    )
    known = F.col("_id").isNotNull()
    count = F.when(F.col("city_codes").isNull(), 1).when(known | (bad == 0), bad).otherwise(1)
    message = (
        F.when(F.col("city_codes").isNull(), MSG_NO_PROVINCE).when(~known, MSG_BAD_PROVINCE).otherwise("")
    )
    df = with_violation(df, "province_code", count, message)
    fixed = F.when((F.col("province_code_count") > 0) & known, F.col("_id").cast("string"))
    return df.withColumn("city_codes_fixed", F.coalesce(fixed, F.col("city_codes"))).drop("_name", "_id")


def own_place(df: DataFrame, name: str) -> Column:
    """A posting's own name for its province or district, where it has such a field."""
    return F.coalesce(f"place_{name}", name, F.lit("")) if f"place_{name}" in df.columns else text_or_empty(name)


@step(("address", "province", "district"), ("address_detail",))
def with_address_detail(df: DataFrame) -> DataFrame:
    """Add `address_detail`: what is left of the address without its places.

    The places are the posting's own names for them, where it has these fields.
    """
    own = {c: own_place(df, c) for c in ("province", "district")}
    df = df.withColumn("_addr", normalize_address(strip_phrase(text_or_empty("address"), NATIONWIDE_PHRASE)))
    detail = strip_place_suffix(F.col("_addr"), own["province"], own["district"])
    return df.withColumn("address_detail", detail).drop("_addr")


@rule("nationwide", reads=("address", "province"))
def rule_nationwide(df: DataFrame) -> DataFrame:
    in_address = F.lower(F.trim(text_or_empty("address"))).isin(*NATIONWIDE_ADDRESSES)
    in_province = F.contains(F.lower(text_or_empty("province")), F.lit(NATIONWIDE))
    message = F.concat_ws(
        "\n", F.when(in_address, F.lit(MSG_ADDRESS_NATIONWIDE)), F.when(in_province, F.lit(MSG_PROVINCE_NATIONWIDE))
    )
    return with_violation(df, "nationwide", in_address | in_province, message)


@rule("address_detail", reads=("address_detail",))
def rule_address_detail(df: DataFrame) -> DataFrame:
    """No building word or number in the first segments of `address_detail`."""
    parts = F.split("address_detail", ",")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    digit = "[0-9]"
    vague = ~first.rlike(digit) & ~second.rlike(f"{digit}|số") & (F.size(parts) < 4)
    numbered = F.regexp_replace(first, UNIT_NUMBERS, " ").rlike(digit)
    violated = ~first.rlike(BUILDING_WORDS) & F.when(F.size(parts) > 1, vague).otherwise(~numbered)
    return with_violation(df, "address_detail", violated, MSG_NO_DETAIL)


def _no_accents(detail: Column) -> Column:
    return (detail == "") | (detail == fold_accents(detail))


@rule("multi_address", reads=("address_detail",))
def rule_multi_address(df: DataFrame) -> DataFrame:
    detail = F.col("address_detail")
    words = tokens(F.translate(F.regexp_replace(detail, LOCATION_WORDS, ""), ",", " "))
    both = F.arrays_overlap(words, F.array(*map(F.lit, MANY_ADDRESS_WORDS)))
    return with_violation(df, "multi_address", ~_no_accents(detail) & both, MSG_MANY_ADDRESSES)


@rule("address_missing", reads=("address_detail",))
def rule_address_missing(df: DataFrame) -> DataFrame:
    return with_violation(df, "address_missing", _no_accents(F.col("address_detail")), MSG_NO_ADDRESS)


def _with_address(df: DataFrame, district: Column) -> DataFrame:
    """Add `_addr`, the address in the form that places are looked up in, and `_own`, the declared district in it."""
    address = _replace_all(normalize_address(text_or_empty("address")), SPELLINGS)
    return df.withColumns({"_addr": F.regexp_replace(address, ",việt nam$", ""), "_own": unit_code(district)})


def _place_faults(df: DataFrame, name: str, missing: Column, same: Column, known: Column) -> DataFrame:
    """Count and messages of the declared places against those of the address, and `_asks_other` where these name another district.

    Reads `_addr`, `_own`, `_in_address` (the province of the address) and `_named` (its districts, of the declared province);
    `same` tells whether the provinces agree, `known` whether the declared one is in the dictionary.
    """
    addr, own = F.col("_addr"), F.col("_own")
    parts = F.split(addr, ",")
    short = F.substring(own, F.lit(3), F.length(own))
    present = F.when(
        F.contains(addr, F.lit(",")), F.array_contains(parts, own) | F.array_contains(parts, short)
    ).otherwise(F.contains(addr, own) | F.contains(addr, short))
    df = df.withColumns(
        {
            "_many": F.contains(own, F.lit(",")),
            "_missing": missing,
            "_absent": ~present,
            "_same": F.coalesce(same, F.lit(False)),
            "_known": known,
            "_others": F.size(F.filter("_named", lambda d: ~d.isin(own, bare_name(own)))),
        }
    )
    checked, has_province = ~F.col("_missing"), F.col("_in_address").isNotNull()
    absent = checked & has_province & F.col("_same") & F.col("_absent")
    elsewhere = checked & has_province & ~F.col("_same")
    other = F.when(checked & ~has_province, F.col("_others")).otherwise(0)
    unknown = checked & ~has_province & ~F.col("_known")
    count = (
        F.col("_many").cast("int") + F.col("_missing").cast("int") + absent.cast("int")
        + elsewhere.cast("int") + unknown.cast("int") + other
    )
    message = F.concat_ws(
        "\n",
        F.when(F.col("_many"), F.lit(MSG_MANY_DISTRICTS)),
        F.when(F.col("_missing"), F.lit(MSG_NO_PLACE)),
        F.when(absent, F.lit(MSG_DISTRICT_ABSENT)),
        F.when(elsewhere, F.lit(MSG_OTHER_PROVINCE)),
        F.when(unknown, F.lit(MSG_UNKNOWN_PROVINCE)),
        F.when(other > 0, F.lit(MSG_OTHER_DISTRICT)),
    )
    df = with_violation(df, name, count, message).withColumn("_asks_other", absent | (other > 0))
    return df.drop("_many", "_missing", "_absent", "_same", "_known", "_others")


@rule("district_province", reads=("address", "province", "district"), makes=("district_fixed",))
def rule_district_province(df: DataFrame, dims: Dictionaries, key: str = "post_id") -> DataFrame:
    """Declared district and province against the address; `district_fixed` suggests one.

    The suggestion is the last district of the declared province that a listed address names besides the declared one, as
    the dictionary spells it; without one `district_fixed` keeps the declared district.
    """
    df = _with_address(df, text_or_empty("district"))
    df = resolve_province(df, F.col("province"), dims.province_alias, "_declared", "_declared_id")
    df = match_province_in_address(df, key, F.col("_addr"), dims.province_alias, "_in_address")
    df = match_district_of_province(
        df, key, F.col("_addr"), text_or_empty("address"), "_declared", dims.district_province, "_named"
    )
    missing = (F.col("_own") == "") | (text_or_empty("province") == "")
    df = _place_faults(df, "district_province", missing, F.col("_in_address") == F.col("_declared"), F.col("_declared").isNotNull())
    asked = F.col("_asks_other") & F.contains("_addr", F.lit(","))
    last = F.try_element_at(F.filter("_named", lambda d: ~d.isin(F.col("_own"), bare_name(F.col("_own")))), F.lit(-1))
    spelled = F.when(asked & last.isNotNull(), F.array(district_key(F.col("_declared"), last))).otherwise(F.array().cast("array<string>"))
    df = names_mapped(df.withColumn("_last", spelled), "_last", district_spellings(dims.district_province), "_spelled")
    return df.withColumn("district_fixed", F.coalesce(F.get("_spelled", F.lit(0)), F.col("district"))).drop(
        "_addr", "_own", "_declared", "_declared_id", "_in_address", "_named", "_asks_other", "_last", "_spelled"
    )


@rule("district_province_index", "index", reads=("address", "province", "district"))
def rule_district_province_index(df: DataFrame, dims: Dictionaries, key: str = "post_id") -> DataFrame:
    """Index profile of the same rule: the posting's own place fields, and any of several provinces will do.

    `place_province` may list provinces with commas; the address has to be in one of them, and a district that it names is
    compared if it belongs to one of them.  Nothing is suggested.  Null and empty fields count as missing.
    """
    df = _with_address(df, own_place(df, "district"))
    names = F.filter(F.transform(F.split(F.lower(own_place(df, "province")), ","), lambda n: F.trim(n)), lambda n: n != "")
    df = names_mapped(df.withColumn("_names", names), "_names", province_names(dims.province_alias), "_declared")
    df = match_province_in_address(df, key, F.col("_addr"), dims.province_alias, "_in_address")
    df = names_mapped(df, "_declared", district_names(dims.district_province), "_districts")
    coded = uses_unit_words(F.col("_addr"), text_or_empty("address"))
    listed = F.flatten(F.transform("_districts", lambda d: F.when(coded, d["coded"]).otherwise(d["bare"])))
    df = with_place_candidates(df, "_addr", dims.district_province, "_candidates")
    df = df.withColumn("_named", F.array_intersect("_candidates", F.coalesce(listed, F.array().cast("array<string>"))))
    missing = (F.col("_own") == "") | (F.size("_names") == 0)
    df = _place_faults(df, "district_province_index", missing, F.array_contains("_declared", F.col("_in_address")), F.size("_declared") > 0)
    return df.drop("_addr", "_own", "_names", "_declared", "_in_address", "_districts", "_candidates", "_named", "_asks_other")
