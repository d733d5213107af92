"""Province and district lookups in postings and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sangloc.functions.address import UNIT_WORDS, bare_name, unit_code
from sangloc.functions.text import tokens
from sangloc.operators.generate import explode_rows
from sangloc.operators.joins import MAX_SET_ROWS, dim_join, is_small, rows_if_small
from sangloc.operators.lexicon import CONTENT, _grams, phrase_hits, with_content, words_of_longest


def resolve_province(
    df: DataFrame, name: Column, aliases: DataFrame, province: str = "named_province", code: str = "named_province_id"
) -> DataFrame:
    """Left join of a free-form province name to `province_alias(alias, province, province_id)`."""
    dim = aliases.select(
        F.lower("alias").alias("_alias"), F.col("province").alias(province), F.col("province_id").alias(code)
    ).dropDuplicates(["_alias"])
    return dim_join(df.withColumn("_alias", F.lower(F.trim(name))), dim, "_alias", sized=aliases).drop("_alias")


def match_province_in_address(
    df: DataFrame, key: str, address: Column, aliases: DataFrame, province: str = "address_province"
) -> DataFrame:
    """Province that a normalised address names: its last segment, or, in an address
    without commas, the last alias among its words."""
    has_comma = F.contains(address, F.lit(","))
    lexicon = aliases.select(F.lower("alias").alias("words"), F.lit("province").alias("kind"))
    loose = F.when(has_comma, F.array().cast("array<string>")).otherwise(tokens(address))
    df = phrase_hits(df, key, loose, lexicon, "_alias_hits")
    found = F.when(has_comma, F.element_at(F.split(address, ","), -1)).otherwise(
        F.try_element_at(F.transform("_alias_hits", lambda h: h["words"]), F.lit(-1))
    )
    return resolve_province(df, found, aliases, province, "_id").drop("_alias_hits", "_id")


def names_mapped(df: DataFrame, names: str, dim: DataFrame, out: str, max_rows: int = MAX_SET_ROWS) -> DataFrame:
    """Add `out`: the values of `dim(name, value)`, one row per name, for an array of names; unknown names give nothing.

    A dictionary proven small is one map value inside the row expression; a larger one is met by the exploded names.
    """
    dim = dim.where(F.col("name").isNotNull())
    listed = rows_if_small(dim.select("name", "value"), max_rows)
    if listed is not None:
        none = F.array().cast(found_type(dim))
        if not listed:
            return df.withColumn(out, none)
        known = F.create_map(*[x for r in sorted(listed, key=lambda r: r.name) for x in (F.lit(r.name), _literal(r.value))])
        found = F.filter(F.transform(names, lambda n: F.try_element_at(known, n)), lambda v: v.isNotNull())
        return df.withColumn(out, F.coalesce(F.array_distinct(found), none))
    df = with_content(df, names)
    rows = explode_rows(df, list(CONTENT), F.array_distinct(names), "name")
    found = dim_join(rows, dim, "name", "inner").groupBy(*CONTENT).agg(F.collect_set("value").alias(out))
    return df.join(found, list(CONTENT), "left").withColumn(out, F.coalesce(out, F.array().cast(found_type(dim)))).drop(*CONTENT)


def _literal(value: str | list | Row) -> Column:
    if isinstance(value, Row):
        return F.struct(*[_literal(v).alias(n) for n, v in value.asDict().items()])
    return F.array(*map(F.lit, sorted(value))) if isinstance(value, list) else F.lit(value)


def found_type(dim: DataFrame) -> T.ArrayType:
    return T.ArrayType(dim.schema["value"].dataType)


def province_names(aliases: DataFrame) -> DataFrame:
    """(name, value): each alias in lower case with one province, the smallest."""
    return aliases.groupBy(F.lower("alias").alias("name")).agg(F.min("province").alias("value"))


def district_names(district_province: DataFrame) -> DataFrame:
    """(name, value): each province with its districts in address form, with their codes and bare."""
    coded = district_province.select(F.col("province").alias("name"), unit_code(F.col("district")).alias("coded"))
    forms = coded.where("coded IS NOT NULL").withColumn("bare", bare_name(F.col("coded")))
    return forms.groupBy("name").agg(F.struct(F.collect_set("coded").alias("coded"), F.collect_set("bare").alias("bare")).alias("value"))


def district_key(province: Column, name: Column) -> Column:
    return F.concat_ws("\n", province, name)


def district_spellings(district_province: DataFrame) -> DataFrame:
    """(name, value): province and address form of each district, with and without its code, to its spelling."""
    coded = unit_code(F.col("district"))
    forms = district_province.where("district IS NOT NULL").select("province", "district", F.explode(F.array_distinct(F.array(coded, bare_name(coded)))).alias("form"))
    return forms.groupBy(district_key(F.col("province"), F.col("form")).alias("name")).agg(F.min("district").alias("value"))


def uses_unit_words(address: Column, raw_address: Column) -> Column:
    """Whether an address says which unit a name is, so that its districts carry their codes."""
    return F.lower(raw_address).rlike(UNIT_WORDS) | address.rlike(r"(^|[, ])[qtxh] ")


def with_place_candidates(df: DataFrame, address: str, district_province: DataFrame, out: str) -> DataFrame:
    """Add `out`: what may be a district in a normalised address, its segments or, without commas, its runs of words."""
    coded = district_province.select(unit_code(F.col("district")).alias("coded"))
    df = df.withColumn("_words", tokens(F.col(address)))
    runs = F.transform(_grams("_words", words_of_longest(coded, "coded")), lambda g: g["words"])
    return df.withColumn(out, F.when(F.contains(address, F.lit(",")), F.split(address, ",")).otherwise(runs)).drop("_words")


def match_district_of_province(
    df: DataFrame,
    key: str,
    address: Column,
    raw_address: Column,
    province: str,
    district_province: DataFrame,
    out: str = "address_districts",
    max_rows: int = MAX_SET_ROWS,
) -> DataFrame:
    """Add `out`: districts of the row's province that the address names, in address form.

    An address with unit words must name a district with its code (`q 1`, `h x`), one
    without them by the bare name.  Segments are compared whole; an address without
    commas is compared by its runs of words.
    """
    dim = district_province.select(
        F.col("province").alias("_p"), unit_code(F.col("district")).alias("coded")
    ).withColumn("bare", bare_name(F.col("coded")))
    coded_form = uses_unit_words(address, raw_address)
    df = df.withColumns({"_words": tokens(address), "_p": F.col(province), "_form": coded_form})
    candidates = F.when(F.contains(address, F.lit(",")), F.split(address, ",")).otherwise(
        F.transform(_grams("_words", words_of_longest(dim, "coded")), lambda g: g["words"])
    )
    if is_small(district_province, max_rows):
        by_province = dim.groupBy("_p").agg(
            F.collect_set("coded").alias("_coded"), F.collect_set("bare").alias("_bare")
        )
        df = df.join(F.broadcast(by_province), "_p", "left")
        listed = F.when(F.col("_form"), F.col("_coded")).otherwise(F.col("_bare"))
        df = df.withColumn(out, F.coalesce(F.array_intersect(candidates, listed), F.array().cast("array<string>")))
        return df.drop("_words", "_p", "_form", "_coded", "_bare")
    coded = dim.select("_p", F.lit(True).alias("_form"), F.col("coded").alias("name"))
    bare = dim.select("_p", F.lit(False).alias("_form"), F.col("bare").alias("name"))
    named = coded.unionByName(bare).distinct()
    df = with_content(df.withColumn("_names", F.array_distinct(candidates)), "_p", "_form", "_names")
    exploded = explode_rows(df, [*CONTENT, "_p", "_form"], "_names", "name")
    found = dim_join(exploded, named, ["_p", "_form", "name"], "left_semi").groupBy(*CONTENT).agg(F.collect_set("name").alias(out))
    # In the order of the address, as the small way gives them.
    placed = F.coalesce(F.array_intersect("_names", out), F.array().cast("array<string>"))
    return (
        df.join(found, list(CONTENT), "left")
        .withColumn(out, placed)
        .drop("_words", "_p", "_form", "_names", *CONTENT)
    )
