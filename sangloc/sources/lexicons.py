"""Dictionary tables from files and mappings."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sangloc.functions.text import trim_space


def distinct_words(lines: DataFrame, column: str = "value") -> DataFrame:
    word = trim_space(F.col(column))
    return lines.select(word.alias("word")).where(F.col("word") != "").dropDuplicates()


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Line file -> distinct `word` table."""
    return distinct_words(spark.read.text(path))


def lexicon_from_map(
    spark: SparkSession, rows: Mapping[str, Iterable[str]], key: str = "term", value: str = "related_term"
) -> DataFrame:
    """A mapping of sets -> long (key, value) table, one row per pair."""
    nested = spark.createDataFrame([(k, sorted(set(v))) for k, v in rows.items()], f"{key} string, v array<string>")
    return long_lexicon(nested, key, "v", value)


def long_lexicon(nested: DataFrame, key: str, values: str, value: str) -> DataFrame:
    """Array column -> one distinct row per (key, value)."""
    return nested.select(key, F.explode(values).alias(value)).dropDuplicates()


def phrase_table(names: DataFrame, column: str, kind: str) -> DataFrame:
    """(words, n_words, kind) from a column of names."""
    words = F.lower(F.regexp_replace(trim_space(F.col(column)), r"\s+", " "))
    return (
        names.select(words.alias("words"), F.lit(kind).alias("kind"))
        .dropDuplicates()
        .select("words", F.size(F.split("words", " ")).alias("n_words"), "kind")
    )
