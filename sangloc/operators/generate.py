"""Arrays to rows.

A plain `explode` makes Catalyst add the filter `size(array) > 0` and push it below the
projections that compute the array, which evaluates those expressions again and, inside
lambdas, once per element.  The outer form with a filter on the result has no such cost.
Array elements here are never null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, keep: list[str | Column], array: Column | str, name: str) -> DataFrame:
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def inline_rows(df: DataFrame, keep: list[str | Column], array: Column | str, not_null: str) -> DataFrame:
    """One row per struct; `not_null` names a field that every struct fills."""
    return df.select(*keep, F.inline_outer(array)).where(F.col(not_null).isNotNull())
