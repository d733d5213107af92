"""Pay extraction over the sections of a posting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sangloc.functions.money import amounts, money_text
from sangloc.functions.text import html_to_text
from sangloc.operators.generate import inline_rows

UNITS = ("vnd", "usd", "vnd/hour", "vnd/day")


def extract_salary(sections: DataFrame, text: str = "text") -> DataFrame:
    """(..., unit, n_amounts, min_pay, max_pay): one row per section and unit found.

    Lowest and highest amounts are taken inside the row, so nothing is shuffled.
    """
    found = sections.withColumn("_squashed", money_text(html_to_text(F.col(text)))).withColumn(
        "_found", amounts(F.col("_squashed"))
    )

    def summary(unit: str):
        same = F.filter("_found", lambda a: a["unit"] == unit)
        return F.struct(
            F.lit(unit).alias("unit"),
            F.size(same).alias("n_amounts"),
            F.array_min(F.transform(same, lambda a: a["low"])).alias("min_pay"),
            F.array_max(F.transform(same, lambda a: a["high"])).alias("max_pay"),
        )

    rows = F.filter(F.array(*[summary(u) for u in UNITS]), lambda s: s["n_amounts"] > 0)
    keep = [c for c in sections.columns if c != text]
    return inline_rows(found, keep, rows, "unit")
