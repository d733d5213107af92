"""Joins against dimension tables that stay safe when the dimension or one key grows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

# Rows up to which a word list becomes a hash set inside the row expression.
MAX_SET_ROWS = 2_000
# Rows up to which a dimension is broadcast.
MAX_BROADCAST_ROWS = 200_000


def is_small(dim: DataFrame, max_rows: int) -> bool:
    """Count at most `max_rows + 1` rows to prove that a dimension is bounded."""
    return dim.limit(max_rows + 1).count() <= max_rows


def rows_if_small(dim: DataFrame, max_rows: int) -> list[Row] | None:
    """The rows of a dimension, or None if it has more than `max_rows`."""
    rows = dim.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def dim_join(
    rows: DataFrame,
    dim: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    max_rows: int = MAX_BROADCAST_ROWS,
    sized: DataFrame | None = None,
) -> DataFrame:
    """Broadcast a dimension proven small; otherwise leave the strategy to Catalyst and AQE.

    `sized` is what is counted: the source of `dim`, where that has at least as many rows
    and costs less to count.
    """
    small = is_small(dim if sized is None else sized, max_rows)
    return rows.join(F.broadcast(dim) if small else dim, on, how)


def hot_rows(dim: DataFrame, weight: str, most: int = 50_000) -> DataFrame:
    """The rows of a dimension that hold more than 1/`most` of all its weight: fewer than `most`, whatever the data."""
    total = dim.agg(F.sum(weight).alias("total")).scalar()
    return dim.where(F.col(weight) * most > total)


def skew_join(
    rows: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    weight: str,
    how: str = "inner",
    hot_share: float = 0.001,
    salts: int = 64,
) -> DataFrame:
    """Equi-join to a large dimension whose `weight` column counts the matching `rows` per key.

    A key holding more than `hot_share` of all rows is hot, so there are at most
    1/hot_share hot keys whatever the data: that list may be broadcast.  Hot rows get a
    random-looking salt and the dimension repeats its hot rows once per salt; all other
    rows join on salt 0.  `dim` must have one row per key.
    """
    keys = list(keys)
    total = dim.agg(F.sum(weight).alias("total")).scalar()
    hot = F.col(weight) > F.lit(hot_share) * total
    hot_keys = dim.where(hot).select(*keys, F.lit(True).alias("_hot"))
    spread = F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    salted_dim = dim.withColumn("_salt", spread)
    others = [c for c in rows.columns if c not in keys]
    salted_rows = rows.join(F.broadcast(hot_keys), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*others), F.lit(salts)).cast("int")).otherwise(0)
    )
    return salted_rows.join(salted_dim.drop(weight), [*keys, "_salt"], how).drop("_salt", "_hot")
