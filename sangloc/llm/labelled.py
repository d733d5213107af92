"""What the classifiers of this folder learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sangloc.llm.common import is_held_out

#: A classifier learns from about this many labelled rows, chosen by the hash of their key.
FIT_ROWS = 50_000


def sample(rows: DataFrame, key: str, fit_rows: int) -> DataFrame:
    """All rows that may be learned from, or about `fit_rows` of them where there are more.

    The choice depends on the key's hash alone, so a lost task draws the same rows again.
    """
    usable = rows.where(F.col(key).isNotNull() & ~is_held_out(F.col(key)))
    total = usable.count()
    if total <= fit_rows:
        return usable
    return usable.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1_000_000 * fit_rows / total))


def labelled_texts(
    docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS
) -> DataFrame:
    """(text, label 0 or 1) of a bounded sample; keys with contradicting or null labels are left out.

    The sample of keys is broadcast: it has about `fit_rows` rows at most.
    """
    known = labels.groupBy(key).agg(F.min(label).alias("label"), F.max(label).alias("_max"))
    known = known.where((F.col("label") == F.col("_max")) & F.col("label").isin(0, 1)).select(key, "label")
    chosen = sample(known, key, fit_rows)
    return docs.select(key, F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), key).select("text", "label")
