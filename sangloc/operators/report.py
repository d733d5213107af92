"""Reports over the violations table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sangloc.operators.similarity import top_k


def rule_report(violations: DataFrame, by: str = "source") -> DataFrame:
    """(rule_id, <by>, level, postings, errors): per rule and group, with totals.

    `level` is the grouping id: 0 rule and group, 1 rule, 3 everything.
    """
    return (
        violations.rollup("rule_id", by)
        .agg(F.grouping_id().alias("level"), F.count("*").alias("postings"), F.sum("count").alias("errors"))
        .select("rule_id", by, "level", "postings", "errors")
    )


def worst_postings(moderated: DataFrame, k: int, by: str = "source", key: str = "post_id") -> DataFrame:
    """Top k postings per group by number of errors."""
    return top_k(moderated.select(by, key, "num_error"), by, key, "num_error", k)


def threshold_curve(scores: DataFrame, labels: DataFrame, key: str, bucket: str, label: str) -> DataFrame:
    """(bucket, poor_and_bad, poor_but_good, precision, recall): what a rule that calls `bucket` and all above it poor would do.

    `bucket` is a score in steps, as many as one wants to compare; `label` is 1 for good and 0 for bad.  The rows are counted by
    bucket first, so that only one row for each bucket is summed up in order.  Rows without a bucket or a label do not count.
    """
    known = scores.join(labels.where(F.col(label).isin(0, 1)), key).where(F.col(bucket).isNotNull())
    counts = known.groupBy(bucket).agg(F.count_if(F.col(label) == 0).alias("bad"), F.count_if(F.col(label) == 1).alias("good"))
    above = Window.orderBy(F.col(bucket).desc())
    bad, good = F.sum("bad").over(above), F.sum("good").over(above)
    all_bad = F.sum("bad").over(Window.partitionBy())
    return counts.select(
        bucket,
        bad.alias("poor_and_bad"),
        good.alias("poor_but_good"),
        F.round(bad / (bad + good), 6).alias("precision"),
        F.round(F.try_divide(bad, all_bad), 6).alias("recall"),
    )


def rule_label_agreement(flags: DataFrame, labels: DataFrame, key: str, flag: str, label: str) -> DataFrame:
    """Confusion counts of a rule against a 0/1 label (1 = good)."""
    poor, good = F.col(flag), F.col(label) == 1
    return flags.join(labels, key).agg(
        F.count_if(poor & ~good).alias("poor_and_bad"),
        F.count_if(poor & good).alias("poor_but_good"),
        F.count_if(~poor & ~good).alias("fine_but_bad"),
        F.count_if(~poor & good).alias("fine_and_good"),
    )
