"""The corpus pipeline: documents to tokens, in five stages.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame; it is written to the shared folder and read
again as the next one's docs.  All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sangloc.llm import bpe, leakage, line_spread, quality, shingle_join
from sangloc.llm.common import removed, staged, table


def quality_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents that the quality classifier does not reject.

    It learns from the labelled documents among `docs`; without labels of both classes nothing is rejected.
    """
    return quality.kept(docs, quality.fit(docs, table(spark, folder, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents without cross-site boilerplate lines; a document that was nothing else goes.

    Documents that lost no line stay as they are, the empty ones and those with a null text too.
    """
    cleaned = line_spread.without_boilerplate(docs)
    emptied = (F.col("n_removed") > 0) & (F.trim(F.translate("text", "\n", " ")) == "")
    return cleaned.where(~F.coalesce(emptied, F.lit(False))).select(*docs.columns)


def copies_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return shingle_join.without_near_copies(docs)


def leakage_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return leakage.without_leaks(docs, table(spark, folder, "benchmark"))


def tokens_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): ids as little-endian unsigned 32-bit integers."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)
    return both.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "ids",
    )


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_copies", copies_stage),
    ("decontamination", leakage_stage),
    ("byte_bpe", tokens_stage),
]

#: Classifier, similarity, alignment and merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    before = None
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, folder), f"stage-{name}")
        if before is not None:
            removed(before)
        before = docs
    return docs
