"""One query for each operator of this folder, over its whole table, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from sangloc.llm import (
    bpe,
    divergence,
    langid,
    leakage,
    line_spread,
    merkle,
    packing,
    quality,
    shingle_join,
    toxicity,
    url_templates,
    vector_passes,
    zip_archives,
)
from sangloc.llm.common import table


def op6_qgram_leakage(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


def op10_quality_discriminant(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_sorted_passes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_passes.linked(table(spark, folder, "embeddings"))


def op8_language_codes(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identified(table(spark, folder, "documents"))

#: (host, path, verdict); a rule holds for subdomains too, and the longest one decides.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_shingle_join(spark: SparkSession, folder: str) -> DataFrame:
    return shingle_join.linked(table(spark, folder, "documents"))


def op2_toxicity_grammar(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_url_templates(spark: SparkSession, folder: str) -> DataFrame:
    return url_templates.judged(table(spark, folder, "pages"), RULES)


def op4_zip_warc(spark: SparkSession, folder: str) -> DataFrame:
    return zip_archives.round_trip(table(spark, folder, "pages"))


def op5_line_spread(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_spread.without_boilerplate(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "text", "n_lines", "n_removed")


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audited(table(spark, folder, "documents"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(table(spark, folder, "documents"), tampered=merkle.every_third())


def op13_tiered_packing(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.packed(table(spark, folder, "documents"), tokenizer, public_tokenizers.PATTERN)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group"
    )


QUERIES = {
    "op1_shingle_join": op1_shingle_join,
    "op2_toxicity_grammar": op2_toxicity_grammar,
    "op3_url_templates": op3_url_templates,
    "op4_zip_warc": op4_zip_warc,
    "op5_line_spread": op5_line_spread,
    "op6_qgram_leakage": op6_qgram_leakage,
    "op7_sorted_passes": op7_sorted_passes,
    "op8_language_codes": op8_language_codes,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_quality_discriminant": op10_quality_discriminant,
    "op11_source_divergence": op11_source_divergence,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_tiered_packing": op13_tiered_packing,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = {
    "op5_line_spread": line_spread.ORACLE_SQL,
    "op11_source_divergence": divergence.ORACLE_SQL,
    "op12_merkle_manifest": merkle.ORACLE_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
