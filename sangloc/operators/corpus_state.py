"""Corpus counts that follow a stream: deltas by batch, merged by adding, compacted now and then.

Every batch writes its own counts to a folder named after its number, so a batch that is repeated after a failure
replaces its part and changes nothing.  A batch is judged against the sum of all earlier parts.  `compact` adds parts up to
one; a sum that is not complete is not read, and parts are removed only after it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sangloc.operators.quality import (
    Corpus,
    Keys,
    bigram_counts,
    bucket_counts,
    corpus_perplexity,
    key_list,
    model_of,
    perplexity_bucket,
    vocabulary,
)
from sangloc.sources.sinks import folder_names, remove_folder, removed, staged

#: Tables of counts: the columns that name a row, and those that add up.
TABLES = {
    "vocabulary": ("token string", "n_rows long, n_docs long"),
    "bigrams": ("w1 string, w2 string", "n_rows long"),
    "sketch": ("bucket int", "n long"),
}


def _names(columns: str) -> list[str]:
    return [c.split()[0] for c in columns.split(", ")]


class CorpusState:
    """The parts below a folder: `delta=<batch>` and `base=<last batch in it>`, each with one table of every kind."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _numbers(self, kind: str) -> list[int]:
        found = [n.split("=")[1] for n in folder_names(self.spark, self.folder) if n.startswith(f"{kind}=")]
        return sorted(map(int, found))

    def _is_complete(self, part: str) -> bool:
        return all("_SUCCESS" in folder_names(self.spark, f"{self.folder}/{part}/{table}") for table in TABLES)

    def parts(self, before: int | None = None) -> list[str]:
        """The newest complete sum of batches before this one, and the deltas that it leaves out."""
        wanted = [n for n in self._numbers("base") if (before is None or n < before) and self._is_complete(f"base={n}")]
        base = wanted[-1:]
        deltas = [n for n in self._numbers("delta") if (before is None or n < before) and (not base or n > base[0])]
        return [f"base={n}" for n in base] + [f"delta={n}" for n in deltas]

    def counts(self, table: str, before: int | None = None) -> DataFrame:
        """The sum of a table over all batches, or over those before one."""
        keys, sums = TABLES[table]
        paths = [f"{self.folder}/{part}/{table}" for part in self.parts(before)]
        schema = f"{keys}, {sums}"
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.groupBy(*_names(keys)).agg(*[F.sum(c).alias(c) for c in _names(sums)])

    def corpus(self, before: int | None = None) -> Corpus | None:
        """What a batch is judged against, as staged tables; None before the first batch."""
        if not self.parts(before):
            return None
        pairs, parts = staged(self.counts("bigrams", before), "bigrams"), []
        model = staged(model_of(pairs, parts), "bigram-model")
        removed(pairs, *parts)
        return Corpus(staged(self.counts("vocabulary", before), "vocabulary"), model, staged(self.counts("sketch", before), "sketch"))

    def add(self, batch: int, texts: DataFrame, key: Keys, words: Column) -> None:
        """Write the counts of a batch in place of what it wrote before.

        Its perplexities are those under the counts up to and with this batch, so every bigram is known.
        """
        named = staged(texts.select(*key_list(key), words.alias("_words")), "batch-words")
        part = f"{self.folder}/delta={batch}"
        vocabulary(named, F.col("_words")).write.mode("overwrite").parquet(f"{part}/vocabulary")
        bigram_counts(named, F.col("_words")).write.mode("overwrite").parquet(f"{part}/bigrams")
        pairs, parts = staged(self.counts("bigrams", batch + 1), "bigrams"), []
        model = staged(model_of(pairs, parts), "bigram-model")
        scored = corpus_perplexity(named, key, F.col("_words"), model).select(perplexity_bucket(F.col("perplexity")).alias("bucket"))
        bucket_counts(scored).write.mode("overwrite").parquet(f"{part}/sketch")
        removed(named, pairs, model, *parts)

    def compact(self, last: int) -> None:
        """Add up all batches up to `last`, which must be over, and remove their parts."""
        old = [p for p in self.parts(last + 1)]
        if not old or old == [f"base={last}"]:
            return
        for table in TABLES:
            self.counts(table, last + 1).write.mode("overwrite").parquet(f"{self.folder}/base={last}/{table}")
        for kind, most in (("base", last - 1), ("delta", last)):
            for number in self._numbers(kind):
                if number <= most:
                    remove_folder(self.spark, f"{self.folder}/{kind}={number}")
