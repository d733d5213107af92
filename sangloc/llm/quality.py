"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each text gives a vector of transformed statistics (`STATISTICS`).  Per class, Spark sums the
vectors and their products; mean and covariance follow from these sums, whatever the number of
rows.  A class covariance is shrunk towards the covariance pooled over the classes and that towards
its diagonal, so that a class of few rows, or a statistic that never varies in it, has an
inverse.  The Cholesky factor of each covariance is made once and cached in the model; the log
density of a text is its Mahalanobis distance by one triangular product.  The score is the
posterior of class 1.

Rows: one result per input row.  Null and empty texts have the statistics of an empty text.  If no
row of one of the classes is given to learn from, every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sangloc.llm.common import column_type, is_held_out, lowered, map_text, text_bytes
from sangloc.llm.hashing import distinct, word_hashes, words
from sangloc.llm.labelled import FIT_ROWS, labelled_texts

STATISTICS = (
    "log_bytes log_words log_word_length upper_share symbol_share digit_share mark_share shout_share bar_share "
    "repeat_share variety odd_end_share line_share"
).split()
#: A document is kept if its score reaches this.
KEEP_SCORE = 0.7
SHRINK_TO_POOLED = 0.1
SHRINK_TO_DIAGONAL = 0.05

LETTER, UPPER, DIGIT, SPACE, LINE, MARK, SHOUT, BAR, SYMBOL = range(9)
CLASS_OF_BYTE = np.full(256, SYMBOL)
CLASS_OF_BYTE[[*range(97, 123), *range(128, 256)]] = LETTER
CLASS_OF_BYTE[[*range(65, 91)]] = UPPER
CLASS_OF_BYTE[[*range(48, 58)]] = DIGIT
CLASS_OF_BYTE[[9, 11, 12, 13, 32]] = SPACE
CLASS_OF_BYTE[10] = LINE
CLASS_OF_BYTE[[ord(c) for c in ".,;:'\"?()-"]] = MARK
CLASS_OF_BYTE[ord("!")] = SHOUT
CLASS_OF_BYTE[ord("|")] = BAR
CLASS_OF_BYTE = CLASS_OF_BYTE.astype(np.int64)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS per text, over the whole text."""
    flat, bounds = text_bytes(texts)
    rows = len(texts)
    size = np.diff(bounds)
    row_of_byte = np.repeat(np.arange(rows) * 9, size)
    counts = np.bincount(row_of_byte + CLASS_OF_BYTE[flat], minlength=rows * 9).reshape(rows, 9).astype(float)
    starts, ends, row = words(flat, bounds)
    n_words = np.bincount(row, minlength=rows).astype(float)
    hashes = word_hashes(lowered(flat), starts, ends)
    same = (row[1:] == row[:-1]) & (hashes[1:] == hashes[:-1])
    repeats = np.bincount(row[1:][same], minlength=rows)
    kinds = np.bincount(distinct(row, hashes)[0], minlength=rows)
    odd = np.bincount(row[np.isin(CLASS_OF_BYTE[flat[ends - 1]], (SYMBOL, SHOUT, BAR, DIGIT))], minlength=rows)
    letters = np.maximum(1, counts[:, LETTER] + counts[:, UPPER])
    inked = np.maximum(1, size - counts[:, SPACE] - counts[:, LINE])
    many = np.maximum(1, n_words)
    share = np.stack(
        [
            counts[:, UPPER] / letters,
            counts[:, SYMBOL] / inked,
            counts[:, DIGIT] / inked,
            counts[:, MARK] / inked,
            counts[:, SHOUT] / inked,
            counts[:, BAR] / inked,
            repeats / many,
        ],
        1,
    )
    variety = np.log1p(kinds) / np.log1p(many)
    return np.column_stack(
        [
            np.log1p(size),
            np.log1p(n_words),
            np.log1p(inked / many),
            np.sqrt(share),
            variety,
            np.sqrt(odd / many),
            np.sqrt(counts[:, LINE] / many),
        ]
    )


@dataclass
class Discriminant:
    """Per class: log prior less half the log determinant, mean, and inverse Cholesky factor."""

    offsets: list[float]
    means: list[np.ndarray]
    factors: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.means) < 2:
            return np.full(len(x), 0.5)
        density = [o - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for o, m, f in zip(self.offsets, self.means, self.factors)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def discriminant(sums: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Discriminant:
    """From (rows, sum, sum of products) of the classes 0 and 1."""
    if set(sums) != {0, 1}:
        return Discriminant([], [], [])
    total = sum(n for n, _, _ in sums.values())
    means = {k: s / n for k, (n, s, _) in sums.items()}
    scatter = {k: p - n * np.outer(means[k], means[k]) for k, (n, _, p) in sums.items()}
    pooled = sum(scatter.values()) / total
    floor = np.diag(np.diag(pooled) + 1e-6)
    pooled = (1 - SHRINK_TO_DIAGONAL) * pooled + SHRINK_TO_DIAGONAL * floor
    model = Discriminant([], [], [])
    for k in (0, 1):
        n = sums[k][0]
        # The fewer the rows, the more of the pooled covariance.
        weight = max(SHRINK_TO_POOLED, len(STATISTICS) / (n + len(STATISTICS)))
        factor = np.linalg.cholesky((1 - weight) * scatter[k] / n + weight * pooled + 1e-6 * np.eye(len(pooled)))
        model.offsets.append(float(np.log(n / total) - np.log(np.diag(factor)).sum()))
        model.means.append(means[k])
        model.factors.append(np.linalg.inv(factor))
    return model


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    key: str = "doc_id",
    text: str = "text",
    fit_rows: int = FIT_ROWS,
) -> Discriminant:
    width = len(STATISTICS)

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = statistics(batch.column(0))
        columns = [batch.column(1), *(pa.array(x[:, i]) for i in range(width))]
        return pa.RecordBatch.from_arrays(columns, ["label", *STATISTICS])

    rows = labelled_texts(docs, labels, label, key, text, fit_rows).select("text", F.col("label").cast("int"))
    rows = map_text(rows, "text", vectors, "label int, " + ", ".join(f"{s} double" for s in STATISTICS))
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    found = rows.groupBy("label").agg(
        F.count("*").alias("n"),
        *[F.sum(s).alias(f"s{i}") for i, s in enumerate(STATISTICS)],
        *[F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j])).alias(f"p{i}_{j}") for i, j in pairs],
    )
    sums = {}
    for r in found.collect():  # a row for each class
        products = np.zeros((width, width))
        for i, j in pairs:
            products[i, j] = products[j, i] = r[f"p{i}_{j}"]
        sums[r.label] = (float(r.n), np.array([r[f"s{i}"] for i in range(width)]), products)
    return discriminant(sums)


def score(docs: DataFrame, model: Discriminant, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""
    schema = T.StructType([T.StructField(key, column_type(docs, key)), T.StructField("score", T.DoubleType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(statistics(batch.column(1))))], [key, "score"])

    return map_text(docs.select(key, F.col(text).cast("string").alias("_text")), "_text", run, schema)


def kept(docs: DataFrame, model: Discriminant, text: str = "text", keep_score: float = KEEP_SCORE) -> DataFrame:
    """The rows that the model does not reject, with all their columns."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(model.score(statistics(batch.column(text))) >= keep_score))

    return map_text(docs, text, run, docs.schema) if model.means else docs


def judged(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", keep_score: float = KEEP_SCORE) -> DataFrame:
    """(key, held_out, score, predicted) of every row, by a model of the rows that are not held out."""
    return score(docs, fit(docs, labels, label, key), key).select(
        key, is_held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= keep_score).cast("int").alias("predicted")
    )
