"""Language identification by error-correcting output codes.

Each language has a codeword.  Bit b of the code splits the languages into two sides, and a binary
naive-Bayes classifier over hashed byte n-grams tells the sides apart: the weight of an n-gram is the log
ratio of its frequency on both sides, each side being the mean of its languages, so that a language with
many rows weighs no more.  The text's evidence for a bit is the mean weight over its n-grams times
the root of their number, but no more than `MOST_SCALE`: long texts in two languages stay doubtful.  Decoding adds up the logistic loss of every bit against
each codeword, weighted by how well the bit's classifier does on the rows it learned from, and
takes the codeword with the least loss.  Where the two best are close, the row is
flagged as ambiguous.

Codes: all splits of the languages up to 7 of them; beyond that, splits drawn from a fixed seed,
10 log2(L) of them.

Rows: one result per input row.  A null text, or one without a letter, gives `und` with score 0.  With
no language to learn from all rows are `und`; with one, that one with score 1.  A tie goes to the
language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sangloc.llm.common import column_type, is_held_out, map_text, slices, text_bytes
from sangloc.llm.labelled import FIT_ROWS, sample

UNKNOWN = "und"
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
#: N-grams of two and of three bytes.
SIZES = (2, 3)
#: The mean weight counts this many times at most.
MOST_SCALE = 6.0
#: Below this difference of losses, as a share of the weight of all bits, a row is ambiguous.
CLOSE = 0.5
#: Bytes scored at a time.
PART = 1 << 20

FOLDED = np.full(256, 32, np.uint8)
FOLDED[97:123] = np.arange(97, 123)
FOLDED[65:91] = np.arange(97, 123)
FOLDED[128:] = np.arange(128, 256)


def grams(flat: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, bucket) of the n-grams that lie in one row and hold a letter; other bytes are spaces."""
    code = FOLDED[flat].astype(np.uint32)
    row_end = np.repeat(bounds[1:], np.diff(bounds))
    for size in SIZES:
        n = max(0, len(code) - size + 1)
        h = np.full(n, size, np.uint32)
        some = np.zeros(n, bool)
        for place in range(size):
            part = code[place : place + n]
            h = (h * np.uint32(0x01000193)) ^ part
            some |= part != 32
        h *= np.uint32(0x9E3779B1)
        start = np.flatnonzero(some & (np.arange(n) + size <= row_end[:n]))
        yield start, (h[start] >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def codewords(languages: int) -> np.ndarray:
    """-1 or 1 for each language and bit; every bit has languages on both sides."""
    if languages <= 7:
        bits = np.arange(1, 1 << max(0, languages - 1))
        return np.where((bits[None, :] >> np.arange(languages)[:, None]) & 1, 1, -1)
    draw = np.random.default_rng(7)
    wanted, columns = int(np.ceil(10 * np.log2(languages))), []
    while len(columns) < wanted:
        column = draw.integers(0, 2, languages) * 2 - 1
        if abs(column.sum()) < languages:
            columns.append(column)
    return np.stack(columns, 1)


@dataclass
class OutputCode:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def evidence(self, texts: pa.Array) -> np.ndarray:
        flat, bounds = text_bytes(texts)
        rows, bits = len(texts), self.code.shape[1]
        total, number = np.zeros((rows, bits)), np.zeros(rows)
        for start, bucket in grams(flat, bounds):
            row = np.searchsorted(bounds, start, "right") - 1
            number += np.bincount(row, minlength=rows)
            for at in range(0, len(row), PART):
                r, weight = row[at : at + PART], self.weights[bucket[at : at + PART]]
                first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                total[r[first]] += np.add.reduceat(weight, first, axis=0)
        number = np.maximum(1, number)
        return total / number[:, None] * np.minimum(np.sqrt(number), MOST_SCALE)[:, None]

    def losses(self, evidence: np.ndarray) -> np.ndarray:
        """Weighted loss of each row against each codeword."""
        out = np.empty((len(evidence), len(self.languages)))
        for k, word in enumerate(self.code):
            out[:, k] = (np.logaddexp(0, -evidence * word) * self.trust).sum(1)
        return out

    def decide(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the runner-up is close."""
        rows = len(texts)
        if len(self.languages) > 1:
            loss = self.losses(self.evidence(texts))
            order = np.sort(loss, 1)
            close = order[:, 1] - order[:, 0] < CLOSE * self.trust.sum()
            best = loss.argmin(1)
            score = 1 / np.exp(order[:, :1] - loss).sum(1)
        else:
            best, score, close = np.zeros(rows, int), np.ones(rows), np.zeros(rows, bool)
        flat, bounds = text_bytes(texts)
        latin = ((flat >= 65) & (flat <= 90)) | ((flat >= 97) & (flat <= 122))
        found = np.concatenate([[0], np.cumsum(latin)])
        lettered = found[bounds[1:]] > found[bounds[:-1]]
        for i in np.flatnonzero(~lettered):
            lettered[i] = any(map(str.isalpha, texts[int(i)].as_py() or ""))
        lettered &= bool(self.languages)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist())]
        return names, np.where(lettered, score, 0.0), close | ~lettered


def output_code(languages: list[str], counts: np.ndarray) -> OutputCode:
    """`counts`: occurrences of each bucket in each language."""
    code = codewords(len(languages))
    rate = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS)
    weights, trust = np.zeros((BUCKETS, code.shape[1]), np.float32), np.ones(code.shape[1])
    for b, bit in enumerate(code.T):
        w = np.log(rate[bit > 0].mean(0) / rate[bit < 0].mean(0))
        weights[:, b] = w
        # How far apart the bit's sides are: the least mean evidence of any language for its own side.
        trust[b] = max(0.05, min(float((rate[k] * w).sum()) * bit[k] for k in range(len(languages))))
    return OutputCode(languages, code, weights, trust / trust.mean() if len(trust) else trust)


def fit(docs: DataFrame, lang: str = "lang", key: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS) -> OutputCode:
    """Counts over the whole texts of a bounded sample; the driver gets languages x buckets numbers."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = sample(rows.where("lang IS NOT NULL AND text IS NOT NULL"), "key", fit_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                flat, bounds = text_bytes(part.column(0))
                names, which = np.unique(np.array(part.column(1).to_pylist(), object), return_inverse=True)
                for start, bucket in grams(flat, bounds):
                    row = np.searchsorted(bounds, start, "right") - 1
                    seen = np.bincount(which[row] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                    for name, n in zip(names, seen):
                        found[name] = found.get(name, 0) + n
        for name, n in found.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    seen = rows.select("text", "lang").mapInArrow(count, "lang string, bucket long, n long")
    seen = seen.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(seen["lang"].to_pylist(), object)
    languages = sorted(set(names))
    counts = np.zeros((len(languages), BUCKETS))
    place = {name: i for i, name in enumerate(languages)}
    counts[[place[x] for x in names], seen["bucket"].to_numpy()] = seen["n"].to_numpy()
    return output_code(languages, counts)


def predict(docs: DataFrame, model: OutputCode, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, ambiguous) of every row."""
    fields = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("ambiguous", T.BooleanType())]
    schema = T.StructType([T.StructField(key, column_type(docs, key)), *(T.StructField(*f) for f in fields)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, score, close = model.decide(batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(close)], schema.names)

    return map_text(docs.select(key, F.col(text).cast("string").alias("_text")), "_text", run, schema)


def identified(docs: DataFrame, key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score, ambiguous), by a model of the rows that are not held out."""
    return predict(docs, fit(docs, lang, key), key).select(
        key, is_held_out(F.col(key)).alias("held_out"), "lang_pred", "score", "ambiguous"
    )
