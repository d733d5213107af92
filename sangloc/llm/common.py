"""Helpers that several operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sangloc.operators.joins import is_small
from sangloc.sources.sinks import removed, staged

__all__ = ["is_small", "removed", "staged"]

#: Bytes of text that a task holds in Python at a time.
SLICE_BYTES = 1 << 20
#: A row may be learned from if its checksum leaves another remainder.
HELD_OUT = 2


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def is_held_out(key: Column) -> Column:
    """True for the quarter of the rows that no model learns from; a null key counts as held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(True))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one array, and the n + 1 row bounds in it; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most `most` bytes of text each, or with a single row."""
    if not batch.num_rows:
        return
    bounds = text_bytes(batch.column(text))[1]
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(bounds, bounds[start] + most, "right")) - 1
        end = max(start + 1, min(end, batch.num_rows))
        yield batch.slice(start, end - start)
        start = end


def map_text(
    df: DataFrame,
    text: str,
    fn: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    schema: T.StructType | str,
    most: int = SLICE_BYTES,
) -> DataFrame:
    """`fn` on every slice of the rows; memory of a task is bounded by a slice or the longest row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, most):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def column_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def lowered(flat: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return np.where((flat >= 65) & (flat <= 90), flat + 32, flat).astype(np.uint8)
