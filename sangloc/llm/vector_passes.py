"""Embedding near-dedup by sorted projection passes.

1. A pass has random directions of its own.  A vector's hashes, the signs of its products with them, are concatenated to one
   number, and the vectors of a label are ordered by it: close vectors share long prefixes and come to stand near each other.
2. A vector's window is its run of equal prefixes in that order.  The prefix has as many bits as cut the label to runs of
   about `RUN` vectors, so a window stays bounded however large the label is.  Runs that are longer, the dense ones, are
   cut to blocks of `BLOCK` vectors, and these are compared block against block, so no group is capped.
3. Pairs are verified by their cosine in double precision.  A pair counts in the first pass whose windows hold it: a task
   hashes the vectors of a linked pair for the earlier passes too, and leaves the pair out if it shares a prefix there.
4. The links of all passes are added up and united to components.

Two vectors at the threshold share one sign with the odds 1 - angle / pi, and a prefix with the power of it, so the number of
passes after which a link is missed with `MISSED` at most follows from the bits: one pass, without a prefix and without a
miss, for a label of up to `RUN` vectors, and a number that grows with the logarithm of the label beyond that.  The work is
passes x vectors x window; closer vectors are found more surely than those at the threshold.

Blocks are files in the shared folder, which tasks write and read; no pair leaves its task: a task
sends, for each vector, a number of links and one vector of its group.  Only files of rows that the writing stage returned are read.
Passes are taken in rounds of about `ROUND_VECTORS` vectors, and a round's files go before the next one.

Equal vectors of a label are one class from the start.

Rows: one result per distinct non-null vec_id.  Vectors that are null, zero, or hold null or non-finite components, and those
with a null label, link with nothing.  Rows that repeat a vec_id: the largest (label, vector) stands for it.  Vectors of different
length are never compared.
"""

from __future__ import annotations

import io
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sangloc.llm.common import removed, staged
from sangloc.llm.components import components
from sangloc.llm.zip_archives import made_folder, opened
from sangloc.operators.joins import dim_join
from sangloc.sources.sinks import remove_folder, shared_folder

THRESHOLD = 0.93
#: Signs in the number that the vectors are sorted by; a prefix has fewer.
BITS = 48
#: Vectors of a block, of a run on average at most, and of a block compared at a time.
BLOCK, AT_ONCE = 2048, 512
RUN_BLOCKS = 4
#: The odds of missing a link at the threshold.
MISSED = 1e-6
#: Vectors, each counted once for each of its passes, that a round orders.
ROUND_VECTORS = 1 << 21
SEED = 20240


def directions(dimension: int, number: int) -> np.ndarray:
    return np.random.default_rng([SEED, dimension, number]).standard_normal((dimension, BITS))


def numbers(x: np.ndarray, number: int) -> np.ndarray:
    """The signs of a pass as one number, the first direction's foremost."""
    weight = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    return (x @ directions(x.shape[1], number) > 0) @ weight


def prefix_bits(vectors: Column) -> Column:
    """Bits that cut so many vectors to runs of RUN_BLOCKS blocks at most, on average."""
    return F.greatest(F.ceil(F.log2(vectors / (RUN_BLOCKS * BLOCK))), F.lit(0)).cast("int")


def pass_count(bits: Column, threshold: float) -> Column:
    """Passes after which two vectors at the threshold have shared a prefix, but for the odds MISSED."""
    shared = F.pow(F.lit(1 - math.acos(threshold) / math.pi), bits)
    return F.when(bits == 0, 1).otherwise(F.ceil(math.log(MISSED) / F.log(1 - shared))).cast("int")


def unit(blob: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(blob), np.float64).reshape(len(blob), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vectors(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, label, v): one row per key; v has the components as doubles, or is null if it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, name in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ok = bool(x) and name is not None and None not in x
                x = np.array(x, np.float64) + 0.0 if ok else None
                norm = np.linalg.norm(x) if ok else 0.0
                out.append(x.tobytes() if ok and np.isfinite(x).all() and 0 < norm < np.inf else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["key", "label", "v"])

    named = rows.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v"), F.col(label).cast("string").alias("label"))
    made = named.where("key IS NOT NULL").mapInArrow(run, "key long, label string, v binary")
    return made.groupBy("key").agg(F.max(F.struct("label", "v")).alias("x")).select("key", "x.*")


@dataclass
class Block:
    """Consecutive vectors of an order: their keys, copies, and for each run (pass, bits) and an array of unit vectors."""

    keys: np.ndarray
    copies: np.ndarray
    runs: list[tuple[int, int]]
    parts: list[np.ndarray]

    def write(self, uri: str) -> None:
        data = io.BytesIO()
        for array in (self.keys, self.copies, np.array(self.runs, np.int64), *self.parts):
            np.save(data, array)
        system, path = opened(uri)
        with system.open_output_stream(path) as out:
            out.write(data.getvalue())

    @classmethod
    def read(cls, uri: str) -> Block:
        system, path = opened(uri)
        with system.open_input_file(path) as file:
            data = io.BytesIO(file.read())
        keys, copies, runs = (np.load(data) for _ in range(3))
        return cls(keys, copies, [tuple(r) for r in runs.tolist()], [np.load(data) for _ in runs])


#: What names a run.
RUN = ("size", "label", "pass", "prefix")
_RUN_KINDS = [pa.int64(), pa.string(), pa.int32(), pa.int64()]


def ordered(rows: DataFrame, folder: str) -> DataFrame:
    """(id, path, size, label, pass, prefix, last_...): the blocks of the orders, written to the folder; a staged table.

    `rows` are (key, label, v, copies, bits, pass).  Vectors are range-partitioned by run and number and sorted; ids
    follow the order; the last run of a block is named as its first one is.
    """
    block = BLOCK
    names = ["key", "label", "v", "copies", "bits", "pass"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(2).to_pylist()
            sizes = np.array([len(b) for b in blobs], np.int64)
            bits, number = (batch.column(i).to_numpy().astype(np.int64) for i in (4, 5))
            signs = np.zeros(len(blobs), np.int64)
            for size, n in {*zip(sizes.tolist(), number.tolist())}:
                at = np.flatnonzero((sizes == size) & (number == n))
                signs[at] = numbers(unit([blobs[i] for i in at]), n)
            columns = [*batch.columns, pa.array(sizes), pa.array(signs >> (BITS - bits)), pa.array(signs)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "size", "prefix", "number"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, held = TaskContext.get().partitionId(), 0, []

        def closed(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal seen
            groups: dict[tuple, list[tuple]] = {}
            for key, label, v, copies, bits, number, size, prefix in rows:
                groups.setdefault((size, label, number, prefix), []).append((v, bits))
            path = f"{folder}/{uuid.uuid4().hex}"
            keys, copies = (np.array([r[k] for r in rows], np.int64) for k in (0, 3))
            runs = [(name[2], members[0][1]) for name, members in groups.items()]
            Block(keys, copies, runs, [unit([v for v, _ in g]) for g in groups.values()]).write(path)
            ends = [*groups][0], [*groups][-1]
            values = [(part << 32) + seen, path, *ends[0], *ends[1]]
            kinds = [pa.int64(), pa.string(), *_RUN_KINDS, *_RUN_KINDS]
            seen += 1
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds)], ["id", "path", *RUN, *[f"last_{n}" for n in RUN]])

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            while len(held) >= block:
                yield closed(held[:block])
                held = held[block:]
        if held:
            yield closed(held)

    schema = "key long, label string, v binary, copies long, bits int, pass int, size long, prefix long, number long"
    made = rows.select(*names).mapInArrow(hashed, schema)
    by = ["size", "label", "pass", "number", "key"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = made.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("number")
    run = "{0}size long, {0}label string, {0}pass int, {0}prefix long"
    return staged(made.mapInArrow(cut, f"id long, path string, {run.format('')}, {run.format('last_')}"), "blocks")


def block_pairs(blocks: DataFrame) -> DataFrame:
    """(a, path, b, other_path): every block with itself, and with the later blocks that begin with the run it ends with."""
    later = blocks.select(F.col("id").alias("b"), F.col("path").alias("other_path"), *[F.col(n).alias(f"last_{n}") for n in RUN])
    earlier = blocks.select(F.col("id").alias("a"), "path", *[f"last_{n}" for n in RUN])
    pairs = earlier.join(later, [f"last_{n}" for n in RUN]).where("a < b").select("a", "path", "b", "other_path")
    return pairs.unionByName(blocks.select(F.col("id").alias("a"), "path", F.col("id").alias("b"), F.col("path").alias("other_path")))


def compared(blocks: DataFrame, threshold: float) -> DataFrame:
    """(key, links, other): per pair of blocks and vector, how many vectors it links with there, and one of its group."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, first = None, None
        for batch in batches:
            for path, other in zip(*(c.to_pylist() for c in batch.columns)):
                if path != name:
                    name, first = path, Block.read(path)
                found = within(first, threshold) if other == path else between(first, Block.read(other), threshold)
                for keys, links, root in found:
                    some = np.flatnonzero(links)
                    if len(some):
                        columns = [keys[some], links[some], keys[root[some]]]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "links", "other"])

    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The pairs of a block are dealt to several tasks, each of which reads it once.
    pairs = block_pairs(blocks).repartition(parts, "a", F.pmod("b", F.lit(64))).sortWithinPartitions("a", "b")
    return pairs.select("path", "other_path").mapInArrow(compare, "key long, links long, other long")


#: Keys, their links, and the place of one of its group for each.
Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def within(block: Block, threshold: float) -> Iterator[Found]:
    at = 0
    for x, (number, bits) in zip(block.parts, block.runs):
        keys, copies = block.keys[at : at + len(x)], block.copies[at : at + len(x)]
        at += len(x)
        yield keys, *_links(x, x, copies, copies, threshold, True, number, bits)


def between(one: Block, two: Block, threshold: float) -> Iterator[Found]:
    """Links of the last run of one block with the first of a later one, which is the same."""
    x, y = one.parts[-1], two.parts[0]
    keys = np.concatenate([one.keys[len(one.keys) - len(x) :], two.keys[: len(y)]])
    mine, others = one.copies[len(one.keys) - len(x) :], two.copies[: len(y)]
    yield keys, *_links(x, y, mine, others, threshold, False, *one.runs[-1])


def _earlier(x: np.ndarray, number: int, bits: int) -> list[np.ndarray]:
    """The prefixes of the passes before."""
    return [numbers(x, n) >> (BITS - bits) for n in range(number)]


def _links(
    x: np.ndarray, y: np.ndarray, mine: np.ndarray, others: np.ndarray, threshold: float, same: bool, number: int, bits: int
) -> tuple[np.ndarray, np.ndarray]:
    """Links that no earlier pass met, and groups, of the rows of x and then of y, or of x alone if y is the same."""
    shift = 0 if same else len(x)
    links, root = np.zeros(shift + len(y), np.int64), np.arange(shift + len(y))
    before = _earlier(x, number, bits)
    before_y = before if same else _earlier(y, number, bits)
    for start in range(0, len(x), AT_ONCE):
        part = slice(start, start + AT_ONCE)
        close = x[part] @ y[start if same else 0 :].T >= threshold
        # Each pair of a block is seen once.
        a, b = np.nonzero(np.triu(close, 1) if same else close)
        a, b = a + start, b + (start if same else 0)
        met = np.zeros(len(a), bool)
        for p, q in zip(before, before_y):
            met |= p[a] == q[b]
        a, b = a[~met], b[~met]
        links += np.bincount(a, others[b], len(links)).astype(np.int64)
        links += np.bincount(b + shift, mine[a], len(links)).astype(np.int64)
        _unite(root, a, b + shift)
    return links, root


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Smallest index of each group, in place: minima go along the pairs and then along the roots."""
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root[:] = root[root]
        if (root == before).all():
            break


def passes(reps: DataFrame, threshold: float) -> DataFrame:
    """(size, label, n, bits, passes): how each label is ordered; a staged table."""
    sizes = reps.groupBy(F.octet_length("v").alias("size"), "label").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("bits", prefix_bits(F.col("n")))
    return staged(sizes.withColumn("passes", pass_count(F.col("bits"), threshold)), "labels")


def linked(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD
) -> DataFrame:
    """(key, n_links, component_id, kept) of every vector."""
    spark = rows.sparkSession
    known = staged(vectors(rows, key, vector, label), "vectors")
    reps = known.where("v IS NOT NULL").groupBy("label", "v").agg(F.min("key").alias("key"), F.count("*").alias("copies"))
    reps = staged(reps, "classes")
    labels = passes(reps, threshold)
    plan = labels.agg(F.max("passes").alias("most"), F.sum(F.when(F.col("passes") > 1, F.col("n"))).alias("n")).first()
    at_once = max(1, ROUND_VECTORS // max(1, plan.n or 0))
    placed = dim_join(reps.withColumn("size", F.octet_length("v")), labels, ["size", "label"], "inner")
    found = []
    for start in range(0, plan.most or 0, at_once):
        these = F.sequence(F.lit(start), F.least(F.col("passes"), F.lit(start + at_once)) - 1)
        turn = placed.where(F.col("passes") > start).select("key", "label", "v", "copies", "bits", F.explode(these).alias("pass"))
        folder = shared_folder(spark, "vector-blocks")
        made_folder(folder)
        blocks = ordered(turn, folder)
        found.append(staged(compared(blocks, threshold), "found"))
        remove_folder(spark, folder)
        removed(blocks)
    links = spark.createDataFrame([], "key long, links long, other long")
    for part in found:
        links = links.unionByName(part)
    groups = components(links, "key", "other")
    counts = links.groupBy("key").agg(F.sum("links").alias("links"))
    classes = reps.join(counts, "key", "left").join(groups.withColumnRenamed("vertex", "key"), "key", "left")
    classes = classes.select(
        "label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "key").alias("component")
    )
    out = known.join(classes, ["label", "v"], "left")
    kind = rows.schema[key].dataType
    out = out.select(
        F.col("key").cast(kind).alias(key),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "key").cast(kind).alias("component_id"),
        (F.coalesce("component", "key") == F.col("key")).alias("kept"),
    )
    out = staged(out, "linked")
    removed(known, reps, labels, groups, *found)
    return out
