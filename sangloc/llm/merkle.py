"""Merkle manifest of a table: a tree for each language, a tree over those, and a proof for every row, by time-forward processing.

A leaf is the hash of a row's columns.  Leaves of a language ascend by key; eight consecutive nodes (the last run: fewer) have
their hash as parent, until one is left, the subroot.  Subroots in the order of languages, null first, make the root alike.

Time-forward processing: every node has a label, and a node's result is a message to a node with a later label, which waits in
a priority queue ordered by label.  Here the label is (last leaf below the node, level), so that children come right
before their parent.  The queue has two parts.  Within a segment of `FAN ** LEVELS` leaves it is a heap in the task that works
through the segment in order of labels; there it never holds more than `FAN` messages for each level.  Messages to other
segments are rows, and Spark's external sort by (tree, segment, label) puts them in order.

1. Forward sweep: leaves come in order, each node takes its children's digests from the queue, sends its own digest to its
   parent, and is recorded with its children's digests.  The tops of all segments are the leaves of the next round, and a
   few rounds (each takes `LEVELS` levels off) give the subroots, then the root.
2. Reversed sweep: from the root back, in falling order of labels.  A node takes the suffix of all proofs below it from the queue,
   puts each child's siblings before it, and sends it to the child.  Suffixes that reach a segment's top in an upper round are
   messages to that segment in the round below.  At a leaf the suffix is its proof, which is hashed and folded there.

Proofs are never stored or shuffled as a whole, for each leaf only their hash.  All leaves are numbered by a range sort, so a hot
language is spread over many tasks; hashes of texts are made before, without a shuffle of texts.

Rows: one result per input row, repeated rows included.  A null in any column is hashed as `-`.  Rows without a key come first in
their language; rows with equal keys are ordered by leaf.  A row alone in its language is its subroot, and its proof in that tree is
empty.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sangloc.llm.common import is_small, removed, staged

#: Children of a node, and levels that a round shortens a tree by.
FAN, LEVELS = 8, 4
#: Columns that a leaf covers.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Up to this many (partition, language) rows are broadcast to number the leaves; beyond that they are joined by key.
MOST_BROADCAST_ROWS = 200_000

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: One step of a proof: the digests left of a node in its run, and those right of it.
Step = tuple[bytes, bytes]


def leaf_hash(columns: Sequence[str | Column]) -> Column:
    """sha256 of `-` for each null, else of the number of UTF-8 bytes, `:` and the value."""

    def field(c: str | Column) -> Column:
        value = (F.col(c) if isinstance(c, str) else c).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(field, columns)), 256)


def hashed(parts: Sequence[bytes]) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def levels_above(nodes: int, most: int) -> int:
    """Levels that a segment has above its leaves, in a tree that has so many nodes left."""
    levels = 0
    while nodes > 1 and levels < most:
        nodes, levels = -(-nodes // FAN), levels + 1
    return levels


def numbered(leaves: DataFrame, key: str, lang: str) -> DataFrame:
    """The rows with `tree` (the place of the language), `n` (its leaves) and `i` (the place of the leaf in it)."""
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["_lang", key, "leaf"]
    # A null language is the empty text, others follow a mark: the order is that of the UTF-8 bytes, null first.
    named = leaves.withColumn("_lang", F.coalesce(F.concat(F.lit("1"), F.col(lang)), F.lit("")))
    rows = named.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    rows = staged(rows.withColumn("_at", F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftright("_at", 33).alias("_part")
    runs = rows.groupBy("_lang", part).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    runs = staged(runs, "merkle-runs")
    before = Window.partitionBy("_lang").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    langs = runs.groupBy("_lang").agg(F.sum("_rows").alias("n"))
    langs = langs.withColumn("tree", F.row_number().over(Window.orderBy("_lang")).cast("long") - 1)
    places = runs.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first"))
    places = places.join(langs, "_lang").select("_lang", "_part", "_before", "n", "tree")
    places = F.broadcast(places) if is_small(runs, MOST_BROADCAST_ROWS) else places
    out = rows.withColumn("_part", part).join(places, ["_lang", "_part"])
    out = out.withColumn("i", F.col("_at") + F.col("_before")).drop("_lang", "_part", "_at", "_before")
    out = staged(out, "merkle-leaves")
    removed(rows, runs)
    return out


def _parent(i: int, level: int, nodes: int) -> int:
    """The label's first part of the node `i` of `level`: the last leaf below it."""
    return min((i + 1) * FAN**level, nodes) - 1


def forward(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(tree, seg, n, at, level, digest, children) from (tree, n, i, digest): what the forward sweep records.

    One row per inner node of a round, with its children's digests, and one per segment with `children` null: its top.
    """
    length = FAN**levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue: list[tuple[int, int, int, bytes]] = []
        segment, top, out = None, 0, []

        def node_at(at: int, level: int) -> int:
            return at // FAN**level

        def send(at: int, level: int, digest: bytes) -> None:
            """To the parent, or out of the segment."""
            tree, seg, n = segment
            if level == top:
                out.append((tree, seg, n, at, level, digest, None))
                return
            i = node_at(at, level)
            heapq.heappush(queue, (_parent(i // FAN, level + 1, n), level + 1, i % FAN, digest))

        def until(at: int | None) -> None:
            """All nodes whose last leaf comes before `at`."""
            while queue and (at is None or queue[0][0] < at):
                label, level = queue[0][:2]
                children = []
                while queue and queue[0][:2] == (label, level):
                    children.append(heapq.heappop(queue)[3])
                digest = hashed(children)
                out.append((*segment, label, level, digest, b"".join(children)))
                send(label, level, digest)

        def flushed() -> pa.RecordBatch:
            kinds = [pa.int64()] * 5 + [pa.binary()] * 2
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["tree", "seg", "n", "at", "level", "digest", "children"])

        for batch in batches:
            for tree, n, i, digest in zip(*(c.to_pylist() for c in batch.columns)):
                here = (tree, i // length, n)
                if here != segment:
                    until(None)
                    segment, top = here, levels_above(n, levels)
                until(i)
                send(i, 0, digest)
            if out:
                yield flushed()
        until(None)
        if out:
            yield flushed()

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seg = F.floor(F.col("i") / length).alias("seg")
    rows = nodes.select("tree", "n", "i", "digest", seg).repartition(parts, "tree", "seg").sortWithinPartitions("tree", "i")
    schema = "tree long, seg long, n long, at long, level long, digest binary, children binary"
    return rows.drop("seg").mapInArrow(run, schema)


def tops(recorded: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(tree, n, i, digest): the nodes of the next round."""
    left = F.ceil(F.col("n") / FAN**levels).alias("n")
    return recorded.where("children IS NULL").select("tree", left, F.col("seg").alias("i"), "digest")


_DOWN = "tree long, i long, digest binary, left array<binary>, right array<binary>, subroot binary, root binary"
_DIGEST = 64


def backward(nodes: DataFrame, recorded: DataFrame, suffixes: DataFrame, payload: str | None = None, levels: int = LEVELS) -> DataFrame:
    """The proof suffix of every node of a round, or, with `payload`, what each leaf is given back.

    `nodes` are (tree, n, i, digest), `suffixes` the messages to the segments' tops as (tree, i, left, right, subroot, root).
    `payload` names a column of `nodes` with the digest that is folded; the result is then (tree, i, leaf, subroot, root,
    proof_sha256, folded_root).
    """
    final = payload is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Labels fall, so they are negative in the heap; (level, at) name the receiver.
        queue: list[tuple[int, int, list[Step]]] = []
        segment, n, roots, out = None, 0, (None, None), []

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            if final:
                kinds = [pa.int64(), pa.int64(), *[pa.string()] * 5]
                names = ["tree", "i", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
            else:
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.binary(), pa.binary()]
                names = ["tree", "i", "digest", "left", "right", "subroot", "root"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for tree, seg, size, at, level, digest, children, left, right, subroot, root in zip(*(c.to_pylist() for c in batch.columns)):
                if left is not None:
                    segment, n, roots, queue = (tree, seg), size, (subroot, root), []
                    queue.append((-at, -level, list(zip(left, right))))
                    continue
                suffix = heapq.heappop(queue)
                if suffix[:2] != (-at, -level) or segment != (tree, seg):
                    raise ValueError("a node of the tree did not get its message")
                if level:
                    first = (at // FAN**level) * FAN
                    digests = [children[j : j + _DIGEST] for j in range(0, len(children), _DIGEST)]
                    for j in range(len(digests)):
                        step = (b"".join(digests[:j]), b"".join(digests[j + 1 :]))
                        heapq.heappush(queue, (-_parent(first + j, level - 1, n), 1 - level, [step, *suffix[2]]))
                elif final:
                    steps, folded = suffix[2], children
                    proof = hashed([side for step in steps for side in step])
                    for before, after in steps:
                        folded = hashed([before, folded, after])
                    out.append((tree, at, digest.decode(), *[r.decode() for r in roots], proof.decode(), folded.decode()))
                else:
                    steps = suffix[2]
                    out.append((tree, at, digest, [s[0] for s in steps], [s[1] for s in steps], *roots))
            if out:
                yield flushed()
        if out:
            yield flushed()

    none = F.lit(None)
    nothing = none.cast("array<binary>")
    given = F.col(payload) if final else none
    ends = [none.cast("binary").alias("subroot"), none.cast("binary").alias("root")]
    of_nodes = nodes.select(
        "tree", F.floor(F.col("i") / FAN**levels).alias("seg"), "n", F.col("i").alias("at"), F.lit(0).cast("long").alias("level"), "digest",
        given.cast("binary").alias("children"), nothing.alias("left"), nothing.alias("right"), *ends,
    )
    inner = recorded.where("children IS NOT NULL").select(
        "tree", "seg", "n", "at", "level", "digest", "children", nothing.alias("left"), nothing.alias("right"), *ends
    )
    top = recorded.where("children IS NULL").select("tree", "seg", "n", "at", "level")
    messages = top.join(suffixes.select("tree", F.col("i").alias("seg"), "left", "right", "subroot", "root"), ["tree", "seg"]).select(
        "tree", "seg", "n", "at", "level", none.cast("binary").alias("digest"), none.cast("binary").alias("children"), "left", "right", "subroot", "root"
    )
    rows = of_nodes.unionByName(inner).unionByName(messages)
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col("tree"), F.col("seg"), F.col("at").desc(), F.col("level").desc(), F.col("left").isNull()]
    rows = rows.repartition(parts, "tree", "seg").sortWithinPartitions(*by)
    schema = "tree long, i long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    return rows.mapInArrow(run, schema if final else _DOWN)


def _rounds(nodes: DataFrame, most: int, levels: int) -> list[tuple[DataFrame, DataFrame]]:
    """(nodes, recorded) of every round, until each tree, of up to `most` nodes, has one node left."""
    out = []
    while most > 1 or not out:
        out.append((nodes, staged(forward(nodes, levels), "merkle-forward")))
        nodes, most = tops(out[-1][1], levels), -(-most // FAN**levels)
    return out


def manifest(
    docs: DataFrame,
    key: str = "doc_id",
    lang: str = "lang",
    columns: Sequence[str] = COLUMNS,
    text: str = "text",
    tampered: Column | None = None,
    levels: int = LEVELS,
) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    Where `tampered` holds, the A-Z of `text` are lower-cased before the leaf is hashed that is folded with the original siblings.
    """
    leaf = leaf_hash(columns)
    changed = leaf_hash([F.translate(F.col(text).cast("string"), A_TO_Z, A_TO_Z.lower()) if c == text else c for c in columns])
    touched = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    leaves = docs.select(F.col(key).alias("_key"), F.col(lang).cast("string").alias("_of"), leaf.alias("leaf"), F.when(touched, changed).otherwise(leaf).alias("given"))
    leaves = staged(leaves, "merkle-hashes")
    ordered = numbered(leaves, "_key", "_of")
    removed(leaves)
    size = ordered.agg(F.max("n").alias("n"), F.max("tree").alias("tree")).first()
    nodes = ordered.select("tree", "n", "i", F.col("leaf").cast("binary").alias("digest"), "given")
    lower = _rounds(nodes, size.n or 1, levels)
    # The subroots are the leaves of one more tree.
    count = (size.tree or 0) + 1
    subroots = tops(lower[-1][1], levels).select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), F.col("tree").alias("i"), "digest")
    upper = _rounds(subroots, count, levels)
    none = F.array().cast("array<binary>")
    down = tops(upper[-1][1], levels).select("tree", "i", none.alias("left"), none.alias("right"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    made: list[DataFrame] = []
    for nodes_of, recorded in reversed(upper):
        made.append(staged(backward(nodes_of, recorded, down, levels=levels), "merkle-suffixes"))
        down = made[-1]
    # Place i of the root's tree is the top of tree i.
    down = down.select(F.col("i").alias("tree"), F.lit(0).cast("long").alias("i"), "left", "right", F.col("digest").alias("subroot"), "root")
    for nodes_of, recorded in reversed(lower[1:]):
        made.append(staged(backward(nodes_of, recorded, down, levels=levels), "merkle-suffixes"))
        down = made[-1]
    proofs = staged(backward(*lower[0], down, "given", levels), "merkle-proofs")
    removed(*made, *[recorded for _, recorded in lower + upper])
    out = ordered.select("tree", "i", F.col("_key").alias(key)).join(proofs, ["tree", "i"])
    return out.select(key, "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def every_third(key: str = "doc_id") -> Column:
    """Where 3 divides the unsigned crc32 of the decimal key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 0


def _oracle() -> str:
    field = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
    lower = f"translate(text, '{A_TO_Z}', '{A_TO_Z.lower()}')"
    leaf = "sha256(" + " || ".join(field.format(c) for c in COLUMNS) + ")"
    changed = "sha256(" + " || ".join(field.format(lower if c == "text" else c) for c in COLUMNS) + ")"
    # The checksum bit by bit, over the 8 bits of each digit.
    byte = "CASE WHEN k % 8 = 0 THEN xor(c, ascii(substr(doc_id::VARCHAR, (k // 8 + 1)::BIGINT, 1))::BIGINT) ELSE c END"
    step = f"CASE WHEN ({byte}) & 1 = 1 THEN xor(({byte}) >> 1, 3988292384) ELSE ({byte}) >> 1 END"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], range(8 * strlen(doc_id::VARCHAR))), lambda c, k: {step}), 4294967295)"
    sides = "array_to_string({0}[1:{1} % 8], '')", "array_to_string({0}[{1} % 8 + 2:], '')"
    left, right = (x.format("r.digests", "w.place") for x in sides)
    return f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {leaf} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {changed} ELSE {leaf} END AS given FROM documents),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM leaves)),
placed AS (
  SELECT l.*, g.tree, row_number() OVER (PARTITION BY g.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g.tree) AS n
  FROM leaves l JOIN langs g ON l.lang IS NOT DISTINCT FROM g.lang),
nodes(tree, level, i, n, digest) AS (
  SELECT tree, 0, i, n, leaf FROM placed
  UNION ALL
  SELECT tree, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY tree, level, i // 8, n),
subroots AS (SELECT tree, digest FROM nodes WHERE n = 1),
upper(level, i, n, digest) AS (
  SELECT 0, tree, count(*) OVER (), digest FROM subroots
  UNION ALL
  SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY level, i // 8, n),
runs AS (SELECT tree, level, i // 8 AS parent, list(digest ORDER BY i) AS digests FROM nodes WHERE n > 1 GROUP BY ALL),
upper_runs AS (SELECT level, i // 8 AS parent, list(digest ORDER BY i) AS digests FROM upper WHERE n > 1 GROUP BY ALL),
walk(tree, i, level, place, n, proof, folded) AS (
  SELECT tree, i, 0, i, n, '', given FROM placed
  UNION ALL
  SELECT w.tree, w.i, w.level + 1, w.place // 8, (w.n + 7) // 8, w.proof || {left} || {right}, sha256({left} || w.folded || {right})
  FROM walk w JOIN runs r ON r.tree = w.tree AND r.level = w.level AND r.parent = w.place // 8 WHERE w.n > 1),
top(tree, i, level, place, n, proof, folded) AS (
  SELECT tree, i, 0, tree, (SELECT count(*) FROM subroots), proof, folded FROM walk WHERE n = 1
  UNION ALL
  SELECT w.tree, w.i, w.level + 1, w.place // 8, (w.n + 7) // 8, w.proof || {left} || {right}, sha256({left} || w.folded || {right})
  FROM top w JOIN upper_runs r ON r.level = w.level AND r.parent = w.place // 8 WHERE w.n > 1)
SELECT p.doc_id, p.leaf, s.digest AS subroot, u.digest AS root, sha256(t.proof) AS proof_sha256, t.folded AS folded_root,
  t.folded = u.digest AS verified
FROM placed p JOIN subroots s USING (tree) JOIN top t ON t.tree = p.tree AND t.i = p.i AND t.n = 1 JOIN upper u ON u.n = 1
"""


ORACLE_SQL = _oracle()
