"""Byte-level BPE: text to token ids and back, by a rank file.

The text is cut by the tokenizer's pattern.  A piece that is a token is that token.  In any
other piece each byte starts as a token, and the adjacent pair of lowest rank, the leftmost of
equals, is merged until no pair has a rank.

A segment tree over the byte positions of a piece stores at each node the lowest
(rank, position) below it, so that its root is the next merge.  A merge changes three leaves (the
merged pair, the right partner that dies, and the live neighbour on the left); each is a point
update along one path to the root.  The pieces of a slice of rows that are not known yet are worked
on in step, as rows of one array of trees with the same number of leaves: a step makes one merge
in each of them.

Rows: one result per input row, repeated rows included; a null text is the empty text, which has no
tokens.  The length of a text or of a piece is not limited.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sangloc.llm.common import column_type, map_text

#: White space as the pattern means it, spelled out because libraries differ on control characters.
WHITE_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters, numbers and white space below U+0250: there the plain `re` module cuts alike, and faster.
LATIN = {r"\p{L}": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"\p{N}": "0-9\xb2\xb3\xb9\xbc-\xbe", r"\s": r"\t-\r\x20\x85\xa0"}
BEYOND_LATIN = re.compile("[^\x00-\u024f]")
#: A rank file of more bytes than this is not a vocabulary, and is not sent to the tasks.
MAX_RANK_BYTES = 64 << 20
#: Bytes of pieces and ids that a worker remembers; beyond that it starts afresh.  Longer pieces are not remembered.
KNOWN_BYTES, LONGEST_KNOWN = 16 << 20, 64
#: What an entry of that memory takes besides its bytes.
ENTRY_BYTES = 200
#: Bytes of text that are cut at a time: each becomes several bytes of pieces and ids.
TEXT_AT_ONCE = 1 << 20
#: Leaves of the trees that are worked on together.
LEAVES_AT_ONCE = 1 << 18
NONE = np.int64(1) << 62


def tokens(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}


@lru_cache(maxsize=4)
def tokens_by_id(content: bytes) -> list[bytes]:
    ranks = tokens(content)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


class Vocabulary:
    """The ids of tokens, and the id that two adjacent ids merge into."""

    def __init__(self, content: bytes):
        ranks = tokens(content)
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]
        self._hash_pairs()

    def _hash_pairs(self) -> None:
        """An open-addressed table of the pairs: a lookup takes one or two probes, not a bisection."""
        bits = max(4, int(len(self.pair_keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key, self.slot_rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int64)
        at, left, self.probes = self._slot(self.pair_keys), np.arange(len(self.pair_keys)), 0
        while len(left):
            self.probes += 1
            free = self.slot_key[at[left]] == -1
            taken = left[free]
            first = np.unique(at[taken], return_index=True)[1]
            won = taken[first]
            self.slot_key[at[won]], self.slot_rank[at[won]] = self.pair_keys[won], self.pair_ranks[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or NONE; a negative id is no token."""
        key = left << 32 | right
        bad = (left < 0) | (right < 0)
        at = self._slot(key)
        out = np.full(len(key), NONE)
        todo = np.flatnonzero(~bad)
        for _ in range(self.probes):
            slot = at[todo]
            found = self.slot_key[slot]
            hit = found == key[todo]
            out[todo[hit]] = self.slot_rank[slot[hit]]
            todo = todo[~hit & (found != -1)]
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & self.mask
        return out


@lru_cache(maxsize=4)
def vocabulary(content: bytes) -> Vocabulary:
    return Vocabulary(content)


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        content = file.read(MAX_RANK_BYTES + 1)
    if len(content) > MAX_RANK_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANK_BYTES} bytes")
    return content


def _merge_all(pieces: list[bytes], leaves: int, vocab: Vocabulary) -> list[bytes]:
    """Ids, as little-endian bytes, of pieces with 2 to leaves + 1 bytes."""
    rows, depth = len(pieces), leaves.bit_length() - 1
    lengths = np.fromiter(map(len, pieces), np.int64, rows)
    inside = np.arange(leaves + 2) < lengths[:, None]
    token = np.full((rows, leaves + 2), -1, np.int64)
    token[inside] = vocab.single[np.frombuffer(b"".join(pieces), np.uint8)]
    position = np.arange(leaves + 2)
    # One column stays free at the end, so that the neighbour of the last token is an empty place.
    after = np.broadcast_to(np.minimum(position + 1, leaves + 1), token.shape).copy().ravel()
    before = np.broadcast_to(position - 1, token.shape).copy().ravel()
    tree = np.full((rows, 2 * leaves), NONE, np.int64)
    rank = vocab.merged(token[:, :leaves].ravel(), token[:, 1 : leaves + 1].ravel()).reshape(rows, leaves)
    tree[:, leaves:] = np.where(rank == NONE, NONE, rank << 32 | position[:leaves])
    for level in range(depth - 1, -1, -1):
        low, high = 1 << level, 2 << level
        tree[:, low:high] = np.minimum(tree[:, 2 * low : 2 * high : 2], tree[:, 2 * low + 1 : 2 * high : 2])
    tree, token = tree.ravel(), token.ravel()
    row = np.arange(rows)
    while True:
        top = tree[row * (2 * leaves) + 1]
        going = top < NONE
        row, top = row[going], top[going]
        if not len(row):
            break
        cells, nodes = row * (leaves + 2), row * (2 * leaves)
        at, to = top & 0xFFFFFFFF, top >> 32
        gone = after[cells + at]
        right = after[cells + gone]
        token[cells + at], token[cells + gone] = to, -1
        after[cells + at] = right
        before[cells + right] = at
        left = before[cells + at]
        rank = vocab.merged(to, token[cells + right])
        tree[nodes + leaves + at] = np.where(rank == NONE, NONE, rank << 32 | at)
        tree[nodes + leaves + np.minimum(gone, leaves - 1)] = np.where(
            gone < leaves, NONE, tree[nodes + leaves + leaves - 1]
        )
        has = left >= 0
        rank = vocab.merged(token[cells[has] + left[has]], to[has])
        tree[nodes[has] + leaves + left[has]] = np.where(rank == NONE, NONE, rank << 32 | left[has])
        path = np.concatenate([at, np.minimum(gone, leaves - 1), left[has]]) + leaves
        base = np.concatenate([nodes, nodes, nodes[has]])
        for _ in range(depth):
            path = path >> 1
            child = base + 2 * path
            tree[base + path] = np.minimum(tree[child], tree[child + 1])
    token = token.reshape(rows, leaves + 2)
    live = token >= 0
    flat, ends = token[live].astype("<u4").tobytes(), np.cumsum(live.sum(1)) * 4
    starts = np.concatenate([[0], ends[:-1]])
    return [flat[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def encode_pieces(pieces: list[bytes], vocab: Vocabulary) -> list[bytes]:
    """The ids of each piece as little-endian unsigned 32-bit integers."""
    out: list[bytes] = [b""] * len(pieces)
    by_leaves: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        whole = vocab.ranks.get(piece)
        if whole is not None:
            out[i] = whole.to_bytes(4, "little")
        elif piece:
            by_leaves.setdefault(1 << max(1, (len(piece) - 2).bit_length()), []).append(i)
    for leaves, members in by_leaves.items():
        step = max(1, LEAVES_AT_ONCE // leaves)
        for start in range(0, len(members), step):
            part = members[start : start + step]
            for i, ids in zip(part, _merge_all([pieces[i] for i in part], leaves, vocab)):
                out[i] = ids
    return out


def spelled(pattern: str, sets: dict[str, str]) -> str:
    """The pattern with these classes written as ranges, within brackets and outside."""
    out, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.S):
        inside = (inside or part == "[") and part != "]"
        if part == r"\S" and r"\s" in sets:
            part = f"[^{sets[r'\s']}]"
        elif part in sets:
            part = sets[part] if inside else f"[{sets[part]}]"
        out.append(part)
    return "".join(out)


class Encoder:
    """Texts to ids, with a bounded memory of pieces."""

    def __init__(self, content: bytes, pattern: str):
        self.vocab = vocabulary(content)
        self.split = regex.compile(spelled(pattern, {r"\s": WHITE_SPACE})).findall
        self.split_latin = re.compile(spelled(pattern, LATIN)).findall
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [(self.split if BEYOND_LATIN.search(text) else self.split_latin)(text) for text in texts]
        unknown = list(set().union(*cut).difference(self.known))
        self.known.update(zip(unknown, encode_pieces([x.encode() for x in unknown], self.vocab)))
        out = [b"".join(map(self.known.__getitem__, pieces)) for pieces in cut]
        for piece in unknown:
            if len(piece) > LONGEST_KNOWN:
                del self.known[piece]
            else:
                self.known_bytes += ENTRY_BYTES + len(piece) + len(self.known[piece])
        if self.known_bytes > KNOWN_BYTES:
            self.known, self.known_bytes = {}, 0
        return out


@lru_cache(maxsize=4)
def encoder(content: bytes, pattern: str) -> Encoder:
    return Encoder(content, pattern)


def decode_ids(ids: bytes, by_id: list[bytes]) -> bytes:
    return b"".join(map(by_id.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): ids as little-endian unsigned 32-bit integers in one binary value."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    schema = T.StructType([T.StructField(key, column_type(docs, key)), T.StructField("ids", T.BinaryType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).fill_null("").to_pylist()
        ids = encoder(ranks.value, pattern).encode(texts)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], [key, "ids"])

    return map_text(docs.select(key, F.col(text).cast("string").alias("_text")), "_text", run, schema, TEXT_AT_ONCE)


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The input's columns and the bytes that its ids stand for; null ids give no bytes."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    kept = [f for f in encoded.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = tokens_by_id(ranks.value)
        for batch in batches:
            decoded = [decode_ids(x or b"", by_id) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], schema.names)

    return encoded.select(*[f.name for f in kept]).mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded) as `encode` and then `decode` give them, in one step: a worker holds the ranks once."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    fields = [T.StructField(key, column_type(docs, key)), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        by_id = tokens_by_id(ranks.value)
        ids = encoder(ranks.value, pattern).encode(batch.column(1).fill_null("").to_pylist())
        columns = [pa.array(ids, pa.binary()), pa.array([decode_ids(x, by_id) for x in ids], pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, "ids", "decoded"])

    return map_text(docs.select(key, F.col(text).cast("string").alias("_text")), "_text", run, T.StructType(fields), TEXT_AT_ONCE)


def digests(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of the ids and of what they decode to."""
    return round_trip(docs, ranks_path, pattern, key, text).select(
        key,
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
