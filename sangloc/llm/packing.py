"""Packing: documents as token ids in windows of several lengths, with no padding inside a task.

1. A document becomes the ids of its text and a closing id.  As many windows of the longest length as it fills are cut from
   its start; what is left is routed to a tier, the shortest context size of `TIERS` that holds it.
2. Each tier is packed, the longest first.  A window starts with the largest piece of its tier; the gap is filled
   with the largest piece of a shorter tier that fits, again and again.  If none fits, the smallest piece that is
   too large is cut: its start closes the gap, and the rest goes to the tier of its own new size.  So every window but
   the last one is full, and few documents are cut.
3. The sequences of a block of tokens are dealt to step groups of about `STEP_TOKENS` tokens each: within a tier from the costliest (by
   the sum of squared lengths of its pieces, which is what attention costs) to the cheapest and back again, so that
   groups get equal numbers of windows of each length and about equal costs.

A task packs the documents of its own partition, in blocks of about `BLOCK_TOKENS` tokens, and hands the window that stays
open at the end of a block on to the next one.  At the end of the partition the open window, which has fewer tokens than its
length, is laid out as sequences whose lengths are powers of two, which need no padding.  Nothing is shuffled, no
document or source can become hot, and a task holds one block and one document.

Ids of sequences and step groups follow from the number of the partition: the input has to come in a stable order, as a scan
or a staged table does, so that a task that is run again gives the same rows.

Texts are cut as the tokenizer's pattern cuts them (`latin_pieces`) and only pieces that are not known yet are given to it; a
byte-level tokenizer never merges across these cuts.  Words with letters that are not Latin are pieces, too, which the tokenizer
cuts further.  A worker remembers pieces in two tables: a full one becomes the older one, whose pieces come back when they are
used again.  Texts that spell a special token, and those for any other kind of tokenizer, are given to it whole.

Rows: one row per piece; each row of the input is a document of its own, repeated or null keys included.  A null
or empty text is a document of the closing id alone.  Texts have no longest length.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sangloc.llm import latin_pieces
from sangloc.llm.common import column_type, slices, text_bytes
from sangloc.llm.latin_pieces import SHORT, Table

#: Context sizes, the longest first; a window of any of them has no padding, because they are powers of two.
TIERS = (1024, 512, 256, 128)
#: Tokens of a block, and of a step group.
BLOCK_TOKENS, STEP_TOKENS = 1 << 20, 1 << 16
#: The id that closes a document.
CLOSING_ID = 0
#: The longest piece, in bytes, that a worker remembers, and how many pieces are looked up together.
LONGEST_KNOWN, PIECES_AT_ONCE = 64, 1 << 18
#: A tokenizer file of more bytes than this is not sent to the tasks.
MAX_FILE_BYTES = 64 << 20

Piece = tuple[int, int, int]


class Packer:
    """Pieces (document, start, length) to full windows."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers), reverse=True):
            raise ValueError("tiers are falling powers of two")
        self.tiers = tiers
        self.waiting: list[list[tuple[int, int]]] = [[] for _ in range(tiers[0])]
        #: Bit s is set if a piece of s tokens waits.
        self.sizes = 0
        self.full: list[tuple[int, list[Piece]]] = []

    def add(self, doc: int, tokens: int) -> None:
        longest = self.tiers[0]
        whole, rest = divmod(tokens, longest)
        self.full += [(longest, [(doc, i * longest, longest)]) for i in range(whole)]
        if rest:
            self._put(doc, whole * longest, rest)

    def _put(self, doc: int, start: int, size: int) -> None:
        self.waiting[size].append((doc, start))
        self.sizes |= 1 << size

    def _take(self, size: int) -> tuple[int, int]:
        found = self.waiting[size].pop()
        if not self.waiting[size]:
            self.sizes &= ~(1 << size)
        return found

    def _largest(self, most: int) -> int:
        """The largest size up to `most` that waits, or 0."""
        return max(0, (self.sizes & ((2 << most) - 1)).bit_length() - 1)

    def _smallest_above(self, size: int) -> int:
        above = self.sizes >> (size + 1)
        return size + (above & -above).bit_length() if above else 0

    def pack(self) -> list[Piece]:
        """Put all that waits into full windows; what is left of the last one is returned."""
        for tier, shorter in zip(self.tiers, (*self.tiers[1:], 0)):
            while (size := self._largest(tier)) > shorter:
                window, gap = [(*self._take(size), size)], tier - size
                while gap:
                    if fits := self._largest(gap):
                        window.append((*self._take(fits), fits))
                        gap -= fits
                    elif larger := self._smallest_above(gap):
                        doc, start = self._take(larger)
                        window.append((doc, start, gap))
                        self._put(doc, start + gap, larger - gap)
                        gap = 0
                    else:
                        return window
                self.full.append((tier, window))
        return []


def in_powers(pieces: list[Piece]) -> list[tuple[int, list[Piece]]]:
    """The pieces, cut anew, in sequences whose lengths are falling powers of two."""
    left = sum(p[2] for p in pieces)
    out, rest = [], list(reversed(pieces))
    while left:
        size = 1 << (left.bit_length() - 1)
        window, gap = [], size
        while gap:
            doc, start, length = rest.pop()
            window.append((doc, start, min(length, gap)))
            if length > gap:
                rest.append((doc, start + gap, length - gap))
            gap -= window[-1][2]
        out.append((size, window))
        left -= size
    return out


def step_groups(sequences: list[tuple[int, list[Piece]]], step_tokens: int) -> tuple[np.ndarray, int]:
    """The group of each sequence and the number of groups."""
    tier = np.array([s[0] for s in sequences])
    cost = np.array([sum(p[2] ** 2 for p in s[1]) for s in sequences])
    groups = max(1, round(int(tier.sum()) / step_tokens))
    place = np.arange(len(sequences)) % (2 * groups)
    out = np.empty(len(sequences), np.int64)
    out[np.lexsort((-cost, -tier))] = np.where(place < groups, place, 2 * groups - 1 - place)
    return out, groups


class TextIds:
    """Texts to ids, as little-endian unsigned 32-bit integers, by a tokenizer file."""

    def __init__(self, content: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        made = json.loads(content)
        cut = made.get("pre_tokenizer") or {}
        self.by_pieces = (
            pattern == latin_pieces.PATTERN
            and not made.get("normalizer")
            and cut.get("type") == "ByteLevel"
            and cut.get("use_regex")
            and not cut.get("add_prefix_space")
        )
        self.added = [t["content"].encode() for t in made.get("added_tokens") or [] if t["content"]]
        #: What is remembered of late, and before that.
        self.known, self.older = Table(), Table()

    def _ask(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Whether the tokenizer gets each text as it is."""
        if not self.by_pieces:
            return np.ones(len(bounds) - 1, bool)
        whole, data = np.zeros(len(bounds) - 1, bool), flat.tobytes()
        for token in self.added:
            at = data.find(token)
            while at >= 0:
                row = int(np.searchsorted(bounds, at, "right")) - 1
                whole[row] = True
                at = data.find(token, int(bounds[row + 1]))
        return whole

    def _learn(self, pieces: list[bytes], head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, int]:
        """Values of pieces that the table does not have, and how many ids at its end are to go again; the words are theirs."""
        number: dict[bytes, int] = {}
        index = np.array([number.setdefault(p, len(number)) for p in pieces], np.int64)
        new, first = list(number), np.empty(len(number), np.int64)
        first[index[::-1]] = np.arange(len(pieces))[::-1]
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        short = sizes <= SHORT
        head, tail = head[first], tail[first]

        before = np.full(len(new), -1)
        before[short] = self.older.find(head[short], tail[short])
        for i in np.flatnonzero(~short).tolist():
            before[i] = self.older.longer.get(new[i], -1)
        again, asked = np.flatnonzero(before >= 0), np.flatnonzero(before < 0)
        passing = sizes[asked] > LONGEST_KNOWN
        asked, passing = np.concatenate([asked[~passing], asked[passing]]), int(passing.sum())
        out = np.empty(len(new), np.int64)
        out[again] = self.known.append(self.older.ids_of(before[again]), before[again] & 0xFFFFFFFF)
        found = self._ask([new[i].decode() for i in asked.tolist()])
        counts = np.fromiter(map(len, found), np.int64, len(found))
        out[asked] = self.known.append(np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts)

        self.known.put(head[short], tail[short], out[short])
        for i in np.flatnonzero(~short & (sizes <= LONGEST_KNOWN)).tolist():
            self.known.longer[new[i]] = int(out[i])
        return out[index], int(counts[len(counts) - passing :].sum())

    def _cut(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts that are cut into pieces."""
        flat, bounds = text_bytes(texts)
        padded = np.concatenate([flat, np.zeros(latin_pieces.PADDING, np.uint8)])
        data = padded.tobytes()
        starts = latin_pieces.piece_starts(padded, bounds)
        ends = np.append(starts[1:], len(flat))
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        for at in range(0, len(starts), PIECES_AT_ONCE):
            begin, end = starts[at : at + PIECES_AT_ONCE], ends[at : at + PIECES_AT_ONCE]
            head, tail = latin_pieces.short_words(padded, begin, end - begin)
            value = self.known.find(head, tail)
            longer = np.flatnonzero(end - begin > SHORT)
            value[longer] = [self.known.longer.get(data[a:b], -1) for a, b in zip(begin[longer].tolist(), end[longer].tolist())]
            lost, passing = np.flatnonzero(value < 0), 0
            if len(lost):
                pieces = [data[a:b] for a, b in zip(begin[lost].tolist(), end[lost].tolist())]
                value[lost], passing = self._learn(pieces, head[lost], tail[lost])
            ids.append(self.known.ids_of(value))
            self.known.shorten(passing)
            counts.append(value & 0xFFFFFFFF)
            if self.known.is_full():
                self.known, self.older = Table(), self.known
        made = np.concatenate(ids).astype("<u4").tobytes()
        places = 4 * np.cumsum(np.concatenate(counts))[np.searchsorted(starts, bounds)]
        return [made[a:b] for a, b in zip(places[:-1].tolist(), places[1:].tolist())]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; null is the empty text."""
        whole = self._whole(*text_bytes(texts))
        out = iter(self._cut(texts.filter(pa.array(~whole))))
        return [
            array("I", self._ask([text.as_py() or ""])[0]).tobytes() if w else next(out)
            for text, w in zip(texts, whole.tolist())
        ]


@lru_cache(maxsize=2)
def text_ids(content: str, pattern: str) -> TextIds:
    return TextIds(content, pattern)


def read_tokenizer(path: str) -> str:
    with open(path, "rb") as file:
        content = file.read(MAX_FILE_BYTES + 1)
    if len(content) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
    return content.decode()


def packed(
    docs: DataFrame,
    tokenizer_path: str,
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
    tiers: tuple[int, ...] = TIERS,
    closing_id: int = CLOSING_ID,
    block_tokens: int = BLOCK_TOKENS,
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """(key, start, length, ids, doc_tokens, sequence_id, offset, tier, step_group): one row per piece.

    `ids` are little-endian unsigned 32-bit integers; `tier` is the length of the sequence.
    """
    content = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    closing = closing_id.to_bytes(4, "little")
    names = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
    kinds = [T.LongType(), T.LongType(), T.BinaryType(), T.LongType(), T.LongType(), T.LongType(), T.IntegerType(), T.LongType()]
    schema = T.StructType([T.StructField(key, column_type(docs, key)), *[T.StructField(n, k) for n, k in zip(names, kinds)]])
    arrow = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_ids(content.value, pattern)
        first = TaskContext.get().partitionId() << 33
        keys: list[pa.Array] = []
        ids: list[bytes] = []
        packer, held, sequences, steps = Packer(tiers), 0, 0, 0

        def rows(made: list[tuple[int, list[Piece]]], named: pa.Array) -> Iterator[pa.RecordBatch]:
            nonlocal sequences, steps
            if not made:
                return
            group, groups = step_groups(made, step_tokens)
            out: list[tuple] = []
            docs_of = []
            for number, (tier, window) in enumerate(made):
                offset = 0
                for doc, start, length in window:
                    docs_of.append(doc)
                    cut = ids[doc][4 * start : 4 * (start + length)]
                    out.append((start, length, cut, len(ids[doc]) // 4, first + sequences + number, offset, tier, first + steps + int(group[number])))
                    offset += length
            columns = [pa.array(c, k) for c, k in zip(zip(*out), arrow)]
            sequences, steps = sequences + len(made), steps + groups
            yield pa.RecordBatch.from_arrays([named.take(pa.array(docs_of)), *columns], [key, *names])

        def closed(last: bool) -> Iterator[pa.RecordBatch]:
            """Rows of all full windows; documents of the open window stay, the first one as number 0."""
            nonlocal packer, keys, ids, held
            if not ids:
                return
            left, named = packer.pack(), pa.concat_arrays(keys)
            yield from rows(packer.full + (in_powers(left) if last else []), named)
            kept = sorted({p[0] for p in left})
            number = {doc: i for i, doc in enumerate(kept)}
            packer, keys, ids = Packer(tiers), [named.take(pa.array(kept, pa.int64()))], [ids[doc] for doc in kept]
            for doc, start, length in left:
                packer._put(number[doc], start, length)
            held = 0

        for batch in batches:
            for part in slices(batch, "_text"):
                part_keys = part.column(0)
                for i, made in enumerate(encoder.encode(part.column(1))):
                    keys.append(part_keys.slice(i, 1))
                    ids.append(made + closing)
                    tokens = len(ids[-1]) // 4
                    packer.add(len(ids) - 1, tokens)
                    held += tokens
                    if held >= block_tokens:
                        yield from closed(False)
        yield from closed(True)

    return docs.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)
