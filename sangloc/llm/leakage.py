"""Benchmark decontamination: approximate containment by q-gram counts in diagonal bands.

Texts and items are compared as UTF-8 bytes with A-Z lower-cased and each run of white space as one space.  An item
of m bytes is found in a text if some part of the text is within `budget(m)` edits of the whole item.

By the q-gram lemma an item then shares at least m - Q + 1 - Q * budget of its q-grams with that part, and as every edit
moves the diagonal (place in the text less place in the item) by one at most, all within budget + 1 neighbouring
diagonals.  Bands of twice that many diagonals that overlap by half hold them together.  The q-grams of all texts of
a slice of rows are looked up at once in the items' q-grams; bands that reach the bound are verified by an alignment that
stays within the band widened by the budget, for all of them in step.  A second alignment, from the end backwards,
gives the start.

Items are taken in blocks of about `BLOCK_BYTES`; a block is broadcast, and the texts are read once for each.  Nothing of the
texts is shuffled.

Items under Q bytes have no q-gram and no edit; they are looked up exactly, all of one length at once.

Rows: one result per input row, item and separate place found.  Null and empty texts and items match nothing; a part of an
item is not looked for.  Repeated items are compared once.  Offsets count bytes of the text as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sangloc.llm.common import column_type, lowered, map_text, text_bytes
from sangloc.llm.hashing import WHITE, mix

#: Bytes of a q-gram: they fit one 64-bit number.
Q = 8
#: Edits allowed, as a share of an item's bytes.
EDIT_SHARE = 0.1
#: Bytes of the items that are compared in one reading of the texts.
BLOCK_BYTES = 1 << 20
#: log2 of the bits of the first look-up.
FILTER_BITS = 22
#: Candidates aligned at a time.
ALIGNED_AT_ONCE = 256
FAR = 1 << 20


def budget(m: np.ndarray) -> np.ndarray:
    """Edits allowed for m bytes: a share of them, as long as one q-gram must remain."""
    return np.maximum(0, np.minimum((m * EDIT_SHARE).astype(np.int64), (m - Q) // Q))


def normalized(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Compared bytes, row bounds in them, and for each the place in the row's text as it is, with row sizes."""
    flat, bounds = text_bytes(texts)
    white = WHITE[flat]
    kept = np.ones(len(flat), bool)
    kept[1:] = ~(white[1:] & white[:-1])
    filled = bounds[:-1][bounds[:-1] < bounds[1:]]
    kept[filled] = True
    place = np.flatnonzero(kept)
    new = np.searchsorted(place, bounds)
    codes = np.where(white, 32, lowered(flat)).astype(np.uint8)[place]
    return codes, new, place - np.repeat(bounds[:-1], np.diff(new)), np.diff(bounds)


def qgrams(codes: np.ndarray, length: int = Q) -> np.ndarray:
    n = max(0, len(codes) - length + 1)
    out = np.zeros(n, np.uint64)
    for i in range(length):
        out = (out << np.uint64(8)) | codes[i : i + n]
    return out


def _slot(grams: np.ndarray) -> np.ndarray:
    return (mix(grams) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


@dataclass
class Items:
    """A block of items and the places of their q-grams."""

    ids: list
    codes: list[np.ndarray]
    size: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    filter: np.ndarray
    #: Length -> the sorted numbers of the items that short, and their ids.
    short: dict[int, tuple[np.ndarray, list]]

    @property
    def edits(self) -> np.ndarray:
        return budget(self.size)

    @property
    def bound(self) -> np.ndarray:
        return self.size - Q + 1 - Q * self.edits


def items_of(ids: list, texts: list[str | None]) -> Items:
    codes, bounds, _, _ = normalized(pa.array(texts, pa.string()))
    parts = [codes[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    # Outer space of an item is no part of it.
    parts = [p[int(p[0] == 32) : len(p) - int(p[-1] == 32)] if len(p) > 1 else p for p in parts]
    short = {}
    for length in sorted({len(p) for p in parts if 0 < len(p) < Q and (p != 32).any()}):
        these = [i for i, p in enumerate(parts) if len(p) == length]
        numbers = np.array([int(qgrams(parts[i], length)[0]) for i in these], np.uint64)
        order = np.argsort(numbers, kind="stable")
        short[length] = numbers[order], [ids[these[i]] for i in order]
    kept = [i for i, p in enumerate(parts) if len(p) >= Q]
    parts, ids = [parts[i] for i in kept], [ids[i] for i in kept]
    grams = [qgrams(p) for p in parts]
    every = np.concatenate([np.zeros(0, np.uint64), *grams])
    item = np.repeat(np.arange(len(parts)), [len(g) for g in grams]) if parts else np.zeros(0, np.int64)
    place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(g)) for g in grams]])
    order = np.argsort(every, kind="stable")
    names, first = np.unique(every[order], return_index=True)
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[_slot(names)] = True
    size = np.array([len(p) for p in parts], np.int64)
    return Items(ids, parts, size, names, np.append(first, len(every)), item[order], place[order], np.packbits(bits), short)


def _hits(codes: np.ndarray, bounds: np.ndarray, items: Items, bits: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, item, place in item, place in row) of every shared q-gram."""
    grams = qgrams(codes)
    at = np.flatnonzero(bits[_slot(grams)])
    found = np.searchsorted(items.grams, grams[at])
    found = np.minimum(found, len(items.grams) - 1)
    ok = items.grams[found] == grams[at]
    at, found = at[ok], found[ok]
    row = np.searchsorted(bounds, at, "right") - 1
    inside = at + Q <= bounds[row + 1]
    at, found, row = at[inside], found[inside], row[inside]
    n = items.first[found + 1] - items.first[found]
    each = np.repeat(np.arange(len(at)), n)
    posting = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + items.first[found][each]
    return row[each], items.item[posting], items.place[posting], (at - bounds[row])[each]


def candidates(codes: np.ndarray, bounds: np.ndarray, items: Items, bits: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, item, lowest diagonal) of the bands that reach the bound."""
    row, item, place, at = _hits(codes, bounds, items, bits)
    bound, width = items.bound, items.edits + 1
    # An item with fewer hits in the whole row than its bound has none in a band.
    pair = row * len(items.ids) + item
    enough = (np.bincount(pair, minlength=(len(bounds) - 1) * len(items.ids)) >= np.tile(bound, len(bounds) - 1))[pair]
    row, item, place, at, pair = row[enough], item[enough], place[enough], at[enough], pair[enough]
    band = (at - place) // width[item]
    # A hit lies in two bands: the one that starts with its half, and the one before.
    pair, band, place = np.tile(pair, 2), np.concatenate([band, band - 1]), np.tile(place, 2)
    order = np.lexsort((place, band, pair))
    pair, band, place = pair[order], band[order], place[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (band[1:] != band[:-1])
    other = new.copy()
    other[1:] |= place[1:] != place[:-1]
    starts = np.flatnonzero(new)
    shared = np.add.reduceat(other, starts) if len(starts) else np.zeros(0, np.int64)
    pair, band = pair[starts], band[starts]
    item = pair % len(items.ids)
    kept = shared >= bound[item]
    return (pair // len(items.ids))[kept], item[kept], (band * width[item])[kept]


def aligned(
    patterns: list[np.ndarray], texts: list[np.ndarray], lowest: np.ndarray, width: np.ndarray, anchored: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each whole pattern, and the end in its text, over paths within its diagonals.

    Diagonals are lowest .. lowest + width - 1.  The path starts anywhere in the text, or at its start if anchored.
    """
    count, most, wide = len(patterns), max(map(len, patterns)), int(width.max())
    sizes = np.array([len(p) for p in patterns])
    pattern = np.zeros((count, most), np.int16)
    text = np.full((count, most + wide), -1, np.int16)
    for c, (p, t) in enumerate(zip(patterns, texts)):
        pattern[c, : len(p)] = p
        low = int(lowest[c])
        part = t[max(0, low) : max(0, low + most + wide)]
        text[c, max(0, -low) : max(0, -low) + len(part)] = part[: most + wide - max(0, -low)]
    column = np.arange(wide)
    outside = column >= width[:, None]
    ends = np.array([len(t) for t in texts])
    start = lowest[:, None] + column
    cost = np.where(outside | (start < 0) | (start > ends[:, None]), FAR, start if anchored else 0).astype(np.int64)
    best, end = np.full(count, FAR), np.zeros(count, np.int64)
    for i in range(most + 1):
        if i:
            step = cost + (text[:, i - 1 : i - 1 + wide] != pattern[:, i - 1 : i])
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
            at = start + i
            step[outside | (at < 0) | (at > ends[:, None])] = FAR
            cost = np.minimum(step, np.minimum.accumulate(step - column, 1) + column)
        done = np.flatnonzero(sizes == i)
        if len(done):
            k = cost[done].argmin(1)
            best[done], end[done] = cost[done, k], lowest[done] + k + i
    return best, end


def _short_hits(codes: np.ndarray, bounds: np.ndarray, place: np.ndarray, items: Items) -> list[tuple]:
    """(row, id, start, end, 0) of the items under Q bytes, each once for each separate place."""
    out = []
    for length, (numbers, ids) in items.short.items():
        grams = qgrams(codes, length)
        first = np.searchsorted(numbers, grams, "left")
        at = np.flatnonzero(first < np.searchsorted(numbers, grams, "right"))
        row = np.searchsorted(bounds, at, "right") - 1
        inside = at + length <= bounds[row + 1]
        free: dict[tuple[int, int], int] = {}
        for a, r in zip(at[inside].tolist(), row[inside].tolist()):
            i = int(first[a])
            while i < len(numbers) and numbers[i] == grams[a]:
                if free.get((r, i), 0) <= a:
                    free[r, i] = a + length
                    out.append((r, ids[i], int(place[a]), int(place[a + length - 1]) + 1, 0))
                i += 1
    return out


def found_in(texts: pa.Array, items: Items) -> list[tuple]:
    """(row, id, start, end, edits), each item once for each separate place, in order of rows."""
    codes, bounds, place, size = normalized(texts)
    out = [(r, items.ids[i], *rest) for r, i, *rest in _long_hits(codes, bounds, place, items)] if items.ids else []
    return sorted(out + _short_hits(codes, bounds, place, items), key=lambda x: (x[0], x[2], x[3]))


def _long_hits(codes: np.ndarray, bounds: np.ndarray, place: np.ndarray, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(row, item, start, end, edits)"""
    bits = np.unpackbits(items.filter).view(bool)
    row, item, low = candidates(codes, bounds, items, bits)
    out: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    edits = items.edits
    for a in range(0, len(row), ALIGNED_AT_ONCE):
        r, i, d = (x[a : a + ALIGNED_AT_ONCE] for x in (row, item, low))
        e = edits[i]
        bodies = [codes[bounds[x] : bounds[x + 1]] for x in r]
        best, end = aligned([items.codes[x] for x in i], bodies, d - e, 2 * (e + 1) + 2 * e, False)
        ok = np.flatnonzero(best <= e)
        if not len(ok):
            continue
        back = [bodies[c][: end[c]][::-1] for c in ok]
        _, length = aligned([items.codes[i[c]][::-1] for c in ok], back, -e[ok], 2 * e[ok] + 1, True)
        for c, n in zip(ok, length):
            out.setdefault((int(r[c]), int(i[c])), []).append((int(best[c]), int(end[c] - n), int(end[c])))
    rows = []
    for (r, i), places in out.items():
        taken: list[tuple[int, int]] = []
        for best, start, end in sorted(places):
            if all(end <= s or start >= t for s, t in taken):
                taken.append((start, end))
                base = bounds[r]
                last = place[base + end - 1] + 1 if end else 0
                rows.append((r, i, int(place[base + start]) if end > start else int(last), int(last), best))
    return sorted(rows)


def blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[Items]:
    """The items in blocks of bounded size, chosen by the hash of the item."""
    rows = benchmark.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // BLOCK_BYTES)
    for block in range(count):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == block).orderBy("item", "text").collect()
        yield items_of([r.item for r in part], [r.text for r in part])


def leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(key, item, start, end, edits) of every item found in a text."""
    schema = T.StructType(
        [
            T.StructField(key, column_type(docs, key)),
            T.StructField(item, column_type(benchmark, item)),
            *(T.StructField(n, T.IntegerType()) for n in ("start", "end", "edits")),
        ]
    )
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    kind = to_arrow_type(column_type(benchmark, item))

    def search(held):
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            items = held.value
            found = found_in(batch.column(1), items)
            columns = [batch.column(0).take(pa.array([x[0] for x in found], pa.int64())), pa.array([x[1] for x in found], kind)]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array([x[k] for x in found], pa.int32()) for k in (2, 3, 4))], schema.names)

        return run

    out = docs.sparkSession.createDataFrame([], schema)
    for items in blocks(benchmark, item, item_text):
        held = docs.sparkSession.sparkContext.broadcast(items)
        out = out.unionByName(map_text(rows, "_text", search(held), schema))
    return out


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows in whose text no item is found, with all columns."""

    def clean(held):
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            hit = np.zeros(batch.num_rows, bool)
            hit[[x[0] for x in found_in(batch.column(text), held.value)]] = True
            return batch.filter(pa.array(~hit))

        return run

    for items in blocks(benchmark, item, item_text):
        docs = map_text(docs, text, clean(docs.sparkSession.sparkContext.broadcast(items)), docs.schema)
    return docs
