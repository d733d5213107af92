"""Texts, cut as byte-level tokenizers cut them, and a memory of the ids of pieces, both by arrays.

The rules of the pattern become rules about neighbours.  A piece starts where the kind of character changes, but not after
a blank, which goes with what follows; the last of several white-space characters starts a piece if a text goes on behind
it; an apostrophe that starts a piece takes the letters of a contraction with it, and the next piece starts behind them.

That is so for Latin letters.  Whatever else a text holds, a piece starts where white space follows a Latin character, and what
is on one side does not change the cuts on the other.  What lies between two such places and has a character beyond the Latin
letters stays whole, and the tokenizer cuts it.

Pieces of up to 15 bytes are two words of 64 bits with the length in the highest byte, and are looked up all at once in an
open-addressed table; longer ones are few and looked up one by one.
"""

from __future__ import annotations

import re

import numpy as np

from sangloc.llm.bpe import LATIN

#: The pattern of byte-level tokenizers, which the rules here spell out.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The first character that is not among these Latin letters.
BEYOND = 0x250
OTHER, LETTER, NUMBER, SPACE, UNKNOWN = range(5)
#: The kind of each character that has one or two bytes; bytes that are none of these are unknown.
KIND = np.full(2048, UNKNOWN, np.uint8)
KIND[:BEYOND] = OTHER
for _kind, _name in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
    _found = re.compile(f"[{LATIN[_name]}]").match
    KIND[[c for c in range(BEYOND) if _found(chr(c))]] = _kind
BYTE_KIND = np.where(np.arange(256) < 128, KIND[:256], UNKNOWN).astype(np.uint8)
#: Longest piece that is looked up as two words, and zeros behind the texts so that words can be read at any place.
SHORT, PADDING = 15, 24
#: Words whose lowest 0 to 8 bytes are set.
LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Slots of the table are 1 << SLOT_BITS; it is full with half as many pieces, or with so many ids.
SLOT_BITS, MOST_IDS = 21, 1 << 23


def piece_starts(padded: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pieces of all rows start; `padded` are their UTF-8 bytes and PADDING zeros."""
    flat = padded[:-PADDING]
    n = len(flat)
    if not n:
        return np.zeros(0, np.int64)
    kind = BYTE_KIND[flat]
    lead = np.flatnonzero((flat[:-1] >= 0xC2) & (flat[:-1] < 0xE0))
    kind[lead] = kind[lead + 1] = KIND[(flat[lead] & 31).astype(np.int64) << 6 | flat[lead + 1] & 63]
    filled = bounds[:-1] < bounds[1:]
    rows, ends = bounds[:-1][filled], bounds[1:][filled]

    start = np.zeros(n + 4, bool)
    start[1:n] = (kind[1:] != kind[:-1]) & (flat[:-1] != 0x20)
    space = kind == SPACE
    last = np.zeros(n, bool)
    last[1:-1] = space[1:-1] & space[:-2] & ~space[2:]
    last[ends - 1] = False
    wide = lead[space[lead]]
    last[wide] = last[wide + 1] & space[wide - 1]
    last[wide + 1] = False
    start[:n] |= last
    start[rows] = True

    quote = np.flatnonzero((flat == 0x27) & start[:n])
    left = ends[np.searchsorted(ends, quote, "right")] - quote
    one, two = padded[quote + 1], padded[quote + 2]
    size = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 2, 0)
    size[(one == 0x6C) & (two == 0x6C) | ((one == 0x72) | (one == 0x76)) & (two == 0x65)] = 3
    taken = (size > 0) & (size <= left)
    quote, size = quote[taken], size[taken]
    start[quote + 1] = False
    start[quote + size] = True

    unknown = np.flatnonzero(kind == UNKNOWN)
    if len(unknown):
        whole = np.zeros(n, bool)
        whole[1:] = space[1:] & ~space[:-1] & (kind[:-1] != UNKNOWN)
        whole[rows] = True
        parts = np.append(np.flatnonzero(whole), n)
        part = np.unique(np.searchsorted(parts, unknown, "right"))
        edge = np.zeros(n + 1, np.int8)
        edge[parts[part - 1]] += 1
        edge[parts[part]] -= 1
        start[:n] &= whole | (np.cumsum(edge[:n], dtype=np.int8) == 0)
    return np.flatnonzero(start[:n])


class Table:
    """Pieces and their ids; a value is a place in `ids` and, in its low half, their number."""

    def __init__(self) -> None:
        self.head, self.tail = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.uint64)
        self.value = np.zeros(1 << SLOT_BITS, np.int64)
        self.longer: dict[bytes, int] = {}
        self.ids, self.used, self.size = np.zeros(1 << 16, np.uint32), 0, 0

    def is_full(self) -> bool:
        return self.size + 4 * len(self.longer) > 1 << (SLOT_BITS - 1) or self.used > MOST_IDS

    @staticmethod
    def _slot(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
        mixed = head ^ tail * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def find(self, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """The value of each short piece, or -1."""
        at = self._slot(head, tail)
        out = np.full(len(head), -1)
        todo = np.arange(len(head))
        while len(todo):
            there = self.tail[at]
            hit = (there == tail) & (self.head[at] == head)
            out[todo[hit]] = self.value[at[hit]]
            on = ~hit & (there != 0)
            todo, head, tail, at = todo[on], head[on], tail[on], (at[on] + 1) & ((1 << SLOT_BITS) - 1)
        return out

    def put(self, head: np.ndarray, tail: np.ndarray, value: np.ndarray) -> None:
        """Short pieces that differ and are not in the table."""
        self.size += len(head)
        at = self._slot(head, tail)
        while len(at):
            free = np.flatnonzero(self.tail[at] == 0)
            slot = at[free]
            # Of several pieces for a slot the last one stays, and then finds itself there.
            self.tail[slot], self.head[slot], self.value[slot] = tail[free], head[free], value[free]
            on = (self.tail[at] != tail) | (self.head[at] != head)
            head, tail, value, at = head[on], tail[on], value[on], (at[on] + 1) & ((1 << SLOT_BITS) - 1)

    def append(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Values for the next pieces, whose ids follow one another."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + len(ids), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        out = (self.used + np.cumsum(counts) - counts) << 32 | counts
        self.used += len(ids)
        return out

    def shorten(self, passing: int) -> None:
        """Drop as many ids at the end, which no piece in the table has, and the room that very long pieces took."""
        self.used -= passing
        if len(self.ids) > 4 * MOST_IDS:
            self.ids = self.ids[: self.used].copy()

    def ids_of(self, value: np.ndarray) -> np.ndarray:
        """The ids of all these pieces, one after the other."""
        counts = value & 0xFFFFFFFF
        ends = np.cumsum(counts)
        at = np.repeat((value >> 32) - ends + counts, counts)
        at += np.arange(len(at))
        return self.ids[at]


def short_words(padded: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each piece as two words; those of pieces that are not short are never put into a table."""
    words = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    head = words[starts] & LOW[np.minimum(sizes, 8)]
    tail = words[starts + 8] & LOW[np.clip(sizes - 8, 0, 7)]
    return head, tail | np.minimum(sizes, 255).astype(np.uint64) << np.uint64(56)
