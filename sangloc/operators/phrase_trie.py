"""A trie of phrases over word ids, walked from all positions of a batch of token arrays at once.

The trie is a sorted array of edges (node, word) -> node, so a level is one binary search for every position that is still
on a path.  Words outside of the lexicon end all paths at once.  Its size follows from the lexicon, which has a bound
(`lexicon.MAX_TRIE_ROWS`); it is broadcast, and texts are neither exploded nor shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

HIT = "array<struct<pos:int,n:int,words:string,kind:string>>"
_FIELDS = [pa.field("pos", pa.int32()), pa.field("n", pa.int32()), pa.field("words", pa.string()), pa.field("kind", pa.string())]


class PhraseTrie:
    """`phrases` maps phrases, words joined by single blanks, to kinds."""

    def __init__(self, phrases: dict[str, str]):
        names = sorted(phrases)
        self.phrases, self.kinds = pa.array(names, pa.string()), pa.array([phrases[n] for n in names], pa.string())
        split = [n.split(" ") for n in names]
        self.words = pa.array(sorted({w for s in split for w in s}), pa.string())
        ids = {w: i for i, w in enumerate(self.words.to_pylist())}
        nodes: dict[tuple[int, int], int] = {}
        ends = [-1]
        for number, words in enumerate(split):
            at = 0
            for word in words:
                edge = (at, ids[word])
                if edge not in nodes:
                    nodes[edge] = len(nodes) + 1
                    ends.append(-1)
                at = nodes[edge]
            ends[at] = number
        keys = np.array([(a << 32) | w for a, w in nodes], np.int64)
        order = np.argsort(keys)
        self.edges, self.targets = keys[order], np.fromiter(nodes.values(), np.int64, len(nodes))[order]
        #: The phrase that ends at a node, or -1.
        self.ends = np.array(ends, np.int64)

    def hits(self, words: pa.Array, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, words, phrase) of every phrase within a row, by position and length; `bounds` are the rows' in `words`."""
        known = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        row_end = np.repeat(bounds[1:], np.diff(bounds))
        start = np.flatnonzero(known >= 0)
        node, depth = np.zeros(len(start), np.int64), 0
        found = []
        while len(start) and len(self.edges):
            key = (node << 32) | known[start + depth]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            on = self.edges[at] == key
            start, node, depth = start[on], self.targets[at[on]], depth + 1
            end = self.ends[node]
            ended = end >= 0
            found.append((start[ended], np.full(int(ended.sum()), depth, np.int64), end[ended]))
            more = start + depth < row_end[start]
            more[more] = known[start[more] + depth] >= 0
            start, node = start[more], node[more]
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        start, size, phrase = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((size, start))
        return start[order], size[order], phrase[order]

    def matched(self, lists: pa.ListArray, greedy: bool, least_words: int) -> pa.ListArray:
        """The hits of each row as structs; if `greedy` the longest of each start, left to right, without overlaps."""
        offsets = lists.offsets.to_numpy()
        bounds = offsets - offsets[0]
        words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        start, size, phrase = self.hits(words, bounds)
        row = np.searchsorted(bounds, start, "right") - 1
        kept = size >= least_words
        if greedy:
            kept &= self._taken(start, size, kept)
        start, size, phrase, row = start[kept], size[kept], phrase[kept], row[kept]
        at = pa.array(phrase)
        columns = [pa.array((start - bounds[row] + 1).astype(np.int32)), pa.array(size.astype(np.int32)), self.phrases.take(at), self.kinds.take(at)]
        counts = np.bincount(row, minlength=len(lists)) if len(lists) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, fields=_FIELDS))

    @staticmethod
    def _taken(start: np.ndarray, size: np.ndarray, able: np.ndarray) -> np.ndarray:
        """Which hits a walk from left to right takes; the longest hit of a start is its last one."""
        out = np.zeros(len(start), bool)
        able = np.flatnonzero(able)
        last = able[np.r_[start[able][1:] != start[able][:-1], True]] if len(able) else able
        free, taken = 0, []
        for i, a, b in zip(last.tolist(), start[last].tolist(), (start[last] + size[last]).tolist()):
            if a >= free:
                taken.append(i)
                free = b
        out[taken] = True
        return out


def trie_hits(spark: SparkSession, phrases: dict[str, str], words: Column, greedy: bool = False, least_words: int = 1) -> Column:
    """The hits of a lexicon in token arrays, as an Arrow function; null arrays have none."""
    shared = spark.sparkContext.broadcast(PhraseTrie(phrases))

    @F.arrow_udf(HIT)
    def matches(lists: pa.Array) -> pa.Array:
        return shared.value.matched(lists, greedy, least_words)

    return matches(F.coalesce(words, F.array().cast("array<string>")))
