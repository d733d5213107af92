"""Near-duplicate documents: a Jaccard self-join of word shingles by token-combination prefixes.

Two documents link if their sets of distinct five-word shingles have a Jaccard similarity of `THRESHOLD` or more.
All links between different sets are found; equal sets are one class from the start, and only its
representative, the smallest key, is compared.

1. `shingle_sets` reads every text and keeps (key, size, identity) of its set.  Rows with equal identity are a class.
2. `suspects` drops the documents that cannot have a partner.  If x and y link, at most
   `spare(x)` = |x| - ceil(0.75 |x|) shingles of x are missing in y, so that of the spare(x) + k smallest hashes of x
   at least k are in y.  Every document sends these prefixes, packed by range of hashes; a document stays if
   enough of its prefix occurs elsewhere.  A shingle that repeats within a slice of rows is sent once for it.
3. The sets of the remaining representatives are packed, and document frequencies are counted exactly: a pack
   sends a shingle once, whatever the number of its sets that hold it.
4. `signatures`: the shingles of a set in order of (frequency, hash).  Rare shingles are indexed alone;
   frequent and very frequent ones in combinations of two and of three within small hash groups.  If j shingles of a
   group of n are missing in y, a combination of k in it survives as long as n - j >= k; the group is lost only with
   n - k + 1 missing.  So a prefix whose groups sum up to spare(x) + 1 such losses has a
   combination in common with every partner (the partner's prefix holds it too, because the one that ends
   earlier in the common order lies within the other's range).  Groups depend on the size of the set, so a
   set is indexed for its own band of sizes and the next; partners share one of them.
5. A few signatures of each set give first pairs, each with the smallest key of the signature and, where more sets
   share it, with the smallest of a small random group of them: in a large group whose members link with many of the
   others, though not with its smallest key, these unite nearly all.  Verified pairs are joined to components.  Then
   every signature whose sets are not all in one component yields all its pairs across components, so that no link between components is missed, but for those that a
   bound rules out within the join: a set's shingles are hashed to the parities of 1,024 bits, and where two sets
   differ in more parities than they may differ in shingles, they cannot link.  A pair is made at its first common
   signature only, as far as the sets' smallest signatures tell.  Pairs within a component
   need no comparison: they cannot change it.  So a group of thousands of near copies costs a few pairs for
   each of them, not all pairs.
6. Pairs are verified on the whole sets.

Hashes have 64 bits.

Rows: one result per distinct non-null key.  Null texts and texts without words have an empty set and link with
nothing.  Rows that repeat a key: the largest set stands for it (of equals, that of the larger identity).  Rows with a
null key name no document and have no result.  The key is an integer column.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sangloc.llm.common import is_small, lowered, map_text, removed, slices, staged, text_bytes
from sangloc.llm.components import components
from sangloc.llm.hashing import distinct, mix, shingles, word_hashes, words

SHINGLE = 5
#: The similarity is at least 3/4; sizes are compared in integers.
THRESHOLD = 0.75
#: Shingles that a prefix of the first filter holds beyond the spare ones, as a share of the set.
EXTRA = 0.2
#: Shingles in more sets than this are indexed in twos, and in threes.
FREQUENT, VERY_FREQUENT = 8, 128
#: Sets smaller than this are indexed by single shingles; larger ones have a hash group for each so many shingles.
LEAST_GROUPED, GROUP_SHARE = 24, 12
#: Signatures of a set that the first pairs are made from.
FIRST_SIGNATURES = 6
#: Signatures with more sets than this are also dealt into random groups of about this size.
DEALT_OVER, DEALT_GROUP = 16, 4
#: Smallest signatures of a set by which the join tells whether an earlier one made the pair.
SMALLEST = 24
#: log2 of the parity bits of a set.
PARITY_BITS = 10
#: Shingles that one task of an exchange sorts at a time.
RANGE_SHINGLES = 250_000
#: Up to this many keys are broadcast; beyond that texts are joined to them by key.
MOST_BROADCAST_KEYS = 1_000_000


def needed(n: np.ndarray) -> np.ndarray:
    """ceil(0.75 n)."""
    return (3 * n + 3) // 4


def spare(n: np.ndarray) -> np.ndarray:
    return n - needed(n)


def extra(n: np.ndarray) -> np.ndarray:
    return np.maximum(1, np.minimum(needed(n), np.ceil(EXTRA * n).astype(np.int64)))


def sets_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles, in order."""
    flat, bounds = text_bytes(texts)
    low = lowered(flat)
    starts, ends, row = words(low, bounds)
    return distinct(*shingles(word_hashes(low, starts, ends), row, len(texts), SHINGLE))


def identities(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two sums of each row's set; equal sets have equal values."""
    n = np.bincount(row, minlength=rows)
    ends = np.concatenate([[0], np.cumsum(n)])
    out = []
    for salt in (0x1B873593, 0xC2B2AE3D27D4EB4F):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)))])
        out.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
    return n, *out


def shingle_sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, s1, s2): one row per key."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, h = sets_of(batch.column(1))
        columns = [batch.column(0), *map(pa.array, identities(row, h, batch.num_rows))]
        return pa.RecordBatch.from_arrays(columns, ["key", "n", "s1", "s2"])

    rows = map_text(_named(docs, key, text), "text", run, "key long, n long, s1 long, s2 long")
    return rows.groupBy("key").agg(F.max(F.struct("n", "s1", "s2")).alias("set")).select("key", "set.*")


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    named = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return named.where(F.col("key").isNotNull())


def _ranges(shingle_count: int) -> int:
    """Bits of a hash that name its range, so that a range holds about RANGE_SHINGLES."""
    return max(4, int(np.ceil(np.log2(max(1, shingle_count / RANGE_SHINGLES)))))


def _split(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges present in sorted hashes, and where they start."""
    return np.unique((h >> np.uint64(64 - bits)).astype(np.int64), return_index=True)


def suspects(docs: DataFrame, classes: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of `classes` (key, n, ...) whose document may have a partner other than its copies."""
    bits = _ranges(classes.agg(F.sum("n")).first()[0] or 0)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, h = sets_of(part.column(1))
                keys = part.column(0).to_numpy()
                n = np.bincount(row, minlength=len(keys))
                first = np.cumsum(n) - n
                within = np.arange(len(row)) - first[row] < (spare(n) + extra(n))[row]
                row, h = row[within], h[within]
                order = np.argsort(h, kind="stable")
                row, h = row[order], h[order]
                new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
                size = np.diff(np.r_[np.flatnonzero(new), len(h)])
                many = np.repeat(size > 1, size)
                # A shingle of several rows here is sent once, without a key; its rows are hits already.
                sent = new | ~many
                owner = np.where(many, np.iinfo(np.int64).min, keys[row])[sent]
                h_sent = h[sent]
                which, start = _split(h_sent, bits)
                hit_row, hit_n = np.unique(row[many], return_counts=True)
                for i, (r, a) in enumerate(zip(which, start)):
                    b = start[i + 1] if i + 1 < len(start) else len(h_sent)
                    hits = (keys[hit_row], hit_n) if i == 0 else (keys[:0], hit_n[:0])
                    columns = [[int(r)], [h_sent[a:b].tobytes()], [owner[a:b].tobytes()], [hits[0].tobytes()], [hits[1].tobytes()]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, (pa.int64(), *[pa.binary()] * 4))], ["part", "h", "owner", "hit", "n"]
                    )

    def match(table: pa.Table) -> pa.Table:
        read = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
        h, owner = read("h", np.uint64), read("owner", np.int64)
        order = np.argsort(h)
        h, owner = h[order], owner[order]
        new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        size = np.diff(np.r_[starts, len(h)])
        marked = np.add.reduceat(owner == np.iinfo(np.int64).min, starts) > 0 if len(starts) else np.zeros(0, bool)
        shared = np.repeat((size > 1) | marked, size) & (owner != np.iinfo(np.int64).min)
        keys = np.concatenate([owner[shared], read("hit", np.int64)])
        counts = np.concatenate([np.ones(int(shared.sum()), np.int64), read("n", np.int64)])
        names, inverse = np.unique(keys, return_inverse=True)
        return pa.table({"key": names, "hits": np.bincount(inverse, counts, len(names)).astype(np.int64)})

    sent = _named(docs, key, text).mapInArrow(send, "part long, h binary, owner binary, hit binary, n binary")
    hits = sent.groupBy("part").applyInArrow(match, "key long, hits long").groupBy("key").agg(F.sum("hits").alias("hits"))
    least = F.ceil(0.75 * F.col("n"))
    enough = F.greatest(F.lit(1), F.least(F.ceil(0.75 * least), F.ceil(EXTRA * least)))
    return classes.join(hits, "key").where(F.col("hits") >= enough).drop("hits")


def packs(docs: DataFrame, chosen: DataFrame, key: str, text: str) -> DataFrame:
    """The sets of `chosen` (key, n, s1, s2), several in a row: (pack, keys, sizes, h); pack is the smallest key."""
    chosen = F.broadcast(chosen) if is_small(chosen, MOST_BROADCAST_KEYS) else chosen
    rows = _named(docs, key, text).join(chosen, "key").select("text", "key", "n", "s1", "s2")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        row, h = sets_of(batch.column(0))
        n, s1, s2 = identities(row, h, batch.num_rows)
        same = (n == batch.column(2).to_numpy()) & (s1 == batch.column(3).to_numpy()) & (s2 == batch.column(4).to_numpy())
        kept = same[row]
        n, h = n[same], h[kept]
        if not len(n):
            return None
        keys = batch.column(1).to_numpy()[same]
        columns = [[int(keys.min())], [keys.tobytes()], [n.tobytes()], [h.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), *[pa.binary()] * 3))], ["pack", "keys", "sizes", "h"])

    return map_text(rows, "text", run, "pack long, keys binary, sizes binary, h binary")


def frequencies(packed: DataFrame, shingle_count: int) -> DataFrame:
    """(pack, h, df): the shingles of each pack that several sets hold, with the number of sets."""
    bits = _ranges(shingle_count)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h, n = np.unique(np.frombuffer(blob, np.uint64), return_counts=True)
                which, start = _split(h, bits)
                ends = [*start[1:], len(h)]
                columns = [which, [pack] * len(which), [h[a:b].tobytes() for a, b in zip(start, ends)], [n[a:b].astype(np.int64).tobytes() for a, b in zip(start, ends)]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["part", "pack", "h", "df"]
                )

    def add(table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(b, np.uint64) for b in table["h"].to_pylist()]
        names, inverse = np.unique(np.concatenate(blobs), return_inverse=True)
        counts = np.frombuffer(b"".join(table["df"].to_pylist()), np.int64)
        total = np.bincount(inverse, counts, len(names)).astype(np.int64)[inverse]
        ends = np.cumsum([len(b) for b in blobs])
        out = []
        for blob, end in zip(blobs, ends):
            df = total[end - len(blob) : end]
            out.append((blob[df > 1].tobytes(), df[df > 1].tobytes()))
        return pa.table({"pack": table["pack"], "h": pa.array([a for a, _ in out], pa.binary()), "df": pa.array([b for _, b in out], pa.binary())})

    sent = packed.select("pack", "h").mapInArrow(send, "part long, pack long, h binary, df binary")
    return sent.groupBy("part").applyInArrow(add, "pack long, h binary, df binary")


@lru_cache(maxsize=1)
def band_starts() -> np.ndarray:
    """Bands of sizes: sets that can link are in the same band or in adjacent ones."""
    out = [1]
    while out[-1] < 1 << 50:
        out.append(4 * out[-1] // 3 + 1)
    return np.array(out)


def signatures_of(set_of: np.ndarray, h: np.ndarray, df: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) of sets of `sizes`, given all their shingles."""
    order = np.lexsort((h, df, set_of))
    set_of, h, df = set_of[order], h[order], df[order]
    alone = np.bincount(set_of[df == 1], minlength=len(sizes))
    able = (alone <= spare(sizes))[set_of]
    set_of, h, df = set_of[able], h[able], df[able]
    band = np.searchsorted(band_starts(), sizes, "right") - 1
    found_set, found = [], []
    for ahead in (0, 1):
        scheme = band + ahead
        smallest = band_starts()[np.maximum(0, scheme - 1)]
        grouped = (smallest >= LEAST_GROUPED)[set_of]
        kind = np.where(grouped, 1 + (df > FREQUENT) + (df > VERY_FREQUENT), 1)
        groups = np.maximum(1, smallest // GROUP_SHARE).astype(np.uint64)
        group = np.where(kind > 1, (mix(h) % groups[set_of]).astype(np.int64), 0)
        # Place of each shingle within its group, in the common order.
        by = np.lexsort((np.arange(len(h)), group, kind, set_of))
        s, k, g = set_of[by], kind[by], group[by]
        new = np.r_[True, (s[1:] != s[:-1]) | (k[1:] != k[:-1]) | (g[1:] != g[:-1])] if len(s) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        place = np.empty(len(s), np.int64)
        place[by] = np.arange(len(s)) - np.repeat(starts, np.diff(np.r_[starts, len(s)]))
        gain = np.cumsum(place >= kind - 1)
        set_start = np.searchsorted(set_of, np.arange(len(sizes)))
        base = np.where(set_start > 0, gain[np.maximum(0, set_start - 1)], 0) if len(gain) else np.zeros(len(sizes), np.int64)
        before = np.r_[0, gain[:-1]] - base[set_of] if len(gain) else gain
        taken = (before < (spare(sizes) + 1)[set_of]) & (df > 1)
        singles = taken & (kind == 1)
        found_set.append(set_of[singles])
        found.append(mix(h[singles]))
        for size in (2, 3):
            chosen = np.flatnonzero(taken & (kind == size))
            chosen = chosen[np.lexsort((h[chosen], group[chosen], set_of[chosen]))]
            who, where, value = set_of[chosen], group[chosen], h[chosen]
            salt = mix(scheme[who].astype(np.uint64) * np.uint64(8) + np.uint64(size))
            for at, together in _combinations(who, where, size):
                total = salt[at].copy()
                for factor, member in zip((3, 5, 7), together):
                    total = mix(total + value[member] * np.uint64(factor))
                found_set.append(who[at])
                found.append(total)
    return distinct(np.concatenate(found_set), np.concatenate(found))


def _combinations(who: np.ndarray, where: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Index arrays of all combinations of 2 or 3 neighbours in sorted runs of equal (who, where)."""
    n = len(who)
    if not n:
        return
    new = np.r_[True, (who[1:] != who[:-1]) | (where[1:] != where[:-1])]
    starts = np.flatnonzero(new)
    left = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n])) - np.arange(n) - 1
    for step in range(1, int(left.max()) + 1):
        first = np.flatnonzero(left >= step)
        if size == 2:
            yield first, [first, first + step]
            continue
        for more in range(1, int(left.max()) - step + 1):
            at = first[left[first] >= step + more]
            if len(at):
                yield at, [at, at + step, at + step + more]


def signatures(packed: DataFrame, found: DataFrame) -> DataFrame:
    """(sig, key, n, common, rank): common counts the shingles that other sets hold too; rank orders a set's signatures."""
    lists = found.groupBy("pack").agg(F.collect_list(F.struct("h", "df")).alias("df"))
    rows = packed.join(lists, "pack").select("keys", "sizes", "h", "df")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys, sizes, h = (np.frombuffer(r[k], t) for k, t in (("keys", np.int64), ("sizes", np.int64), ("h", np.uint64)))
                known = np.frombuffer(b"".join(x["h"] for x in r["df"]), np.uint64)
                count = np.frombuffer(b"".join(x["df"] for x in r["df"]), np.int64)
                order = np.argsort(known)
                known, count = known[order], count[order]
                at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                df = np.where(known[at] == h, count[at], 1) if len(known) else np.ones(len(h), np.int64)
                set_of = np.repeat(np.arange(len(keys)), sizes)
                common = np.bincount(set_of[df > 1], minlength=len(keys))
                who, sig = signatures_of(set_of, h, df, sizes)
                rank = np.arange(len(who)) - np.searchsorted(who, who)
                columns = [sig.view(np.int64), keys[who], sizes[who], common[who], rank]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sig", "key", "n", "common", "rank"])

    return rows.mapInArrow(run, "sig long, key long, n long, common long, rank long")


def verified(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, with their similarity."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys, sizes = np.frombuffer(r["keys"], np.int64), np.frombuffer(r["sizes"], np.int64)
                ends = np.cumsum(sizes) * 8
                values = [r["h"][e - 8 * n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values, pa.binary())], ["key", "h"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = [
                len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            shared = np.array(shared, np.int64)
            sizes = [np.array([len(x) // 8 for x in batch.column(i).to_pylist()], np.int64) for i in (2, 3)]
            union = sizes[0] + sizes[1] - shared
            ok = 100 * shared >= round(100 * THRESHOLD) * union
            columns = [batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok)), pa.array((shared / union)[ok])]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "similarity"])

    sets = packed.select("keys", "sizes", "h").mapInArrow(unpack, "key long, h binary")
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("h").alias("ha")), "a")
    both = both.join(sets.select(F.col("key").alias("b"), F.col("h").alias("hb")), "b").select("a", "b", "ha", "hb")
    return both.mapInArrow(compare, "a long, b long, similarity double")


def _may_link(n: str, common: str, other_n: str, other_common: str) -> Column:
    """By sizes, and because an overlap of 3/7 of both sizes together, the threshold's, needs as many common shingles."""
    n, common, m, theirs = map(F.col, (n, common, other_n, other_common))
    return (4 * n >= 3 * m) & (4 * m >= 3 * n) & (7 * F.least(common, theirs) >= 3 * (n + m))


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, copy_of) of every document; copy_of is the smallest key with an equal set."""
    sets = shingle_sets(docs, key, text)
    sets = staged(sets, "sets")
    first = sets.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("key").alias("key"))
    classes = staged(first, "classes")
    chosen = staged(suspects(docs, classes, key, text), "suspects")
    packed = staged(packs(docs, chosen, key, text), "packs")
    total = chosen.agg(F.sum("n")).first()[0] or 0
    sigs = staged(signatures(packed, frequencies(packed, total)), "signatures")
    links = staged(verified(_first_pairs(sigs), packed), "first-links")
    rough = components(links, "a", "b")
    across = _pairs_across(sigs, rough, packed)
    more = staged(verified(across, packed), "more-links")
    removed(across)
    if more.isEmpty():
        merged = rough
    else:
        stars = rough.select(F.col("vertex").alias("a"), F.col("component").alias("b"))
        merged = components(stars.unionByName(more.select("a", "b")), "a", "b")
        removed(rough)
    named = classes.join(merged.withColumnRenamed("vertex", "key"), "key", "left").select(
        "n", "s1", "s2", F.col("key").alias("_copy_of"), F.coalesce("component", "key").alias("_component")
    )
    removed(chosen, packed, sigs, links, more)
    out = sets.join(named, ["n", "s1", "s2"], "left")
    out = out.select(
        F.col("key").cast(docs.schema[key].dataType).alias(key),
        F.col("n").alias("n_shingles"),
        F.coalesce("_component", "key").cast(docs.schema[key].dataType).alias("component_id"),
        F.coalesce("_copy_of", "key").cast(docs.schema[key].dataType).alias("copy_of"),
    )
    out = staged(out, "linked")
    removed(sets, classes, merged)
    return out


def _first_pairs(sigs: DataFrame) -> DataFrame:
    """Each set with the smallest key of each of its first signatures, and with that of its random group."""
    few = sigs.where(F.col("rank") < FIRST_SIGNATURES)
    sizes = few.groupBy("sig").agg(F.count("*").alias("sets")).where("sets > 1")
    groups = F.when(F.col("sets") > DEALT_OVER, F.ceil(F.col("sets") / DEALT_GROUP))
    dealt = F.pmod(F.xxhash64("key", "sig"), groups)
    every = F.lit(-1).cast("long")
    named = F.when(groups.isNull(), F.array(every)).otherwise(F.array(every, dealt))
    rows = few.join(sizes, "sig").withColumn("group", F.explode(named))
    least = rows.groupBy("sig", "group").agg(F.min(F.struct("key", "n", "common")).alias("least"))
    may = _may_link("n", "common", "least.n", "least.common")
    pairs = rows.join(least, ["sig", "group"]).where((F.col("key") != F.col("least.key")) & may)
    return pairs.select(F.col("least.key").alias("a"), F.col("key").alias("b")).distinct()


def _open(sigs: DataFrame, merged: DataFrame) -> DataFrame:
    """(sig, key, n, component) of the signatures whose sets are in several components."""
    placed = sigs.join(merged.withColumnRenamed("vertex", "key"), "key", "left").select(
        "sig", "key", "n", "common", F.coalesce("component", "key").alias("component")
    )
    split = placed.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return placed.join(split.select("sig"), "sig", "left_semi")


def parities(packed: DataFrame) -> DataFrame:
    """(key, parity): for each bit whether an odd number of the set's shingles fall on it, in longs."""
    longs = 1 << PARITY_BITS - 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys, sizes = np.frombuffer(r["keys"], np.int64), np.frombuffer(r["sizes"], np.int64)
                bit = (mix(np.frombuffer(r["h"], np.uint64)) >> np.uint64(64 - PARITY_BITS)).astype(np.int64)
                at = (np.repeat(np.arange(len(keys)), sizes) << PARITY_BITS) + bit
                odd = np.bincount(at, minlength=len(keys) << PARITY_BITS).astype(np.uint8) & 1
                parity = np.packbits(odd).view(np.int64).reshape(len(keys), longs)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(parity.tolist(), pa.list_(pa.int64()))], ["key", "parity"])

    return packed.select("keys", "sizes", "h").mapInArrow(run, "key long, parity array<long>")


def _pairs_across(sigs: DataFrame, merged: DataFrame, packed: DataFrame) -> DataFrame:
    """All pairs of sets that share a signature but, so far, no component, and that may link."""
    opened = staged(_open(sigs, merged), "open")
    smallest = opened.groupBy("key").agg(F.slice(F.sort_array(F.collect_list("sig")), 1, SMALLEST).alias("smallest"))
    rows = opened.join(parities(packed).join(smallest, "key"), "key")
    names = [f"p{i}" for i in range(1 << PARITY_BITS - 6)]
    rows = rows.select("sig", "key", "n", "common", "component", "smallest", *[F.get("parity", F.lit(i)).alias(p) for i, p in enumerate(names)])
    other = rows.select(
        "sig",
        F.col("key").alias("other"),
        F.col("n").alias("m"),
        F.col("common").alias("shared"),
        F.col("component").alias("theirs"),
        F.col("smallest").alias("others_smallest"),
        *[F.col(p).alias(f"q{p}") for p in names],
    )
    apart = reduce(lambda a, b: a + b, [F.bit_count(F.col(p).bitwiseXOR(F.col(f"q{p}"))) for p in names])
    # Sets that differ in d shingles have an overlap of (n + m - d) / 2, and 3/7 of n + m is needed.
    may = _may_link("n", "common", "m", "shared") & (7 * apart <= F.col("n") + F.col("m"))
    # The first of all common signatures is never passed over, as nothing smaller is common.
    is_first = ~F.exists(F.array_intersect("smallest", "others_smallest"), lambda s: s < F.col("sig"))
    pairs = rows.join(other, "sig").where((F.col("component") < F.col("theirs")) & may & is_first)
    made = staged(pairs.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct(), "pairs")
    removed(opened)
    return made


def without_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of the smallest key of each component, with all columns; rows with a null key stay."""
    gone = linked(docs, key, text).where(F.col("component_id") != F.col(key)).select(F.col(key).alias("key"))
    # Names of one table on each side: columns of any name may come along.
    return docs.alias("docs").join(gone.alias("gone"), docs[key] == gone["key"], "left_anti")
