"""Source divergence audit: how the words of a language's sources differ from each other and from the language.

Terms are counted by length-bucketed packing.  A slice of rows is one array of bytes; a term of up to 8 bytes is a 64-bit word,
one of up to 16 bytes two of them, so that numbers compare as the bytes do.  They are radix-sorted by 16 bits at a
time, the rows' (language, source) first, and counted as runs.  Longer terms are sorted as bytes, in a bucket for each power of
two.  A task sends one row for each term and group of a slice; Spark adds them up, on both sides of the shuffle.

A language keeps the terms that at least `MIN_DOCS` of its rows hold.  With V of them, and N uses in a group, a term has the integer
share p = 1 + floor(10**9 (uses + 2) / (N + 2 V)) in each source of the language and in the language itself, and two shares differ by
floor((p - q)**2 / (p + q)).

Sources are compared in pairs as blocks of matrices: the kept terms of a language are dealt to chunks, its sources to blocks of
`SOURCES_AT_ONCE`, and a task adds up one chunk for one pair of blocks, so that its memory is bounded and no group of rows is
hot, however many terms or sources a language has.  A source without uses of a term has the share of zero uses there; each
chunk gets these from one row per source.  The distinguishing terms of a source come from a join with the language's counts.

Integers only: 10**9 (uses + 2) is a decimal, all else fits in 64 bits.

Rows: null text, language and source are empty texts.  Every (language, source) that occurs is compared, also one without
terms.  Rows that repeat are counted as often as they occur.  Texts and terms have no longest length.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sangloc.llm.common import lowered, map_text, removed, staged, text_bytes
from sangloc.operators.joins import dim_join

MIN_DOCS = 10
SCALE = 10**9
#: Distinguishing terms of a source.
TOP_TERMS = 10
#: Terms of a chunk, and sources of a block, that a task compares.
TERMS_AT_ONCE, SOURCES_AT_ONCE = 2048, 256
#: Bytes of text that are sorted at a time.
TEXT_AT_ONCE = 4 << 20
#: floor((p - q)**2 / (p + q))
DIFFERENCE = "(p - q) * (p - q) div (p + q)"
#: Bytes of a term: A-Z, a-z and all beyond ASCII.
IN_TERM = np.zeros(256, bool)
IN_TERM[0x41:0x5B] = IN_TERM[0x61:0x7B] = IN_TERM[0x80:] = True


def radix_order(words: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """`order`, stably sorted by numbers whose words are listed from the most significant one; 16 bits a pass."""
    for word in reversed(words):
        bits = 8 * word.dtype.itemsize
        varying = np.bitwise_or.reduce(word ^ word[0]) if len(word) else word.dtype.type(0)
        for shift in range(0, bits, 16):
            if (int(varying) >> shift) & 0xFFFF:
                digit = (word >> word.dtype.type(shift)).astype(np.uint16)
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def packed_words(padded: np.ndarray, starts: np.ndarray, lengths: np.ndarray, words: int) -> list[np.ndarray]:
    """The terms' first 8 * words bytes as big-endian numbers; what lies behind a term's end is zero."""
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = []
    for i in range(words):
        value = eight[starts + 8 * i].view(">u8").ravel().astype(np.uint64)
        unused = (8 * (8 - np.clip(lengths - 8 * i, 1, 8))).astype(np.uint64)
        out.append(value >> unused << unused)
    return out


def _spans(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and row of every term."""
    inside = IN_TERM[flat]
    edge = np.zeros(len(flat) + 1, bool)
    edge[bounds] = True
    first = inside & (edge[:-1] | ~np.r_[False, inside[:-1]])
    last = inside & (edge[1:] | ~np.r_[inside[1:], False])
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    return starts, lengths, np.searchsorted(bounds, starts, "right") - 1


def _runs(same: np.ndarray, group: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, uses and rows of each run of equal terms in a group; `same` tells where a term equals the one before."""
    new = ~same | np.r_[True, group[1:] != group[:-1]]
    starts = np.flatnonzero(new)
    new_row = new | np.r_[True, row[1:] != row[:-1]]
    return starts, np.diff(np.r_[starts, len(new)]), np.add.reduceat(new_row, starts)


def term_counts(flat: np.ndarray, bounds: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, uses, rows) of all terms of the rows, whose groups are small numbers."""
    flat = lowered(flat)
    starts, lengths, row = _spans(flat, bounds)
    # Rows in order of their groups, so that a group's uses of a term are neighbours once the terms are sorted.
    rank = np.empty(len(group), np.uint32)
    rank[np.argsort(group, kind="stable")] = np.arange(len(group), dtype=np.uint32)
    padded = np.concatenate([flat, np.zeros(24, np.uint8)])
    groups, blobs, sizes, uses, rows = [], [], [], [], []
    longest = int(lengths.max()) if len(lengths) else 0
    low, high = 0, 8
    while low < longest:
        chosen = np.flatnonzero((lengths > low) & (lengths <= high))
        if len(chosen):
            s, n, r = starts[chosen], lengths[chosen], row[chosen]
            order = radix_order([rank[r]], np.arange(len(s)))
            if high <= 16:
                keys = packed_words(padded, s, n, high // 8)
                order = radix_order(keys, order)
                keys = [k[order] for k in keys]
                same = np.r_[False, np.logical_and.reduce([k[1:] == k[:-1] for k in keys])]
                at, count, held = _runs(same, group[r[order]], r[order])
                text = np.stack([k[at] for k in keys], 1).astype(">u8").view(np.uint8).reshape(len(at), high)
            else:
                # Padded with zero bytes, which no term holds.
                wide = np.zeros((len(s), high), np.uint8)
                mask = np.arange(high) < n[:, None]
                wide[mask] = flat[np.repeat(s - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))]
                names = wide.view(f"S{high}").ravel()
                order = order[np.argsort(names[order], kind="stable")]
                same = np.r_[False, names[order][1:] == names[order][:-1]]
                at, count, held = _runs(same, group[r[order]], r[order])
                text = wide[order[at]]
            size = n[order[at]]
            blobs.append(text[np.arange(high) < size[:, None]])
            groups.append(group[r[order[at]]])
            sizes.append(size)
            uses.append(count)
            rows.append(held)
        low, high = high, 2 * high
    if not sizes:
        none = np.zeros(0, np.int64)
        return none, pa.array([], pa.string()), none, none
    ends = np.r_[0, np.cumsum(np.concatenate(sizes))].astype(np.int32)
    terms = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.concatenate(blobs).tobytes()))
    return np.concatenate(groups), terms, np.concatenate(uses), np.concatenate(rows)


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, uses, docs): one row per term of a group."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = pa.StructArray.from_arrays([batch.column(1), batch.column(2)], ["lang", "source"]).to_pylist()
        names = {(p["lang"], p["source"]): 0 for p in pairs}
        names = {name: i for i, name in enumerate(names)}
        group = np.array([names[p["lang"], p["source"]] for p in pairs], np.int64)
        of, terms, uses, rows = term_counts(*text_bytes(batch.column(0)), group)
        columns = [pa.array([n[k] for n in names], pa.string()).take(pa.array(of)) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*columns, terms, pa.array(uses), pa.array(rows)], ["lang", "source", "term", "uses", "docs"])

    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    parts = map_text(named, "text", run, "lang string, source string, term string, uses long, docs long", TEXT_AT_ONCE)
    return parts.groupBy("lang", "source", "term").agg(F.sum("uses").alias("uses"), F.sum("docs").alias("docs"))


def share(uses: str, total: str, kept: str) -> Column:
    """1 + floor(10**9 (uses + 2) / (total + 2 kept)) of these columns; of no interest where nothing is kept."""
    whole = f"cast({SCALE} AS decimal(10, 0)) * cast({uses} + 2 AS decimal(20, 0))"
    return F.expr(f"1 + ({whole}) div cast(greatest({total} + 2 * {kept}, 1) AS decimal(20, 0))")


def pair_sums(shares: np.ndarray, other: np.ndarray, same: bool) -> np.ndarray:
    """For each source of one block and each of another the sum of the terms' differences; shares are (source, term)."""
    out = np.zeros((len(shares), len(other)), np.int64)
    for i, mine in enumerate(shares):
        theirs = other[i + 1 :] if same else other
        apart = theirs - mine
        np.multiply(apart, apart, out=apart)
        apart //= theirs + mine
        out[i, i + 1 if same else 0 :] = apart.sum(1)
    return out


def compared(shares: DataFrame, sources: DataFrame) -> DataFrame:
    """(lang, source, item, value): every two sources of a language with the sum of their differences, both ways round.

    `shares` are (lang, place, term, p, kept) of the terms that a source uses, `sources` are (lang, source, place, zero, kept, n_sources)
    with the place of the source in its language and the share of no use.
    """
    terms, block = TERMS_AT_ONCE, SOURCES_AT_ONCE
    chunks = F.greatest(F.ceil(F.col("kept") / terms), F.lit(1))
    blocks = F.ceil(F.col("n_sources") / block)
    # Every chunk learns the share of no use of each source from a row without a term.
    zeros = sources.select("lang", "place", "zero", "kept", "n_sources", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"))
    zeros = zeros.select("lang", "place", "n_sources", "chunk", F.lit(None).cast("string").alias("term"), F.col("zero").alias("p"), "kept")
    uses = shares.select("lang", "place", "n_sources", F.pmod(F.xxhash64("term"), chunks).alias("chunk"), "term", "p", "kept")
    # A block meets each block once: as the first of the two, or as the second.
    mine = F.floor(F.col("place") / block)
    others = F.sequence(F.lit(0).cast("long"), blocks - 1)
    both = F.transform(others, lambda o: F.struct(F.least(mine, o).alias("a"), F.greatest(mine, o).alias("b")))
    rows = zeros.unionByName(uses).select("lang", "place", "chunk", "term", "p", "kept", F.inline(both))

    def add(key: tuple, table: pa.Table) -> pa.Table:
        lang, _, a, b = (k.as_py() for k in key)
        place, p = table["place"].to_numpy(), table["p"].to_numpy()
        term = table["term"].combine_chunks().dictionary_encode()
        is_zero = term.indices.is_null().to_numpy(zero_copy_only=False)
        at = term.indices.fill_null(0).to_numpy()
        n_terms = len(term.dictionary)
        names = [np.sort(place[is_zero & (place // block == x)]) for x in (a, b)]
        matrices = []
        for x, known in zip((a, b), names):
            here = place // block == x
            matrix = np.empty((len(known), n_terms), np.int64)
            matrix[np.searchsorted(known, place[here & is_zero])] = p[here & is_zero][:, None]
            matrix[np.searchsorted(known, place[here & ~is_zero]), at[here & ~is_zero]] = p[here & ~is_zero]
            matrices.append(matrix)
        sums = pair_sums(*matrices, a == b)
        i, j = np.triu_indices(len(names[0]), 1) if a == b else map(np.ravel, np.indices(sums.shape))
        made = {"lang": pa.array([lang] * len(i), pa.string()), "one": names[0][i], "two": names[1][j], "value": sums[i, j]}
        return pa.table(made | {"seen": np.full(len(i), n_terms, np.int64)})

    sums = rows.groupBy("lang", "chunk", "a", "b").applyInArrow(add, "lang string, one long, two long, value long, seen long")
    sums = sums.groupBy("lang", "one", "two").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    named = sources.select("lang", "source", "place", "zero", "kept")
    sums = dim_join(sums, named.select("lang", F.col("place").alias("one"), F.col("source").alias("source_one"), F.col("zero").alias("p"), "kept"), ["lang", "one"], "inner")
    sums = dim_join(sums, named.select("lang", F.col("place").alias("two"), F.col("source").alias("source_two"), F.col("zero").alias("q")), ["lang", "two"], "inner")
    # A kept term that neither block uses was not seen: two shares of no use differ there.
    value = F.col("value") + (F.col("kept") - F.col("seen")) * F.expr(DIFFERENCE)
    ways = F.array(*[F.struct(F.col(a).alias("source"), F.col(b).alias("item")) for a, b in (("source_one", "source_two"), ("source_two", "source_one"))])
    return sums.select("lang", F.inline(ways), value.alias("value")).select("lang", "source", "item", "value")


def audited(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", top_terms: int = TOP_TERMS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank): what each source of a language differs in.

    Part `pair`: every other source of the language and the sum of the differences over all kept terms.  Part `term`: the
    `top_terms` kept terms that the source uses more than its language does, by difference.
    """
    counts = staged(counted(docs, text, lang, source), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("uses").alias("lang_uses"), F.sum("docs").alias("docs"))
    kept = staged(kept.where(F.col("docs") >= min_docs).drop("docs"), "kept-terms")
    uses = staged(counts.drop("docs").join(kept, ["lang", "term"]), "kept-uses")
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]).distinct()
    totals = uses.groupBy("lang", "source").agg(F.sum("uses").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_uses").alias("lang_total"))
    in_lang = Window.partitionBy("lang")
    sources = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    sources = sources.withColumn("unused", F.lit(0).cast("long"))
    sources = sources.select(
        "lang", "source", "total", "kept", "lang_total",
        (F.row_number().over(in_lang.orderBy("source")) - 1).cast("long").alias("place"),
        F.count("*").over(in_lang).alias("n_sources"),
        share("unused", "total", "kept").alias("zero"),
    )
    sources = staged(sources, "sources")
    shares = dim_join(uses, sources.drop("zero"), ["lang", "source"], "inner").withColumns(
        {"p": share("uses", "total", "kept"), "q": share("lang_uses", "lang_total", "kept")}
    )
    pairs = staged(compared(shares.select("lang", "place", "n_sources", "term", "p", "kept"), sources), "source-pairs")
    of_source = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = F.row_number().over(of_source).alias("rank")
    of_pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", ranked)
    terms = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(DIFFERENCE).alias("value"))
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", ranked).where(F.col("rank") <= top_terms)
    out = staged(of_pairs.unionByName(terms), "audit")
    removed(counts, kept, uses, sources, pairs)
    return out


def _oracle() -> str:
    lower = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    p = "1 + ({0}::HUGEINT + 2) * 1000000000 // ({1} + 2 * {2})"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
uses AS (
  SELECT d, lang, source, unnest(regexp_extract_all({lower.format("text")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS c FROM uses GROUP BY ALL),
kept AS (SELECT lang, term, count(*) AS c FROM uses GROUP BY ALL HAVING count(DISTINCT d) >= {MIN_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT lang, source, sum(counts.c) AS n FROM counts JOIN kept USING (lang, term) GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(s.c, 0) AS c, {p.format("coalesce(s.c, 0)", "coalesce(t.n, 0)", "l.v")} AS p, {p.format("k.c", "l.n", "l.v")} AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang)
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN counts s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
all_pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM all_pairs
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE c > 0 AND p > q),
ranked AS (
  SELECT lang, source, part, item, value::BIGINT AS value,
    (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""


ORACLE_SQL = _oracle()
