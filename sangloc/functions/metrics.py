"""Text-quality metrics and vector cosines that need one row only."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sangloc.functions.text import SPACE, let, sentences, tokens

# Limits of the poor-text checks.
MIN_WORDS = 30
MIN_CHARS = 200
READABLE = (30.0, 80.0)
MIN_TYPE_TOKEN_RATIO = 0.3
MIN_COHERENCE = 0.2
MAX_UNKNOWN_RATIO = 0.05
MIN_MATCH_SCORE = 0.3

# Stop words of the pair TF-IDF.
PAIR_STOPWORDS = ("và", "của", "có", "là", "cho", "đến")

# Weight of a term that only one of two texts holds: smooth idf for two documents.
LONE_IDF = 1 + math.log(1.5)


def _round2(c: Column) -> Column:
    # the nudge keeps x.xx5 from falling either way with the binary rounding of the double
    return F.round(c + F.lit(1e-9), 2)


def too_short(c: Column, words: Column | None = None) -> Column:
    words = tokens(c) if words is None else words
    return (F.size(words) < MIN_WORDS) | (F.length(c) < MIN_CHARS)


def readability(c: Column) -> Column:
    """Struct of words per sentence, characters per word, long-word share and score."""

    def measured(m: Column) -> Column:
        words = m["words"]
        n_words = F.size(words)
        wps = F.try_divide(n_words.cast("double"), m["n_sentences"])
        cpw = F.try_divide(F.length(F.array_join(words, "")).cast("double"), n_words)
        poly = F.try_divide(F.size(F.filter(words, lambda w: F.length(w) >= 5)).cast("double"), n_words)
        return let(F.struct(wps.alias("wps"), cpw.alias("cpw"), poly.alias("poly"), (n_words > 0).alias("filled")), rated)

    def rated(m: Column) -> Column:
        score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - m["wps"] * 1.5 - m["cpw"] * 3 - m["poly"] * 20))

        def out(x: Column) -> Column:
            return F.when(m["filled"], _round2(x)).otherwise(F.lit(0.0))

        return F.struct(
            out(m["wps"]).alias("words_per_sentence"),
            out(m["cpw"]).alias("chars_per_word"),
            out(m["poly"]).alias("long_word_ratio"),
            out(score).alias("score"),
        )

    # sentence marks part words like blanks do
    words = F.filter(F.split(c, rf"[.!?{SPACE[1:-1]}]+"), lambda w: w != "")
    return let(F.struct(words.alias("words"), F.size(sentences(c)).alias("n_sentences")), measured)


def hard_to_read(c: Column) -> Column:
    return let(readability(c)["score"], lambda score: (score < READABLE[0]) | (score > READABLE[1]))


def type_token_ratio(words: Column) -> Column:
    """Distinct share of (lower-case) words; null for an empty text."""
    return F.try_divide(F.size(F.array_distinct(words)).cast("double"), F.size(words))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def run_lengths(values: Column) -> Column:
    """Sorted (term, n) of the distinct values of an array.

    One sort, then runs of equal values by their places: no pass for each of them.
    """

    def runs(ordered: Column) -> Column:
        placed = F.transform(ordered, lambda w, i: F.struct(w.alias("term"), i.alias("at")))
        firsts = F.filter(placed, lambda t: (t["at"] == 0) | (F.get(ordered, t["at"] - 1) != t["term"]))
        return let(firsts, lambda f: counted(f, F.size(ordered)))

    def counted(firsts: Column, size: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            end = F.coalesce(F.get(firsts, i + 1)["at"], size)
            return F.struct(t["term"].alias("term"), (end - t["at"]).cast("bigint").alias("n"))

        return F.transform(firsts, one)

    return let(F.sort_array(values), runs)


def term_vector(words: Column) -> Column:
    """The sparse vector of a token array: struct of `terms`, sorted (term, n), and `norm`, the sum of n * n."""

    def with_norm(terms: Column) -> Column:
        return F.struct(terms.alias("terms"), _sum(F.transform(terms, lambda t: t["n"] * t["n"])).alias("norm"))

    return let(run_lengths(words), with_norm)


def _shared_counts(a: Column, b: Column) -> Column:
    """(in_a, in_b) for every term that two sparse vectors share: in the merged order such a term comes twice in a row."""

    def pairs(merged: Column) -> Column:
        def pair(t: Column, i: Column) -> Column:
            after = F.get(merged, i + 1)
            return F.struct((after["term"] == t["term"]).alias("is_shared"), t["n"].alias("in_a"), after["n"].alias("in_b"))

        return F.filter(F.transform(merged, pair), lambda p: p["is_shared"])

    def side(v: Column, number: int) -> Column:
        return F.transform(v["terms"], lambda t: F.struct(t["term"].alias("term"), F.lit(number).alias("side"), t["n"].alias("n")))

    return let(F.sort_array(F.concat(side(a, 0), side(b, 1))), pairs)


def _cosine(dot: Column, aa: Column, bb: Column) -> Column:
    return F.try_divide(dot.cast("double"), F.sqrt(aa.cast("double") * bb.cast("double")))


def vector_cosine(a: Column, b: Column) -> Column:
    """Cosine of two sparse vectors; null if one is empty."""
    dot = _sum(F.transform(_shared_counts(a, b), lambda c: c["in_a"] * c["in_b"]))
    return _cosine(dot, a["norm"], b["norm"])


def term_cosine(a: Column, b: Column) -> Column:
    """Cosine of the term-count vectors of two token arrays; null if one is empty."""
    return let(F.struct(term_vector(a).alias("a"), term_vector(b).alias("b")), lambda v: vector_cosine(v["a"], v["b"]))


def pair_tfidf_cosine(a: Column, b: Column) -> Column:
    """TF-IDF cosine with the idf fitted on just these two token arrays."""
    lone = F.lit(LONE_IDF * LONE_IDF)

    def cosine(v: Column) -> Column:
        return let(_shared_counts(v["a"], v["b"]), lambda shared: weighted(v, shared))

    def weighted(v: Column, shared: Column) -> Column:
        def square(part: str) -> Column:
            return _sum(F.transform(shared, lambda c: c[part] * c[part]))

        def norm(side: str, part: str) -> Column:
            return lone * (v[side]["norm"] - square(part)) + square(part)

        return _cosine(_sum(F.transform(shared, lambda c: c["in_a"] * c["in_b"])), norm("a", "in_a"), norm("b", "in_b"))

    return let(F.struct(term_vector(a).alias("a"), term_vector(b).alias("b")), cosine)


# What `tokens` and `sentences` split at, for Python, and separators that `str.split` takes for white space, unlike SPACE.
_BLANKS = "\t\n\x0b\f\r" + "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c)[0] == "Z")
_WORDS = re.compile(f"[^{_BLANKS}]+").findall
_SENTENCES = re.compile(r"[.!?\n]+").split
_SEPARATORS = re.compile("[\x1c-\x1f\x85]").search


def _coherence(text: str | None) -> float | None:
    """Mean cosine of the term counts of neighbouring sentences of one text; a sentence has words."""
    if text is None:
        return None
    words = _WORDS if _SEPARATORS(text) else str.split
    n, total, before, norm_before = 0, 0.0, Counter(), 0
    for sentence in _SENTENCES(text):
        counts = Counter(words(sentence))
        if not counts:
            continue
        norm = sum([k * k for k in counts.values()])
        if shared := before.keys() & counts.keys():
            total += sum([before[w] * counts[w] for w in shared]) / math.sqrt(float(norm_before) * float(norm))
        n, before, norm_before = n + 1, counts, norm
    return total / (n - 1) if n > 1 else 0.0


@F.arrow_udf(T.DoubleType())
def _coherences(texts: pa.Array) -> pa.Array:
    return pa.array([_coherence(t) for t in texts.to_pylist()], pa.float64())


def adjacent_coherence(c: Column) -> Column:
    """Mean term cosine of neighbouring sentences; 0 with fewer than two sentences.

    Counted in Python: term counts are hash tables there, which Spark's array functions have to sort for.
    """
    return _coherences(F.lower(c))


def vector_dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def embedding_cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays, in double."""
    return F.try_divide(vector_dot(a, b), F.sqrt(vector_dot(a, a)) * F.sqrt(vector_dot(b, b)))
