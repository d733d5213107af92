"""Phrase lexicons against token arrays.

`phrase_hits` is the one primitive: it adds an array of the places where a lexicon
phrase starts.  A lexicon proven small becomes a hash set inside the row expression, and one of up to `MAX_TRIE_ROWS`
phrases a broadcast trie, so nothing is exploded or shuffled and the operator also works on streams.  A larger one
goes through exploded n-grams and an equi-join; all ways give the same array.  What is
joined back to a row depends on its words alone, so rows meet their result by a hash of
the words: repeated and null keys are no special case.  Phrases may have any length: the
bound comes from the lexicon.

Arrays that a lambda reads by position are made columns of their own first: an inlined
expression would be evaluated again for every element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sangloc.operators.generate import explode_rows, inline_rows
from sangloc.operators.joins import MAX_SET_ROWS, dim_join, is_small, rows_if_small
from sangloc.operators.phrase_trie import trie_hits

_HITS = "array<struct<pos:int,n:int,words:string,kind:string>>"

# Phrases up to which a lexicon becomes a broadcast trie.
MAX_TRIE_ROWS = 200_000


def _grams(words: str, max_words: int, firsts: list[str] | None = None) -> Column:
    """For every position, the phrases of 1..max_words words that start there."""
    col = F.col(words)

    def at(pos: Column) -> Column:
        sizes = F.sequence(F.lit(1), F.least(F.lit(max_words), F.size(col) + 1 - pos))
        return F.transform(
            sizes,
            lambda n: F.struct(pos.alias("pos"), n.alias("n"), F.array_join(F.slice(col, pos, n), " ").alias("words")),
        )

    def able(word: Column, i: Column) -> Column:
        return i + 1 if firsts is None else F.when(word.isin(firsts), i + 1)

    # the positions first: most have no phrase, and make no array of their own
    return F.flatten(F.transform(F.array_compact(F.transform(col, able)), at))


# First words up to which n-grams are filtered in the row; more of them cost time, not results.
MAX_FIRST_WORDS = 20_000

# 128 bits: equal where the content is equal.
CONTENT = ("_content", "_content2")


def with_content(df: DataFrame, *columns: str) -> DataFrame:
    """Add the hashes that a row's result is joined back by."""
    return df.withColumns({CONTENT[0]: F.xxhash64(*columns), CONTENT[1]: F.xxhash64(F.lit(1), *columns)})


def words_of_longest(phrases: DataFrame, column: str) -> int:
    """Words in the longest phrase of a dictionary, at least 1."""
    return phrases.agg(F.max(F.size(F.split(column, " ")))).first()[0] or 1


def _listed(lexicon: DataFrame, max_rows: int) -> dict[str, str] | None:
    """Phrase -> kind, the smallest of several, or None if there are more than `max_rows` rows."""
    rows = rows_if_small(lexicon.select("words", "kind"), max_rows)
    if rows is None:
        return None
    kinds: dict[str, str] = {}
    for r in rows:
        kinds[r.words] = min(r.kind, kinds.get(r.words, r.kind))
    return kinds


def phrase_matches(
    df: DataFrame,
    key: str,
    words: str,
    lexicon: DataFrame,
    out: str,
    max_rows: int = MAX_SET_ROWS,
    least_words: int = 1,
) -> DataFrame:
    """Add `out`: of the phrases of at least `least_words` words the longest of each start, left to right, without overlaps.

    `words` names a column of token arrays; null arrays have no matches.
    """
    lexicon = lexicon.where(F.col("words").isNotNull())
    if not is_small(lexicon, max_rows):
        kinds = _listed(lexicon, MAX_TRIE_ROWS)
        if kinds is not None:
            return df.withColumn(out, trie_hits(df.sparkSession, kinds, F.col(words), True, least_words))
    df = phrase_hits(df, key, F.col(words), lexicon, out, max_rows)
    return df.withColumn(out, greedy_matches(F.filter(out, lambda h: h["n"] >= least_words)))


def phrase_hits(
    df: DataFrame, key: str, words: Column, lexicon: DataFrame, out: str = "hits", max_rows: int = MAX_SET_ROWS
) -> DataFrame:
    """Add `out`: array<struct<pos, n, words, kind>> of lexicon phrases, by position.

    `lexicon` has the columns `words` (lower case, single blanks) and `kind`.  Null words have no hits.
    `key` names the rows for the reader; it need not be unique or filled.
    """
    lexicon = lexicon.where(F.col("words").isNotNull())
    df = df.withColumn("_w", words)
    empty = F.array().cast(_HITS)
    kinds = _listed(lexicon, max_rows)
    if kinds is not None:
        if not kinds:
            return df.withColumn(out, empty).drop("_w")
        firsts = sorted({p.split(" ")[0] for p in kinds})
        by_kind: dict[str, list[str]] = {}
        for phrase, kind in sorted(kinds.items()):
            by_kind.setdefault(kind, []).append(phrase)

        def with_kind(g: Column) -> Column:
            kind = F.lit(None).cast("string")
            for name, members in by_kind.items():
                kind = F.when(g["words"].isin(members), F.lit(name)).otherwise(kind)
            return F.struct(g["pos"].alias("pos"), g["n"].alias("n"), g["words"].alias("words"), kind.alias("kind"))

        max_words = max(p.count(" ") + 1 for p in kinds)
        known = F.filter(_grams("_w", max_words, firsts), lambda g: g["words"].isin(list(kinds)))
        return df.withColumn(out, F.coalesce(F.transform(known, with_kind), empty)).drop("_w")
    kinds = _listed(lexicon, MAX_TRIE_ROWS)
    if kinds is not None:
        return df.withColumn(out, trie_hits(df.sparkSession, kinds, F.col("_w"))).drop("_w")
    df = with_content(df, "_w")
    # Only places where a phrase can begin are exploded, where the first words are few enough to test for.
    firsts = rows_if_small(lexicon.select(F.substring_index("words", " ", 1).alias("word")).distinct(), MAX_FIRST_WORDS)
    firsts = None if firsts is None else sorted(r.word for r in firsts)
    grams = inline_rows(df, list(CONTENT), _grams("_w", words_of_longest(lexicon, "words"), firsts), "pos")
    phrases = lexicon.groupBy("words").agg(F.min("kind").alias("kind"))
    found = (
        dim_join(grams, phrases, "words", "inner")
        .groupBy(*CONTENT)
        .agg(F.sort_array(F.collect_set(F.struct("pos", "n", "words", "kind"))).alias(out))
    )
    return df.drop("_w").join(found, list(CONTENT), "left").withColumn(out, F.coalesce(out, empty)).drop(*CONTENT)


def greedy_matches(hits: Column) -> Column:
    """Longest phrase per start, left to right, without overlaps."""
    start = F.struct(F.lit(1).alias("next"), F.array().cast(_HITS).alias("taken"))

    def step(acc: Column, h: Column) -> Column:
        hit = F.struct(
            h["pos"].alias("pos"), (-h["minus_n"]).alias("n"), h["words"].alias("words"), h["kind"].alias("kind")
        )
        return F.when(
            h["pos"] >= acc.next,
            F.struct((h["pos"] - h["minus_n"]).alias("next"), F.array_append(acc.taken, hit).alias("taken")),
        ).otherwise(acc)

    # by position, longer first
    ordered = F.sort_array(
        F.transform(
            hits,
            lambda h: F.struct(
                h["pos"].alias("pos"), (-h["n"]).alias("minus_n"), h["words"].alias("words"), h["kind"].alias("kind")
            ),
        )
    )
    return F.aggregate(ordered, start, step, lambda acc: acc.taken)


def _rewrite_matches(words: str, matches: str, replacement: Callable[[Column], Column]) -> Column:
    """The token array with every match replaced by the array `replacement(match)`."""
    w, m = F.col(words), F.col(matches)
    n_matches = F.size(m)

    def end_of(i: Column) -> Column:
        return F.coalesce(F.get(m, i)["pos"] + F.get(m, i)["n"], F.lit(1))

    def part(match: Column, i: Column) -> Column:
        start = end_of(i - 1)
        return F.concat(F.slice(w, start, match["pos"] - start), replacement(match))

    tail_from = end_of(n_matches - 1)
    tail = F.slice(w, tail_from, F.greatest(F.size(w) + 1 - tail_from, F.lit(0)))
    return F.concat(F.flatten(F.transform(m, part)), tail)


def join_matches(words: str, matches: str) -> Column:
    """Every match becomes one `a_b` token."""
    return _rewrite_matches(words, matches, lambda m: F.array(F.replace(m["words"], F.lit(" "), F.lit("_"))))


def drop_matches(words: str, matches: str) -> Column:
    return _rewrite_matches(words, matches, lambda m: F.array().cast("array<string>"))


def compound_phrases(
    df: DataFrame, key: str, words: Column, lexicon: DataFrame, out: str = "compounds", max_rows: int = MAX_SET_ROWS
) -> DataFrame:
    """Add `out`: the tokens with multi-word lexicon entries joined by `_`; null stays null."""
    df = phrase_matches(df.withColumn("_words", words), key, "_words", lexicon, "_matches", max_rows, 2)
    return df.withColumn(out, join_matches("_words", "_matches")).drop("_words", "_matches")


def remove_stopwords(
    df: DataFrame, key: str, words: Column, stopwords: DataFrame, out: str = "kept", max_rows: int = MAX_SET_ROWS
) -> DataFrame:
    """Add `out`: the tokens that are no stop word, in order; null stays null.

    A stop word of several words goes where all of them follow each other, longer ones first.
    """
    stopwords = stopwords.where(F.col("word").isNotNull()).select(F.col("word").alias("words"), F.lit("stop").alias("kind"))
    listed = rows_if_small(stopwords, max_rows)
    if listed is not None and not any(" " in r.words for r in listed):
        known = sorted({r.words for r in listed})
        return df.withColumn(out, F.filter(words, lambda w: ~w.isin(known)))
    df = phrase_matches(df.withColumn("_words", words), key, "_words", stopwords, "_matches", max_rows)
    return df.withColumn(out, drop_matches("_words", "_matches")).drop("_words", "_matches")


def location_mentions(
    df: DataFrame, key: str, words: Column, places: DataFrame, out: str = "places", max_rows: int = MAX_SET_ROWS
) -> DataFrame:
    """Add `out`: array<struct<kind, words>> of distinct gazetteer names in the text."""
    df = phrase_matches(df.withColumn("_words", words), key, "_words", places, "_matches", max_rows)
    names = F.transform("_matches", lambda h: F.struct(h["kind"].alias("kind"), h["words"].alias("words")))
    return df.withColumn(out, F.sort_array(F.array_distinct(names))).drop("_words", "_matches")


def count_kind(places: Column, *kinds: str) -> Column:
    return F.size(F.filter(places, lambda p: p["kind"].isin(*kinds)))


def topic_overlap(
    df: DataFrame,
    key: str,
    title_words: str,
    body_words: str,
    topics: DataFrame,
    out: str = "topic_hits",
    max_rows: int = MAX_SET_ROWS,
) -> DataFrame:
    """Add `out`: distinct title terms that the body supports.

    A title term listed in `topics(term, related_term)` counts through its related terms
    only; any other term counts if the body holds the term itself.  Terms of several words
    are found as phrases in title and body.
    """
    # A term without a related one is its own; rows without a term say nothing.
    topics = topics.where(F.col("term").isNotNull()).select("term", F.coalesce("related_term", "term").alias("related_term"))
    names = topics.select(F.explode(F.array("term", "related_term")).alias("words")).where(F.contains("words", F.lit(" ")))
    spelled = {c: F.replace(c, F.lit(" "), F.lit("_")).alias(c) for c in ("term", "related_term")}
    df = df.withColumns({"_t": F.col(title_words), "_b": F.col(body_words)})
    if not names.isEmpty():
        phrases = names.select("words", F.lit("topic").alias("kind"))
        for words in ("_t", "_b"):
            df = compound_phrases(df, key, F.col(words), phrases, words, max_rows)
        topics = topics.select(*spelled.values())
    listed = rows_if_small(topics, max_rows)
    if listed is not None:
        related: dict[str, set[str]] = {}
        for r in listed:
            related.setdefault(r.term, set()).add(r.related_term)
        mapping = F.lit(None).cast("map<string,array<string>>")
        if related:
            pairs = [x for t, rs in sorted(related.items()) for x in (F.lit(t), F.array(*map(F.lit, sorted(rs))))]
            mapping = F.create_map(*pairs)
        hit = F.filter(
            F.array_distinct("_t"),
            lambda t: F.arrays_overlap(F.coalesce(F.try_element_at(mapping, t), F.array(t)), F.col("_b")),
        )
        return df.withColumn(out, F.coalesce(F.size(hit), F.lit(0))).drop("_t", "_b")
    df = with_content(df, "_t", "_b")
    terms = explode_rows(df, list(CONTENT), F.array_distinct("_t"), "term")
    wanted = dim_join(terms, topics, "term", "left").select(
        *CONTENT, "term", F.coalesce("related_term", "term").alias("word")
    )
    body = explode_rows(df, list(CONTENT), F.array_distinct("_b"), "word")
    hits = (
        wanted.join(body, [*CONTENT, "word"], "left_semi")
        .groupBy(*CONTENT)
        .agg(F.count_distinct("term").cast("int").alias(out))
    )
    return df.join(hits, list(CONTENT), "left").withColumn(out, F.coalesce(out, F.lit(0))).drop("_t", "_b", *CONTENT)
