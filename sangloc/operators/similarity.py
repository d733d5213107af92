"""Title/body similarity: TF-IDF, BM25, vectors and their mixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sangloc.functions.metrics import PAIR_STOPWORDS, embedding_cosine, pair_tfidf_cosine, term_cosine
from sangloc.functions.text import word_terms
from sangloc.operators.generate import explode_rows, inline_rows
from sangloc.operators.joins import dim_join, skew_join
from sangloc.sources.sinks import removed, staged

# BM25 constants and mixing weights.
K1 = 1.5
B = 0.75
HYBRID_ALPHA = 0.5
FINAL_ALPHA = 0.75


def final_score(cosine: Column, tfidf: Column) -> Column:
    return FINAL_ALPHA * F.coalesce(cosine, F.lit(0.0)) + (1 - FINAL_ALPHA) * F.coalesce(tfidf, F.lit(0.0))


def with_tfidf(df: DataFrame, title: Column, body: Column, out: str = "tfidf") -> DataFrame:
    """Add the TF-IDF cosine of two texts; their terms are made columns before they are compared."""
    df = df.withColumns({"_ta": word_terms(title, PAIR_STOPWORDS), "_tb": word_terms(body, PAIR_STOPWORDS)})
    return df.withColumn(out, pair_tfidf_cosine(F.col("_ta"), F.col("_tb"))).drop("_ta", "_tb")


def with_match_score(
    df: DataFrame,
    title: Column,
    body: Column,
    title_words: str,
    body_words: str,
    out: str = "match_score",
    vectors: tuple[str, str] | None = None,
) -> DataFrame:
    """Add 0.75 vector cosine + 0.25 TF-IDF.

    `vectors` names the columns of a title and a body vector, arrays of numbers; without them the vectors are the term
    counts of the texts.  A null vector, or one without a length, counts as a cosine of 0.
    """
    df = with_tfidf(df, title, body, "_tfidf")
    cosine = embedding_cosine(*map(F.col, vectors)) if vectors else term_cosine(F.col(title_words), F.col(body_words))
    score = final_score(cosine, F.col("_tfidf"))
    return df.withColumn(out, score).drop("_tfidf")


def _corpus_size(docs: DataFrame, words: str) -> tuple[Column, Column]:
    """Number of documents and their mean length."""
    stats = docs.agg(F.count("*").alias("n"), F.avg(F.size(words)).alias("len"))
    return stats.select("n").scalar(), stats.select("len").scalar()


def _term_score(tf: Column, length: Column, n_docs: Column, n: Column, mean_len: Column) -> Column:
    idf = F.log(1 + (n - n_docs + 0.5) / (n_docs + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_len))


def bm25_score(df: DataFrame, key: str, title_words: str, body_words: str) -> DataFrame:
    """(key, bm25): each title against its own body, term statistics over all bodies.

    Title and body share a row, so term frequencies are counted there and only the few
    title terms travel to the document-frequency table.
    """
    held = explode_rows(df, [], F.array_distinct(body_words), "term").groupBy("term").agg(F.count("*").alias("n_docs"))
    # written once: the join below reads it several times
    df_table = staged(held, "document-frequencies")
    n, mean_len = _corpus_size(df, body_words)
    counted = F.transform(
        F.array_intersect(title_words, body_words),
        lambda t: F.struct(
            t.alias("term"),
            F.size(F.filter(F.col(title_words), lambda x: x == t)).alias("qtf"),
            F.size(F.filter(F.col(body_words), lambda x: x == t)).alias("tf"),
        ),
    )
    length = F.size(body_words).alias("len")
    terms = inline_rows(df, [key, length], counted, "term")
    score = _term_score(F.col("tf"), F.col("len"), F.col("n_docs"), n, mean_len)
    # every (row, title term) is counted at most once per document holding the term
    weighted = df_table.withColumn("n_rows", F.col("n_docs"))
    scored = (
        skew_join(terms, weighted, ["term"], "n_rows")
        .groupBy(key)
        .agg(F.sum(F.col("qtf") * score).alias("bm25"))
    )
    return df.select(key).join(scored, key, "left").select(key, F.coalesce("bm25", F.lit(0.0)).alias("bm25"))


def hybrid_score(bm25: Column, cosine: Column, alpha: float = HYBRID_ALPHA) -> Column:
    return alpha * bm25 + (1 - alpha) * F.coalesce(cosine, F.lit(0.0))


#: Postings of a term that the first pass reads, as a multiple of k, and rows of a slice of a term's postings.
FIRST_PASS = 4
SLICE_ROWS = 100_000
#: Scores are compared with this margin, so that rounding and ties at the k-th place change nothing.
MARGIN = 1e-5
#: Candidates whose terms a task looks up.
TASK_CANDIDATES = 100_000


def impacts(docs: DataFrame, doc_key: str, words: str, terms: DataFrame) -> DataFrame:
    """(term, doc, impact, n_docs): BM25 score of every document for each of `terms` that it holds."""
    n, mean_len = _corpus_size(docs, words)
    uses = explode_rows(docs, [doc_key, F.size(words).alias("len")], words, "term")
    counted = dim_join(uses, terms, "term", "left_semi").groupBy(doc_key, "term", "len").agg(F.count("*").alias("tf"))
    counted = staged(counted, "term-counts")
    held = counted.groupBy("term").agg(F.count("*").alias("n_docs"))
    score = _term_score(F.col("tf"), F.col("len"), F.col("n_docs"), n, mean_len)
    scored = dim_join(counted, held, "term", "inner", sized=terms).select("term", doc_key, score.alias("impact"), "n_docs")
    out = staged(scored, "impacts")
    removed(counted)
    return out


def _on_terms(postings: DataFrame, doc_key: str, asked: DataFrame) -> DataFrame:
    """Postings that meet the queries asking for their term; a long list meets them slice by slice.

    `asked` has the number of documents of its terms too.
    """
    slices = F.ceil(F.col("n_docs") / SLICE_ROWS)
    dealt = postings.select("term", F.pmod(F.xxhash64(doc_key), slices).alias("_slice"), doc_key, "impact")
    wanted = asked.withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1))).drop("n_docs")
    return dim_join(dealt, wanted, ["term", "_slice"], "inner")


def bm25_top_k(
    docs: DataFrame, doc_key: str, words: str, queries: DataFrame, query_key: str, query_words: str, k: int = 5
) -> DataFrame:
    """(query, doc, rank, bm25): the k best documents per query, exactly, without scoring all pairs that share a term.

    1. The postings with the greatest impacts of each term give some documents a partial score; the k-th best is a
       threshold that the k best documents reach.
    2. Terms whose greatest impacts together stay below the threshold cannot bring a document up to it.  Only the
       others, mostly the rare ones, form pairs, and pairs whose partial score and the rest's greatest impacts stay below it go.
    3. What is left is scored in full.

    The top k is taken per (query, slice of documents) before it is taken per query, so no task ranks more than a slice
    of one query.
    """
    asked = explode_rows(queries, [query_key], query_words, "term").groupBy(query_key, "term").agg(F.count("*").alias("qtf"))
    asked = staged(asked, "asked")
    postings = impacts(docs, doc_key, words, asked.select("term").distinct())
    gain = (F.col("qtf") * F.col("impact")).alias("gain")
    lists = postings.groupBy("term").agg(F.first("n_docs").alias("n_docs"), F.max("impact").alias("impact"))
    lists = staged(asked.join(lists, "term"), "asked-lists")

    first = top_k(postings, "term", doc_key, "impact", FIRST_PASS * k).drop("rank")
    partial = _on_terms(first, doc_key, lists.drop("impact")).groupBy(query_key, doc_key).agg(F.sum(gain).alias("partial"))
    thresholds = top_k(partial, query_key, doc_key, "partial", k).groupBy(query_key)
    thresholds = thresholds.agg(F.when(F.count("*") == k, F.min("partial")).otherwise(0.0).alias("threshold"))

    bounds = lists.select(query_key, "term", "qtf", "n_docs", gain).join(thresholds, query_key)
    up_to = Window.partitionBy(query_key).orderBy("gain", "term")
    bounds = bounds.withColumn("needed", F.sum("gain").over(up_to) >= F.col("threshold") - MARGIN)
    rest = F.sum(F.when(~F.col("needed"), F.col("gain")).otherwise(0.0)).over(Window.partitionBy(query_key))
    bounds = staged(bounds.withColumn("rest", rest).where("needed").select(query_key, "term", "qtf", "n_docs", "threshold", "rest"), "bounds")

    pairs = _on_terms(postings, doc_key, bounds).groupBy(query_key, doc_key, "threshold", "rest").agg(F.sum(gain).alias("partial"))
    able = pairs.where(F.col("partial") + F.col("rest") >= F.col("threshold") - MARGIN).select(query_key, doc_key)
    able = staged(able, "candidates")
    # All that a candidate shares with its query.  Candidates and postings meet by document, where the sums stay too: what the
    # candidates' terms multiply to is never shuffled, so both sides may be dealt by a part of the join's keys.
    conf, option = docs.sparkSession.conf, "spark.sql.requireAllClusterKeysForCoPartition"
    n = max(int(conf.get("spark.sql.shuffle.partitions")), able.count() // TASK_CANDIDATES)
    wanted = dim_join(able.repartition(n, doc_key), asked, query_key, "inner")
    held = postings.select(doc_key, "term", "impact").repartition(n, doc_key).hint("shuffle_hash")
    scored = wanted.join(held, [doc_key, "term"]).groupBy(query_key, doc_key).agg(F.round(F.sum(gain), 6).alias("bm25"))
    before = conf.get(option)
    conf.set(option, "false")
    try:
        out = staged(top_k(scored, query_key, doc_key, "bm25", k), "best")
    finally:
        conf.set(option, before)
    removed(asked, postings, lists, bounds, able)
    return out


def top_k(df: DataFrame, group: str, key: str, value: str, k: int, slices: int = 64) -> DataFrame:
    """Exact top k rows per group in two steps, so that a hot group is split over `slices` tasks."""
    best = [F.col(value).desc(), F.col(key)]
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(slices)))
    part = Window.partitionBy(group, "_slice").orderBy(*best)
    whole = Window.partitionBy(group).orderBy(*best)
    return (
        sliced.withColumn("rank", F.row_number().over(part))
        .where(F.col("rank") <= k)
        .withColumn("rank", F.row_number().over(whole))
        .where(F.col("rank") <= k)
        .drop("_slice")
    )
