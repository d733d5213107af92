"""Corpus-wide quality metrics: unknown words, bigram perplexity, neighbour coherence of vectors.

`fit_corpus` writes the tables of a corpus once; batches and streams are scored against them.  Perplexity has no
useful fixed limit, so the corpus also has a sketch of its own perplexities, counts by buckets that grow
by 1 %, from which the cut is taken: a share of the corpus, whatever its size.  All counts add up over parts of a corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sangloc.functions.metrics import embedding_cosine
from sangloc.operators.generate import explode_rows
from sangloc.operators.joins import hot_rows, skew_join
from sangloc.sources.sinks import removed, staged

Keys = str | list[str]

# Perplexities are counted by buckets of this growth, up to the last bucket: at most so many rows.
BUCKET_GROWTH = 1.01
LAST_BUCKET = 8192
# Of a hundred texts of the corpus so many have a perplexity that passes.
PASSING_PERCENT = 95
# A word with more than one of so many uses is frequent; the salts that the pairs of a frequent first word are dealt over.
FREQUENT_WORDS, SALTS = 1_000, 64
# Uses of pairs that a task sorts, so that none has to spill, nor to sort far more than a processor's cache holds.
TASK_USES = 1_000_000
# Tasks a core that add up the lists of a model.
SUM_TASKS = 4


def key_list(key: Keys) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def word_counts(df: DataFrame, words: Column) -> DataFrame:
    """(token, n_rows, n_docs, n, n_first): uses of a token, texts holding it, its uses in texts of two words or more, and those of
    them that another word follows.

    A text's words are followed by its distinct words, so one explode and one map-side combined count give all
    numbers; no distinct over (token, text) is shuffled.
    """
    held = df.select(words.alias("_words"))
    held = held.select(F.size("_words").alias("_n"), F.concat("_words", F.array_distinct("_words")).alias("_all"))
    at, n = F.col("_at"), F.col("_n")
    return (
        held.select("_n", F.posexplode_outer("_all").alias("_at", "token"))
        .where(F.col("token").isNotNull())
        .groupBy("token")
        .agg(
            F.count_if(at < n).alias("n_rows"),
            F.count_if(at >= n).alias("n_docs"),
            F.count_if((at < n) & (n > 1)).alias("n"),
            F.count_if(at < n - 1).alias("n_first"),
        )
    )


def vocabulary(df: DataFrame, words: Column) -> DataFrame:
    """(token, n_rows, n_docs): uses of a token and texts holding it."""
    return word_counts(df, words).select("token", "n_rows", "n_docs")


def _used(uses: DataFrame, keys: list[str], on: list[str], dim: DataFrame, weight: str, value: Column) -> DataFrame:
    """(keys, n, n_met, total) of each text's uses: how many, how many `dim` holds, and the sum of their values.

    Entries of `dim` with a large part of all uses are broadcast (there is a bound on their number), and uses of them are
    dealt by text.  Each use travels once.
    """
    hot = hot_rows(dim, weight).select(*on, F.lit(True).alias("_hot"), value.cast("double").alias("_value"))
    met = uses.join(F.broadcast(hot), on, "left")
    # A text's hot uses get names that no word has (words hold no blanks), spread over many partitions.
    spread = F.concat(F.lit(" "), F.pmod(F.xxhash64(*keys), F.lit(4096)).cast("string"))
    named = [F.when(F.col("_hot"), spread).otherwise(F.col(c)).alias(c) for c in on]
    # One shuffle, by entry: the groups of a text and the join below find their rows where it puts them.
    dealt = met.select(*keys, *named, "_hot", "_value").repartition(*on)
    once = dealt.groupBy(*keys, *on).agg(F.count("*").alias("n"), F.count("_hot").alias("_n_hot"), F.sum("_value").alias("_hot_total"))
    known = dim.select(*on, F.lit(1).alias("_known"), value.cast("double").alias("_value"))
    return (
        once.join(known, on, "left")
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("_n_hot") + F.col("n") * F.coalesce("_known", F.lit(0))).alias("n_met"),
            F.sum(F.coalesce("_hot_total", F.col("n") * F.col("_value"), F.lit(0.0))).alias("total"),
        )
    )


def unknown_word_ratio(df: DataFrame, key: Keys, words: Column, vocab: DataFrame, min_docs: int = 3) -> DataFrame:
    """(key, n_words, n_unknown, unknown_ratio): share of tokens in fewer than `min_docs` texts.

    A token missing from `vocab` (fitted on another batch) is unknown as well.
    """
    keys = key_list(key)
    known = vocab.where(F.col("n_docs") >= min_docs)
    used = _used(explode_rows(df, keys, words, "token"), keys, ["token"], known, "n_rows", F.lit(0))
    unknown = (F.col("n") - F.col("n_met")).alias("n_unknown")
    return used.select(*keys, F.col("n").alias("n_words"), unknown).withColumn("unknown_ratio", F.col("n_unknown") / F.col("n_words"))


def _bigrams(df: DataFrame, words: Column, *keep: str) -> DataFrame:
    held = df.select(*keep, words.alias("_words"))
    firsts = held.select(*keep, "_words", F.posexplode_outer("_words").alias("_at", "w1"))
    followed = firsts.where(F.col("_at") + 1 < F.size("_words"))
    return followed.select(*keep, "w1", F.get("_words", F.col("_at") + 1).alias("w2"))


def bigram_counts(df: DataFrame, words: Column) -> DataFrame:
    """(w1, w2, n_rows): uses of each pair of neighbours."""
    return _bigrams(df, words).groupBy("w1", "w2").agg(F.count("*").alias("n_rows"))


def model_of(pairs: DataFrame, parts: list[DataFrame] | None = None) -> DataFrame:
    """(w1, w2, n_rows, log_p): add-one smoothed log probability of w2 after w1, from written bigram counts.

    First-word counts and the vocabulary size come from that already reduced table.  `parts` receives the written
    tables that the model is read from, for the caller to remove.
    """
    firsts = staged(pairs.groupBy("w1").agg(F.sum("n_rows").alias("n_first"), F.count("*").alias("n_pairs")), "firsts")
    if parts is not None:
        parts.append(firsts)
    v = (
        pairs.select(F.explode(F.array("w1", "w2")).alias("w"))
        .distinct()
        .agg(F.count("*").alias("v"))
        .scalar()
    )
    return skew_join(pairs, firsts, ["w1"], "n_pairs").select(
        "w1", "w2", "n_rows", F.log((F.col("n_rows") + 1) / (F.col("n_first") + v)).alias("log_p")
    )


def _listed(keys: list[str]) -> Column:
    """What a model lists of a text: the key as it is, or a struct of several."""
    return F.struct(*keys) if len(keys) > 1 else F.col(keys[0])


def _model_with_texts(df: DataFrame, words: Column, keys: list[str], counts: DataFrame) -> DataFrame:
    """(w1, w2, n_rows, log_p, _texts): the model, with the keys of the texts that use a pair, once per use.

    Each use is shuffled once, by first word, which gives the count of its pair, the list of its texts and the count of its
    first word together.  Frequent first words are salted.  Pairs of two frequent words, the only ones that can be hot, are
    counted before they are shuffled and have no list (null): there are at most FREQUENT_WORDS squared of them.  Pairs are
    sorted by the hashes of their words in one number, which is a radix sort, so that the grouping meets them in order and need not
    sort words, which are slow to compare where they begin alike.
    """
    v = counts.agg(F.count_if(F.col("n") > 0).alias("v")).scalar()
    log_p = F.log((F.col("n_rows") + 1) / (F.col("n_first") + v)).alias("log_p")

    frequent = [r.token for r in hot_rows(counts, "n", FREQUENT_WORDS).select("token").collect()]
    is_1, is_2 = F.col("w1").isin(frequent), F.col("w2").isin(frequent)
    firsts = counts.select(F.col("token").alias("w1"), "n_first")
    counted = _bigrams(df, words).where(is_1 & is_2).groupBy("w1", "w2").agg(F.count("*").alias("n_rows"))
    common = counted.join(F.broadcast(firsts.where(is_1)), "w1").select("w1", "w2", "n_rows", log_p)

    uses = _bigrams(df, words, *keys).where(~(is_1 & is_2))
    salt = F.when(is_1, F.pmod(F.xxhash64("w2"), F.lit(SALTS)).cast("int")).otherwise(0).alias("_salt")
    n_uses = counts.agg(F.coalesce(F.sum("n_first"), F.lit(0))).first()[0]
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_uses // TASK_USES)
    dealt = uses.select(*keys, "w1", salt, "w2").repartition(n, "w1", "_salt")
    by_hash = F.shiftleft(F.hash("w1").cast("long"), 32).bitwiseOR(F.hash("w2").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    hashed = dealt.withColumn("_hash", by_hash).sortWithinPartitions("_hash")
    lists = hashed.groupBy("_hash", "w1", "_salt", "w2").agg(F.count("*").alias("n_rows"), F.collect_list(_listed(keys)).alias("_texts"))
    if len(keys) == 1:
        # a list leaves out nulls: the uses by texts without a key
        nulls = F.array_repeat(F.lit(None).cast(df.schema[keys[0]].dataType), (F.col("n_rows") - F.size("_texts")).cast("int"))
        lists = lists.withColumn("_texts", F.when(F.size("_texts") < F.col("n_rows"), F.concat("_texts", nulls)).otherwise(F.col("_texts")))
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    salted = firsts.where(F.col("n_first") > 0).select("w1", "n_first", F.explode(F.when(is_1, salts).otherwise(F.array(F.lit(0)))).alias("_salt"))
    # the first words of a task's uses are fewer than these, and hashed they need not be sorted like the lists
    rest = lists.join(salted.hint("shuffle_hash"), ["w1", "_salt"]).select("w1", "w2", "n_rows", log_p, "_texts")
    return rest.unionByName(common, allowMissingColumns=True)


def bigram_model(
    df: DataFrame, words: Column, parts: list[DataFrame] | None = None, key: Keys | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """The model of a text table; with the key of its texts, it also says which texts use a pair.

    The texts of the table are then scored from what the model says of them.  `counts` has its `word_counts`, where they
    were written before.
    """
    if key is not None:
        if counts is None:
            counts = staged(word_counts(df, words), "word-counts")
            if parts is not None:
                parts.append(counts)
        return _model_with_texts(df, words, key_list(key), counts)
    pairs = staged(bigram_counts(df, words), "bigrams")
    if parts is not None:
        parts.append(pairs)
    return model_of(pairs, parts)


def corpus_perplexity(df: DataFrame, key: Keys, words: Column, model: DataFrame) -> DataFrame:
    """(key, n_bigrams, perplexity) for rows with two words or more.

    Bigrams the model has not seen (another batch) score as its least likely pair.  A model that says which texts use its
    pairs must be that of these texts: its lists are added up, and only pairs of frequent words are looked up.
    """
    keys = key_list(key)
    if "_texts" in model.columns:
        common = model.where(F.col("_texts").isNull()).select("w1", "w2", "log_p")
        # fewer words than FREQUENT_WORDS: most uses are passed without a look-up
        frequent = [r.w for r in common.select(F.explode(F.array("w1", "w2")).alias("w")).distinct().collect()]
        between = _bigrams(df, words, *keys).where(F.col("w1").isin(frequent) & F.col("w2").isin(frequent))
        looked_up = between.join(F.broadcast(common), ["w1", "w2"]).select(*keys, "log_p")
        # few tasks, so that each adds up many uses of a text before the sums are shuffled, however large the model
        lists = model.where(F.col("_texts").isNotNull()).coalesce(SUM_TASKS * df.sparkSession.sparkContext.defaultParallelism)
        listed = lists.select(F.explode("_texts").alias("_text"), "log_p")
        named = [F.col("_text").alias(keys[0])] if len(keys) == 1 else [F.col("_text")[k].alias(k) for k in keys]
        every = listed.select(*named, "log_p").unionByName(looked_up)
        return every.groupBy(*keys).agg(F.count("*").alias("n_bigrams"), F.exp(-F.avg("log_p")).alias("perplexity"))
    floor = model.agg(F.min("log_p").alias("floor")).scalar()
    used = _used(_bigrams(df, words, *keys), keys, ["w1", "w2"], model, "n_rows", F.col("log_p"))
    mean = (F.col("total") + (F.col("n") - F.col("n_met")) * F.coalesce(floor, F.lit(0.0))) / F.col("n")
    return used.select(*keys, F.col("n").alias("n_bigrams"), F.exp(-mean).alias("perplexity"))


def perplexity_bucket(perplexity: Column) -> Column:
    return F.least(F.floor(F.log(perplexity) / math.log(BUCKET_GROWTH)), F.lit(LAST_BUCKET)).cast("int")


def bucket_counts(scored: DataFrame) -> DataFrame:
    """(bucket, n): the sketch of the perplexities of a scored table; sketches of parts are merged by adding."""
    return scored.groupBy("bucket").agg(F.count("*").alias("n"))


def perplexity_cut(sketch: DataFrame, passing_percent: int = PASSING_PERCENT) -> int | None:
    """The bucket beyond which a text is gibberish, or None for an empty sketch; reads at most LAST_BUCKET + 1 sums."""
    counts = sorted((r.bucket, r.n) for r in sketch.groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    total, seen = sum(n for _, n in counts), 0
    for bucket, n in counts:
        seen += n
        if 100 * seen >= passing_percent * total:
            return bucket
    return None


@dataclass(frozen=True)
class Corpus:
    """What texts are scored against, as written tables.

    vocabulary(token, n_rows, n_docs), model(w1, w2, n_rows, log_p), sketch(bucket, n).
    """

    vocabulary: DataFrame
    model: DataFrame
    sketch: DataFrame

    def remove(self) -> None:
        removed(self.vocabulary, self.model, self.sketch)


def fit_corpus(df: DataFrame, key: Keys, words: Column) -> Corpus:
    """Vocabulary, bigram model and perplexities of a corpus whose texts are named by a key."""
    corpus, scored = fit_and_score(df, key, words)
    removed(scored)
    return corpus


def fit_and_score(df: DataFrame, key: Keys, words: Column) -> tuple[Corpus, DataFrame]:
    """The corpus, and (key, bucket) of its own texts, which need not be scored again to be judged.

    The words of the texts are made once, for the model, the scores and the vocabulary.
    """
    named = staged(df.select(*key_list(key), words.alias("_words")), "corpus-words")
    fitted = fit_and_score_words(named, key, F.col("_words"))
    removed(named)
    return fitted


def fit_and_score_words(named: DataFrame, key: Keys, words: Column) -> tuple[Corpus, DataFrame]:
    """The same from a written table of the words of the texts."""
    counts = staged(word_counts(named, words), "vocabulary")
    model = staged(bigram_model(named, words, key=key, counts=counts), "bigram-model")
    perplexities = corpus_perplexity(named, key, words, model)
    scored = staged(perplexities.select(*key_list(key), perplexity_bucket(F.col("perplexity")).alias("bucket")), "perplexities")
    vocabulary_ = counts.select("token", "n_rows", "n_docs")
    return Corpus(vocabulary_, model.drop("_texts"), staged(bucket_counts(scored), "sketch")), scored


def neighbour_cosine(
    df: DataFrame, group: str, order: str, vector: str, bucket_rows: int = 100_000
) -> DataFrame:
    """Add `cosine` to the preceding vector of the same group (null for the first); a null group is a group.

    A window over the whole group would put a hot group into one task, so `lag` runs per
    (group, bucket of `order`).  Buckets lie between quantiles of `order`, so they hold about as many
    rows each whatever its values.  Only the first row of a bucket needs another bucket: it
    looks up the last vector of the nearest earlier one among one row per bucket.
    """
    buckets = min(10_000, df.count() // bucket_rows + 1)
    bounds = None
    if buckets > 1:
        shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
        bounds = df.agg(F.percentile_approx(order, shares, 10_000).alias("b")).first().b
    listed = F.array(*[F.lit(b) for b in sorted(set(bounds or []))])
    number = F.size(F.filter(listed, lambda b: b <= F.col(order))) if bounds else F.lit(0)
    bucketed = df.withColumn("_bucket", number)
    within = Window.partitionBy(group, "_bucket").orderBy(order)
    last = bucketed.groupBy(group, "_bucket").agg(F.max_by(vector, order).alias("_last"))
    before = last.select(
        F.col(group).alias("_group"),
        F.col("_bucket").alias("_at"),
        F.lag("_last").over(Window.partitionBy(group).orderBy("_bucket")).alias("_before"),
    )
    return (
        bucketed.withColumn("_prev", F.lag(vector).over(within))
        .withColumn("_first", F.row_number().over(within) == 1)
        .join(before, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_bucket") == F.col("_at")))
        .withColumn("_prev", F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_prev")))
        .withColumn("cosine", embedding_cosine(F.col("_prev"), F.col(vector)))
        .drop("_bucket", "_prev", "_first", "_before", "_group", "_at")
    )
