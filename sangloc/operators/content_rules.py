"""Rules R10 to R13: special characters, title against body, poor text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sangloc.functions.metrics import (
    MAX_UNKNOWN_RATIO,
    MIN_COHERENCE,
    MIN_MATCH_SCORE,
    MIN_TYPE_TOKEN_RATIO,
    adjacent_coherence,
    hard_to_read,
    too_short,
    type_token_ratio,
)
from sangloc.functions.text import (
    bare_tokens,
    drop_special_kinds,
    html_to_text,
    special_count,
    special_kinds_to_drop,
    standardize_text,
    tokens,
)
from sangloc.operators.lexicon import remove_stopwords, topic_overlap
from sangloc.operators.pay_rules import SECTIONS, TEXTS
from sangloc.operators.quality import (
    Corpus,
    corpus_perplexity,
    fit_and_score_words,
    key_list,
    perplexity_bucket,
    perplexity_cut,
    unknown_word_ratio,
)
from sangloc.operators.rules import Dictionaries, rule, with_violation
from sangloc.operators.similarity import with_match_score
from sangloc.operators.verdict import short_circuit
from sangloc.sources.sinks import staged

# Ratio limit, votes, stop words, punctuation and messages of the content rules.
MAX_SPECIAL_RATIO = 0.05
MIN_VOTES = 4
POOR_TEXT_STOPWORDS = ("và", "của", "có", "các")
POOR_TEXT_PUNCT = "@#$%^&*()–,\":;{}|<>_=/+-"
MSG_NO_SECTIONS = "Khong co 1 trong các mục mota quyenloi yeucau"
MSG_SPECIAL_RATIO = "Nội dung chứa quá nhiều ký tự đặc biệt"
MSG_MISMATCH = "Không được tiêu đề một kiểu, mô tả một kiểu"
MSG_TOPIC = "Tiêu đề và mô tả khác chủ đề"
MSG_POOR = {
    "description": "Mô tả lôm côm, sơ sài. Đã viết lại mô tả",
    "requirements": "Yêu cầu lôm côm, sơ sài, cần phải viết lại. Đã viết lại yêu cầu",
    "benefits": "Quyền lợi lôm côm, sơ sài, cần phải viết lại. Đã viết lại quyền lợi",
}


@rule("special_ratio", reads=TEXTS, makes=tuple(f"{s}_fixed" for s in SECTIONS))
def rule_special_ratio(df: DataFrame) -> DataFrame:
    """Share of special characters in the three `_text` columns at 5 % or more.

    Counts 2 when there is no text at all.  `<section>_fixed` loses special characters,
    kind by kind, until the share is below the limit.
    """
    df = df.withColumn("_joined", F.concat(*[F.col(f"{s}_text") for s in SECTIONS]))
    chars = F.length("_joined")
    high = F.try_divide(special_count(F.col("_joined")).cast("double"), chars) >= MAX_SPECIAL_RATIO
    df = df.withColumn("_kinds", F.when(high & (chars > 0), special_kinds_to_drop(F.col("_joined"))).otherwise(0))
    df = df.withColumns({f"{s}_fixed": drop_special_kinds(F.col(f"{s}_text"), F.col("_kinds")) for s in SECTIONS})
    left = F.length(F.concat(*[F.col(f"{s}_fixed") for s in SECTIONS]))
    # only special characters: nothing is left after the repair, which counts like no text
    count = F.when((chars == 0) | (left == 0), 2).when(high, 1).otherwise(0)
    message = F.when(F.col("special_ratio_count") == 2, MSG_NO_SECTIONS).otherwise(MSG_SPECIAL_RATIO)
    return with_violation(df, "special_ratio", count, message).drop("_joined", "_kinds")


@rule("title_body_mismatch", reads=("title_fixed", "description_fixed"), makes=("match_score",))
def rule_title_body_mismatch(
    df: DataFrame,
    dims: Dictionaries,
    title: str = "title_fixed",
    body: str = "description_fixed",
    key: str = "post_id",
    vectors: tuple[str, str] | None = None,
) -> DataFrame:
    """Title and body with a match score below the limit; `vectors` names columns of vectors, see `with_match_score`."""
    df = df.withColumn("_title", html_to_text(F.coalesce(F.col(title), F.lit(""))))
    df = remove_stopwords(df, key, tokens(standardize_text(F.col("_title"))), dims.stopwords, "_title_words")
    df = remove_stopwords(df, key, tokens(standardize_text(F.col(body))), dims.stopwords, "_body_words")
    df = with_match_score(df, F.col("_title"), F.col(body), "_title_words", "_body_words", vectors=vectors)
    return with_violation(df, "title_body_mismatch", F.col("match_score") < MIN_MATCH_SCORE, MSG_MISMATCH).drop(
        "_title", "_title_words", "_body_words"
    )


@rule("topic_mismatch", reads=("title", "description_text"))
def rule_topic_mismatch(
    df: DataFrame, dims: Dictionaries, title: str = "title", body: str = "description_text", key: str = "post_id"
) -> DataFrame:
    df = df.withColumn("_title_words", bare_tokens(F.coalesce(F.col(title), F.lit(""))))
    df = df.withColumn("_body_words", bare_tokens(F.col(body)))
    df = topic_overlap(df, key, "_title_words", "_body_words", dims.topics, "_topic_hits")
    return with_violation(df, "topic_mismatch", F.col("_topic_hits") == 0, MSG_TOPIC).drop(
        "_title_words", "_body_words", "_topic_hits"
    )


def poor_text_form(c: Column) -> Column:
    """Lower case, without the four stop words and without punctuation inside sentences.

    Sentence marks stay, since readability and coherence count sentences.
    """
    words = F.filter(F.split(F.translate(F.lower(c), POOR_TEXT_PUNCT, ""), " "), lambda w: ~w.isin(*POOR_TEXT_STOPWORDS))
    return F.array_join(words, " ")


def corpus_words(c: Column) -> Column:
    return tokens(F.lower(c))


def with_row_checks(df: DataFrame, texts: list[str], out: str) -> DataFrame:
    """Add `out`: the row checks of each text column; their tokens are made columns first, so that no check makes them anew."""
    words = {f"_words_{t}": corpus_words(F.col(t)) for t in texts}
    checks = [row_checks(F.col(t), F.col(w)) for t, w in zip(texts, words)]
    return df.withColumns(words).withColumn(out, F.array(*checks)).drop(*words)


def row_checks(text: Column, words: Column) -> Column:
    """Struct of `is_short` and `votes`: what one row alone says about its quality; `words` are the corpus words of the text."""
    checks = (
        hard_to_read(text),
        F.coalesce(type_token_ratio(words) < MIN_TYPE_TOKEN_RATIO, F.lit(False)),
        adjacent_coherence(text) < MIN_COHERENCE,
    )
    votes = sum((c.cast("int") for c in checks), F.lit(0))
    return F.struct(too_short(text, words).alias("is_short"), votes.alias("votes"))


def needs_corpus(checks: Column) -> Column:
    """A short text is poor anyway, and below two votes four are out of reach."""
    return ~checks["is_short"] & (checks["votes"] >= MIN_VOTES - 2)


def corpus_votes(
    texts: DataFrame,
    key: str | list[str],
    text: str,
    corpus: Corpus,
    min_docs: int = 3,
    scored: DataFrame | None = None,
    words: Column | None = None,
) -> DataFrame:
    """(key, corpus_votes): 0 to 2 votes, for unknown words and for perplexity; the key may be several columns.

    A perplexity is too high beyond the cut of the corpus; no perplexity is held against a text by an empty corpus.  `scored` has
    (key, bucket) of these texts, or of more, where they were scored before; `words` are the corpus words of the text, where they were
    made before.
    """
    keys = key_list(key)
    words = corpus_words(F.col(text)) if words is None else words
    cut = perplexity_cut(corpus.sketch)
    unknown = unknown_word_ratio(texts, keys, words, corpus.vocabulary, min_docs).select(
        *keys, (F.col("unknown_ratio") > MAX_UNKNOWN_RATIO).cast("int").alias("vote")
    )
    if cut is None:
        return unknown.select(*keys, F.lit(0).alias("corpus_votes"))
    if scored is None:
        perplexities = corpus_perplexity(texts, keys, words, corpus.model)
        scored = perplexities.select(*keys, perplexity_bucket(F.col("perplexity")).alias("bucket"))
    gibberish = scored.select(*keys, (F.col("bucket") > cut).cast("int").alias("vote"))
    return unknown.unionByName(gibberish).groupBy(*keys).agg(F.sum("vote").cast("int").alias("corpus_votes"))


def all_votes(
    texts: DataFrame, key: str, text: str, corpus: Corpus, min_docs: int = 3, scored: DataFrame | None = None
) -> DataFrame:
    """(key, votes): how many of the six checks hold against each text; unlike `poor_text` it runs all of them everywhere."""
    checked = with_row_checks(texts.select(key, text), [text], "_checks").withColumn("_check", F.col("_checks")[0])
    checked = checked.select(key, (F.col("_check.votes") + F.col("_check.is_short").cast("int")).alias("votes"))
    votes = corpus_votes(texts, key, text, corpus, min_docs, scored)
    return checked.join(votes, key, "left").select(key, (F.col("votes") + F.coalesce("corpus_votes", F.lit(0))).alias("votes"))


def poor_text(
    texts: DataFrame,
    key: str,
    text: str = "text",
    corpus: Corpus | None = None,
    min_docs: int = 3,
    keep_text: bool = True,
) -> DataFrame:
    """Add `is_poor`: too short, or at least four of the six checks.

    Only texts that the row checks leave open meet the corpus tables; the outcome is the
    same as with all six checks everywhere.  The text need not be kept: it is read once, and the rest works on its words.
    """
    # written once: words and checks come from one pass over the texts, the corpus is made of the words, and both branches below
    # filter on the checks
    words = F.col("_words")
    checked = texts.withColumn("_words", corpus_words(F.col(text)))
    checked = checked.withColumn("_checks", row_checks(F.col(text), words))
    checked = staged(checked if keep_text else checked.drop(text), "checked")
    fitted, scored = (corpus, None) if corpus else fit_and_score_words(checked, key, words)

    def costly(rows: DataFrame) -> DataFrame:
        votes = corpus_votes(rows, key, text, fitted, min_docs, scored, words)
        enough = F.col("_checks")["votes"] + F.coalesce("corpus_votes", F.lit(0)) >= MIN_VOTES
        return rows.join(votes, key, "left").withColumn("is_poor", enough).drop("corpus_votes")

    return short_circuit(
        checked, ~needs_corpus(F.col("_checks")), costly, is_poor=F.col("_checks")["is_short"]
    ).drop("_checks", "_words")
