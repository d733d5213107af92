"""R13 over a corpus: one pass over the texts, and one cheap sort of the uses of pairs."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sangloc.functions import metrics, text
from sangloc.operators import content_rules, quality
from sangloc.sources import sinks


def plans_of(monkeypatch, *modules):
    """The plans of the tables that are written from here on, by name."""
    plans = collections.defaultdict(list)

    def spy(df, name):
        plans[name].append(df._jdf.queryExecution().executedPlan().toString())
        return sinks.staged(df, name)

    for module in modules:
        monkeypatch.setattr(module, "staged", spy)
    return plans


def test_texts_are_read_once(spark, monkeypatch):
    plans = plans_of(monkeypatch, content_rules, quality)
    texts = spark.createDataFrame([(i, f"một hai ba {i}. hai ba bốn. " * (3 * i)) for i in range(9)] + [(None, None)], "id int, text string")
    kept = content_rules.poor_text(texts, "id")
    assert kept.columns == ["id", "text", "is_poor"]
    assert sum("split(" in plan for written in plans.values() for plan in written) == 1
    without = content_rules.poor_text(texts, "id", keep_text=False)
    assert without.columns == ["id", "is_poor"]
    assert sorted(map(str, without.collect())) == sorted(map(str, kept.drop("text").collect()))


def test_pairs_are_sorted_by_a_number_and_few_are_looked_up(spark, monkeypatch):
    plans = plans_of(monkeypatch, quality)
    monkeypatch.setattr(quality, "FREQUENT_WORDS", 20)
    rng = random.Random(3)
    rows = [(i, [f"word-{int(rng.paretovariate(0.7))}" for _ in range(30)]) for i in range(60)]
    df = sinks.staged(spark.createDataFrame(rows, "id int, w array<string>"), "texts")
    quality.fit_and_score(df, "id", F.col("w"))
    (lists,) = [p.split("Initial Plan")[-1] for p in plans["bigram-model"]]
    assert re.search(r"Sort \[_hash#\d+L ASC NULLS FIRST\]", lists) and "ShuffledHashJoin" in lists
    (scored,) = plans["perplexities"]
    assert re.search(r"Filter .* IN(SET)? .* IN(SET)? ", scored)
    assert f"Coalesce {quality.SUM_TASKS * spark.sparkContext.defaultParallelism}" in scored


def test_coherence_is_counted_not_sorted(spark):
    df = spark.createDataFrame([("a",)], "text string").select(metrics.adjacent_coherence(F.col("text")))
    assert "sort_array" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_coherence_of_odd_texts(spark):
    """Against the words that Spark's `tokens` and `sentences` find, with separators and blanks of all kinds."""
    rng = random.Random(8)
    odd = " \t\n\x0b\f\r\x1c\x1d\x1f\x85\xa0 ᠎ ​    　.!?…İßΣ🎉"
    texts = ["".join(rng.choices("ab " + odd, k=rng.randint(0, 60))) for _ in range(400)] + ["", None, "a b. a b", "...", "a\x1cb. a. b"]
    df = sinks.staged(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "texts")
    lower = F.lower("text")
    rows = df.select(metrics.adjacent_coherence(F.col("text")).alias("c"), F.transform(text.sentences(lower), text.tokens).alias("s")).collect()
    for row in rows:
        if row.s is None:
            assert row.c is None
            continue
        counts = [collections.Counter(s) for s in row.s]
        assert all(counts)

        def norm(x):
            return sum(n * n for n in x.values())

        cosines = [sum(n * y[w] for w, n in x.items()) / math.sqrt(norm(x) * norm(y)) for x, y in zip(counts, counts[1:])]
        assert row.c == pytest.approx(sum(cosines) / len(cosines) if cosines else 0.0)


def test_sentences_hold_more_than_blanks(spark):
    df = spark.createDataFrame([("a.   \t.b!\n?c \x1c. \x85",)], "text string")
    assert df.select(text.sentences(F.col("text")).alias("s")).first().s == ["a", "b", "c \x1c", " \x85"]


def test_a_key_of_one_column_may_repeat_or_be_null(spark, monkeypatch):
    rng = random.Random(6)
    for kind, name in (("int", lambda i: i % 40 if i % 3 else None), ("string", lambda i: f"t{i % 40}" if i % 3 else None)):
        rows = [(name(i), [f"w{int(rng.paretovariate(0.8))}" for _ in range(rng.randint(0, 20))]) for i in range(90)]
        df = sinks.staged(spark.createDataFrame(rows, f"id {kind}, w array<string>"), "texts")
        plain = sinks.staged(quality.bigram_model(df, F.col("w")), "model")
        want = {r.id: (r.n_bigrams, pytest.approx(r.perplexity)) for r in quality.corpus_perplexity(df, "id", F.col("w"), plain).collect()}
        for most in (1, 20):
            monkeypatch.setattr(quality, "FREQUENT_WORDS", most)
            model = sinks.staged(quality.bigram_model(df, F.col("w"), key="id"), "model")
            assert {r.id: (r.n_bigrams, r.perplexity) for r in quality.corpus_perplexity(df, "id", F.col("w"), model).collect()} == want


def test_word_counts(spark):
    rows = [["a", "b", "a"], ["a"], ["b", "c"], [], None]
    df = spark.createDataFrame([(r,) for r in rows], "w array<string>")
    got = {r.token: (r.n_rows, r.n_docs, r.n, r.n_first) for r in quality.word_counts(df, F.col("w")).collect()}
    assert got == {"a": (3, 2, 2, 1), "b": (2, 2, 2, 2), "c": (1, 1, 1, 0)}
