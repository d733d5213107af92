"""Lexicon, join, similarity and corpus operators: both physical ways, hot keys, brute force."""

import collections
import math

import pytest
from pyspark.sql import functions as F

from sangloc.functions.text import bare_tokens, tokens
from sangloc.operators import joins, lexicon, places, quality, similarity
from sangloc.sources import lexicons, sinks


@pytest.fixture(scope="module")
def ads(spark):
    rows = [
        (1, "Tuyển nhân viên bán hàng tại Hà Nội và quận Ba Đình"),
        (2, "bán hàng online bán hàng"),
        (3, ""),
        (4, "nhân viên bán hàng online giỏi"),
    ]
    return spark.createDataFrame(rows, "id int, text string").withColumn("w", bare_tokens(F.col("text")))


@pytest.fixture(scope="module")
def phrases(spark):
    rows = [("bán hàng", "job"), ("bán hàng online", "job"), ("nhân viên", "job"), ("viên bán hàng", "job"),
            ("hà nội", "province"), ("quận ba đình", "district")]
    return spark.createDataFrame(rows, "words string, kind string")


@pytest.mark.parametrize("max_rows", [100, 0])
def test_compounds_longest_first(ads, phrases, max_rows):
    got = lexicon.compound_phrases(ads, "id", F.col("w"), phrases, max_rows=max_rows)
    assert {r.id: r.compounds for r in got.collect()} == {
        1: ["tuyển", "nhân_viên", "bán_hàng", "tại", "hà_nội", "và", "quận_ba_đình"],
        2: ["bán_hàng_online", "bán_hàng"],
        3: [],
        4: ["nhân_viên", "bán_hàng_online", "giỏi"],
    }


@pytest.mark.parametrize("max_rows", [100, 0])
def test_mentions_stopwords_topics(spark, ads, phrases, max_rows):
    got = lexicon.location_mentions(ads, "id", F.col("w"), phrases.where("kind <> 'job'"), max_rows=max_rows)
    assert [tuple(p) for p in got.where("id = 1").first().places] == [("district", "quận ba đình"), ("province", "hà nội")]
    stop = spark.createDataFrame([("và",), ("tại",), ("tại",)], "word string")
    kept = lexicon.remove_stopwords(ads, "id", F.col("w"), stop, max_rows=max_rows)
    assert kept.where("id = 1").first().kept == "tuyển nhân viên bán hàng hà nội quận ba đình".split()
    topics = spark.createDataFrame([("kế_toán", "thuế"), ("kế_toán", "sổ")], "term string, related_term string")
    posts = spark.createDataFrame(
        [(1, ["kế_toán"], ["thuế"]), (2, ["kế_toán"], ["kế_toán"]), (3, ["lái", "xe"], ["xe"]), (4, ["x"], [])],
        "id int, t array<string>, b array<string>",
    )
    hits = lexicon.topic_overlap(posts, "id", "t", "b", topics, max_rows=max_rows)
    assert {r.id: r.topic_hits for r in hits.collect()} == {1: 1, 2: 0, 3: 1, 4: 0}


@pytest.mark.parametrize("max_rows", [100, 0])
def test_districts_of_the_province(spark, max_rows):
    dp = spark.createDataFrame(
        [("Quận 1", "HCM"), ("Huyện Châu Thành", "An Giang"), ("Huyện Châu Thành", "Bến Tre")], "district string, province string"
    )
    rows = [(1, "số 5,q 1,hcm", "Số 5, Quận 1, HCM", "HCM"), (2, "ấp 2,h châu thành", "Ấp 2, huyện Châu Thành", "Bến Tre"),
            (3, "ấp 2 châu thành", "Ấp 2 Châu Thành", "An Giang"), (4, "ấp 2 châu thành", "Ấp 2 Châu Thành", "HCM")]
    df = spark.createDataFrame(rows, "id int, a string, raw string, p string")
    got = places.match_district_of_province(df, "id", F.col("a"), F.col("raw"), "p", dp, max_rows=max_rows)
    assert {r.id: r.address_districts for r in got.collect()} == {1: ["q 1"], 2: ["h châu thành"], 3: ["châu thành"], 4: []}


def test_skew_join_equals_a_plain_join(spark):
    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 700) END AS k")
    dim = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")).where("k <> 'k5'")
    for how in ("inner", "left"):
        want = rows.join(dim.drop("n"), "k", how).select("id", "k", "top")
        got = joins.skew_join(rows, dim, ["k"], "n", how, hot_share=0.01, salts=8).select("id", "k", "top")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_top_k_equals_sorting(spark):
    df = spark.range(500).selectExpr("id % 2 AS g", "id", "(id * 37) % 101 AS v")
    want = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (-r.v, r.id)):
        want[r.g].append(r.id)
    got = similarity.top_k(df, "g", "id", "v", 4).orderBy("g", "rank").collect()
    assert [(r.g, r.id) for r in got] == [(g, i) for g in (0, 1) for i in want[g][:4]]


def test_neighbour_cosine_across_buckets(spark):
    df = spark.range(1, 40).selectExpr("id % 3 AS g", "id", "array(float(id), float(id % 5), 1f) AS v")
    got = {r.id: r.cosine for r in quality.neighbour_cosine(df, "g", "id", "v", bucket_rows=4).collect()}
    whole = {r.id: r.cosine for r in quality.neighbour_cosine(df, "g", "id", "v", bucket_rows=1000).collect()}
    assert got == whole and sum(c is None for c in got.values()) == 3


def test_corpus_metrics_by_hand(spark):
    texts = {1: "a b a b", 2: "a b c", 3: "a", 4: "b d"}
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    words = tokens(F.col("text"))
    vocab = quality.vocabulary(df, words)
    assert {r.token: (r.n_rows, r.n_docs) for r in vocab.collect()} == {"a": (4, 3), "b": (4, 3), "c": (1, 1), "d": (1, 1)}
    ratio = {r.id: r.unknown_ratio for r in quality.unknown_word_ratio(df, "id", words, vocab, 2).collect()}
    assert ratio == {1: 0.0, 2: pytest.approx(1 / 3), 3: 0.0, 4: 0.5}
    pairs = collections.Counter(p for t in texts.values() for p in zip(t.split(), t.split()[1:]))
    first = collections.Counter()
    for (a, _), n in pairs.items():
        first[a] += n
    model = sinks.staged(quality.bigram_model(df, words), "model")
    got = {r.id: r.perplexity for r in quality.corpus_perplexity(df, "id", words, model).collect()}
    for i, t in texts.items():
        logs = [math.log((pairs[p] + 1) / (first[p[0]] + 4)) for p in zip(t.split(), t.split()[1:])]
        assert got.get(i) == (pytest.approx(math.exp(-sum(logs) / len(logs))) if logs else None)


def test_lexicon_sources(spark, tmp_path):
    path = tmp_path / "words.txt"
    path.write_text("à\n lắm \n\nlắm\nbị vì\n", encoding="utf-8")
    assert {r.word for r in lexicons.read_lexicon(spark, str(path)).collect()} == {"à", "lắm", "bị vì"}
    table = lexicons.lexicon_from_map(spark, {"HN": {"hà nội", "hn"}, "HCM": ["hcm", "hcm"]}, "province", "alias")
    assert {tuple(r) for r in table.collect()} == {("HN", "hà nội"), ("HN", "hn"), ("HCM", "hcm")}


def hits_of(lists, phrases, greedy, least):
    """By looking at every run of words."""
    out = []
    for words in lists:
        found = [(i + 1, n, " ".join(words[i : i + n])) for i in range(len(words or [])) for n in range(1, 7)
                 if i + n <= len(words) and " ".join(words[i : i + n]) in phrases and n >= least]
        if greedy:
            free, taken = 0, []
            for pos, n, text in sorted(found, key=lambda h: (h[0], -h[1])):
                if pos > free:
                    taken.append((pos, n, text))
                    free = pos + n - 1
            found = taken
        out.append([(*h, phrases[h[2]]) for h in sorted(found)])
    return out


@pytest.mark.parametrize("greedy, least", [(False, 1), (True, 1), (True, 2)])
def test_trie_finds_what_looking_at_every_run_finds(spark, greedy, least):
    import random

    from sangloc.operators.phrase_trie import trie_hits

    rng = random.Random(9)
    words = ["a", "b", "c", "d", "é"]
    phrases = {" ".join(rng.choices(words, k=rng.choice([1, 2, 2, 3, 5]))): rng.choice("xyz") for _ in range(25)}
    lists = [rng.choices([*words, "zz"], k=rng.choice([0, 1, 3, 40])) for _ in range(60)] + [None, [], ["a"] * 3000]
    df = spark.createDataFrame(list(enumerate(lists)), "id int, w array<string>")
    got = {r.id: [tuple(h) for h in r.h] for r in df.select("id", trie_hits(spark, phrases, F.col("w"), greedy, least).alias("h")).collect()}
    assert [got[i] for i in range(len(lists))] == hits_of(lists, phrases, greedy, least)


def test_larger_lexicons_without_a_trie(ads, phrases, spark, monkeypatch):
    monkeypatch.setattr(lexicon, "MAX_TRIE_ROWS", 0)
    got = lexicon.compound_phrases(ads, "id", F.col("w"), phrases, max_rows=0)
    assert {r.id: r.compounds for r in got.collect()}[4] == ["nhân_viên", "bán_hàng_online", "giỏi"]
    got = lexicon.location_mentions(ads, "id", F.col("w"), phrases.where("kind <> 'job'"), max_rows=0)
    assert [tuple(p) for p in got.where("id = 1").first().places] == [("district", "quận ba đình"), ("province", "hà nội")]


@pytest.mark.parametrize("max_rows", [100, 0])
def test_topics_with_nulls(spark, max_rows):
    """A term without a related one is its own; a row without a term says nothing."""
    topics = spark.createDataFrame([("a", None), (None, "b"), ("c", "d"), (None, None)], "term string, related_term string")
    posts = spark.createDataFrame([(1, ["a", "b"], ["a", "b"]), (2, ["c"], ["c"]), (3, ["c"], ["d"]), (4, None, ["a"])], "id int, t array<string>, b array<string>")
    got = lexicon.topic_overlap(posts, "id", "t", "b", topics, max_rows=max_rows)
    assert {r.id: r.topic_hits for r in got.collect()} == {1: 2, 2: 0, 3: 1, 4: 0}


def test_sparse_vectors_against_counters(spark):
    import random

    from sangloc.functions import metrics

    rng = random.Random(2)
    rows = [(i, rng.choices("abcdefgh", k=rng.randint(0, 12)), rng.choices("defghijk", k=rng.randint(0, 9))) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, a array<string>, b array<string>")
    got = df.select("id", metrics.term_vector(F.col("a")).alias("v"), metrics.term_cosine(F.col("a"), F.col("b")).alias("c"),
                    metrics.pair_tfidf_cosine(F.col("a"), F.col("b")).alias("t")).collect()
    for (_, a, b), r in zip(rows, sorted(got, key=lambda r: r.id)):
        x, y = collections.Counter(a), collections.Counter(b)
        assert [tuple(t) for t in r.v.terms] == sorted(x.items()) and r.v.norm == sum(n * n for n in x.values())
        dot = sum(n * y[w] for w, n in x.items())
        norms = math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))
        assert r.c == (pytest.approx(dot / norms) if norms else None)
        idf = lambda w: 1.0 if w in x and w in y else metrics.LONE_IDF
        norms = math.sqrt(sum((n * idf(w)) ** 2 for w, n in x.items()) * sum((n * idf(w)) ** 2 for w, n in y.items()))
        assert r.t == (pytest.approx(dot / norms) if norms else None)


def test_long_sentences_take_linear_time(spark):
    import time

    from sangloc.functions import metrics

    text = " ".join(f"w{i}" for i in range(10_000)) + ". " + " ".join(f"w{i}" for i in range(5_000, 15_000))
    df = spark.createDataFrame([(text,)], "text string")
    df.select(metrics.adjacent_coherence(F.col("text"))).collect()
    started = time.time()
    assert df.select(metrics.adjacent_coherence(F.col("text")).alias("c")).first().c == pytest.approx(0.5)
    assert time.time() - started < 3


def test_hashed_vectors(spark):
    import hashlib

    from sangloc.operators import vectors

    rows = [(1, ["a", "b", "a"]), (2, []), (3, None), (4, [f"w{i}" for i in range(500)])]
    df = spark.createDataFrame(rows, "id int, w array<string>")
    got = {r.id: r.v for r in df.select("id", vectors.hashed_vector(F.col("w"), 16).alias("v")).collect()}
    for i, words in rows:
        want = None if words is None else [0.0] * 16
        for w in words or []:
            digest = hashlib.md5(w.encode()).hexdigest()
            want[int(digest[:7], 16) % 16] += 1 if int(digest[7], 16) % 2 == 0 else -1
        assert got[i] == want


def test_model_is_set_up_once_per_task(spark, tmp_path):
    from sangloc.operators import vectors

    folder = str(tmp_path)

    def load():
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        return lambda texts: [[len(t), 1.0] for t in texts]

    df = spark.range(2000).selectExpr("id", "CASE WHEN id % 7 = 0 THEN NULL ELSE repeat('x', CAST(id % 5 AS INT)) END AS text").repartition(3)
    got = df.select("id", vectors.embedded(F.col("text"), load).alias("v")).collect()
    assert all(r.v == (None if r.id % 7 == 0 else [float(r.id % 5), 1.0]) for r in got)
    assert len(list(tmp_path.iterdir())) <= 3


def test_threshold_curve(spark):
    from sangloc.operators import report

    scores = spark.createDataFrame([(1, 0), (2, 3), (3, 3), (4, 5), (5, None), (6, 1), (7, 9)], "id int, b int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (5, 0), (6, 1), (7, None)], "id int, quality int")
    got = [tuple(r) for r in report.threshold_curve(scores, labels, "id", "b", "quality").orderBy("b").collect()]
    assert got == [(0, 2, 3, 0.4, 1.0), (1, 2, 2, 0.5, 1.0), (3, 2, 1, pytest.approx(2 / 3, abs=1e-6), 1.0), (5, 1, 0, 1.0, 0.5)]


def test_top_k_with_bounds_equals_scoring_all_pairs(spark, monkeypatch):
    """Rare and frequent words, ties, repeated words, queries with fewer than k documents; also with short slices."""
    import random

    rng = random.Random(3)
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(3000)]
    docs = [(i, rng.choices(vocabulary, k=rng.randint(1, 60))) for i in range(400)] + [(1000 + i, ["only", "twin"]) for i in range(3)]
    asked = [(q, rng.choices(vocabulary, k=rng.randint(1, 15))) for q in range(25)] + [(100, ["only", "twin", "twin"]), (101, ["nobody"]), (102, [])]
    n, mean = len(docs), sum(len(w) for _, w in docs) / len(docs)
    held = collections.Counter(w for _, ws in docs for w in set(ws))
    want = {}
    for q, terms in asked:
        scores = []
        for d, ws in docs:
            tf = collections.Counter(ws)
            s = sum(math.log(1 + (n - held[t] + 0.5) / (held[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for t in terms if t in tf)
            if any(t in tf for t in terms):
                scores.append((round(s, 6), d))
        for rank, (s, d) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:5]):
            want[q, rank + 1] = d, s
    frames = spark.createDataFrame(docs, "d int, w array<string>"), spark.createDataFrame(asked, "q int, a array<string>")
    for rows in (similarity.SLICE_ROWS, 7):
        monkeypatch.setattr(similarity, "SLICE_ROWS", rows)
        got = similarity.bm25_top_k(frames[0], "d", "w", frames[1], "q", "a").collect()
        assert {(r.q, r["rank"]): (r.d, pytest.approx(r.bm25, abs=2e-6)) for r in got} == want


def test_model_that_lists_its_texts_scores_like_a_look_up(spark, monkeypatch):
    """Frequent and rare words, texts of one word or none, keys that repeat or are null; each use is shuffled once."""
    import random

    rng = random.Random(5)
    vocabulary = [f"w{int(rng.paretovariate(0.8))}" for _ in range(2000)]
    texts = [(i % 150 if i % 40 else None, f"s{i % 2}", rng.choices(vocabulary, k=rng.randint(0, 40))) for i in range(300)]
    df = sinks.staged(spark.createDataFrame(texts, "id int, section string, words array<string>"), "texts")
    words, key = F.col("words"), ["id", "section"]
    plain = sinks.staged(quality.bigram_model(df, words), "model")
    want = {(r.id, r.section): (r.n_bigrams, pytest.approx(r.perplexity)) for r in quality.corpus_perplexity(df, key, words, plain).collect()}
    want_model = {(r.w1, r.w2): (r.n_rows, pytest.approx(r.log_p)) for r in plain.collect()}
    for most in (1, 20, 1000):
        monkeypatch.setattr(quality, "FREQUENT_WORDS", most)
        lazy = quality.bigram_model(df, words, key=key)
        plan = lazy._jdf.queryExecution().executedPlan().toString()
        assert sum("Exchange hashpartitioning" in line and "id#" in line for line in plan.split("Initial Plan")[-1].splitlines()) == 0
        model = sinks.staged(lazy, "model")
        got = {(r.id, r.section): (r.n_bigrams, r.perplexity) for r in quality.corpus_perplexity(df, key, words, model).collect()}
        assert got == want
        assert {(r.w1, r.w2): (r.n_rows, r.log_p) for r in model.collect()} == want_model


def test_own_texts_are_not_looked_up_use_by_use(spark, monkeypatch):
    """A corpus that scores its own texts adds up the lists of its model."""
    df = spark.createDataFrame([(1, "a b a b"), (2, "a b c"), (3, "a")], "id int, text string")
    monkeypatch.setattr(quality, "_used", lambda *_: pytest.fail("uses are joined to the model"))
    corpus, scored = quality.fit_and_score(df, "id", tokens(F.col("text")))
    assert {r.id for r in scored.collect()} == {1, 2} and corpus.model.columns == ["w1", "w2", "n_rows", "log_p"]


def test_foreign_texts_are_dealt_to_the_model_once(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a", "z"])], "id int, words array<string>")
    model = sinks.staged(quality.bigram_model(df.where("id = 1"), F.col("words")), "model")
    scored = quality.corpus_perplexity(df, "id", F.col("words"), model)
    plan = scored._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "hashpartitioning(id" in plan
    assert not any("hashpartitioning(id" in line and "w1" in line for line in plan.splitlines())


def test_terms_of_candidates_are_not_shuffled(spark, monkeypatch):
    plans = {}

    def spy(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return sinks.staged(df, name)

    monkeypatch.setattr(similarity, "staged", spy)
    docs = spark.createDataFrame([(i, [f"w{i % 7}", f"w{i % 3}", "x"]) for i in range(60)], "d int, w array<string>")
    asked = spark.createDataFrame([(q, [f"w{q}", "x"]) for q in range(5)], "q int, a array<string>")
    similarity.bm25_top_k(docs, "d", "w", asked, "q", "a").collect()
    dealt = [line for line in plans["best"].splitlines() if "Exchange hashpartitioning(" in line]
    assert dealt and not any("term#" in line.split("hashpartitioning(")[1].split(")")[0] for line in dealt)
