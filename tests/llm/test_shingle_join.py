import random
import re

import numpy as np
import pytest

from sangloc.llm import components as cc
from sangloc.llm import shingle_join as sj
from sangloc.llm.queries import op1_shingle_join


def sets_by_hand(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def roots_of(keys, links):
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def by_hand(texts):
    sets = {k: sets_by_hand(t) for k, t in texts.items()}
    keys = sorted(sets)
    links = []
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 75 * (len(x) + len(y) - both):
                    links.append((a, b))
    root = roots_of(keys, links)
    return {k: (len(sets[k]), root[k]) for k in keys}


def check(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in sj.linked(docs).collect()}
    assert got == by_hand(texts)


def edited(rng, words, rate):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < rate / 3 else [rng.choice("xyz") + str(rng.randrange(50))] if x < 2 * rate / 3 else [w, "extra"] if x < rate else [w]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(spark, monkeypatch, seed):
    """Chains, large groups and shared passages, with frequent shingles in twos and threes."""
    monkeypatch.setattr(sj, "FREQUENT", 3)
    monkeypatch.setattr(sj, "VERY_FREQUENT", 9)
    monkeypatch.setattr(sj, "FIRST_SIGNATURES", 1)
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [rng.choices(vocabulary, k=rng.randrange(8, 60)) for _ in range(4)]
    texts = {}
    for group in range(14):
        base = rng.choices(vocabulary, k=rng.choice([1, 3, 5, 6, 8, 12, 30, 80, 200]))
        base = base + (rng.choice(passages) if rng.random() < 0.7 else [])
        for _ in range(rng.choice([1, 2, 5, 25])):
            base = edited(rng, base, rng.choice([0, 0.01, 0.03, 0.05])) if rng.random() < 0.6 else base
            texts[len(texts) * 7 % 1009] = " ".join(edited(rng, base, rng.choice([0, 0.02, 0.04])))
    check(spark, texts)


def test_signatures_meet_for_every_pair_above_the_threshold():
    """The prefix bound itself, on sets just above and below the threshold, for any frequencies."""
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(1, 150))
        universe = np.unique(rng.integers(1, 1 << 60, 3 * n).astype(np.uint64))
        df = rng.choice([2, 5, 9, 50, 129, 1000], len(universe), p=rng.dirichlet(np.ones(6)))
        frequency = dict(zip(universe.tolist(), df.tolist()))
        x = rng.permutation(universe)[:n]
        keep = int(np.ceil(n * rng.uniform(0.8, 1)))
        y = np.unique(np.concatenate([x[:keep], rng.permutation(universe)[: int(rng.integers(0, max(1, n // 6)))]]))
        x = np.sort(x)
        shared = len(np.intersect1d(x, y))
        if 4 * shared < 3 * (len(x) + len(y) - shared) or np.array_equal(x, y):
            continue
        h = np.concatenate([x, y])
        who, sig = sj.signatures_of(np.repeat([0, 1], [len(x), len(y)]), h, np.array([frequency[v] for v in h.tolist()]), np.array([len(x), len(y)]))
        assert np.intersect1d(sig[who == 0], sig[who == 1]).size


def test_bands_of_partners_are_adjacent():
    starts = sj.band_starts()
    n = np.arange(1, 5000)
    band = np.searchsorted(starts, n, "right") - 1
    widest = np.searchsorted(starts, 4 * n // 3, "right") - 1
    assert (widest - band <= 1).all()


def test_edge_rows(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "A B  c\td e f", None), (3, None, "x"), (4, "", "x"), (5, " \n", "x")]
    rows += [(6, "one two", "x"), (7, "ONE two", "x"), (8, "one", "x"), (None, "a b c d e f", "x"), (9, "z" * 30000 + " y" * 30000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in sj.linked(docs).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (1, 6), 7: (1, 6), 8: (1, 8), 9: (2, 9)}
    assert sj.linked(docs.limit(0)).count() == 0
    kept = sj.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 1, 3, 4, 5, 6, 8, 9, None]))


def test_chain_and_star_of_links(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 300)] + [(5, 5), (None, 3), (7, 200)]
    got = {r.vertex: r.component for r in cc.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{i: 7 for i in range(200, 300)}}


def test_query_against_all_pairs(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op1_shingle_join(spark, folder).collect()} == by_hand(texts)


def test_near_copies_with_columns_of_any_name(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(40)) + f" end{i}", 1, "x", 3) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long, _gone string, component_id long")
    out = sj.without_near_copies(docs)
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [0]
