import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from sangloc.llm import divergence
from sangloc.llm.common import text_bytes

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string"


def lower(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


def by_hand(rows, min_docs=10, top=10):
    docs = [[t or "" for t in r[1:]] for r in rows]
    uses, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        found = TERM.findall(lower(text))
        uses[lang, source].update(found)
        held[lang].update(set(found))
    out = set()
    for lang in {d[1] for d in docs}:
        kept = sorted(t for t, n in held[lang].items() if n >= min_docs)
        sources = sorted({d[2] for d in docs if d[1] == lang})
        counts = {s: [uses[lang, s][t] for t in kept] for s in sources}
        share = lambda c: [1 + 10**9 * (x + 2) // (sum(c) + 2 * len(kept)) for x in c]
        p = {s: share(counts[s]) for s in sources}
        q = share([sum(x) for x in zip(*counts.values())])
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(map(f, p[s], p[o])), o) for o in sources if o != s]
            terms = [(f(a, b), t) for t, c, a, b in zip(kept, counts[s], p[s], q) if c and a > b]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found)}
    return out


def got(docs, **kw):
    return [tuple(r) for r in divergence.audited(docs, **kw).collect()]


def text_of(rng, words, n):
    return "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "7", "_"]) for _ in range(n))


WORDS = ["a", "Is", "thEre", "eightlet", "ninechars", "sixteencharacter", "seventeencharacte", "x" * 40, "x" * 41, "é" * 9, "ÉTÉ", "日本語", "K"]


def test_counts_of_a_slice():
    rng = random.Random(3)
    texts = [text_of(rng, WORDS, rng.randint(0, 40)) for _ in range(60)] + ["", None, "x" * 5000, "z"]
    group = np.array([i % 3 for i in range(len(texts))])
    found = divergence.term_counts(*text_bytes(pa.array(texts)), group)
    want_uses, want_docs = Counter(), Counter()
    for text, g in zip(texts, group):
        terms = TERM.findall(lower(text or ""))
        want_uses.update((g, t) for t in terms)
        want_docs.update((g, t) for t in set(terms))
    keys = list(zip(found[0].tolist(), found[1].to_pylist()))
    assert len(keys) == len(set(keys))
    assert dict(zip(keys, found[2].tolist())) == want_uses and dict(zip(keys, found[3].tolist())) == want_docs


def test_radix_order_is_stable_and_sorts_by_both_words():
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 4, 500).astype(np.uint64) << np.uint64(60), rng.integers(0, 3, 500).astype(np.uint64)]
    assert (divergence.radix_order(words, np.arange(500)) == np.lexsort((np.arange(500), words[1], words[0]))).all()


def test_against_plain_counting(spark, monkeypatch):
    """Also with several blocks of sources and chunks of terms, where no source of two blocks uses a term."""
    rng = random.Random(5)
    rows = [(i, text_of(rng, WORDS[i % 4 :], 12), rng.choice(["en", "fr"]), f"s{i % 9}") for i in range(400)]
    rows += [(1000 + i, "onlyhere", "en", "s1") for i in range(12)] + [(2000, "rare words", "en", "silent"), (2001, "", "de", "one"), (2002, "x", "de", "two")]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = by_hand(rows)
    assert set(got(docs)) == want
    monkeypatch.setattr(divergence, "SOURCES_AT_ONCE", 2)
    monkeypatch.setattr(divergence, "TERMS_AT_ONCE", 3)
    again = got(docs)
    assert set(again) == want and len(again) == len(want)


def test_nulls_copies_long_texts_and_clashing_columns(spark):
    rows = [(None, None, None, None), (1, "same", "en", "a"), (1, "same", "en", "a"), (2, "w " * 200_000, None, "b"), (3, "same other", "en", None)]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA + ", term string, uses long, place long")
    assert set(got(docs, min_docs=1)) == by_hand(rows, 1)


def test_no_rows(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_whole_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert set(got(docs)) == by_hand([(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()])
