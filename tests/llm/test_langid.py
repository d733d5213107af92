import numpy as np
import pyarrow as pa

from sangloc.llm import langid
from sangloc.llm.queries import op8_language_codes


def test_every_bit_splits_the_languages():
    for n in range(2, 12):
        code = langid.codewords(n)
        assert ((code > 0).any(0) & (code < 0).any(0)).all()
        assert len({tuple(r) for r in code}) == n


def test_grams_stay_in_their_row():
    flat, bounds = langid.text_bytes(pa.array(["ab", "", "c d", None, "é"]))
    found = [[(int(np.searchsorted(bounds, s, "right") - 1)) for s in start] for start, _ in langid.grams(flat, bounds)]
    assert found == [[0, 2, 2, 4], [2]]


def small(counts):
    return langid.output_code(["aa", "bb"], counts)


def test_evidence_does_not_depend_on_the_slice(monkeypatch):
    rng = np.random.default_rng(2)
    model = small(rng.integers(0, 50, (2, langid.BUCKETS)).astype(float))
    texts = ["one two", "", None, "quelque chose " * 50, "x"]
    together = model.evidence(pa.array(texts))
    monkeypatch.setattr(langid, "PART", 7)
    alone = np.concatenate([model.evidence(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, alone, atol=1e-4)


def test_edge_rows(spark):
    rows = [(1, "the cat", "en", 1.0)] * 2 + [(2, None, "en", 1.0), (3, "12 !?", None, 1.0), (None, "le chat", "fr", 1.0), (5, "日本", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in langid.identified(docs).collect()}
    assert got[2].lang_pred == got[3].lang_pred == "und" and got[2].score == 0 and got[2].ambiguous
    assert got[1].lang_pred == "en" and got[5].lang_pred == "en" and got[None].held_out
    assert langid.identified(docs).count() == 6
    none = langid.identified(docs.limit(0))
    assert none.count() == 0
    unknown = langid.identified(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang"))
    assert {r.lang_pred for r in unknown.collect()} == {"und"}


def test_held_out_rows(spark, folder):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = op8_language_codes(spark, folder).collect()
    assert len(got) == len(langs)
    assert all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in got if r.held_out]) > 0.93


def plain_grams(text):
    """Every run of two and of three bytes with a letter, byte by byte."""
    folded = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()]
    for size in (2, 3):
        for i in range(len(folded) - size + 1):
            part = folded[i : i + size]
            if any(b != 32 for b in part):
                h = size
                for b in part:
                    h = ((h * 0x01000193) & 0xFFFFFFFF) ^ b
                yield ((h * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - langid.BUCKET_BITS)


def plain_prediction(rows, texts):
    """(language, score) by loops over n-grams, bits and languages."""
    names = sorted({lang for _, lang in rows})
    uses = {n: {} for n in names}
    for text, lang in rows:
        for g in plain_grams(text):
            uses[lang][g] = uses[lang].get(g, 0) + 1
    total = {n: sum(uses[n].values()) for n in names}
    rate = lambda n, g: (uses[n].get(g, 0) + 0.5) / (total[n] + 0.5 * langid.BUCKETS)
    code = langid.codewords(len(names))
    sides = [([n for n, c in zip(names, bit) if c > 0], [n for n, c in zip(names, bit) if c < 0]) for bit in code.T]
    every = set().union(*uses.values())

    def weight(bit, g):
        a, b = sides[bit]
        return np.log(np.mean([rate(n, g) for n in a]) / np.mean([rate(n, g) for n in b]))

    trust = []
    for bit in range(len(sides)):
        blank = weight(bit, -1)
        means = []
        for n, side in zip(names, code[:, bit]):
            seen = sum(rate(n, g) * weight(bit, g) for g in every)
            means.append((seen + (langid.BUCKETS - len(every)) * rate(n, -1) * blank) * side)
        trust.append(max(0.05, min(means)))
    trust = np.array(trust) / np.mean(trust)
    out = []
    for text in texts:
        grams = list(plain_grams(text))
        mean = [np.mean([weight(b, g) for g in grams]) if grams else 0.0 for b in range(len(sides))]
        evidence = [m * min(len(grams) ** 0.5, langid.MOST_SCALE) for m in mean]
        losses = [sum(t * np.log1p(np.exp(-e * c)) for t, e, c in zip(trust, evidence, word)) for word in code]
        best = int(np.argmin(losses))
        out.append((names[best], 1 / sum(np.exp(losses[best] - x) for x in losses)))
    return out


def test_predictions_against_plain_loops(spark):
    rows = [("the cat sat on the mat and the dog", "en"), ("where is the thing", "en"), ("le chat est sur la table et le chien", "fr"),
            ("der Hund und die Katze sind müde", "de"), ("el gato y el perro están en la casa", "es")] * 2
    docs = [(i, t, lang) for i, (t, lang) in enumerate(r for r in rows for _ in range(4))]
    kept = [(t, lang) for i, t, lang in docs if __import__("zlib").crc32(str(i).encode()) % 4 != 2]
    asked = ["the dog", "La table", "Katze!", "en casa y", "chat and cat", "x", "the " * 300, "müde"]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.fit(frame)
    names, score, _ = model.decide(pa.array(asked))
    want = plain_prediction(kept, asked)
    assert names == [n for n, _ in want]
    assert np.allclose(score, [s for _, s in want], atol=1e-4)


def test_very_long_texts_and_ties():
    model = small(np.ones((2, langid.BUCKETS)))
    names, score, close = model.decide(pa.array(["word " * 400_000, "a"]))
    assert names == ["aa", "aa"] and np.allclose(score, 0.5) and close.all()
