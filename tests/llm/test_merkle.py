import hashlib
import random
import zlib

from sangloc.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, text):
    values = [r[0], r[3], r[2], r[4], text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def path(levels, i, proof, folded):
    for level in levels[:-1]:
        run, at = level[i // 8 * 8 : i // 8 * 8 + 8], i % 8
        proof = proof + run[:at] + run[at + 1 :]
        folded = h(*run[:at], folded, *run[at + 1 :])
        i //= 8
    return proof, folded


def by_hand(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        mine = [(r[0] is not None, r[0] or 0, leaf_of(r, r[1]), r) for r in rows if r[2] == lang]
        mine.sort(key=lambda x: x[:3])
        trees[lang] = mine, levels_of([x[2] for x in mine])
    top = levels_of([trees[lang][1][-1][0] for lang in langs])
    root = top[-1][0] if rows else None
    out = []
    for at, lang in enumerate(langs):
        mine, levels = trees[lang]
        for i, (_, _, leaf, r) in enumerate(mine):
            third = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            text = r[1].translate({c: c + 32 for c in range(65, 91)}) if third and r[1] is not None else r[1]
            proof, folded = path(levels, i, [], leaf_of(r, text))
            proof, folded = path(top, at, proof, folded)
            out.append((r[0], leaf, levels[-1][0], root, h(*proof), folded, folded == root))
    return sorted(out, key=str)


def got(docs, **kw):
    return sorted((tuple(r) for r in merkle.manifest(docs, tampered=merkle.every_third(), **kw).collect()), key=str)


def make(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_trees_of_several_rounds(spark):
    """One language has more than a segment of leaves, and last runs of one node."""
    rng = random.Random(2)
    rows = [(i, f"Text {i}" if i % 3 else f"text {i}", "en", "s", i) for i in rng.sample(range(10**9), 4097)]
    rows += [(10**10 + i, "É", "fr", None, None) for i in range(65)] + [(5, "A", None, "s", 1), (6, None, "", "s", 1)]
    rng.shuffle(rows)
    out = got(make(spark, rows))
    assert out == by_hand(rows)
    assert 0 < sum(not r[-1] for r in out) < len(rows)


def test_small_segments(spark):
    """Many rounds, also in the tree over the languages."""
    rows = [(i, "Ab", f"l{i % 70}", "s", 2) for i in range(300)]
    assert got(make(spark, rows), levels=1) == by_hand(rows)


def test_nulls_and_repeated_rows(spark):
    rows = [(None, None, None, None, None), (None, "x", "en", "s", 1), (1, "B" * 300_000, "en", "s", 1), (2, "same", "en", "s", 4), (2, "same", "en", "s", 4), (2, "Other", "en", "s", 4)]
    assert got(make(spark, rows)) == by_hand(rows)


def test_one_row_and_none(spark):
    assert got(make(spark, [])) == []
    rows = [(3, "Only", "en", "s", 4)]
    assert got(make(spark, rows)) == by_hand(rows)
    (row,) = got(make(spark, rows))
    assert row[1] == row[2] == row[3] and row[4] == h()


def test_clashing_columns(spark):
    rows = [(i, "T", "en", "s", 1) for i in range(20)]
    docs = spark.createDataFrame([(*r, 7, "z", 1) for r in rows], SCHEMA + ", i long, leaf string, tree long")
    assert got(docs) == by_hand(rows)
