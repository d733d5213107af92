import random

import numpy as np
import pyarrow as pa
import pytest

from sangloc.llm import leakage
from sangloc.llm.queries import op6_qgram_leakage


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    out = []
    for c in low:
        c = " " if c in " \t\n\v\f\r" else c
        if not (c == " " and out and out[-1] == " "):
            out.append(c)
    return "".join(out).encode()


def least_edits(item, text):
    """The whole item against any part of the text, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def spoiled(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        at = rng.randrange(len(text))
        kind = rng.randrange(3)
        if kind == 0:
            text[at] = rng.choice("abcxyz ")
        elif kind == 1:
            del text[at]
        else:
            text.insert(at, rng.choice("abcxyz"))
    return "".join(text)


@pytest.mark.parametrize("seed", range(4))
def test_against_all_cells(seed):
    rng = random.Random(seed)
    words = ["tion", "ing", "the", "and", "réa", "ÉT", "on", "wh"]
    make = lambda n: " ".join("".join(rng.choices(words, k=rng.randrange(1, 4))) for _ in range(n))
    texts = [make(rng.choice([1, 2, 4, 9, 20, 40])) for _ in range(12)]
    items = leakage.items_of(list(range(12)), texts)
    docs = ["", None, make(60)]
    for t in texts:
        m = len(plain(t).strip())
        for edits in (0, int(m * 0.1), int(m * 0.1) + 1, int(m * 0.14) + 2):
            body = spoiled(rng, t, edits).upper() if rng.random() < 0.3 else spoiled(rng, t, edits)
            docs.append(make(rng.randrange(6)) + " \n " + body.replace(" ", "  ") + make(rng.randrange(6)))
    found = leakage.found_in(pa.array(docs), items)
    got = {(r, i) for r, i, *_ in found}
    want = set()
    for r, d in enumerate(docs):
        for i, t in enumerate(texts):
            item = plain(t).strip(b" ")
            if item and least_edits(item, plain(d or "")) <= leakage.budget(np.array([len(item)]))[0]:
                want.add((r, i))
    assert got == want
    for r, i, start, end, edits in found:
        part = docs[r].encode()[start:end]
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in part)
        low = b" ".join(x for x in low.replace(b"\n", b" ").split(b" ") if x)
        assert least_edits(plain(texts[i]).strip(b" "), b" " + low + b" ") <= edits


def test_items_in_blocks_edge_rows_and_stage(spark, monkeypatch):
    long = "one question about the answer to everything else"
    items = [(1, long), (1, long), (2, None), (3, ""), (4, "short"), (5, "another item, quite different from the first one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, f"xx {long.upper()} yy {long}", "a"), (1, "clean", "a"), (2, None, None), (3, "", "a"), (None, items[5][1], "a"), (5, "word " * 20000 + long, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    for size in (1 << 20, 50):
        monkeypatch.setattr(leakage, "BLOCK_BYTES", size)
        got = sorted((str(r.doc_id), r.item_id, r.start, r.end, r.edits) for r in leakage.leaks(docs, bench).collect())
        n = len(long)
        assert got == [("1", 1, 3, 3 + n, 0), ("1", 1, 7 + n, 7 + 2 * n, 0), ("5", 1, 100000, 100000 + n, 0), ("None", 5, 0, len(items[5][1]), 0)]
        kept = leakage.without_leaks(docs, bench)
        assert kept.columns == docs.columns and sorted(str(r.text) for r in kept.collect()) == ["", "None", "clean"]
    assert leakage.leaks(docs.limit(0), bench).count() == 0
    assert leakage.leaks(docs, bench.limit(0)).count() == 0
    assert leakage.without_leaks(docs, bench.limit(0)).count() == len(rows)


def test_query_finds_every_item_that_is_there_as_it_is(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    items = {r.item_id: plain(r.text).strip() for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in op6_qgram_leakage(spark, folder).collect()}
    want = {(d, i) for d, t in docs.items() for i, b in items.items() if b in t}
    assert want and want <= got
    for d, i in got - want:
        assert least_edits(items[i], docs[d]) <= len(items[i]) * leakage.EDIT_SHARE


def test_short_items_and_ids_of_any_type(spark):
    """Items under a q-gram are found verbatim, and only so; ids keep their type."""
    docs = spark.createDataFrame([(1, "A  fox Run."), (2, "foxrun"), (3, "the fox run, fox run"), (4, None), (5, "bee"), (6, "be")], "doc_id int, text string")
    for kind in ("int", "string", "long"):
        items = spark.createDataFrame([(7, "fox run"), (8, " be "), (9, ""), (10, " "), (11, "longer than that")], "item_id int, text string")
        items = items.withColumn("item_id", items.item_id.cast(kind))
        found = leakage.leaks(docs, items)
        assert found.schema["item_id"].dataType == items.schema["item_id"].dataType
        got = {(r.doc_id, int(r.item_id), r.start, r.end, r.edits) for r in found.collect()}
        assert got == {(1, 7, 3, 10, 0), (3, 7, 4, 11, 0), (3, 7, 13, 20, 0), (5, 8, 0, 2, 0), (6, 8, 0, 2, 0)}
        assert sorted(r.doc_id for r in leakage.without_leaks(docs, items).collect()) == [2, 4]
