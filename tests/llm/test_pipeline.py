import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from sangloc.llm import leakage, quality

from test_bpe import OTHER
from test_leakage import least_edits, plain
from test_line_spread import by_hand as lines_by_hand
from test_shingle_join import by_hand as copies_by_hand


@pytest.fixture(scope="module")
def stages(spark, folder):
    """The rows that every stage gets and gives."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, out[-1], folder)
        out.append(spark.createDataFrame(made.collect(), made.schema))
    return [{r.doc_id: r for r in x.collect()} for x in out]


def test_names_and_columns(spark, folder, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_copies", "decontamination", "byte_bpe"]
    columns = spark.read.parquet(f"{folder}/documents.parquet").columns
    for rows in stages[:-1]:
        assert next(iter(rows.values())).__fields__ == columns
    for before, after in zip(stages, stages[1:]):
        assert after.keys() <= before.keys()


def test_quality_stage(spark, folder, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    model = quality.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    ids = list(stages[0])
    scores = model.score(quality.statistics(pa.array([stages[0][i].text for i in ids])))
    assert stages[1].keys() == {i for i, s in zip(ids, scores) if s >= 0.7}
    good = [i for i, q in labels.items() if q == 1]
    assert np.mean([i in stages[1] for i in good]) > 0.9


def test_line_stage(stages):
    rows = [(r.doc_id, r.text, r.source) for r in stages[1].values()]
    want = {k: t for k, t, _, gone in lines_by_hand(rows, 10) if not (gone and not t.replace("\n", "").strip(" "))}
    assert {k: r.text for k, r in stages[2].items()} == want


def test_copies_stage(stages):
    want = copies_by_hand({k: r.text for k, r in stages[2].items()})
    assert stages[3].keys() == {k for k, (_, root) in want.items() if k == root}


def test_leakage_stage(spark, folder, stages):
    items = [plain(r.text).strip() for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for key, r in stages[3].items():
        text = plain(r.text)
        if any(i in text for i in items):
            assert key not in stages[4]
        elif key not in stages[4]:
            assert any(least_edits(i, text) <= leakage.budget(np.array([len(i)]))[0] for i in items)


def test_tokens_stage(stages):
    assert stages[5].keys() == stages[4].keys()
    for key, r in stages[5].items():
        text = stages[4][key].text or ""
        want = np.array(OTHER.encode_ordinary(text), "<u4").tobytes()
        assert bytes(r.ids) == want and r.n_tokens == len(want) // 4
        assert r.ids_sha256 == hashlib.sha256(want).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_run_and_registration(spark, folder, stages):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == {k: r.ids_sha256 for k, r in stages[5].items()}


def test_edge_rows_in_every_stage(spark, folder):
    """Nulls in any column, empty texts, repeated rows, no rows."""
    schema = spark.read.parquet(f"{folder}/documents.parquet").schema
    rng = random.Random(1)
    text = " ".join(rng.choices(["the", "thing", "andon", "there", "ofthe"], k=60))
    kinds = {"doc_id": 1, "text": text, "lang": "en", "source": "src1", "n_chars": len(text)}
    full = [tuple(kinds[f.name] for f in schema.fields)] * 2
    rows = full + [tuple(None if f.name == gone else kinds[f.name] for f in schema.fields) for gone in kinds]
    rows += [tuple(None for _ in schema.fields), tuple("" if f.name == "text" else kinds[f.name] for f in schema.fields)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            assert out.count() <= len(data)
            assert (out.count() == 0) == (not data) or stage is corpus_pipeline.quality_stage


