import zlib

import numpy as np
import pyarrow as pa

from sangloc.llm import quality
from sangloc.llm.queries import op10_quality_discriminant


def test_statistics_of_small_texts():
    x = dict(zip(quality.STATISTICS, quality.statistics(pa.array(["The cat cat sat!\nA1 | b"]))[0]))
    assert np.isclose(x["log_words"], np.log1p(7))
    assert np.isclose(x["repeat_share"] ** 2, 1 / 7)
    assert np.isclose(x["odd_end_share"] ** 2, 3 / 7)
    assert np.isclose(x["upper_share"] ** 2, 2 / 14)
    assert np.isclose(x["variety"], np.log1p(6) / np.log1p(7))


def test_statistics_do_not_depend_on_the_slice():
    texts = ["", None, "one two", " \n", "É é !!", "x" * 3000, "a b " * 500]
    together = quality.statistics(pa.array(texts))
    alone = np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, alone)


def test_density_against_the_plain_formula():
    rng = np.random.default_rng(1)
    width = len(quality.STATISTICS)
    parts = {0: rng.normal(0, 2, (400, width)), 1: rng.normal(1, 1, (900, width))}
    model = quality.discriminant({k: (len(z), z.sum(0), z.T @ z) for k, z in parts.items()})
    x = rng.normal(0.5, 1, (20, width))
    dens = []
    for k in (0, 1):
        cov = np.linalg.inv(model.factors[k])
        cov = cov @ cov.T
        d = x - parts[k].mean(0)
        dens.append(np.log(len(parts[k]) / 1300) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(dens[0] - dens[1])))


def test_edge_rows_and_missing_labels(spark):
    docs = spark.createDataFrame([(1, None, "q"), (2, "", None), (2, "", None), (None, "some text", "q")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 0)], "doc_id long, quality int")
    got = quality.judged(docs, labels).collect()
    assert len(got) == 4 and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {0}
    assert quality.judged(docs.limit(0), labels.limit(0)).count() == 0
    assert quality.kept(docs, quality.fit(docs, labels)).count() == 4


def test_held_out_rows(spark, folder):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = op10_quality_discriminant(spark, folder).collect()
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    judged = [r.predicted == labels[r.doc_id] for r in got if r.held_out and r.doc_id in labels]
    assert len(judged) > 10 and np.mean(judged) >= 0.9
