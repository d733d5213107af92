import numpy as np
import pytest

from sangloc.llm import vector_passes as vp
from sangloc.llm.queries import op7_sorted_passes


def by_hand(rows, threshold=vp.THRESHOLD):
    """vec_id to (links, component), by all pairs."""
    out = {k: (0, k) for k, _, _ in rows}
    groups = {}
    for k, v, label in rows:
        ok = v is not None and label is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)
        if ok:
            groups.setdefault((label, len(v)), []).append((k, v))
    for members in groups.values():
        keys = np.array([k for k, _ in members])
        x = np.array([v for _, v in members], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        links = x @ x.T >= threshold
        np.fill_diagonal(links, False)
        root = keys.copy()
        while True:
            new = np.array([min(r, root[l].min() if l.any() else r) for r, l in zip(root, links)])
            if (new == root).all():
                break
            root = new
        out.update({int(k): (int(n), int(r)) for k, n, r in zip(keys, links.sum(1), root)})
    return out


def result(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return {r.vec_id: (r.n_links, r.component_id) for r in vp.linked(frame).collect()}


def near(rng, centre, angle, n):
    noise = rng.standard_normal((n, len(centre)))
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    return (centre / np.linalg.norm(centre) + np.tan(angle) * noise).astype(np.float32)


@pytest.mark.parametrize("block", [32, 512])
def test_groups_larger_than_a_window(spark, monkeypatch, block):
    """Groups of close vectors (dense runs with a core) and looser ones, against all pairs."""
    monkeypatch.setattr(vp, "BLOCK", block)
    rng = np.random.default_rng(4)
    parts = [near(rng, rng.standard_normal(24), angle, n) for angle, n in [(0.08, 300), (0.12, 12), (0.2, 20), (0.25, 3)] * 2]
    parts += [rng.standard_normal((300, 24)).astype(np.float32)]
    x = np.concatenate(parts)
    x = np.concatenate([x, x[:40], x[:1].repeat(90, 0)])
    rows = [(int(i), [float(c) for c in v], int(i) % 2 if i < 0 else 1) for i, v in zip(rng.permutation(len(x)), x)]
    got, want = result(spark, rows), by_hand(rows)
    assert got == want


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1)]
    rows += [(7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [1.0, None], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.0], 2), (None, [1.0, 0.0], 1)]
    got = result(spark, rows)
    want = {k: (0, k) for k in range(1, 13)} | {1: (1, 1), 2: (1, 1), 3: (1, 3), 12: (1, 3)}
    assert got == want
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vp.linked(empty).count() == 0


def test_groups_in_one_pass():
    root = np.arange(8)
    vp._unite(root, np.array([7, 5, 1]), np.array([5, 3, 7]))
    assert root.tolist() == [0, 1, 2, 1, 4, 1, 6, 1]


def test_query_against_all_pairs(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = op7_sorted_passes(spark, folder).collect()
    want = by_hand(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def pairs_at(rng, cosine, n, dimension=64):
    """n random vectors, and for each another at that cosine."""
    x = rng.standard_normal((n, dimension))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.standard_normal((n, dimension))
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    return np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * noise])


def listed(x, labels):
    return [(i, v, int(name)) for i, (v, name) in enumerate(zip(x.astype(np.float32).tolist(), labels))]


@pytest.mark.parametrize("parts", [3, 7])
def test_partitions_that_do_not_line_up_with_the_order(spark, parts):
    """Thousands of vectors; the last label ends the order."""
    rng = np.random.default_rng(5)
    x = pairs_at(rng, 0.94, 2500)
    rows = listed(x, np.tile([0] * 1500 + [1] * 800 + [2] * 200, 2))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert result(spark, rows) == by_hand(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_wide_group_is_counted_whole(spark):
    """Nearly all members link, and none is within half the threshold's angle of the mean."""
    rng = np.random.default_rng(6)
    x = near(rng, rng.standard_normal(64), np.arccos(0.974), 6000)
    rows = listed(np.concatenate([x, rng.standard_normal((500, 64))]), np.ones(6500))
    got, want = result(spark, rows), by_hand(rows)
    assert np.median([n for n, _ in want.values()]) > 5000
    assert got == want


def test_links_between_blocks_and_of_earlier_passes():
    """Copies count with their number; a pair that shared a prefix in an earlier pass is not counted again."""
    rng = np.random.default_rng(7)
    for angle in (0.02, 0.1, 0.3):
        x = vp.unit([v.tobytes() for v in near(rng, rng.standard_normal(16), angle, 30).astype(float)])
        one, two = x[:15], x[15:]
        copies = np.arange(1, 16), np.arange(2, 17)
        for number, bits in [(0, 0), (0, 3), (2, 3)]:
            blocks = [vp.Block(np.arange(15) + k, c, [(number, bits)], [p]) for p, c, k in zip((one, two), copies, (0, 100))]
            got = {}
            for keys, links, _ in vp.between(*blocks, vp.THRESHOLD):
                got |= dict(zip(keys.tolist(), links.tolist()))
            new = one @ two.T >= vp.THRESHOLD
            for earlier in range(number):
                p, q = (vp.numbers(v, earlier) >> (vp.BITS - bits) for v in (one, two))
                new &= p[:, None] != q
            want = [*(new @ copies[1]), *(copies[0] @ new)]
            assert [got.get(k, 0) for b in blocks for k in b.keys.tolist()] == want


def test_number_of_passes(spark):
    """One pass up to a run, then more with the logarithm; the odds of missing a link stay below MISSED."""
    sizes = [1, 8192, 8193, 20_000, 10**6, 10**9]
    frame = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", vp.prefix_bits(vp.F.col("n")).alias("bits"))
    rows = frame.withColumn("passes", vp.pass_count(vp.F.col("bits"), 0.93)).orderBy("n").collect()
    assert [r.bits for r in rows] == [0, 0, 1, 2, 7, 17]
    assert [r.passes for r in rows][:2] == [1, 1] and rows[-1].passes < 150
    for r in rows[2:]:
        assert (1 - (1 - np.arccos(0.93) / np.pi) ** r.bits) ** r.passes <= vp.MISSED
        assert r.n / 2**r.bits <= vp.RUN_BLOCKS * vp.BLOCK


def test_recall_does_not_fall_with_the_label(spark, monkeypatch):
    """Blocks are small beside the one label, and some vectors share a mean: every id against all rows."""
    monkeypatch.setattr(vp, "BLOCK", 32)
    n, rng = 8000, np.random.default_rng(8)
    x = pairs_at(rng, 0.935, n // 2)
    x[::2] += 0.5 * rng.standard_normal(64) / 8
    rows = listed(x, np.zeros(n))
    got, want = result(spark, rows), by_hand(rows)
    found, known = (sum(links for links, _ in r.values()) for r in (got, want))
    assert (found, sum(got[k] != want[k] for k in want)) == (known, 0)
