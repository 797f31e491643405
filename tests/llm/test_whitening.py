"""Exact sums against Python's integers, components against numpy's on the plain covariance."""

import math
import os
import random

import numpy as np
import pytest

from paceline.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, components=32):
    """(fit list as integers, {(vec_id, component): whitened up to its sign}, explained, deviations)."""
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v, _ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(kept), len(kept[0][1])
    sums = [sum(x[k] for _, x in kept) for k in range(d)]
    cov = [[(n * sum(x[a] * x[b] for _, x in kept) - sums[a] * sums[b]) / n**2 for b in range(d)] for a in range(d)]
    values, vectors = np.linalg.eigh(np.array(cov))
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for _, x in kept])
    deviations = {i: sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for i, x in kept}
    return n, values, centred @ vectors / np.sqrt(values), values / np.trace(np.array(cov)), deviations, [i for i, _ in kept]


def compare(rows, got, components=32):
    n, values, white, explained, deviations, ids = plain(rows, components)
    k = len(values)
    assert len(got) == len(ids) * k
    by = {(r.vec_id, r.component): r for r in got}
    for c in range(1, k + 1):
        mine = np.array([by[i, c].whitened for i in ids])
        theirs = white[:, c - 1]
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-6 * max(1, np.abs(theirs).max())
    for (i, c), r in by.items():
        assert r.n == n and int(r.deviation) == deviations[i] and abs(r.explained / explained[c - 1] - 1) < 1e-9 and 0 <= r.identity_error < 1e-9
    assert len({r.identity_error for r in got}) == 1


def gaussian(n, d, seed=1):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + rng.normal(size=d) * 3
    return [(i, [float(np.float32(c)) for c in v], i % 3) for i, v in enumerate(mixed)]


def test_digits_make_the_number_again():
    rng = np.random.default_rng(2)
    for most in (1, 5, 2**19, 2**20, 2**31, 2**62):
        x = rng.integers(-most, most + 1, (50, 3))
        parts = W.limbs(x)
        assert all(abs(p).max() <= 2**W.LIMB for p in parts)
        assert (sum(p.astype(np.int64).astype(object) << (W.LIMB * i) for i, p in enumerate(parts)) == x.astype(object)).all()
    assert 2 * W.LIMB + math.log2(W.ROWS) < 53


def test_products_are_exact(monkeypatch):
    rng = np.random.default_rng(3)
    for most in (2**20 - 1, 2**41, 2**62):
        x = rng.integers(-most, most, (301, 4))
        want = x.astype(object).T @ x.astype(object)
        assert (W.gram(x) == want).all()
        monkeypatch.setattr(W, "ROWS", 64)
        assert (W.gram(x) == want).all()
        assert all(W.joined(W.split(int(v))) == v for v in [*want.ravel(), -1, 0, 2**150, -(2**150)])


def test_full_product_stays_below_53_bits():
    x = np.full((W.ROWS, 2), 2**W.LIMB - 1)
    assert (W.gram(x) == W.ROWS * (2**W.LIMB - 1) ** 2).all()


def test_against_plain(spark):
    rows = gaussian(500, 9)
    rows += [(900, None, 1), (901, [1.0, None] + [0.0] * 7, 1), (902, [float("nan")] * 9, 1), (903, [float("inf")] + [0.0] * 8, 1), (None, rows[0][1], 1), (7, rows[1][1], 2)]
    rows = [r for r in rows if r[0] != 7 or r[2] != 2]
    compare(rows, W.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect())
    compare(rows, W.whiten(spark.createDataFrame(rows, SCHEMA), components=4).collect(), 4)


def test_a_hot_vector_and_large_entries(spark):
    hot = [(1000 + i, [2.5, -1.0, 4.0], 0) for i in range(300)]
    compare(gaussian(100, 3) + hot, W.whiten(spark.createDataFrame(gaussian(100, 3) + hot, SCHEMA)).collect())
    far = [(i, [1e12 * random.Random(i).random(), 3e11 * i], 0) for i in range(40)]
    compare(far, W.whiten(spark.createDataFrame(far, "vec_id long, embedding array<double>, label int")).collect())


def test_many_tasks_merge(spark, monkeypatch):
    monkeypatch.setattr(W, "MERGERS", 3)
    rows = gaussian(400, 5, 8)
    compare(rows, W.whiten(spark.createDataFrame(rows, SCHEMA).repartition(40)).collect())


def test_no_variance(spark):
    one = W.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0)], SCHEMA)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one, key=lambda r: r.component)] == [(1, 1, "0", 0.0, 0.0, 0.0), (2, 1, "0", 0.0, 0.0, 0.0)]
    line = [(i, [float(i), 2.0 * i, 5.0], 0) for i in range(50)]
    got = W.whiten(spark.createDataFrame(line, SCHEMA)).collect()
    assert {r.component: round(r.explained, 9) for r in got} == {1: 1.0, 2: 0.0, 3: 0.0} and all(r.whitened == 0 for r in got if r.component > 1)
    assert abs(sum(r.whitened**2 for r in got) / 50 - 1) < 1e-9 and got[0].identity_error < 1e-9


def test_odd_tables(spark):
    make = lambda rows: W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert make([]) == [] and make([(1, None, 0)]) == [] and make([(1, [], 0), (2, [None], 0)]) == []
    lengths = [(1, [1.0, 2.0], 0), (2, [3.0, 1.0], 0), (3, [1.0], 0), (4, [1.0, 2.0, 3.0], 0), (5, [], 0)]
    assert {r.vec_id for r in make(lengths)} == {1, 2}
    assert {r.vec_id for r in make([(1, [1.0], 0), (2, [1.0, 2.0], 0)])} == {2}  # as frequent: the longest
    huge = make([(1, [3e38, 0.0], 0), (2, [-3e38, 1.0], 0)])
    assert {r.deviation for r in huge} == {str((2 * 2**62 + 0) ** 2 + 64**2)}


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i % 7)], "x", 1, 2) for i in range(20)], "vec_id long, embedding array<float>, vector string, i int, size int")
    assert len(W.whiten(df).collect()) == 40
    assert {r.vec_id for r in W.whiten(df.withColumnsRenamed({"vec_id": "name", "embedding": "n"}), "name", "n").collect()} == set(range(20))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_query_against_plain(spark):
    from paceline.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    compare(rows, QUERIES["op11_whitening"](spark, "/root/testdata/sf0.01").collect())
