"""Strassen products against plain ones, and mined negatives against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import hard_negatives as hn


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 2), (64, 64, 64), (130, 77, 65), (17, 300, 33)])
def test_products(shape):
    m, n, k = shape
    rng = np.random.default_rng(m)
    a, b = rng.integers(-(2**28), 2**28, (m, k)), rng.integers(-(2**28), 2**28, (n, k))
    for leaf in (1, 2, 16):
        assert (hn.products(a, b, leaf) == a @ b.T).all()


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(1)
    rows = [(0, int(s), int(i), r) for r, (s, i) in enumerate(zip(rng.integers(0, 5, 40), rng.integers(0, 8, 40)))]
    want = sorted(rows, key=lambda x: (-x[1], x[2], x[3]))[:4]
    for seed in range(5):
        random.Random(seed).shuffle(rows)
        heaps = hn.Heaps(1, 4)
        for lo in range(0, 40, 7):
            some = rows[lo : lo + 7]
            heaps.merge(np.array([0]), *[np.array([[x[k] for x in some]]) for k in (1, 2, 3)])
        assert [(0, *x) for x in zip(heaps.scores[0].tolist(), heaps.ids[0].tolist(), heaps.rows[0].tolist())] == want


def brute(rows, n_positives=5, n_negatives=10):
    ok = [(k, i, l, [int(np.floor(256 * np.float64(x))) for x in v]) for k, (i, l, v) in enumerate(rows) if i is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for ka, ia, la, va in ok:
        if ia % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(va, v)), i, l) for k, i, l, v in ok if k != ka), key=lambda x: x[:2])
        for s, i, _ in [x for x in scored if x[2] == la][:n_positives]:
            fits = [x for x in scored if x[2] != la and 30 * -s <= 100 * -x[0] <= 90 * -s]
            out += [(ia, i, r + 1, j, -s, -t) for r, (t, j, _) in enumerate(fits[:n_negatives])]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").withColumn("HN_ID", F.lit("x"))
    return sorted(tuple(r) for r in hn.mine(df, F.col("vec_id") % 100 == 0, **kw).collect())


def vectors(n, seed, dim=6, labels=3):
    rng = np.random.default_rng(seed)
    return [(k, int(rng.integers(labels)), [float(x) for x in np.float32(np.round(rng.normal(0, 0.3, dim), 1))]) for k in range(n)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(hn, "SHARE", 2)
    monkeypatch.setattr(hn, "PANEL", 3)
    monkeypatch.setattr(hn, "HELD", 1)
    if not broadcast:
        monkeypatch.setattr(hn, "sized_broadcast", lambda df: df)
    rows = vectors(901, 5)
    rows[7] = (7, None, rows[7][2])
    rows[8] = (8, 1, None)
    rows[9] = (9, 1, [None, *rows[9][2][1:]])
    rows[10] = (10, 1, [float("nan"), *rows[10][2][1:]])
    rows[11] = (11, 1, [float("-inf"), *rows[11][2][1:]])
    rows[12] = (None, 1, rows[12][2])
    rows[13] = (13, 1, rows[13][2][:2])
    rows[14] = (14, 2, [])
    rows[300] = (300, None, rows[300][2])
    assert mined(spark, rows) == brute(rows)


def test_ties_and_repeated_rows(spark):
    rows = [(100 * (k % 2), k % 3 % 2, [0.5, 0.25]) for k in range(40)] + [(k, 1, [0.4, 0.2]) for k in range(50, 60)] + [(k, 0, [0.3, 0.1]) for k in range(50, 60)]
    got = mined(spark, rows)
    assert got == brute(rows) and got


def test_empty_and_without_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [0.1]), (2, 2, [0.2])]) == []
    assert mined(spark, [(100, 1, [0.1])]) == []


def test_out_of_range_is_refused(spark):
    with pytest.raises(ValueError, match="exact"):
        mined(spark, [(100, 1, [1e30])])
