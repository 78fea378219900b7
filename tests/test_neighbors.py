"""Exact neighbour search against brute force, with copies, gaps and many small blocks."""

import numpy as np
import pandas as pd
import pytest

from plumbline.operators import neighbors as nb


def brute(x, k):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    return d


@pytest.fixture(params=[40, 2000])
def blocks(request, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK", request.param)
    monkeypatch.setattr(nb, "QUERIES_PER_TASK", 30)


def points(seed=0, n=240, copies=60):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    x[:copies] = x[0]  # one point copied many times
    return x


def frame(spark, x, names=("a", "b", "c")):
    return spark.createDataFrame(pd.DataFrame(x, columns=list(names)).assign(k=range(len(x))))


def test_knn_distance(spark, blocks):
    x = points()
    got = nb.knn_distance(frame(spark, x), "k", ["a", "b", "c"], 5).toPandas().sort_values("key")
    want = np.sort(brute(x, 5), axis=1)[:, 4]
    assert np.allclose(got["knn"], want)


def test_lof(spark, blocks):
    x, k = points(copies=1), 6
    d = brute(x, k)
    order = np.argsort(d, axis=1)[:, :k]
    kd = np.take_along_axis(d, order, 1)[:, -1]
    reach = np.maximum(np.take_along_axis(d, order, 1), kd[order])
    lrd = 1 / (reach.mean(1) + 1e-10)
    want = lrd[order].mean(1) / lrd
    got = nb.lof(frame(spark, x), "k", ["a", "b", "c"], k).toPandas().sort_values("key")
    assert np.allclose(got["lof"], want)


def test_lof_is_one_inside_copies(spark):
    x = points(copies=60)
    got = nb.lof(frame(spark, x), "k", ["a", "b", "c"], 6).toPandas().sort_values("key")
    assert len(got) == len(x) and np.allclose(got["lof"][:60], 1.0)


def test_dbscan_noise(spark, blocks):
    x, eps, m = points(5), 0.6, 5
    d = brute(x, 1)
    np.fill_diagonal(d, 0)
    core = (d <= eps).sum(1) >= m
    noise = ~((d <= eps) & core[None, :]).any(1)
    got = nb.dbscan_noise(frame(spark, x), "k", ["a", "b", "c"], eps, m).toPandas().sort_values("key")
    assert (got["noise"].to_numpy() == noise.astype(int)).all() and 0 < noise.sum() < len(x)


def test_knn_impute_with_gaps(spark, blocks):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 3))
    x[rng.random(x.shape) < 0.15] = np.nan
    want = x.copy()
    for i, j in zip(*np.nonzero(np.isnan(x))):
        ok = ~np.isnan(x) & ~np.isnan(x[i])
        with np.errstate(invalid="ignore", divide="ignore"):
            dist = np.sqrt(np.where(ok, (x - x[i]) ** 2, 0).sum(1) * 3 / ok.sum(1))
        dist[np.isnan(x[:, j]) | (ok.sum(1) == 0)] = np.inf
        near = np.argsort(dist, kind="stable")[:5]
        near = near[np.isfinite(dist[near])]
        want[i, j] = x[near, j].mean() if len(near) else np.nanmean(x[:, j])
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(k=range(200)).astype(object).where(lambda f: f.notna(), None), "a double, b double, c double, k long")
    got = nb.knn_impute(df, "k", ["a", "b", "c"]).toPandas().sort_values("k")[list("abc")].to_numpy(dtype=float)
    assert np.allclose(got, want)


def test_knn_distance_in_many_dimensions(spark, blocks, monkeypatch):
    """Distances by matrix products, queries that weigh few blocks at a time, far from the origin, with ties."""
    monkeypatch.setattr(nb, "CELLS", 7)
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(200, 12)), 1) + 1000.0
    x[50:90] = x[0] + np.eye(12)[rng.integers(0, 12, 40)]
    names = [f"e{j}" for j in range(12)]
    got = nb.knn_distance(frame(spark, x, names), "k", names, 5).toPandas().sort_values("key")
    assert np.allclose(got["knn"], np.sort(brute(x, 5), axis=1)[:, 4], rtol=0, atol=1e-9)


def test_few_queries_meet_the_blocks_at_a_time():
    """Matrix products keep every pair that may be among the nearest, ties included."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(120, 10)), 0)
    frame_ = pd.DataFrame(x, columns=[f"e{j}" for j in range(10)]).assign(pid=range(120), mult=1, bound=np.inf)
    got = nb._search(frame_, frame_, [f"e{j}" for j in range(10)], 4)
    d = brute(x, 4)
    for i in range(120):
        want = sorted((d[i, j], j) for j in range(120) if j != i)[:4]
        assert [(a, b) for a, b in got[got["pid"] == i][["dist", "nid"]].itertuples(index=False)] == want
