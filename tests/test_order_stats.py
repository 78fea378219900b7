"""Both plans of every order statistic against brute force, including one group with most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions.draws import draw
from plumbline.operators import order_stats as o


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 3000
    return pd.DataFrame(
        {
            "k": np.arange(n),
            "g": np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abc"), n)),
            "v": np.round(rng.normal(size=n), 2),
            "w": rng.integers(0, 5, n),
        }
    )


@pytest.fixture(params=["small", "large"])
def mode(request, spark):
    if request.param == "large":
        spark.conf.set("spark.plumbline.smallBytes", "0")
    yield request.param
    spark.conf.unset("spark.plumbline.smallBytes")


def test_running_totals(spark, mode, frame):
    got = o.running_totals(spark.createDataFrame(frame), ["v", "k"], {"s": "w"}, ["g"]).toPandas().sort_values("k")
    want = frame.sort_values(["g", "v", "k"]).groupby("g")["w"].cumsum().sort_index()
    assert (got["s"].to_numpy() == want.to_numpy()).all()


def test_running_totals_global(spark, mode, frame):
    got = o.running_totals(spark.createDataFrame(frame), ["v", "k"], {"s": "w"}).toPandas().sort_values("k")
    assert (got["s"].to_numpy() == frame.sort_values(["v", "k"])["w"].cumsum().sort_index().to_numpy()).all()


def test_ranked_and_tiles(spark, mode, frame):
    df = spark.createDataFrame(frame)
    got = o.ranked(df, ["v", "k"], ["g"]).toPandas().sort_values("k")
    want = frame.sort_values(["g", "v", "k"]).groupby("g").cumcount().sort_index() + 1
    assert (got["rn"].to_numpy() == want.to_numpy()).all()
    sizes = o.tiles(df, ["v", "k"], 7).toPandas().groupby("tile").size()
    assert sizes.to_dict() == {i + 1: 3000 // 7 + (1 if i < 3000 % 7 else 0) for i in range(7)}


def test_rank_rows(spark, mode, frame):
    got = o.rank_rows(spark.createDataFrame(frame), "v", ["g"]).toPandas().sort_values("k")
    assert (got["rnk"].to_numpy() == frame.groupby("g")["v"].rank(method="min").to_numpy()).all()
    assert (got["dense"].to_numpy() == frame.groupby("g")["v"].rank(method="dense").to_numpy()).all()


@pytest.mark.parametrize("accuracy", [20, 100_000])
def test_quantiles(spark, mode, frame, accuracy, monkeypatch):
    monkeypatch.setattr(o, "SKETCH_ACCURACY", accuracy)  # 20 makes the brackets much narrower than a group
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = o.quantiles(spark.createDataFrame(frame), ["v", "w"], probs, ["g"]).toPandas().set_index("g")
    for g, part in frame.groupby("g"):
        for c in ("v", "w"):
            want = part[c].quantile(probs).to_numpy()
            assert np.allclose([got.loc[g, o.quantile_name(c, i)] for i in range(len(probs))], want)


def test_sliding(spark, mode, frame):
    out = o.sliding(
        spark.createDataFrame(frame), ["v", "k"], ["g"], 4,
        {"m": lambda w: F.sum("w").over(w.rowsBetween(-4, 0)), "p": lambda w: F.lag("k").over(w), "n": lambda w: F.lead("k").over(w)},
        ahead=1, chunk=50,
    ).toPandas().sort_values("k")
    by = frame.sort_values(["g", "v", "k"]).groupby("g")
    want = by["w"].rolling(5, min_periods=1).sum().reset_index(level=0, drop=True).sort_index()
    assert len(out) == len(frame)
    assert (out["m"].to_numpy() == want.to_numpy()).all()
    assert out["p"].fillna(-1).tolist() == by["k"].shift(1).sort_index().fillna(-1).tolist()
    assert out["n"].fillna(-1).tolist() == by["k"].shift(-1).sort_index().fillna(-1).tolist()


def test_hash_cuts_draw_exact_counts(spark, mode, frame):
    df = spark.createDataFrame(frame).withColumn("h", draw(1, "t", "k"))
    quotas = spark.createDataFrame([("hot", 0, 1), ("hot", 1, 700), ("a", 0, 0), ("b", 0, 10**9)], "g string, slot int, take bigint")
    cuts = o.hash_cuts(df, "h", quotas, ["g"]).collect()
    counts = {(r["g"], r["slot"]): df.filter((F.col("g") == r["g"]) & (F.col("h") <= r["cut"])).count() for r in cuts}
    assert counts == {("hot", 0): 1, ("hot", 1): 700, ("a", 0): 0, ("b", 0): int((frame.g == "b").sum())}
    assert df.filter(F.col("h") <= o.lowest_cut(df, "h", 123)).count() == 123
