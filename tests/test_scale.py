"""Steps that must not gather a table in one task or on the driver."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import inject as i
from plumbline.operators import pipeline as p
from plumbline.operators.duplicates import near_names
from plumbline.operators.order_stats import quantile_name, quantiles
from plumbline.session import cut_lineage, plan_bytes


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def limit(spark):
    yield lambda n: spark.conf.set("spark.plumbline.smallBytes", str(n))
    spark.conf.unset("spark.plumbline.smallBytes")


def test_near_names_has_no_broadcast(spark):
    rows = [(k, "x", n) for k, n in enumerate(["ANNA", "ANNE", "HANNA", "BOB", "ANNA"])]
    out = near_names(cut_lineage(spark.createDataFrame(rows, "k long, b string, n string")), ["b"], "n", "k")
    assert "BroadcastHashJoin" not in plan(out)
    got = {(r["name_a"], r["name_b"], r["n_a"], r["n_b"]) for r in out.collect()}
    assert got == {("ANNA", "ANNE", 2, 1), ("ANNA", "HANNA", 2, 1)}


def test_run_metrics_have_the_response_time(spark):
    now = dt.datetime(2024, 1, 2)
    runs = spark.createDataFrame([(s, now) for s in ["failed", "failed", "completed", "running", "pending"]], "status string, ts timestamp")
    found = p.run_metrics(runs, "status", "ts", F.lit(now))
    assert found.first()["response_ms"] == pytest.approx(450 + 200 / 3 * 50)
    assert [tuple(r) for r in p.alerts(found).select("id", F.round("value", 2)).collect()] == [("error_rate_high", 66.7), ("response_time_high", 3783.33)]


def test_quantiles_of_few_groups_keep_rows_in_their_tasks(spark, limit):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"g": rng.integers(0, 3, 50_000), "x": rng.normal(size=50_000)})
    df = cut_lineage(spark.createDataFrame(frame))
    limit(60_000)
    assert plan_bytes(df) > 60_000
    out = quantiles(df, ["x"], [0.25, 0.95], ["g"])
    assert "BroadcastHashJoin" in plan(out) and "SortMergeJoin" not in plan(out)
    for r in out.collect():
        assert np.allclose([r[quantile_name("x", k)] for k in range(2)], np.quantile(frame.x[frame.g == r["g"]], [0.25, 0.95]))


def test_injection_ranks_few_rows_in_one_task(spark, limit, monkeypatch):
    families = [i.Family("one", "v", {"v": "v + 1"}), i.Family("two", "v", {"v": "v * 2"}, "v > 5")]
    df = cut_lineage(spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 97).alias("v")))
    rows = lambda: sorted(map(tuple, i.inject(df, "k", families)[0].collect()))
    plain = rows()
    seen = []
    kept = i.cut_lineage
    monkeypatch.setattr(i, "cut_lineage", lambda d: seen.append(kept(d)) or seen[-1])
    limit(8 * plan_bytes(df))
    assert rows() == plain
    assert len(seen) == 1 and seen[0].count() < 2_000
