"""Detectors, imputation and stacking: agreement with NumPy or recovery of planted rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plumbline.operators import detectors as d
from plumbline.operators import evaluate as e
from plumbline.operators import impute, inject, stack
from plumbline.operators.features import credit_rules
from plumbline.operators.pipeline import OPERATIONS, clean
from plumbline.plans.registry import Tables
from plumbline.plans.shapes import credit, scored
from tests.conftest import ROOT


def planted(spark, n=600):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 4))
    x[:12] += 6
    return spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")).assign(k=range(n))), x


def recall(scores, name):
    top = scores.toPandas().nlargest(12, name)["key"]
    return (top < 12).mean()


def test_detectors_find_planted_rows(spark):
    df, _ = planted(spark)
    fs = list("abcd")
    assert recall(d.isolation_forest(df, "k", fs, trees=100), "iforest") > 0.9
    assert recall(d.ecod(df, "k", fs), "ecod") > 0.9
    assert recall(d.hbos(df, "k", fs), "hbos") > 0.8
    assert recall(d.loda(df, "k", fs), "loda") > 0.7
    votes = d.vote(df, "k", fs, d.METHODS[:2], contamination=0.02).toPandas()
    assert (votes[votes.anomalous]["key"] < 12).all() and votes.anomalous.sum() >= 8


def test_isolation_forest_repeats(spark):
    df, _ = planted(spark, 300)
    a = d.isolation_forest(df, "k", ["a", "b"], trees=20).toPandas().sort_values("key")
    b = d.isolation_forest(df.repartition(7), "k", ["a", "b"], trees=20).toPandas().sort_values("key")
    assert np.allclose(a["iforest"], b["iforest"]) and a["iforest"].between(0, 1).all()


def test_loda_matches_numpy(spark):
    df, x = planted(spark, 200)
    z = (x - x.mean(0)) / x.std(0)
    p = z @ d.loda_weights(4, 100, 42).T
    lo, hi = p.min(0), p.max(0)
    b = np.clip(np.floor((p - lo) / ((hi - lo) / 10)), 0, 9).astype(int)
    want = np.mean([-np.log(np.bincount(b[:, i], minlength=10)[b[:, i]] / 200) for i in range(100)], axis=0)
    got = d.loda(df, "k", list("abcd")).toPandas().sort_values("key")["loda"]
    assert np.allclose(got, want)


def test_iterative_impute_recovers_a_linear_column(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=300), rng.normal(size=300)
    pdf = pd.DataFrame({"k": range(300), "a": a, "b": b, "c": 2 * a - b + 3})
    gaps = pdf["k"] % 10 == 0
    df = spark.createDataFrame(pdf).withColumn("c", F.when(F.col("k") % 10 != 0, F.col("c")))
    got = impute.iterative_impute(df, "k", ["a", "b", "c"]).toPandas().sort_values("k")
    assert np.allclose(got["c"][gaps.to_numpy()], pdf["c"][gaps], atol=1e-5)
    assert np.allclose(got["c"][~gaps.to_numpy()], pdf["c"][~gaps])


def test_ml_impute_leaves_no_gap(spark):
    df = spark.createDataFrame([(i, None if i % 9 == 0 else float(i % 13), float(i % 7), None if i % 5 == 0 else "ab"[i % 2]) for i in range(90)], "k long, x double, y double, s string")
    for method in ("iterative", "knn", "random_forest"):
        assert impute.ml_impute(df, "k", method=method).filter("x IS NULL OR s IS NULL OR y IS NULL").isEmpty()


def test_stackers_separate_and_are_out_of_fold(spark):
    s = scored(Tables(spark, ROOT)).select("row_id", "y", *stack.BASE)
    raw = e.evaluate(s, "y", stack.BASE).agg(F.max("auc_pr")).first()[0]
    for learner in ("logistic", "boosted", "forest", "perceptron"):
        out = stack.stack(s, "row_id", "y", learner=learner, trees=10, folds=3)
        assert out.count() == s.count()
        got = e.best_f1(out, "y", "stacked").first()
        assert raw * 0.8 < got["auc_pr"] < 0.99  # better than one detector, yet not a leak


def test_platt_lowers_calibration_error(spark):
    s = scored(Tables(spark, ROOT)).select("row_id", "y", "score")
    out = stack.platt(s, "row_id", "y", "score", folds=3)
    raw, cal = (e.calibration(out, "y", c).first()["ece"] for c in ("score", "calibrated"))
    assert cal < raw / 2


def test_importance_and_ablation(spark):
    s = scored(Tables(spark, ROOT)).select("row_id", "y", *stack.BASE)
    imp = stack.importance(s, "y", trees=5).toPandas()
    assert abs(imp["importance"].sum() - 1) < 1e-6
    ab = {r["leave_out"]: r["auc_pr"] for r in stack.ablation(s, "row_id", "y", learner="logistic", folds=3).collect()}
    assert set(ab) == {"none", *stack.BASE} and ab["none"] >= ab["rule"]


def test_injection_is_exact_and_labelled(spark):
    base = credit(Tables(spark, ROOT))
    out, mask = inject.inject(base, "row_id", inject.CREDIT_FAMILIES, rate=0.02)
    n = base.count()
    counts = {r["anomaly_type"]: r["count"] for r in mask.groupBy("anomaly_type").count().collect()}
    assert counts == {f.name: -(-n * 2 // 100) for f in inject.CREDIT_FAMILIES}
    assert out.filter("y = 1").count() == sum(counts.values()) == mask.select("row_id").distinct().count()
    again, _ = inject.inject(base.repartition(5), "row_id", inject.CREDIT_FAMILIES, rate=0.02)
    assert out.exceptAll(again).isEmpty()
    ruled = credit_rules(out)
    assert ruled.filter("y = 1 AND rule = 0").isEmpty()  # every planted row breaks a rule


def test_clean_runs_every_operation(spark):
    rows = [(i, None if i % 11 == 0 else float(i % 17), float(i % 5), "St JohnÃ©" if i % 3 else " ave  x ") for i in range(120)]
    df = spark.createDataFrame(rows, "id long, a double, b double, t string")
    for name in OPERATIONS:
        params = {"format_rules": {"t": {"case": "upper"}}} if name == "standardize_format" else {}
        out, rep = clean(df, "id", [{"operation": name, "parameters": params}, {"operation": "nope"}])
        assert out.count() <= 120 and rep.count() == 1 and out.columns == df.columns
