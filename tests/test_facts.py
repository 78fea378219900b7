"""Report numbers from one read against pandas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators.facts import Facts
from plumbline.operators.pipeline import report

ROWS = [(i, None if i % 7 == 0 else float(i % 40) ** 2, i % 3, ["a1", "B 2", None, "c-3", "2020-01-02"][i % 5], None) for i in range(200)]
SCHEMA = "id bigint, x double, k int, t string, blank string"


@pytest.mark.parametrize("plan", ["small", "large"])
def test_against_pandas(spark, plan):
    df = spark.createDataFrame(ROWS, SCHEMA)
    if plan == "large":
        spark.conf.set("spark.plumbline.smallBytes", "0")
    try:
        got = {(r["section"], r["subject"], r["metric"]): r["value"] for r in report(df, "id").collect()}
    finally:
        spark.conf.unset("spark.plumbline.smallBytes")
    pdf = df.toPandas()
    for c in ("x", "k"):
        s = pdf[c].dropna()
        q1, q3 = s.quantile(0.25), s.quantile(0.75)
        want = {"min": s.min(), "max": s.max(), "mean": s.mean(), "std": s.std(), "median": s.median(), "null_count": pdf[c].isna().sum(), "distinct_count": s.nunique()}
        for m, v in want.items():
            assert got["profile", c, m] == pytest.approx(v), (c, m)
        assert got["outliers", c, "outliers"] == ((s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))).sum()
    assert got["profile", "blank", "distinct_count"] == 0 and got["profile", "blank", "null_pct"] == 100
    rest = pdf.drop(columns="id")
    assert got["duplicates", "*", "duplicates"] == len(rest) - len(rest.drop_duplicates())
    assert got["missing", "*", "missing"] == int(rest.isna().sum().sum()) and got["summary", "*", "rows"] == 200
    assert got["scores", "*", "completeness"] == round(100 * (1 - rest.isna().to_numpy().mean()), 2)


def test_empty_table_and_repeated_reads(spark):
    none = spark.createDataFrame([], SCHEMA)
    got = {(r["subject"], r["metric"]): r["value"] for r in report(none, "id").collect()}
    assert got["*", "rows"] == 0 and got["x", "mean"] is None and got["*", "completeness"] is None
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame(ROWS, SCHEMA)
    Facts(df.mapInArrow(count, df.schema), ["x", "k", "t"])
    assert seen.value == len(ROWS)  # read once


def test_null_and_empty_rows_differ(spark):
    df = spark.createDataFrame([("", None), (None, ""), (None, None), ("", None)], "a string, b string")
    f = Facts(df, ["a", "b"])
    assert (f.rows, f.distinct_rows) == (4, 3)
    assert math.isclose(f.scores()["uniqueness"], 75.0) and not np.isnan(f.scores()["overall"])
    assert f.values["a"]["distinct"] == 1 and df.filter(F.col("a").isNull()).count() == 2
