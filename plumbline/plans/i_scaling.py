"""Scaling."""

from pyspark.sql import functions as F

from plumbline.operators.outliers import scale
from plumbline.plans.registry import query

COLS = ["o_totalprice", "o_custkey", "flat"]
BASE = "SELECT o_orderkey, o_totalprice, CAST(o_custkey AS DOUBLE) AS o_custkey, 7e0 AS flat FROM {orders}"


def sql(mid, spread):
    each = ", ".join(
        f"round(({c} - (SELECT {mid.replace('$c', c)} FROM b)) / (SELECT CASE WHEN {spread.replace('$c', c)} = 0 THEN 1 ELSE {spread.replace('$c', c)} END FROM b), 6) AS {c}"
        for c in COLS
    )
    return f"WITH b AS ({BASE.replace('{orders}', 'orders')}) SELECT o_orderkey, {each} FROM b"


def run(t, method):
    out = scale(t.sql(BASE), COLS, method)
    return out.withColumns({c: F.round(c, 6) + 0.0 for c in COLS})


@query("i1_standard_scaling", sql("avg($c)", "stddev_pop($c)"))
def i1(t):
    return run(t, "standard")


@query("i2_minmax_scaling", sql("min($c)", "(max($c) - min($c))"))
def i2(t):
    return run(t, "minmax")


@query("i3_robust_scaling", sql("quantile_cont($c, 0.5)", "(quantile_cont($c, 0.75) - quantile_cont($c, 0.25))"))
def i3(t):
    return run(t, "robust")
