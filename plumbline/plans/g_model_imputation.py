"""Imputation by neighbours and models."""

from pyspark.sql import functions as F

from plumbline.operators import impute as m
from plumbline.operators.neighbors import knn_impute
from plumbline.operators.outliers import scale
from plumbline.plans.registry import duck, query
from plumbline.plans.shapes import CREDIT

# standard-scaled credit columns with gaps in two of them
GAPS = f"""SELECT row_id, CASE WHEN row_id % 9 = 4 THEN NULL ELSE bill_amt1 / 1e3 END AS bill, CASE WHEN row_id % 14 = 5 THEN NULL ELSE age / 1e1 END AS age,
  limit_bal / 1e5 AS lim, pay_amt1 / 1e3 AS pay, CASE WHEN row_id % 6 = 1 THEN NULL ELSE 's' || CAST(sex AS STRING) END AS sex FROM ({CREDIT}) c"""
COLS = ["bill", "age", "lim", "pay"]


def gaps(t):
    return t.sql(GAPS)


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def knn_sql(c):
    """Mean of the five nearest donors of column c; distances use the columns both rows have."""
    both = " + ".join(f"CASE WHEN q.{x} IS NULL OR d.{x} IS NULL THEN 0 ELSE (q.{x} - d.{x}) * (q.{x} - d.{x}) END" for x in COLS)
    have = " + ".join(f"CASE WHEN q.{x} IS NULL OR d.{x} IS NULL THEN 0 ELSE 1 END" for x in COLS)
    return f"""(SELECT row_id, avg(v) AS v FROM (SELECT q.row_id, d.{c} AS v, row_number() OVER (PARTITION BY q.row_id ORDER BY sqrt(({both}) * 4.0::DOUBLE / ({have})), d.row_id) AS rn
      FROM g q JOIN g d ON q.{c} IS NULL AND d.{c} IS NOT NULL) z WHERE rn <= 5 GROUP BY 1)"""


@query(
    "g8_knn_fill",
    f"""WITH g AS ({duck(GAPS)}) SELECT g.row_id, round(coalesce(g.bill, b.v), 6) AS bill, round(coalesce(g.age, a.v), 6) AS age
    FROM g LEFT JOIN {knn_sql('bill')} b ON b.row_id = g.row_id LEFT JOIN {knn_sql('age')} a ON a.row_id = g.row_id""",
)
def g8(t):
    return r6(knn_impute(gaps(t), "row_id", ["bill", "age"], COLS).select("row_id", "bill", "age"), "bill", "age")


@query("g9_iterative_fill")
def g9(t):
    return r6(m.iterative_impute(gaps(t), "row_id", COLS), *COLS).select("row_id", *COLS)


@query(
    "g9_two_columns",
    f"""WITH g AS ({duck(GAPS)}), r AS (SELECT regr_slope(bill, lim) AS b, regr_intercept(bill, lim) AS a FROM g)
    SELECT row_id, round(coalesce(bill, a + b * lim), 3) AS bill FROM g, r""",
)
def g9_two(t):
    """One column with gaps and one predictor: the chained regression is the least-squares line."""
    full = m.iterative_impute(gaps(t).select("row_id", "bill", "lim"), "row_id", ["bill", "lim"])
    return full.select("row_id", F.round("bill", 3).alias("bill"))


MODE = "(SELECT sex FROM g WHERE sex IS NOT NULL GROUP BY sex ORDER BY count(*) DESC, sex LIMIT 1)"


@query(
    "g10_ml_fill_knn",
    f"""WITH g AS ({duck(GAPS)}) SELECT g.row_id, round(coalesce(g.bill, b.v), 6) AS bill, round(coalesce(g.age, a.v), 6) AS age, round(lim, 6) AS lim, round(pay, 6) AS pay,
    coalesce(sex, {MODE}) AS sex FROM g LEFT JOIN {knn_sql('bill')} b ON b.row_id = g.row_id LEFT JOIN {knn_sql('age')} a ON a.row_id = g.row_id""",
)
def g10(t):
    return r6(m.ml_impute(gaps(t), "row_id", method="knn"), *COLS)


@query(
    "g10_ml_fill_two_columns",
    f"""WITH g AS ({duck(GAPS)}), r AS (SELECT regr_slope(bill, lim) AS b, regr_intercept(bill, lim) AS a FROM g)
    SELECT row_id, round(coalesce(bill, a + b * lim), 3) AS bill, coalesce(sex, {MODE}) AS sex FROM g, r""",
)
def g10_two(t):
    out = m.ml_impute(gaps(t).select("row_id", "bill", "lim", "sex"), "row_id", method="iterative")
    return out.select("row_id", F.round("bill", 3).alias("bill"), "sex")


@query("g10_ml_fill_iterative")
def g10_iterative(t):
    return m.ml_impute(gaps(t), "row_id", method="iterative")


@query("g10_ml_fill_random_forest")
def g10_forest(t):
    return m.ml_impute(gaps(t), "row_id", method="random_forest")
