"""Drift of recent orders against older ones."""

from pyspark.sql import functions as F

from plumbline.operators import drift as d
from plumbline.plans.registry import duck, query

BASE = """SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS cust,
  CASE WHEN year(o_orderdate) >= 1999 THEN o_totalprice * 125e-2 + 9000 ELSE o_totalprice END AS price,
  CASE WHEN year(o_orderdate) >= 1999 AND o_orderkey % 4 = 0 THEN 'X' WHEN year(o_orderdate) < 1999 AND o_orderkey % 50 = 0 THEN 'OLD' ELSE o_orderstatus END AS status,
  o_orderpriority AS priority, year(o_orderdate) >= 1999 AS recent FROM {orders}"""
NUMS, TEXT = ["cust", "price"], ["status", "priority"]


def sides(t):
    b = t.sql(BASE)
    return b.filter("recent"), b.filter("NOT recent")


def r6(df, cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


HEAD = f"WITH b AS ({duck(BASE)})"


def num_sql(c, ks=True):
    k = (
        f"""(SELECT max(abs(c1 / t1 - c0 / t0)) FROM (SELECT v, sum(sum(CAST(recent AS INTEGER))) OVER (ORDER BY v) AS c1,
          sum(sum(1 - CAST(recent AS INTEGER))) OVER (ORDER BY v) AS c0 FROM (SELECT {c} AS v, recent FROM b) x GROUP BY v) y,
          (SELECT count(*) FILTER (WHERE recent) AS t1, count(*) FILTER (WHERE NOT recent) AS t0 FROM b) z)"""
        if ks else "0.0"
    )
    return f"""SELECT '{c}' AS "column", 'statistical' AS method, mean_drift, std_drift, CAST({k} AS DOUBLE) AS ks FROM (SELECT
      abs(avg({c}) FILTER (WHERE recent) - avg({c}) FILTER (WHERE NOT recent)) / (stddev_samp({c}) FILTER (WHERE NOT recent) + 1e-8) AS mean_drift,
      abs(stddev_samp({c}) FILTER (WHERE recent) - stddev_samp({c}) FILTER (WHERE NOT recent)) / (stddev_samp({c}) FILTER (WHERE NOT recent) + 1e-8) AS std_drift FROM b) s"""


def num_all(ks=True):
    return f"""SELECT "column", method, round(least(1, (mean_drift + std_drift + ks) / 3), 6) AS score, round(mean_drift, 6) AS mean_drift,
      round(std_drift, 6) AS std_drift, round(ks, 6) AS ks FROM ({' UNION ALL '.join(num_sql(c, ks) for c in NUMS)}) u"""


def cat_sql(c):
    return f"""SELECT '{c}' AS "column", 'js_divergence' AS method, round(least(1, js / ln(2)), 6) AS score, round(js, 6) AS js_divergence, new_categories, missing_categories
      FROM (SELECT sum(0.5::DOUBLE * p * ln(p / ((p + q) / 2)) + 0.5::DOUBLE * q * ln(q / ((p + q) / 2))) AS js,
        count(*) FILTER (WHERE a > 0 AND z = 0) AS new_categories, count(*) FILTER (WHERE a = 0 AND z > 0) AS missing_categories
      FROM (SELECT a, z, (a * 1.0::DOUBLE / sum(a) OVER () + 1e-8) / (1 + count(*) OVER () * 1e-8) AS p, (z * 1.0::DOUBLE / sum(z) OVER () + 1e-8) / (1 + count(*) OVER () * 1e-8) AS q
        FROM (SELECT {c}, count(*) FILTER (WHERE recent) AS a, count(*) FILTER (WHERE NOT recent) AS z FROM b WHERE {c} IS NOT NULL GROUP BY 1) g) h) i"""


CATS = " UNION ALL ".join(cat_sql(c) for c in TEXT)


@query("j1_numeric_drift", f"{HEAD} {num_all()}")
def j1(t):
    return r6(d.numeric_drift(*sides(t), NUMS), ["score", "mean_drift", "std_drift", "ks"])


@query("j2_ks_statistic", f'{HEAD} SELECT "column", ks FROM ({num_all()}) k')
def j2(t):
    return r6(d.ks_statistic(*sides(t), NUMS), ["ks"])


@query("j3_categorical_drift", f"{HEAD} {CATS}")
def j3(t):
    return r6(d.categorical_drift(*sides(t), TEXT), ["score", "js_divergence"])


@query(
    "j3_category_changes",
    HEAD + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {c} AS value, CASE WHEN bool_and(recent) THEN 'new' ELSE 'missing' END AS change FROM b GROUP BY {c}
        HAVING bool_and(recent) OR NOT bool_or(recent)""" for c in TEXT
    ),
)
def j3_changes(t):
    return d.category_changes(*sides(t), TEXT)


@query(
    "j4_table_drift",
    f"""{HEAD}, s AS (SELECT score FROM ({num_all()}) n UNION ALL SELECT score FROM ({CATS}) c)
    SELECT round(avg(score), 5) AS overall, avg(score) > 0.3 AS detected, count(*) FILTER (WHERE score > 0.5) AS high_columns FROM s""",
)
def j4(t):
    return r6(d.table_drift(d.drift(*sides(t), NUMS + TEXT)), []).withColumn("overall", F.round("overall", 5))


@query("j5_drift_from_stored_stats", f"{HEAD} {num_all(ks=False)}")
def j5(t):
    cur, ref = sides(t)
    return r6(d.numeric_drift_from_stats(cur, d.moments(ref, NUMS), NUMS), ["score", "mean_drift", "std_drift", "ks"])


@query("j5_drift_from_stored_counts", f"{HEAD} {CATS}")
def j5_counts(t):
    from plumbline.operators.profile import value_counts

    cur, ref = sides(t)
    return r6(d.categorical_drift_from_counts(cur, value_counts(ref, TEXT), TEXT), ["score", "js_divergence"])
