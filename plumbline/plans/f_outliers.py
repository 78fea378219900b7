"""Outliers and unsupervised detectors."""

from pyspark.sql import functions as F

from plumbline.operators import detectors as d
from plumbline.operators import neighbors as nb
from plumbline.operators import outliers as o
from plumbline.plans.c_profile import stack
from plumbline.plans.registry import query
from plumbline.plans.shapes import CREDIT, PEOPLE, SCORED, credit, people, scored, with_

P = with_("p", PEOPLE)
NUMS = ["nation", "balance", "tier"]


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def iqr_sql(src, key, columns, k=1.5):
    return stack(
        columns,
        f"""SELECT {key} AS key, '$c' AS "column", CAST($c AS DOUBLE) AS value, abs($c - m) / s AS z, 'iqr' AS method FROM {src},
        (SELECT quantile_cont($c, 0.25) AS a, quantile_cont($c, 0.75) AS b, avg($c) AS m, stddev_samp($c) AS s, count($c) AS n FROM {src}) q
        WHERE n >= 10 AND ($c < a - {k} * (b - a) OR $c > b + {k} * (b - a))""",
    )


def zscore_sql(src, key, columns, k=3):
    return stack(
        columns,
        f"""SELECT {key} AS key, '$c' AS "column", CAST($c AS DOUBLE) AS value, abs($c - m) / s AS z, 'zscore' AS method FROM {src},
        (SELECT avg($c) AS m, stddev_samp($c) AS s, stddev_pop($c) AS sp, count($c) AS n FROM {src}) q WHERE n >= 10 AND sp > 0 AND abs($c - m) / sp > {k}""",
    )


OUT = "SELECT key, \"column\", value, round(z, 6) AS z, method FROM"


@query("f1_iqr_outliers", f"{P} {OUT} ({iqr_sql('p', 'id', NUMS)}) u")
def f1(t):
    return r6(o.outliers(people(t), "id", NUMS, "iqr"), "z")


@query(
    "f1_iqr_outliers_by_group",
    """WITH b AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders GROUP BY 1)
    SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_totalprice < a - 0.2 * (b - a) OR o_totalprice > b + 0.2 * (b - a)) AS outliers
    FROM orders JOIN b USING (o_orderpriority) GROUP BY 1""",
)
def f1_group(t):
    from plumbline.operators.order_stats import bounded_join, quantile_name, quantiles

    q = quantiles(t.orders, ["o_totalprice"], [0.25, 0.75], ["o_orderpriority"])
    a, b = F.col(quantile_name("o_totalprice", 0)), F.col(quantile_name("o_totalprice", 1))
    v = F.col("o_totalprice")
    return bounded_join(t.orders, q, ["o_orderpriority"]).groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((v < a - 0.2 * (b - a)) | (v > b + 0.2 * (b - a))).alias("outliers")
    )


@query("f2_zscore_outliers", f"{P} {OUT} ({zscore_sql('p', 'id', NUMS)}) u")
def f2(t):
    return r6(o.outliers(people(t), "id", NUMS, "zscore"), "z")


MERGED = f"""{P}, m AS (SELECT key, "column", max(value) AS value, max(z) AS z, max(method) AS method FROM (
  {iqr_sql('p', 'id', NUMS)} UNION ALL {zscore_sql('p', 'id', NUMS)}) u GROUP BY 1, 2)"""


def merged(t):
    src = people(t)
    return o.merge_methods([o.outliers(src, "id", NUMS, "iqr"), o.outliers(src, "id", NUMS, "zscore")])


@query(
    "f3_outlier_listing",
    f"""{MERGED} SELECT key, "column", value, round(z, 6) AS z, method, CAST(position AS INTEGER) AS position FROM (
    SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY z DESC, key) AS position FROM m) r WHERE position <= 20""",
)
def f3(t):
    return r6(o.listing(merged(t)), "z")


@query("f3_outlier_totals", f"""{MERGED} SELECT "column", count(*) AS outliers, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM p), 2) AS pct FROM m GROUP BY 1""")
def f3_totals(t):
    return o.listing_totals(merged(t), people(t))


@query("f4_isolation_forest_column")
def f4(t):
    return d.isolation_outliers(t.orders, "o_orderkey", "o_totalprice")


CREDIT_COLS = ["limit_bal", "age", "bill_amt1", "pay_0", "pay_amt1"]


@query("f5_isolation_forest")
def f5(t):
    base = o.scale(credit(t), CREDIT_COLS)
    return d.isolation_forest(base, "row_id", CREDIT_COLS)


def vectors(t):
    """Embedding components as columns."""
    return t.embeddings.select("vec_id", *[F.element_at("embedding", i + 1).cast("double").alias(f"e{i}") for i in range(64)])


EMB = [f"e{i}" for i in range(64)]
VEC = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def near_sql(k):
    return f"""{VEC}, pair AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.e, b.e) AS dist FROM v a JOIN v b ON a.vec_id <> b.vec_id),
      nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS rk FROM pair) z WHERE rk <= {k}),
      kd AS (SELECT a, max(dist) AS kdist FROM nn GROUP BY 1)"""


@query(
    "f6_local_outlier_factor",
    f"""WITH {near_sql(20)}, lrd AS (SELECT nn.a, 1.0 / (avg(greatest(dist, kdist)) + 1e-10) AS lrd FROM nn JOIN kd ON kd.a = nn.b GROUP BY 1)
    SELECT nn.a AS key, round(avg(y.lrd) / max(x.lrd), 6) AS lof FROM nn JOIN lrd x ON x.a = nn.a JOIN lrd y ON y.a = nn.b GROUP BY 1""",
)
def f6(t):
    return r6(nb.lof(vectors(t), "vec_id", EMB, 20), "lof")


DB = ["limit_bal", "age", "bill_amt1"]
SCALED = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in DB)


@query(
    "f7_dbscan_noise",
    f"""{with_('b', CREDIT)}, s AS (SELECT row_id, {SCALED} FROM b),
    near AS (SELECT x.row_id AS a, y.row_id AS b FROM s x JOIN s y ON {' + '.join(f'(x.{c} - y.{c}) * (x.{c} - y.{c})' for c in DB)} <= 0.25),
    core AS (SELECT a FROM near GROUP BY 1 HAVING count(*) >= 5), ok AS (SELECT DISTINCT near.a FROM near JOIN core ON core.a = near.b)
    SELECT row_id AS key, CASE WHEN ok.a IS NULL THEN 1 ELSE 0 END AS noise FROM s LEFT JOIN ok ON ok.a = row_id""",
)
def f7(t):
    return nb.dbscan_noise(o.scale(credit(t).select("row_id", *DB), DB), "row_id", DB)


@query("f8_majority_vote")
def f8(t):
    return d.vote(credit(t), "row_id", DB, d.METHODS)


@query("f9_anomaly_ranking")
def f9(t):
    return d.anomaly_ranking(credit(t), "row_id", CREDIT_COLS)


def remove_sql(src, columns, inside):
    return f"{src} SELECT id, balance, tier FROM p WHERE " + " AND ".join(f"coalesce({inside.replace('$c', c)}, true)" for c in columns)


IN_IQR = "($c BETWEEN (SELECT quantile_cont($c, 0.25) - 1.5 * (quantile_cont($c, 0.75) - quantile_cont($c, 0.25)) FROM p) AND (SELECT quantile_cont($c, 0.75) + 1.5 * (quantile_cont($c, 0.75) - quantile_cont($c, 0.25)) FROM p))"
IN_Z = "(abs($c - (SELECT avg($c) FROM p)) / (SELECT stddev_samp($c) FROM p) <= 3)"


@query("f10_remove_iqr", remove_sql(P, ["balance", "tier"], IN_IQR))
def f10(t):
    return o.remove_outliers(people(t), ["balance", "tier"], "iqr", 1.5).select("id", "balance", "tier")


@query(
    "f10_removed_counts",
    P + stack(NUMS, f"""SELECT '$c' AS "column", count(*) FILTER (WHERE NOT {IN_IQR}) AS outliers FROM p"""),
)
def f10_counts(t):
    return o.outlier_counts(people(t), NUMS, "iqr", 1.5)


@query("f11_remove_zscore", remove_sql(P, ["balance", "tier"], IN_Z))
def f11(t):
    return o.remove_outliers(people(t), ["balance", "tier"], "zscore", 3.0).select("id", "balance", "tier")


@query("f11_remove_isolation_forest")
def f11_forest(t):
    return d.remove_anomalies(credit(t), "row_id", CREDIT_COLS, methods=["isolation_forest"])


TAILS = f"{with_('b', CREDIT)}, " + ", ".join(
    f"""t_{c} AS (SELECT row_id, -ln(cume_dist() OVER (ORDER BY {c})) AS l, -ln(cume_dist() OVER (ORDER BY {c} DESC)) AS r,
      (SELECT sqrt(count(*)) * sum(pow({c} - a, 3)) / pow(sum(pow({c} - a, 2)), 1.5) FROM b, (SELECT avg({c}) AS a FROM b) m) AS skew FROM b)""" for c in CREDIT_COLS
) + ", o AS (SELECT row_id AS key, " + ", ".join(
    f"({' + '.join(e.replace('$t', f't_{c}') for c in CREDIT_COLS)}) AS {n}"
    for n, e in (("o_left", "$t.l"), ("o_right", "$t.r"), ("o_auto", "CASE WHEN $t.skew < -1e-9 THEN $t.l ELSE $t.r END"))
) + " FROM " + f"t_{CREDIT_COLS[0]} " + " ".join(f"JOIN t_{c} USING (row_id)" for c in CREDIT_COLS[1:]) + ")"


@query("f12_ecod", f"{TAILS} SELECT key, round(greatest(o_left, o_right, o_auto), 6) AS ecod FROM o")
def f12(t):
    return r6(d.ecod(credit(t), "row_id", CREDIT_COLS), "ecod")


@query("f13_copod", f"{TAILS} SELECT key, round(o_left, 6) AS o_left, round(o_right, 6) AS o_right, round(o_auto, 6) AS o_auto, round(greatest(o_left, o_right, o_auto), 6) AS copod FROM o")
def f13(t):
    return r6(d.copod(credit(t), "row_id", CREDIT_COLS), "o_left", "o_right", "o_auto", "copod")


def bin_of(c):
    return f"CAST(least(9, floor(({c} - min({c}) OVER ()) / ((max({c}) OVER () - min({c}) OVER ()) / 10.0::DOUBLE))) AS INTEGER)"


HBOS = " + ".join(f"ln((SELECT max(n) FROM (SELECT count(*) AS n FROM g GROUP BY b_{c}) x) * 1.0::DOUBLE / count(*) OVER (PARTITION BY b_{c}))" for c in CREDIT_COLS)


@query("f14_hbos", f"{with_('b', CREDIT)}, g AS (SELECT row_id, {', '.join(f'{bin_of(c)} AS b_{c}' for c in CREDIT_COLS)} FROM b) SELECT row_id AS key, round({HBOS}, 6) AS hbos FROM g")
def f14(t):
    return r6(d.hbos(credit(t), "row_id", CREDIT_COLS), "hbos")


@query("f15_knn_distance", f"WITH {near_sql(10)} SELECT a AS key, round(kdist, 6) AS knn FROM kd")
def f15(t):
    return r6(nb.knn_distance(vectors(t), "vec_id", EMB, 10), "knn")


@query("f16_loda")
def f16(t):
    return d.loda(credit(t), "row_id", CREDIT_COLS)


@query(
    "f17_minmax_scores",
    f"""{with_('s', SCORED)} SELECT row_id, round((rule - min(rule) OVER ()) / greatest(1e-9, max(rule) OVER () - min(rule) OVER ()), 6) AS rule,
    round((lof - min(lof) OVER ()) / greatest(1e-9, max(lof) OVER () - min(lof) OVER ()), 6) AS lof FROM s""",
)
def f17(t):
    return r6(d.unit_scores(scored(t).select("row_id", "rule", "lof"), ["rule", "lof"]), "rule", "lof")
