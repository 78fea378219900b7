"""Samples, folds and splits."""

from pyspark.sql import functions as F

from plumbline.operators import sampling as s
from plumbline.plans.registry import query
from plumbline.plans.shapes import PEOPLE, SCORED, people, scored, with_

S = with_("s", SCORED)


def md(tag, key):
    return f"md5('42|{tag}|' || CAST({key} AS VARCHAR))"


@query("b1_sample_n", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {md('sample', 'o_orderkey')} LIMIT 2000")
def b1(t):
    return s.sample_n(t.orders.select("o_orderkey", "o_totalprice"), 2000, "o_orderkey")


@query(
    "b2_stratified_sample",
    f"""WITH n AS (SELECT o_orderpriority, o_orderstatus, o_orderkey, {md('strata', 'o_orderkey')} AS h FROM orders),
    q AS (SELECT o_orderpriority, least(greatest(1, CAST(round(count(*) * (3000.0 / (SELECT count(*) FROM orders))) AS BIGINT)), count(*)) AS take
      FROM n GROUP BY 1),
    r AS (SELECT n.*, take, row_number() OVER (PARTITION BY n.o_orderpriority ORDER BY h) AS rn FROM n JOIN q USING (o_orderpriority)),
    a AS (SELECT * FROM r WHERE rn <= take),
    trim AS (SELECT o_orderkey, o_orderpriority FROM a ORDER BY {md('trim', 'o_orderkey')} LIMIT 3000),
    top AS (SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (ORDER BY {md('topup', 'o_orderkey')}) AS k FROM r WHERE rn > take) z
      WHERE k <= 3000 - (SELECT count(*) FROM a))
    SELECT * FROM trim UNION ALL SELECT * FROM top""",
)
def b2(t):
    return s.stratified_sample(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", 3000, "o_orderkey")


@query(
    "b3_stratified_folds",
    f"""{S}, f AS (SELECT row_id, y, ntile(5) OVER (PARTITION BY y ORDER BY {md('folds', 'row_id')}) - 1 AS fold FROM s)
    SELECT CAST(fold AS INTEGER) AS fold, y, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS key_sum FROM f GROUP BY 1, 2""",
)
def b3(t):
    f = s.assign_folds(scored(t).select("row_id", "y"), 5, "row_id", label="y")
    return f.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("key_sum"))


NULLS = with_("p", PEOPLE) + f""", n AS (SELECT segment, id, {md('strata', 'id')} AS h FROM p),
    q AS (SELECT segment, least(greatest(1, CAST(round(count(*) * (400.0 / (SELECT count(*) FROM p))) AS BIGINT)), count(*)) AS take FROM n GROUP BY 1),
    r AS (SELECT n.*, take, row_number() OVER (PARTITION BY n.segment ORDER BY h) AS rn FROM n JOIN q ON n.segment IS NOT DISTINCT FROM q.segment),
    a AS (SELECT * FROM r WHERE rn <= take),
    trim AS (SELECT id, segment FROM a ORDER BY {md('trim', 'id')} LIMIT 400),
    top AS (SELECT id, segment FROM (SELECT *, row_number() OVER (ORDER BY {md('topup', 'id')}) AS k FROM r WHERE rn > take) z WHERE k <= 400 - (SELECT count(*) FROM a))
    SELECT * FROM trim UNION ALL SELECT * FROM top"""


@query("b2_null_stratum", NULLS)
def b2_null(t):
    """A stratum of NULLs gets its share; both plans are the same to the rows."""
    return s.stratified_sample(people(t).select("id", "segment"), "segment", 400, "id")


@query(
    "b3_null_class",
    with_("p", PEOPLE) + f""" SELECT segment, CAST(fold AS INTEGER) AS fold, count(*) AS n, CAST(sum(id) AS BIGINT) AS key_sum
    FROM (SELECT segment, id, ntile(5) OVER (PARTITION BY segment ORDER BY {md('folds', 'id')}) - 1 AS fold FROM p) f GROUP BY 1, 2""",
)
def b3_null(t):
    f = s.assign_folds(people(t).select("id", "segment"), 5, "id", label="segment")
    return f.groupBy("segment", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("id").cast("bigint").alias("key_sum"))


@query(
    "b4_plain_folds",
    f"""SELECT CAST(CAST('0x' || substr({md('folds', 'o_orderkey')}, 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold,
    count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders GROUP BY 1""",
)
def b4(t):
    f = s.assign_folds(t.orders.select("o_orderkey"), 5, "o_orderkey")
    return f.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"))


@query(
    "b5_ordered_split",
    """SELECT frac, CASE WHEN o_orderkey <= c THEN 'first' ELSE 'last' END AS part, count(*) AS n, max(o_orderkey) AS last_key
    FROM orders CROSS JOIN (SELECT 0.5::DOUBLE AS frac, quantile_cont(o_orderkey, 0.5) AS c FROM orders
      UNION ALL SELECT 0.7::DOUBLE, quantile_cont(o_orderkey, 0.7) FROM orders) q GROUP BY 1, 2""",
)
def b5(t):
    out = None
    for frac in (0.5, 0.7):
        part = s.ordered_split(t.orders.select("o_orderkey"), "o_orderkey", frac).groupBy("part").agg(
            F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last_key")
        ).withColumn("frac", F.lit(frac))
        out = part if out is None else out.unionByName(part)
    return out


def _prev_sql(drop, p):
    d = 0 if drop == "neg" else 1
    take = (
        f"least(CAST(floor(n_pos * (1 - {p}) / {p}) AS BIGINT), n_neg)" if drop == "neg"
        else f"least(CAST(floor(n_neg * {p}::DOUBLE / (1 - {p})) AS BIGINT), n_pos)"
    )
    return f"""{S}, c AS (SELECT CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg FROM s),
    r AS (SELECT s.*, row_number() OVER (PARTITION BY y ORDER BY {md(f'prev-{drop}-{p}', 'row_id')}) AS rn FROM s)
    SELECT row_id, y FROM r, c WHERE y <> {d} OR rn <= {take}"""


@query("b6_prevalence_drop_negatives", _prev_sql("neg", 0.2))
def b6(t):
    return s.prevalence_sample(scored(t).select("row_id", "y"), "y", 0.2, "row_id", "neg")


@query("b7_prevalence_drop_positives", _prev_sql("pos", 0.02))
def b7(t):
    return s.prevalence_sample(scored(t).select("row_id", "y"), "y", 0.02, "row_id", "pos")


@query(
    "b8_holdout",
    f"""SELECT is_test, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM (
      SELECT o_orderkey, row_number() OVER (ORDER BY {md('holdout', 'o_orderkey')}) >
        (SELECT CAST(floor(0.8 * count(*)) AS BIGINT) FROM orders) AS is_test FROM orders) z GROUP BY 1""",
)
def b8(t):
    f = s.holdout(t.orders.select("o_orderkey"), "o_orderkey")
    return f.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"))
