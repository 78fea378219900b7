"""The relational features of the SQL corpus over the provided tables."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.operators import order_stats as o
from plumbline.operators.similarity import full_text_search
from plumbline.plans.o_gates import COMPARED, per_query
from plumbline.plans.registry import duck, query
from plumbline.plans.shapes import CREDIT, PAYROLL, credit, payroll, with_


def both(name, text):
    """A query whose text both engines read."""

    @query(name, duck(text))
    def run(t):
        return t.sql(text)


both("q1_filter_and", "SELECT c_custkey, c_name, c_acctbal FROM {customer} WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
both(
    "q2_in_between_like_null",
    """SELECT o_orderkey, o_orderpriority, o_totalprice FROM {orders} WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice BETWEEN 100000 AND 200000
    AND o_orderpriority NOT LIKE '%LOW' AND o_orderstatus LIKE 'F%' AND o_orderdate IS NOT NULL""",
)
both("q3_ilike", "SELECT p_partkey, p_name FROM {part} WHERE p_name ILIKE '%RED%'")


@query("q3_regex", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(red|blue) .*t$')")
def q3(t):
    return t.part.filter(F.col("p_name").rlike("^(red|blue) .*t$")).select("p_partkey", "p_name")


both("q4_distinct", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM {orders}")
both("q5_order_limit", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
both("q5_limit_offset", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
both(
    "q6_aggregates",
    """SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total, round(avg(l_quantity), 4) AS avg_qty, min(l_discount) AS lo, max(l_discount) AS hi,
    count(DISTINCT l_suppkey) AS suppliers FROM {lineitem}""",
)
both(
    "q7_group_having",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {lineitem}
    GROUP BY l_returnflag, l_linestatus HAVING count(*) > 100""",
)
both(
    "q7_having_alerts",
    "SELECT title_description, round(sum(total_ot_paid) / nullif(sum(regular_gross_paid), 0), 8) AS ot_ratio FROM (" + PAYROLL + ") p GROUP BY title_description HAVING sum(regular_gross_paid) > 100000",
)
both(
    "q8_conditional_aggregation",
    """SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) * 1e0 AS finished, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) * 1e0 AS open,
    round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS finished_value FROM {orders} GROUP BY o_orderpriority""",
)
both(
    "q9_inner_left_join",
    """SELECT c_custkey, c_name, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS spent FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey, c_name""",
)
both(
    "q9_full_outer_join",
    """SELECT c.n_nationkey AS customer_nation, s.n_nationkey AS supplier_nation, customers, suppliers FROM
    (SELECT n_nationkey, count(*) AS customers FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_acctbal > 9800 GROUP BY n_nationkey) c
    FULL OUTER JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS suppliers FROM {supplier} WHERE s_acctbal > 5000 GROUP BY s_nationkey) s ON c.n_nationkey = s.n_nationkey""",
)
both("q9_cross_join", "SELECT r_name, x.priority FROM {region} CROSS JOIN (SELECT DISTINCT o_orderpriority AS priority FROM {orders}) x")
both(
    "q9_self_join",
    """SELECT a.s_suppkey AS left_key, b.s_suppkey AS right_key, a.s_nationkey AS nation FROM {supplier} a JOIN {supplier} b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey""",
)
both(
    "q9_multi_way_join",
    """SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM {lineitem}
    JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
    WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' GROUP BY r_name, n_name""",
)
both("q10_in_subquery", "SELECT c_custkey, c_name FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 480000)")
both(
    "q10_exists",
    "SELECT p_partkey FROM {part} WHERE EXISTS (SELECT 1 FROM {lineitem} WHERE l_partkey = p_partkey AND l_quantity >= 50) AND NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_partkey = p_partkey AND l_quantity <= 1)",
)
both(
    "q11_correlated_scalar",
    """SELECT c_custkey, (SELECT count(*) FROM {orders} WHERE o_custkey = c_custkey) AS orders, (SELECT max(o_totalprice) FROM {orders} WHERE o_custkey = c_custkey) AS top FROM {customer}""",
)
both(
    "q11_above_own_average",
    """SELECT o_orderkey, o_custkey FROM {orders} x WHERE o_totalprice > (SELECT avg(y.o_totalprice) * 18e-1 FROM {orders} y WHERE y.o_custkey = x.o_custkey)""",
)


@query(
    "q12_lateral_top_n",
    """SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 3) x""",
)
def q12(t):
    # a limit on row_number reaches the tasks before the shuffle, so a hot customer stays cheap
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    top = t.orders.withColumn("rn", F.row_number().over(w)).filter("rn <= 3")
    return t.customer.join(top, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


both(
    "q13_chained_ctes",
    """WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM {orders} GROUP BY o_custkey), ranked AS (SELECT c_nationkey, total FROM spend JOIN {customer} ON c_custkey = o_custkey)
    SELECT n_name, count(*) AS customers, round(sum(total), 2) AS spend FROM ranked JOIN {nation} ON n_nationkey = c_nationkey GROUP BY n_name""",
)
both(
    "q13_risk_agencies",
    "WITH a AS (SELECT agency_name, avg(total_ot_paid) AS avg_ot, avg(base_salary) AS avg_base FROM (" + PAYROLL + """) p WHERE pay_basis = 'per Annum' GROUP BY agency_name),
    r AS (SELECT agency_name, avg_ot / nullif(avg_base, 0) AS ratio FROM a WHERE avg_ot > 100) SELECT agency_name, round(ratio, 6) AS ratio, CAST(rank() OVER (ORDER BY ratio DESC) AS BIGINT) AS rnk FROM r""",
)
RECURSIVE = """WITH RECURSIVE tree(id, depth) AS (SELECT c_custkey, 0 FROM {customer} WHERE c_custkey = 0
  UNION ALL SELECT c_custkey, depth + 1 FROM {customer} JOIN tree ON CAST(floor(c_custkey / 10) AS BIGINT) = tree.id WHERE c_custkey > 0)
  SELECT depth, count(*) AS n, CAST(sum(id) AS BIGINT) AS key_sum FROM tree GROUP BY depth"""


@query("q14_recursive_cte", duck(RECURSIVE))
def q14(t):
    """Levels of the customer hierarchy; the depth is the number of digits, so rounds stay few."""
    from plumbline.session import cut_lineage

    parent = F.when(F.col("c_custkey") > 0, F.floor(F.col("c_custkey") / 10))
    nodes = t.customer.select(F.col("c_custkey").alias("id"), parent.cast("bigint").alias("parent"))
    level = nodes.filter("parent IS NULL").select("id")
    out, depth = None, 0
    while True:
        level = cut_lineage(level)
        stats = level.agg(F.lit(depth).alias("depth"), F.count(F.lit(1)).alias("n"), F.sum("id").alias("key_sum"))
        if level.isEmpty():
            return out
        out = stats if out is None else out.unionByName(stats)
        level = nodes.join(level.withColumnRenamed("id", "up"), F.col("parent") == F.col("up"), "left_semi").select("id")
        depth += 1


@query("q14_recursive_sql", duck(RECURSIVE))
def q14_sql(t):
    return t.sql(RECURSIVE)


both(
    "q15_union_all",
    "SELECT 'customer' AS kind, c_nationkey AS nation, c_acctbal AS balance FROM {customer} WHERE c_acctbal < 0 UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM {supplier} WHERE s_acctbal < 1000",
)
both(
    "q16_case",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'small' END AS size_class FROM {orders}""",
)


@query(
    "q16_decode_iif",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS status, CASE WHEN o_totalprice > 250000 THEN 'Y' ELSE 'N' END AS big FROM orders",
)
def q16(t):
    return t.orders.selectExpr("o_orderkey", "decode(o_orderstatus, 'F', 'finished', 'O', 'open', 'other') AS status", "if(o_totalprice > 250000, 'Y', 'N') AS big")


both(
    "q17_coalesce_nullif",
    """SELECT c_custkey, coalesce(spent, 0) AS spent, round(spent / nullif(c_acctbal, 0), 4) AS ratio FROM {customer} LEFT JOIN
    (SELECT o_custkey, round(sum(o_totalprice), 2) AS spent FROM {orders} WHERE o_orderstatus = 'P' GROUP BY o_custkey) s ON o_custkey = c_custkey""",
)


def orders(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus")


@query("q18_row_number", "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders")
def q18(t):
    return o.ranked(orders(t), ["o_orderdate", "o_orderkey"], ["o_custkey"]).select("o_orderkey", "o_custkey", "rn")


@query(
    "q18_rank_dense_rank",
    """SELECT o_orderkey, o_orderpriority, rank() OVER (PARTITION BY o_orderpriority ORDER BY day DESC) AS rnk, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY day DESC) AS dense
    FROM (SELECT *, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS day FROM orders) o""",
)
def q18_rank(t):
    d = orders(t).withColumn("neg", -(F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("bigint"))
    return o.rank_rows(d, "neg", ["o_orderpriority"]).select("o_orderkey", "o_orderpriority", "rnk", "dense")


@query(
    "q18_global_ntile",
    f"""{with_('c', CREDIT)}, n AS (SELECT *, ntile(4) OVER (ORDER BY limit_bal, row_id) AS quartile FROM c)
    SELECT quartile, count(*) AS n, round(avg(bill_amt1), 4) AS avg_bill, CAST(sum(default_next) AS BIGINT) AS defaults FROM n GROUP BY 1""",
)
def q18_ntile(t):
    q = o.tiles(credit(t), ["limit_bal", "row_id"], 4, name="quartile")
    return q.groupBy("quartile").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("bill_amt1"), 4).alias("avg_bill"), F.sum("default_next").alias("defaults"))


@query("q18_global_rank", "SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice DESC) AS rnk FROM orders")
def q18_global(t):
    return o.rank_rows(orders(t).withColumn("neg", -F.col("o_totalprice")), "neg").select("o_orderkey", "rnk")


LAG = """SELECT o_orderkey, lag(o_totalprice) OVER w AS previous, lead(o_totalprice) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""


@query("q19_lag_lead", LAG)
def q19(t):
    out = o.sliding(
        orders(t), ["o_orderdate", "o_orderkey"], ["o_custkey"], 1,
        {"previous": lambda w: F.lag("o_totalprice").over(w), "next": lambda w: F.lead("o_totalprice").over(w)}, ahead=1,
    )
    return out.select("o_orderkey", "previous", "next")


@query(
    "q20_moving_average",
    """SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS avg7,
    round(sum(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 2) AS sum30 FROM orders""",
)
def q20(t):
    out = o.sliding(
        orders(t), ["o_orderdate", "o_orderkey"], ["o_orderpriority"], 29,
        {"avg7": lambda w: F.avg("o_totalprice").over(w.rowsBetween(-6, 0)), "sum30": lambda w: F.sum("o_totalprice").over(w.rowsBetween(-29, 0))},
    )
    return out.select("o_orderkey", F.round("avg7", 4).alias("avg7"), F.round("sum30", 2).alias("sum30"))


def exact(t):
    """Orders with the price as a decimal, so that sums do not depend on their order."""
    return t.orders.select("o_orderkey", "o_orderdate", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))


@query(
    "q21_running_total_partitioned",
    "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM orders",
)
def q21(t):
    out = o.running_totals(exact(t), ["o_orderdate", "o_orderkey"], {"running": "price"}, ["o_orderstatus"])
    return out.select("o_orderkey", F.col("running").cast("double").alias("running"))


@query(
    "q21_running_total_global",
    "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM orders",
)
def q21_global(t):
    out = o.running_totals(exact(t), ["o_orderdate", "o_orderkey"], {"running": "price"})
    return out.select("o_orderkey", F.col("running").cast("double").alias("running"))


both(
    "q22_share_of_total",
    """SELECT o_orderpriority, n, round(total, 2) AS total, round(total / sum(total) OVER (), 6) AS share, CAST(rank() OVER (ORDER BY total DESC) AS BIGINT) AS rnk
    FROM (SELECT o_orderpriority, count(*) AS n, sum(o_totalprice) AS total FROM {orders} GROUP BY o_orderpriority) g""",
)
both(
    "q22_growth_with_lag",
    """SELECT y, m, round(total, 2) AS total, round((total - lag(total) OVER (ORDER BY y, m)) * 100 / lag(total) OVER (ORDER BY y, m), 4) AS growth_pct
    FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, sum(o_totalprice) AS total FROM {orders} GROUP BY 1, 2) g""",
)


@query(
    "q23_qualify",
    f"""{with_('p', PAYROLL)} SELECT agency_name, last_name, base_salary FROM p QUALIFY rank() OVER (PARTITION BY agency_name ORDER BY base_salary DESC) = 1""",
)
def q23(t):
    # rank() = 1 is the maximum: one aggregate and a join on it, no window over an agency
    p = payroll(t).select("agency_name", "last_name", "base_salary")
    top = p.groupBy("agency_name").agg(F.max("base_salary").alias("base_salary"))
    return o.bounded_join(p, top, ["agency_name", "base_salary"], "left_semi")


@query(
    "q24_pagination",
    "SELECT o_orderkey, o_totalprice, rn FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) o WHERE rn BETWEEN 101 AND 200",
)
def q24(t):
    page = t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(200)  # top-k
    w = W.orderBy(F.desc("o_totalprice"), "o_orderkey")  # over the 200 rows of the page
    return page.withColumn("rn", F.row_number().over(w).cast("bigint")).filter("rn BETWEEN 101 AND 200")


@query(
    "q24_top_n_per_group",
    "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) x WHERE rn <= 5",
)
def q24_top(t):
    w = W.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
    top = t.lineitem.withColumn("rn", F.row_number().over(w)).filter("rn <= 5")
    return top.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    "q25_percentiles",
    """SELECT l_returnflag, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS median, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS p90,
    round(percentile_cont(0.99) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS p99 FROM lineitem GROUP BY 1""",
)
def q25(t):
    q = o.quantiles(t.lineitem, ["l_extendedprice"], [0.5, 0.9, 0.99], ["l_returnflag"])
    name = lambda i: F.round(o.quantile_name("l_extendedprice", i), 4)
    return q.select("l_returnflag", name(0).alias("median"), name(1).alias("p90"), name(2).alias("p99"))


@query("q26_string_aggregation", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS nations FROM nation GROUP BY 1")
def q26(t):
    return t.nation.groupBy("n_regionkey").agg(F.expr("listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name)").alias("nations"))


@query("q27_array_agg", "SELECT s_nationkey, list(s_suppkey ORDER BY s_suppkey) AS suppliers, len(list(s_suppkey)) AS n, list_contains(list(s_suppkey), 7) AS has_seven FROM supplier GROUP BY 1")
def q27(t):
    a = t.supplier.groupBy("s_nationkey").agg(F.sort_array(F.collect_list("s_suppkey")).alias("suppliers"))
    return a.select("s_nationkey", "suppliers", F.size("suppliers").cast("bigint").alias("n"), F.array_contains("suppliers", 7).alias("has_seven"))


@query("q27_split_flatten", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) w GROUP BY 1")
def q27_split(t):
    return t.part.select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("q27_array_literal", "SELECT p_partkey, [p_brand, p_type] AS pair, p_size IN (1, 5, 10) AS listed FROM part")
def q27_literal(t):
    return t.part.select("p_partkey", F.array("p_brand", "p_type").alias("pair"), F.array_contains(F.array(*[F.lit(x) for x in (1, 5, 10)]), F.col("p_size")).alias("listed"))


@query("q28_json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def q28(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")).filter("k > 50")


@query("q28_variant", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def q28_variant(t):
    v = t.events.select("event_type", F.expr("variant_get(parse_json(props), '$.k', 'bigint')").alias("k"))
    return v.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


@query(
    "q28_json_aggregation",
    """SELECT n_regionkey, '[' || string_agg('{"key":' || n_nationkey || ',"name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']' AS nations FROM nation GROUP BY 1""",
)
def q28_agg(t):
    item = F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return t.nation.groupBy("n_regionkey").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("nations"))


@query("q29_xml_path", "SELECT p_partkey, p_brand AS brand, CAST(p_size AS VARCHAR) AS size FROM part")
def q29(t):
    doc = F.concat(F.lit("<part><brand>"), "p_brand", F.lit('</brand><dim size="'), F.col("p_size").cast("string"), F.lit('"/></part>'))
    return t.part.withColumn("doc", doc).select("p_partkey", F.xpath_string("doc", F.lit("part/brand")).alias("brand"), F.xpath_string("doc", F.lit("part/dim/@size")).alias("size"))


@query(
    "q30_date_parts",
    """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(max(extract(quarter FROM o_orderdate)) AS INTEGER) AS quarter, count(*) AS n, min(strftime(o_orderdate, '%Y-%m')) AS label,
    min(strftime(o_orderdate, '%d/%m/%Y')) AS first_label FROM orders GROUP BY 1""",
)
def q30(t):
    return t.orders.groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month")).agg(
        F.max(F.quarter("o_orderdate")).alias("quarter"), F.count(F.lit(1)).alias("n"), F.min(F.date_format("o_orderdate", "yyyy-MM")).alias("label"),
        F.min(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("first_label"),
    )


@query(
    "q30_relative_range",
    """SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1""",
)
def q30_range(t):
    now = t.events.agg(F.max("ts").alias("now"))  # a fixed clock from the data
    return o.one_row(t.events, now).filter("ts >= now - INTERVAL 7 DAY").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q31_calendar",
    """WITH d AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1997-01-01', TIMESTAMP '1997-12-31', INTERVAL 1 DAY)) AS DATE) AS day)
    SELECT day, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS value FROM d LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') o ON CAST(o_orderdate AS DATE) = day GROUP BY 1""",
)
def q31(t):
    days = t.spark.range(1).select(F.explode(F.sequence(F.lit("1997-01-01").cast("date"), F.lit("1997-12-31").cast("date"))).alias("day"))
    # facts are counted per day before the join, so the calendar stays small on both sides
    facts = t.orders.filter("o_orderstatus = 'P'").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("value")
    )
    return days.join(facts, "day", "left").select("day", F.coalesce("orders", F.lit(0)).alias("orders"), F.round(F.coalesce("value", F.lit(0.0)), 2).alias("value"))


@query(
    "q32_pivot",
    """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1""",
)
def q32(t):
    return t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)


@query(
    "q32_unpivot",
    """SELECT l_returnflag, measure, round(value, 2) AS value FROM (SELECT l_returnflag, 'qty' AS measure, sum(l_quantity) AS value FROM lineitem GROUP BY 1
    UNION ALL SELECT l_returnflag, 'price', sum(l_extendedprice) FROM lineitem GROUP BY 1) u""",
)
def q32_unpivot(t):
    g = t.lineitem.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("price"))
    return g.unpivot("l_returnflag", ["qty", "price"], "measure", "value").withColumn("value", F.round("value", 2))


both(
    "q33_try_cast",
    """SELECT o_orderkey, TRY_CAST(code AS INTEGER) AS code, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority FROM
    (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE '' END || CAST(o_custkey AS STRING) AS code FROM {orders}) o""",
)

WORDS = "SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'), lambda w: w IN ('the', 'with')) AS w FROM documents"


@query(
    "q34_full_text_search",
    f"""WITH t AS ({WORDS}), c AS (SELECT doc_id, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'with')) AS b FROM t),
    n AS (SELECT count(*) AS n, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM c)
    SELECT doc_id AS key, round(a * (ln((1 + n) * 1.0::DOUBLE / (1 + da)) + 1) + b * (ln((1 + n) * 1.0::DOUBLE / (1 + db)) + 1), 6) AS score FROM c, n WHERE a > 0 AND b > 0""",
)
def q34(t):
    return full_text_search(t.documents, "doc_id", "text", "the with").withColumn("score", F.round("score", 6))


both(
    "q35_buckets_and_ranges",
    "SELECT CASE WHEN age < 30 THEN '20s' WHEN age < 40 THEN '30s' WHEN age < 50 THEN '40s' ELSE '50+' END AS bucket, count(*) AS n, sum(CASE WHEN age < 18 OR age > 65 THEN 1 ELSE 0 END) * 1e0 AS out_of_range, round(sum(bill_amt1) * 1e0 / nullif(sum(limit_bal), 0), 6) AS usage FROM ("
    + CREDIT + ") c GROUP BY 1",
)
both("q35_column_difference", "SELECT row_id, bill_amt1, bill_amt2, bill_amt1 - bill_amt2 AS delta FROM (" + CREDIT + ") c WHERE abs(bill_amt1 - bill_amt2) > 50000")
both(
    "q37_scalar_functions",
    """SELECT c_custkey, round(abs(c_acctbal - 5000), 2) AS distance, upper(substr(c_mktsegment, 1, 4)) AS code, concat(c_name, '/', c_mktsegment) AS label,
    CAST(CAST(c_acctbal AS DECIMAL(18, 2)) AS STRING) AS exact FROM {customer}""",
)


@query(
    "q36_gate_suite_rates",
    f"""{COMPARED} SELECT dataset, condition, count(*) AS queries, count(*) FILTER (WHERE is_error) AS wrong,
    count(*) FILTER (WHERE verdict = 'row_count_diff') AS row_count_diffs FROM pq GROUP BY 1, 2""",
)
def q36(t):
    return per_query(t).groupBy("dataset", "condition").agg(
        F.count(F.lit(1)).alias("queries"), F.count_if("is_error").alias("wrong"),
        F.count_if(F.col("verdict") == "row_count_diff").alias("row_count_diffs"),
    )
