"""Table changes, as-of reads and the two streams."""

from pyspark.sql import functions as F

from plumbline.operators import changes as c
from plumbline.operators.order_stats import one_row
from plumbline.plans.registry import duck, query
from plumbline.session import scratch_path
from plumbline.streaming import streams

FEED = "SELECT event_id, ts, user_id, value, CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'purchase' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS action FROM {events}"
INSERTS = f"WITH f AS ({duck(FEED)}) SELECT event_id, ts, user_id, value FROM f WHERE action = 'INSERT'"
DAILY = "SELECT date_trunc('day', ts) AS day, event_type AS status, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2"


@query("r1_insert_stream", INSERTS)
def r1(t):
    folder = scratch_path(t.spark, "r1")
    t.sql(FEED).repartition(4).write.parquet(folder + "/in")
    feed = streams.read_folder(t.spark, folder + "/in", t.sql(FEED).schema, files_per_trigger=2)
    return streams.run_to_table(streams.inserts(feed), folder + "/out", folder + "/checkpoint")


@query("r1_insert_stream_batch_twin", INSERTS)
def r1_batch(t):
    return streams.inserts(t.sql(FEED))


@query("r2_daily_stream", DAILY)
def r2(t):
    folder = scratch_path(t.spark, "r2")
    src = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    src.repartition(4).write.parquet(folder + "/in")
    events = streams.read_folder(t.spark, folder + "/in", src.schema, files_per_trigger=2)
    # files arrive in no time order, so lateness up to the whole month is kept
    daily = streams.daily_counts(events, late="60 days")
    out = streams.run_to_table(daily, folder + "/out", folder + "/checkpoint", "complete")
    return out.select(F.col("day").cast("timestamp_ntz").alias("day"), "status", "n", F.round("value", 2).alias("value"))


@query("r2_daily_batch_twin", DAILY)
def r2_batch(t):
    out = streams.daily_counts(t.events.withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.col("day").cast("timestamp_ntz").alias("day"), "status", "n", F.round("value", 2).alias("value"))


@query("r3_conditional_update", "SELECT o_orderkey, CASE WHEN o_totalprice > 400000 AND o_orderstatus = 'O' THEN 'R' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def r3(t):
    return c.update_where(t.orders, "o_totalprice > 400000 AND o_orderstatus = 'O'", {"o_orderstatus": "'R'"}).select("o_orderkey", "o_orderstatus")


@query(
    "r3_update_in_subquery",
    "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal FROM customer",
)
def r3_sub(t):
    big = t.orders.filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return c.update_matching(t.customer, big, "c_custkey", {"c_acctbal": "c_acctbal + 100"}).select("c_custkey", "c_acctbal")


@query("r4_delete", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE NOT (l_quantity < 40 OR l_returnflag = 'R')")
def r4(t):
    return c.delete_where(t.lineitem, "l_quantity < 40 OR l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_quantity")


NEW_ROWS = "SELECT s_suppkey + 50 AS s_suppkey, 'new ' || s_name AS s_name, s_nationkey, s_acctbal * 2 AS s_acctbal FROM {supplier}"


@query("r5_insert", f"SELECT * FROM supplier UNION ALL {duck(NEW_ROWS)}")
def r5(t):
    return c.insert(t.supplier, t.sql(NEW_ROWS))


@query("r5_insert_ignore", f"SELECT * FROM supplier UNION ALL SELECT * FROM ({duck(NEW_ROWS)}) n WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier)")
def r5_ignore(t):
    return c.insert_ignore(t.supplier, t.sql(NEW_ROWS), "s_suppkey")


@query(
    "r6_upsert_accumulating",
    f"""WITH n AS ({duck(NEW_ROWS)}) SELECT coalesce(o.s_suppkey, n.s_suppkey) AS s_suppkey, CASE WHEN n.s_suppkey IS NULL THEN o.s_name WHEN o.s_suppkey IS NULL THEN n.s_name ELSE o.s_name END AS s_name,
    CASE WHEN n.s_suppkey IS NULL THEN o.s_nationkey ELSE n.s_nationkey END AS s_nationkey,
    CASE WHEN n.s_suppkey IS NULL THEN o.s_acctbal WHEN o.s_suppkey IS NULL THEN n.s_acctbal ELSE o.s_acctbal + n.s_acctbal END AS s_acctbal
    FROM supplier o FULL JOIN n ON o.s_suppkey = n.s_suppkey""",
)
def r6(t):
    merge = {"s_name": F.col("old.s_name"), "s_acctbal": F.col("old.s_acctbal") + F.col("new.s_acctbal")}
    return c.upsert(t.supplier, t.sql(NEW_ROWS), "s_suppkey", merge)


@query("r6_merge", f"WITH n AS ({duck(NEW_ROWS)}) SELECT * FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM n) UNION ALL SELECT * FROM n")
def r6_merge(t):
    return c.merge_table(t.supplier, t.sql(NEW_ROWS), "s_suppkey")


@query("r7_add_column", "SELECT p_partkey, CAST(p_retailprice * 0.9::DOUBLE AS DOUBLE) AS sale_price, CAST(NULL AS VARCHAR) AS remark FROM part")
def r7(t):
    out = c.add_column(c.add_column(t.part, "sale_price", "p_retailprice * 9e-1", "double"), "remark")
    return out.select("p_partkey", "sale_price", "remark")


@query("r7_dense_ids", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) + 1000 AS id FROM orders")
def r7_ids(t):
    return c.dense_ids(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], start=1001).select("o_orderkey", "id")


@query("r7_uuid", "SELECT count(*) AS n, count(*) AS distinct_ids, 36::BIGINT AS width FROM customer")
def r7_uuid(t):
    out = c.add_uuid(t.customer.select("c_custkey"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("uuid").alias("distinct_ids"), F.max(F.length("uuid")).cast("bigint").alias("width"))


@query(
    "r8_as_of",
    """WITH v AS (SELECT user_id, ts, value, event_id, event_type FROM events WHERE ts <= (SELECT min(ts) FROM events) + INTERVAL 12 DAY)
    SELECT user_id, ts, value, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM v) z WHERE rn = 1""",
)
def r8(t):
    first = t.events.agg(F.min("ts").alias("first"))
    versions = one_row(t.events.drop("props"), first)
    return c.as_of(versions, "user_id", "ts", F.col("first") + F.expr("INTERVAL 12 DAY"), "event_id").select("user_id", "ts", "value", "event_type")


@query("r9_copy", "SELECT * FROM nation")
def r9(t):
    return c.copy_table(t.nation, scratch_path(t.spark, "r9"))
