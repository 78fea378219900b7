"""Sources and sinks."""

from pyspark.sql import functions as F

from plumbline.operators import scores
from plumbline.plans.registry import query
from plumbline.plans.shapes import PEOPLE_COPIES, people_copies, with_
from plumbline.session import scratch_path
from plumbline.sources import tables as io

PART = "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part"


def _part(t):
    return t.part.select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")


PART_SCHEMA = "p_partkey BIGINT, p_name STRING, p_brand STRING, p_size INT, p_retailprice DOUBLE"


@query("a1_load_csv", PART)
def a1_csv(t):
    path = scratch_path(t.spark, "a1") + ".csv"
    _part(t).write.csv(path, header=True)
    return io.load(t.spark, path, schema=PART_SCHEMA)


@query("a1_load_tsv_inferred", "SELECT p_partkey, p_name, p_size FROM part")
def a1_tsv(t):
    path = scratch_path(t.spark, "a1") + ".tsv"
    _part(t).write.csv(path, header=True, sep="\t")
    return io.load(t.spark, path).select(F.col("p_partkey").cast("bigint"), "p_name", "p_size")


@query("a1_load_json", PART)
def a1_json(t):
    path = scratch_path(t.spark, "a1") + ".json"
    _part(t).write.json(path)
    return io.load(t.spark, path, schema=PART_SCHEMA)


@query(
    "a2_schema_snapshot",
    """SELECT * FROM (VALUES (0,'o_orderkey','bigint'),(1,'o_custkey','bigint'),(2,'o_orderstatus','string'),
    (3,'o_totalprice','double'),(4,'o_orderdate','timestamp_ntz'),(5,'o_orderpriority','string')) v(position, "column", type)
    CROSS JOIN (SELECT count(*) AS n_rows, 6 AS n_columns FROM orders) n""",
)
def a2(t):
    return io.snapshot(t.orders)


@query(
    "a3_tolerant_read",
    """SELECT CAST(o_orderkey AS DOUBLE) AS id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS price,
    o_orderstatus AS status FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderstatus <> 'P' ORDER BY o_orderkey LIMIT 5000""",
)
def a3(t):
    path = scratch_path(t.spark, "a3")
    price = F.when(F.col("o_orderkey") % 11 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    extra = F.when(F.col("o_orderkey") % 7 == 0, F.lit("\tstray\tfields")).otherwise(F.lit(""))
    t.orders.select(
        F.concat(F.concat_ws("\t", F.col("o_orderkey").cast("string"), price, "o_orderstatus"), extra).alias("value")
    ).write.text(path)
    return io.read_tolerant(
        t.spark, path, ["id", "price", "status"], numeric=["id", "price"], keep=["status <> 'P'"],
        first=5000, order_by=["id"], has_header=False,
    )


YEAR = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"]


@query(
    "a4_pruned_scan",
    f"SELECT {', '.join(YEAR)} FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-07-01' AND l_shipdate < TIMESTAMP '1998-07-01'",
)
def a4(t):
    return io.scan(
        t.lineitem, YEAR, "l_shipdate >= TIMESTAMP_NTZ '1997-07-01' AND l_shipdate < TIMESTAMP_NTZ '1998-07-01'"
    )


@query("a5_normalised_names", "SELECT c_custkey AS Customer_Key, c_acctbal AS Balance_USD, c_name AS full_name FROM customer")
def a5(t):
    messy = t.customer.select("c_custkey", "c_acctbal", "c_name").toDF("Customer Key", "Balance/(USD)", "full-name")
    return io.normalise_names(messy)


@query("a6_parquet_sink", "SELECT * FROM supplier")
def a6(t):
    return t.spark.read.parquet(io.write_parquet(t.supplier, scratch_path(t.spark, "a6")))


COPIES = with_("p", PEOPLE_COPIES)
FIRST_COPY = """SELECT rid, name, segment, nation, tier FROM (
  SELECT *, row_number() OVER (PARTITION BY name, segment, nation, tier ORDER BY rid) AS rn FROM p) s WHERE rn = 1"""


@query("a7_cleaned_csv_sink", f"{COPIES} {FIRST_COPY}")
def a7(t):
    from plumbline.operators.duplicates import drop_dups

    src = people_copies(t)
    clean = drop_dups(src, ["name", "segment", "nation", "tier"], "first", "rid")
    path = io.write_cleaned_csv(clean, scratch_path(t.spark, "a7"), "people")
    return io.load(t.spark, path, schema=clean.schema)


@query(
    "a8_cleaning_history",
    f"""{COPIES}, c AS ({FIRST_COPY}),
    s AS (SELECT (SELECT count(*) FROM p) AS a, (SELECT count(*) FROM c) AS b,
      (SELECT 100.0 * (count(name) + count(segment) + count(nation) + count(tier)) / (4 * count(*)) FROM p) AS pc,
      (SELECT 100.0 * (count(name) + count(segment) + count(nation) + count(tier)) / (4 * count(*)) FROM c) AS cc)
    SELECT 'remove_duplicates' AS operations, a AS original_rows, b AS cleaned_rows, a - b AS removed_rows,
      round(CAST(round(cc - pc, 2) + round(100 - 100.0 * b / a, 2) AS DOUBLE) / 2, 2) AS improvement FROM s""",
)
def a8(t):
    from plumbline.operators.duplicates import drop_dups

    src = people_copies(t)
    cols = ["name", "segment", "nation", "tier"]
    clean = drop_dups(src, cols, "first", "rid")
    path = scratch_path(t.spark, "a8")
    better = scores.improvement(src.select(cols), clean.select(cols))
    io.append_history(t.spark, path, ["remove_duplicates"], src, clean, better)
    return t.spark.read.parquet(path).select(
        F.concat_ws(",", "operations").alias("operations"), "original_rows", "cleaned_rows", "removed_rows", "improvement"
    )
