"""Cleaning pipeline, reports and run metrics."""

from pyspark.sql import functions as F

from plumbline.operators import pipeline as p
from plumbline.operators.order_stats import one_row
from plumbline.operators.scores import METRICS
from plumbline.plans.c_profile import NUMERIC, infer_sql, pattern_sql, stack
from plumbline.plans.d_scores import SHAPE, VALID, accuracy_sql, consistency_sql
from plumbline.plans.e_duplicates import GROUPS
from plumbline.plans.h_text import mojibake_sql
from plumbline.plans.registry import duck, query
from plumbline.plans.shapes import PEOPLE, PEOPLE_COLUMNS, PEOPLE_TEXT, people, with_
from plumbline.functions.patterns import FORMAT_PATTERNS

STEPS = [
    {"operation": "fill_missing", "parameters": {"columns": ["segment"], "strategy": "constant", "constant_value": "none"}},
    {"operation": "text_standardization", "parameters": {"columns": ["segment"]}},
    {"operation": "no_such_operation"},
    {"operation": "standardize_format", "parameters": {"columns": ["phone"], "format_rules": {"phone": {"regex_replace": {"pattern": "[^0-9]", "replacement": ""}}}}},
    {"operation": "remove_duplicates", "parameters": {"subset": ["name", "segment", "tier"]}},
    {"operation": "remove_outliers", "parameters": {"columns": ["balance"]}},
    {"operation": "fill_missing", "parameters": {"columns": ["balance"], "strategy": "mean"}},
]
BASE = "id, name, phone, segment, tier, balance"
CLEAN = f"""{with_('p', PEOPLE)}, a AS (SELECT id, name, regexp_replace(trim(phone), '[^0-9]', '', 'g') AS phone, regexp_replace(trim(lower(coalesce(segment, 'none'))), '\\s+', ' ', 'g') AS segment, tier, balance FROM p),
  b AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY name, segment, tier ORDER BY id) AS rn FROM a) z WHERE rn = 1),
  q AS (SELECT quantile_cont(balance, 0.25) AS x, quantile_cont(balance, 0.75) AS y FROM b),
  c AS (SELECT b.* FROM b, q WHERE coalesce(balance BETWEEN x - 1.5 * (y - x) AND y + 1.5 * (y - x), true)),
  d AS (SELECT * REPLACE (coalesce(balance, (SELECT avg(balance) FROM c)) AS balance) FROM c)"""


def cleaned(t):
    return p.clean(people(t).select(*BASE.split(", ")), "id", STEPS)


@query("p1_clean", f"{CLEAN} SELECT id, name, phone, segment, tier, round(balance, 4) AS balance FROM d")
def p1(t):
    return cleaned(t)[0].withColumn("balance", F.round("balance", 4))


@query(
    "p1_clean_report",
    f"""{CLEAN} SELECT 0 AS step, 'fill_missing' AS operation, count(*) - count(segment) AS modifications FROM p
    UNION ALL SELECT 1, 'text_standardization', count(*) FILTER (WHERE coalesce(segment, 'none') <> lower(coalesce(segment, 'none'))) FROM p
    UNION ALL SELECT 3, 'standardize_format', count(*) FILTER (WHERE p.phone <> a.phone) FROM p JOIN a USING (id)
    UNION ALL SELECT 4, 'remove_duplicates', (SELECT count(*) FROM a) - (SELECT count(*) FROM b)
    UNION ALL SELECT 5, 'remove_outliers', (SELECT count(*) FROM b) - (SELECT count(*) FROM c)
    UNION ALL SELECT 6, 'fill_missing', count(*) - count(balance) FROM c""",
)
def p1_report(t):
    return cleaned(t)[1]


@query("p2_preview", f"{CLEAN} SELECT id, name, phone, segment FROM d ORDER BY id LIMIT 100")
def p2(t):
    return p.preview(cleaned(t)[0].select("id", "name", "phone", "segment"), "id")


@query("p3_analyze_duplicates", f"""{with_('p', PEOPLE)}, u AS (SELECT count(*) AS k FROM (SELECT DISTINCT {', '.join(c for c in PEOPLE_COLUMNS if c != 'id')} FROM p) x)
    SELECT count(*) AS rows, count(*) - max(k) AS duplicates, round((count(*) - max(k)) * 100.0::DOUBLE / count(*), 2) AS pct FROM p, u""")
def p3(t):
    return p.analyze(people(t), "id", ["duplicates"])["duplicates"]


VALUES = [
    {"operation": "correct_types", "parameters": {"type_corrections": {"age_text": "numeric", "active": "boolean"}, "auto_detect": False}},
    {"operation": "normalize_values", "parameters": {"columns": ["balance"], "method": "minmax"}},
    {"operation": "auto_encoding_detection", "parameters": {"columns": ["name"]}},
]


@query(
    "p1_clean_values",
    f"""{with_('p', PEOPLE)}, g AS (SELECT id, replace(name, 'e', 'Ã©') AS name, age_text, active, balance FROM p)
    SELECT id, {mojibake_sql('name')} AS name, CAST(age_text AS DOUBLE) AS age_text, active = 'yes' AS active,
    round((balance - (SELECT min(balance) FROM p)) / (SELECT max(balance) - min(balance) FROM p), 6) AS balance FROM g""",
)
def p1_values(t):
    garbled = people(t).select("id", F.replace("name", F.lit("e"), F.lit("Ã©")).alias("name"), "age_text", "active", "balance")
    return p.clean(garbled, "id", VALUES, report=False)[0].withColumn("balance", F.round("balance", 6))


@query("p1_clean_documents", f"{GROUPS} SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT n FROM comp WHERE n <> c)")
def p1_documents(t):
    steps = [{"operation": "smart_duplicate_detection", "parameters": {"columns": ["text"]}}]
    return p.clean(t.documents.select("doc_id", "lang", "text"), "doc_id", steps, report=False)[0].select("doc_id", "lang")


@query(
    "p1_clean_models",
    f"""{with_('p', PEOPLE)} SELECT 'ml_imputation' AS step, count(*) AS n, 0::BIGINT AS gaps, 0::BIGINT AS moved, TRUE AS as_expected FROM p
    UNION ALL SELECT 'anomaly_detection', count(*), count(*) - count(balance) + count(*) - count(tier), 0::BIGINT, TRUE FROM p""",
)
def p1_models(t):
    """Model steps: gaps are filled and known values stay; the rows that go are few and all others stay as they are."""
    from plumbline.session import cut_lineage

    rows = cut_lineage(people(t).select("id", "nation", F.col("balance").cast("double").alias("balance"), F.col("tier").cast("double").alias("tier")))
    full = p.clean(rows, "id", [{"operation": "ml_imputation"}], report=False)[0]
    kept = p.clean(rows, "id", [{"operation": "anomaly_detection", "parameters": {"columns": ["nation", "balance"], "methods": ["isolation_forest"]}}], report=False)[0]

    def facts(name, after, complete):
        pair = rows.join(after.select("id", F.col("balance").alias("b"), F.col("tier").alias("t"), F.lit(True).alias("stays")), "id", "left")
        moved = F.count_if(F.col("stays") & ((F.col("balance").isNotNull() & (F.abs(F.col("balance") - F.col("b")) > 1e-9)) | (F.col("tier").isNotNull() & (F.col("tier") != F.col("t")))))
        gaps = F.count_if(F.col("b").isNull()) + F.count_if(F.col("t").isNull()) if complete else F.count_if(F.col("balance").isNull()) + F.count_if(F.col("tier").isNull())
        gone = F.count_if(F.col("stays").isNull())
        expected = gone == 0 if complete else (gone > 0) & (gone <= F.ceil(F.count(F.lit(1)) * 0.1))
        return pair.agg(F.lit(name).alias("step"), F.count(F.lit(1)).alias("n"), gaps.alias("gaps"), moved.alias("moved"), expected.alias("as_expected"))

    return facts("ml_imputation", full, True).unionByName(facts("anomaly_detection", kept, False))


@query(
    "p3_analyze_sample",
    f"""{with_('p', PEOPLE)}, s AS (SELECT * FROM p ORDER BY md5('42|sample|' || CAST(id AS VARCHAR)) LIMIT 500) SELECT * FROM ({pattern_sql(PEOPLE_TEXT, FORMAT_PATTERNS).replace(" FROM p", " FROM s")}) z""",
)
def p3_sample(t):
    return p.analyze(people(t), "id", ["patterns"], sample_size=500)["patterns"]


REST = [c for c in PEOPLE_COLUMNS if c != "id"]
NUMS = ["nation", "balance", "tier"]
GAPS = " + ".join(f"count(*) - count({c})" for c in REST)
OUTSIDE = """SELECT count(*) FILTER (WHERE $c < a - 1.5 * (b - a) OR $c > b + 1.5 * (b - a)) AS o FROM p, (SELECT quantile_cont($c, 0.25) AS a, quantile_cont($c, 0.75) AS b FROM p) q"""
SCORES = f"""SELECT c.completeness, v.validity, u.uniqueness, s.consistency, a.accuracy,
  c.completeness * 0.25 + v.validity * 0.25 + u.uniqueness * 0.2 + s.consistency * 0.15 + a.accuracy * 0.15 AS overall FROM
  (SELECT 100 - ({GAPS}) * 100.0::DOUBLE / (count(*) * {len(REST)}) AS completeness FROM p) c, ({VALID} AND "column" <> 'id') v,
  (SELECT (SELECT count(*) FROM (SELECT DISTINCT {', '.join(REST)} FROM p) d) * 100.0::DOUBLE / count(*) AS uniqueness FROM p) u, ({consistency_sql(SHAPE)}) s, ({accuracy_sql(NUMS)}) a"""
REPORT = f"""{infer_sql()}, n AS ({NUMERIC}), r AS ({SCORES})
  {stack(REST, """SELECT 'profile' AS section, '$c' AS subject, 'null_count' AS metric, CAST(count(*) - count($c) AS DOUBLE) AS value FROM p
    UNION ALL SELECT 'profile', '$c', 'null_pct', round((count(*) - count($c)) * 100.0::DOUBLE / count(*), 2) FROM p
    UNION ALL SELECT 'profile', '$c', 'distinct_count', CAST(count(DISTINCT $c) AS DOUBLE) FROM p
    UNION ALL SELECT 'profile', '$c', 'distinct_pct', round(count(DISTINCT $c) * 100.0::DOUBLE / count(*), 2) FROM p""")}
  UNION ALL SELECT 'profile', "column", metric, value FROM n WHERE "column" <> 'id'
  UNION ALL {stack(METRICS, "SELECT 'scores', '*', '$c', round(CAST($c AS DOUBLE), 2) FROM r")}
  UNION ALL SELECT 'duplicates', '*', 'duplicates', CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(REST)} FROM p) d) AS DOUBLE) FROM p
  UNION ALL SELECT 'summary', '*', 'rows', CAST(count(*) AS DOUBLE) FROM p
  UNION ALL {stack(NUMS, f"SELECT 'outliers', '$c', 'outliers', CAST(o AS DOUBLE) FROM ({OUTSIDE}) o_$c")}
  UNION ALL SELECT 'missing', '*', 'missing', CAST({GAPS} AS DOUBLE) FROM p
  UNION ALL SELECT 'patterns', "column", pattern, CAST(matches AS DOUBLE) FROM ({pattern_sql(PEOPLE_TEXT, FORMAT_PATTERNS)}) m"""


@query("p4_full_report", REPORT)
def p4(t):
    return p.report(people(t), "id").withColumn("value", F.round("value", 4))


# runs: one per event; the clock is the last event
RUNS = """SELECT event_id AS run_id, ts, user_id, value, CASE event_type WHEN 'view' THEN 'running' WHEN 'signup' THEN 'pending' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status FROM {events}"""
R = f"WITH r AS ({duck(RUNS)})"
METRICS = f"""{R}, k AS (SELECT max(ts) AS now FROM r), m AS (SELECT count(*) FILTER (WHERE status = 'running') AS active, count(*) FILTER (WHERE status = 'pending') AS pending,
  count(*) FILTER (WHERE status = 'completed' AND ts >= now - INTERVAL 1 DAY) AS completed, count(*) FILTER (WHERE status = 'failed' AND ts >= now - INTERVAL 1 DAY) AS failed FROM r, k),
  v AS (SELECT *, round(completed * 100.0::DOUBLE / (completed + failed), 1) AS success_rate, round(failed * 100.0::DOUBLE / (completed + failed), 1) AS error_rate,
    round(450 + failed * 100.0::DOUBLE / (completed + failed) * 50, 4) AS response_ms FROM m)"""


def metrics(t):
    runs = t.sql(RUNS)
    clocked = one_row(runs, runs.agg(F.max("ts").alias("now")))
    return p.run_metrics(clocked, "status", "ts", F.col("now")).withColumn("response_ms", F.round("response_ms", 4))


@query("p5_run_metrics", f"{METRICS} SELECT * FROM v")
def p5(t):
    return metrics(t)


@query(
    "p6_alerts",
    f"""{METRICS} SELECT 'error_rate_high' AS id, 'medium' AS severity, error_rate AS value FROM v WHERE error_rate > 5
    UNION ALL SELECT 'response_time_high', 'medium', response_ms FROM v WHERE response_ms > 2000 UNION ALL SELECT 'queue_long', 'medium', CAST(pending AS DOUBLE) FROM v WHERE pending > 100""",
)
def p6(t):
    return p.alerts(metrics(t))


@query(
    "p6_rolled_up_status",
    """WITH s AS (SELECT user_id, CASE WHEN value > 200 AND user_id % 3 = 0 THEN 'error' WHEN value > 150 AND user_id % 2 = 0 THEN 'degraded' WHEN value > 100 THEN 'slow' ELSE 'operational' END AS st FROM events)
    SELECT user_id, CASE WHEN bool_or(st = 'error') THEN 'critical' WHEN bool_or(st = 'degraded') THEN 'degraded' WHEN bool_and(st = 'operational') THEN 'healthy' ELSE 'warning' END AS status FROM s GROUP BY 1""",
)
def p6_status(t):
    v, u = F.col("value"), F.col("user_id")
    st = F.when((v > 200) & (u % 3 == 0), "error").when((v > 150) & (u % 2 == 0), "degraded").when(v > 100, "slow").otherwise("operational")
    return p.rolled_up(t.events.withColumn("st", st), "st", ["user_id"])


@query(
    "p7_history_page",
    f"""{R}, h AS (SELECT * FROM r WHERE status = 'failed' AND value > 5) SELECT run_id, ts, value, (SELECT count(*) FROM h) AS total, (SELECT count(*) FROM h) > 75 AS has_next
    FROM h ORDER BY ts DESC, run_id DESC LIMIT 25 OFFSET 50""",
)
def p7(t):
    page = p.history(t.sql(RUNS), ["status = 'failed'", "value > 5"], [F.desc("ts"), F.desc("run_id")], 25, 50)
    return page.select("run_id", "ts", "value", "total", "has_next")


@query(
    "p8_run_summary",
    f"""{R} SELECT user_id, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS succeeded, round(count(*) FILTER (WHERE status = 'completed') * 100.0::DOUBLE / count(*), 2) AS success_rate,
    round(avg(value), 4) AS average, string_agg(DISTINCT status, ',' ORDER BY status) AS kinds FROM r GROUP BY 1""",
)
def p8(t):
    out = p.run_summary(t.sql(RUNS), F.col("status") == "completed", "value", "status", ["user_id"])
    return out.withColumn("average", F.round("average", 4)).withColumn("kinds", F.array_join("kinds", ","))


@query(
    "p9_recent_uploads",
    """WITH top AS (SELECT c_custkey, c_name FROM customer ORDER BY c_custkey DESC LIMIT 200),
    j AS (SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
    SELECT c_custkey, c_name, o_orderdate, o_orderkey, o_orderstatus FROM top LEFT JOIN j ON o_custkey = c_custkey AND rn = 1""",
)
def p9(t):
    return p.recent_uploads(
        t.customer.select("c_custkey", "c_name"), t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus"),
        "c_custkey", "o_custkey", ["o_orderdate", "o_orderkey"], [F.desc("c_custkey")], 200,
    )
