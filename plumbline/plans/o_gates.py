"""Quarantine, repair and the downstream-query gate on the injected payroll and credit tables."""

from pyspark.sql import functions as F

from plumbline.operators import features as ft
from plumbline.operators import gates as g
from plumbline.operators.inject import CREDIT_FAMILIES, PAYROLL_FAMILIES
from plumbline.operators.profile import numeric_columns
from plumbline.plans.gate_suite import GATE_QUERIES
from plumbline.plans.k_injection import SHAPES, injected_sql
from plumbline.plans.l_features import LOG, injected, rules_sql, z_ctes
from plumbline.plans.registry import duck, query
from plumbline.plans.shapes import credit, payroll
from plumbline.session import cut_lineage

TAU = 0.5

DATASETS = {
    "payroll": (payroll, PAYROLL_FAMILIES, ft.payroll_rules), "credit": (credit, CREDIT_FAMILIES, ft.credit_rules),
}


def table(t, name):
    """Truth, scored dirty table and provenance of one dataset."""
    make, families, rules = DATASETS[name]
    truth = cut_lineage(make(t))
    dirty = injected(truth, families)
    scored = cut_lineage(dirty.join(rules(dirty).select("row_id", F.round("rule", 6).alias("score")), "row_id"))
    prov = cut_lineage(g.provenance(scored, truth, "row_id", "score", TAU))
    return g.GateTables(truth, scored, prov, "row_id", "score", TAU)


def results(t):
    return cut_lineage(g.run_gate(t.spark, GATE_QUERIES, {name: table(t, name) for name in DATASETS}))


def per_query(t):
    return cut_lineage(g.compare(results(t)))


# --- the same in SQL -------------------------------------------------------------------------------


def _numeric(shape):
    text, _, columns = SHAPES[shape]
    from plumbline.plans.k_injection import TEXT

    return [c for c in columns if c not in TEXT and c != "row_id"]


def scored_sql(shape):
    """CTEs <shape>_true, <shape>_dirty (with score) and <shape>_prov."""
    families, rules = (PAYROLL_FAMILIES, ft.PAYROLL_RULES) if shape == "payroll" else (CREDIT_FAMILIES, ft.CREDIT_RULES)
    flags, total = rules_sql(rules)
    head = injected_sql(shape, families)
    if shape == "payroll":
        chain = f"""{z_ctes('inj', LOG.format(c='regular_gross_paid + 1'), 'agency_name')},
          d AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY upper(last_name) || '|' || upper(agency_name) ORDER BY row_id) > 1 THEN 1 ELSE 0 END AS is_dup FROM z)"""
        body = f"SELECT *, round({total}, 6) AS score FROM (SELECT *, {flags} FROM d) q"
        scored = f"{head}, {chain} {body}"
    else:
        scored = f"{head} SELECT *, round({total}, 6) AS score FROM (SELECT *, {flags} FROM inj) q"
    odd = ", ".join(
        f"CASE WHEN abs(({c} - (SELECT avg({c}) FROM {shape}_true)) / (SELECT CASE WHEN stddev_samp({c}) = 0 THEN 1 ELSE stddev_samp({c}) END FROM {shape}_true)) > 3 THEN '{c}' END"
        for c in _numeric(shape)
    )
    return f"""{shape}_true AS MATERIALIZED ({duck(SHAPES[shape][0])}), {shape}_dirty AS MATERIALIZED ({scored}),
      {shape}_prov AS MATERIALIZED (SELECT row_id, CASE WHEN row_id IN (SELECT row_id FROM {shape}_true) THEN list_filter([{odd}], lambda x: x IS NOT NULL) ELSE ['STRUCTURAL'] END AS columns
        FROM {shape}_dirty WHERE score >= {TAU})"""


def condition_sql(shape, condition, columns=()):
    cols = ", ".join(SHAPES[shape][2])
    if condition == "true":
        return f"(SELECT {cols} FROM {shape}_true)"
    base = f"SELECT {cols} FROM {shape}_dirty"
    if condition == "dirty":
        return f"({base})"
    if condition == "clean":
        return f"({base} WHERE score < {TAU})"
    if condition == "repaired":
        return f"({base} WHERE score < {TAU} UNION ALL SELECT {cols} FROM {shape}_true WHERE row_id IN (SELECT row_id FROM {shape}_dirty WHERE score >= {TAU}))"
    used = "[" + ", ".join(f"'{c}'" for c in columns) + "]"
    return f"""({base} WHERE score < {TAU} OR row_id IN (SELECT row_id FROM {shape}_prov WHERE NOT list_contains(columns, 'STRUCTURAL')
      AND (len(columns) = 0 OR NOT list_has_any(columns, {used}))))"""


TEXT_RESULTS = {"agency_name", "title_description", "work_location_borough", "pay_basis"}


def _outputs(q):
    """Output names of a suite query with whether they are text."""
    return [(n, n in TEXT_RESULTS) for n in q.outputs]


def results_cte():
    rows = []
    for q in GATE_QUERIES:
        outs = _outputs(q)
        cell = [f"coalesce(lower(trim({n})), 'NULL')" if txt else f"coalesce(CAST(round(CAST({n} AS DOUBLE), 4) + 0.0 AS VARCHAR), 'NULL')" for n, txt in outs]
        num = ["CAST(NULL AS DOUBLE)" if txt else f"CAST({n} AS DOUBLE)" for n, txt in outs]
        for c in ["true", *g.CONDITIONS]:
            sql = q.sql.replace("{table}", f"{condition_sql(q.dataset, c, q.columns)} src")
            rows.append(
                f"SELECT '{q.id}' AS query_id, '{q.dataset}' AS dataset, '{q.stratum}' AS stratum, '{q.kind}' AS kind, '{c}' AS condition, {cell[0]} AS first, "
                f"{' || chr(124) || '.join(cell)} AS row, [{', '.join(num)}] AS nums FROM ({sql}) r"
            )
    return f"WITH {scored_sql('payroll')}, {scored_sql('credit')}, res AS MATERIALIZED ({' UNION ALL '.join(rows)})"


RESULTS = results_cte()
COMPARED = RESULTS + f"""
, k AS (SELECT DISTINCT query_id, dataset, stratum, kind, unnest({g.CONDITIONS}) AS condition FROM res WHERE condition = 'true'),
rr AS (SELECT query_id, row, count(*) AS r FROM res WHERE condition = 'true' GROUP BY 1, 2),
cc AS (SELECT query_id, condition, row, count(*) AS c FROM res WHERE condition <> 'true' GROUP BY 1, 2, 3),
sets AS (SELECT query_id, condition, sum(r) AS n_ref, sum(c) AS n_cand, count(*) AS n_union, count(*) FILTER (WHERE r > 0 AND c > 0) AS n_both,
  count(*) FILTER (WHERE c = 0) AS missing_rows, count(*) FILTER (WHERE r = 0) AS extra_rows, count(*) FILTER (WHERE r <> c) AS uneven
  FROM (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.condition, b.condition) AS condition, coalesce(r, 0) AS r, coalesce(c, 0) AS c
    FROM (SELECT rr.query_id, k.condition, row, r FROM rr JOIN k USING (query_id)) a FULL JOIN cc b ON a.query_id = b.query_id AND a.condition = b.condition AND a.row = b.row) j GROUP BY 1, 2),
pick AS (SELECT query_id, condition, first, min_by(nums, row) AS other FROM res WHERE condition <> 'true' GROUP BY 1, 2, 3),
cells AS (SELECT p.query_id, p.condition, unnest(r.nums) AS a, unnest(p.other) AS b FROM res r JOIN pick p ON r.query_id = p.query_id AND r.first = p.first WHERE r.condition = 'true'),
errs AS (SELECT query_id, condition, avg(e) AS mean_cell, quantile_cont(e, 0.5) AS median_cell, max(e) AS max_cell
  FROM (SELECT query_id, condition, abs(a - b) / greatest(abs(a), 1e-9) AS e FROM cells WHERE a IS NOT NULL AND b IS NOT NULL) e GROUP BY 1, 2),
val AS (SELECT query_id, condition, max(nums[1]) AS v FROM res WHERE kind = 'scalar' GROUP BY 1, 2),
j AS (SELECT k.*, n_ref, n_cand, n_union, n_both, missing_rows, extra_rows, uneven, mean_cell, median_cell, max_cell, abs(t.v - c.v) AS delta, abs(t.v) AS ref_abs
  FROM k LEFT JOIN sets USING (query_id, condition) LEFT JOIN errs USING (query_id, condition)
  LEFT JOIN val t ON t.query_id = k.query_id AND t.condition = 'true' LEFT JOIN val c ON c.query_id = k.query_id AND c.condition = k.condition),
x AS (SELECT *, CASE WHEN kind = 'scalar' THEN coalesce(delta / greatest(ref_abs, 1e-9), 1) ELSE greatest(1 - n_both * 1.0::DOUBLE / n_union, coalesce(max_cell, 0)) END AS rel,
  CASE WHEN n_ref <> n_cand THEN 'row_count_diff' WHEN kind = 'scalar' THEN CASE WHEN coalesce(delta > greatest(1e-4, 1e-6 * ref_abs), true) THEN 'value_diff' ELSE 'within_float_tolerance' END
    WHEN uneven > 0 THEN 'value_diff' ELSE 'match' END AS verdict FROM j),
pq AS MATERIALIZED (SELECT query_id, dataset, stratum, kind, condition, verdict, verdict IN ('row_count_diff', 'value_diff') AS is_error, CASE WHEN kind = 'scalar' THEN delta END AS abs_err, rel AS rel_err,
  CASE WHEN kind = 'scalar' THEN CAST(rel < 1e-6 AS DOUBLE) ELSE n_both * 1.0::DOUBLE / n_union END AS jaccard, CASE WHEN kind = 'scalar' THEN 0 ELSE missing_rows END AS missing_rows,
  CASE WHEN kind = 'scalar' THEN 0 ELSE extra_rows END AS extra_rows, CAST(n_cand - n_ref AS BIGINT) AS row_delta, CASE WHEN kind = 'scalar' THEN rel ELSE mean_cell END AS mean_cell_err,
  CASE WHEN kind = 'scalar' THEN rel ELSE median_cell END AS median_cell_err, CASE WHEN kind = 'scalar' THEN rel ELSE max_cell END AS max_cell_err FROM x),
st AS (SELECT * FROM pq UNION ALL SELECT * REPLACE ('all' AS stratum) FROM pq)"""

ONE = f"WITH {scored_sql('credit')}"
CCOLS = ", ".join(SHAPES["credit"][2])


@query("o1_quarantine", f"{ONE} SELECT row_id, score FROM credit_dirty WHERE score < {TAU}")
def o1(t):
    return g.quarantine(table(t, "credit").dirty, "score", TAU).select("row_id", "score")


@query("o2_repair", f"{ONE} SELECT * FROM {condition_sql('credit', 'repaired')} r")
def o2(t):
    c = table(t, "credit")
    return g.repair(c.dirty, c.truth, "row_id", "score", TAU)


@query("o2_repair_added_rows", f"WITH {scored_sql('payroll')} SELECT row_id, last_name, agency_name FROM {condition_sql('payroll', 'repaired')} r")
def o2_payroll(t):
    p = table(t, "payroll")
    return g.repair(p.dirty, p.truth, "row_id", "score", TAU).select("row_id", "last_name", "agency_name")


@query("o3_column_provenance", f"WITH {scored_sql('payroll')} SELECT row_id, array_to_string(columns, ',') AS columns FROM payroll_prov")
def o3(t):
    return table(t, "payroll").prov.select("row_id", F.array_join("columns", ",").alias("columns"))


@query(
    "o4_coupled_reinstatement",
    f"WITH {scored_sql('payroll')} SELECT row_id, total_ot_paid FROM {condition_sql('payroll', 'coupled', ['total_ot_paid', 'regular_hours'])} r",
)
def o4(t):
    p = table(t, "payroll")
    return g.coupled(p.dirty, p.prov, "row_id", "score", TAU, ["total_ot_paid", "regular_hours"]).select("row_id", "total_ot_paid")


@query("o5_gate_results", f"{RESULTS} SELECT query_id, condition, count(*) AS rows, round(sum(coalesce(nums[-1], 0)), 3) AS last_sum FROM res GROUP BY 1, 2")
def o5(t):
    last = F.coalesce(F.element_at("nums", -1), F.lit(0.0))
    return results(t).groupBy("query_id", "condition").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum(last), 3).alias("last_sum"))


@query("o6_result_comparison", f"{COMPARED} SELECT query_id, condition, verdict, is_error, round(abs_err, 3) AS abs_err FROM pq")
def o6(t):
    return per_query(t).select("query_id", "condition", "verdict", "is_error", F.round("abs_err", 3).alias("abs_err"))


MAG = ["rel_err", "jaccard", "mean_cell_err", "median_cell_err", "max_cell_err"]


@query("o7_error_magnitudes", f"{COMPARED} SELECT query_id, condition, missing_rows, extra_rows, row_delta, {', '.join(f'round({c}, 5) AS {c}' for c in MAG)} FROM pq")
def o7(t):
    return per_query(t).select("query_id", "condition", "missing_rows", "extra_rows", "row_delta", *[F.round(c, 5).alias(c) for c in MAG])


@query(
    "o8_error_rates",
    f"""{COMPARED} SELECT condition, stratum, count(*) AS queries, count(*) FILTER (WHERE is_error) AS wrong, round(count(*) FILTER (WHERE is_error) * 100.0::DOUBLE / count(*), 1) AS pct
    FROM st GROUP BY 1, 2""",
)
def o8(t):
    return g.error_rates(per_query(t))


@query(
    "o8_joint_required",
    f"""{COMPARED}, f AS (SELECT stratum, query_id, bool_or(is_error) FILTER (WHERE condition = 'dirty') AS a, bool_or(is_error) FILTER (WHERE condition = 'clean') AS b,
      bool_or(is_error) FILTER (WHERE condition = 'coupled') AS c FROM st GROUP BY 1, 2)
    SELECT stratum, count(*) AS queries, count(*) FILTER (WHERE a AND b AND NOT c) AS joint_required FROM f GROUP BY 1""",
)
def o8_joint(t):
    return g.joint_required(per_query(t), "dirty", "clean", "coupled")


@query(
    "o9_error_distribution",
    f"""{COMPARED} SELECT condition, stratum, count(rel_err) AS n, round(min(rel_err), 3) AS min, round(quantile_cont(rel_err, 0.5), 3) AS median, round(quantile_cont(rel_err, 0.75), 3) AS p75,
    round(quantile_cont(rel_err, 0.9), 3) AS p90, round(max(rel_err), 3) AS max, round(avg(rel_err), 2) AS mean FROM st GROUP BY 1, 2""",
)
def o9(t):
    # a reference answer of zero makes errors of 1e11, so quantiles and mean are compared at fewer digits
    out = g.error_distribution(per_query(t)).withColumn("mean", F.round("mean", 2))
    return out.withColumns({c: F.round(c, 3) for c in ("min", "median", "p75", "p90", "max")})


@query(
    "o10_materiality",
    f"""{COMPARED} SELECT condition, stratum, threshold, count(rel_err) AS n, round(count(*) FILTER (WHERE rel_err > threshold) * 100.0::DOUBLE / count(rel_err), 1) AS pct
    FROM st, (SELECT unnest([0.001, 0.01, 0.05])::DOUBLE AS threshold) m GROUP BY 1, 2, 3""",
)
def o10(t):
    return g.materiality(per_query(t))


MED = ", ".join(f"round(quantile_cont(rel_err, 0.5) FILTER (WHERE condition = '{c}'), 6) AS {c}" for c in g.CONDITIONS)


@query(
    "o11_coupled_comparison",
    f"""{COMPARED}, m AS (SELECT stratum, count(DISTINCT query_id) AS queries, {MED} FROM st GROUP BY 1)
    SELECT stratum, queries, dirty, clean, repaired, coupled,
    least(dirty, clean, repaired) AS best_single, coupled < least(dirty, clean, repaired) AS coupled_better FROM m""",
)
def o11(t):
    return g.coupled_comparison(per_query(t))


@query(
    "o12_analyst_cost",
    f"""WITH {scored_sql('payroll')}, {scored_sql('credit')}, u AS (SELECT 'payroll' AS dataset, y, score FROM payroll_dirty UNION ALL SELECT 'credit', y, score FROM credit_dirty)
    SELECT dataset, count(*) FILTER (WHERE score >= {TAU}) AS n_quarantined, count(*) FILTER (WHERE score >= {TAU} AND y = 1) AS n_tp, count(*) FILTER (WHERE score >= {TAU} AND y = 0) AS n_fp,
    round(count(*) FILTER (WHERE score >= {TAU} AND y = 0) * 1.0::DOUBLE / count(*) FILTER (WHERE score >= {TAU}), 4) AS fp_fraction, count(*) FILTER (WHERE score < {TAU} AND y = 1) AS n_escaped,
    count(*) FILTER (WHERE y = 1) AS n_positive FROM u GROUP BY 1""",
)
def o12(t):
    both = [table(t, d).dirty.select(F.lit(d).alias("dataset"), "y", "score") for d in ("payroll", "credit")]
    return g.analyst_cost(both[0].unionByName(both[1]), "y", "score", TAU, ["dataset"])


PAIRS = ", ".join(f"('{k}', '{c}')" for k, v in g.FAMILY_COLUMNS.items() for c in v)


@query(
    "o13_column_risk",
    f"""WITH {scored_sql('payroll')} SELECT m.family, m.col AS "column", count(*) AS injected, count(*) FILTER (WHERE score >= {TAU}) AS quarantined,
    round(count(*) FILTER (WHERE score >= {TAU}) * 1.0::DOUBLE / count(*), 6) AS rate,
    round(count(*) FILTER (WHERE score >= {TAU}) * 1.0::DOUBLE / (SELECT count(*) FROM payroll_dirty WHERE score >= {TAU}), 6) AS risk_mass
    FROM payroll_dirty d JOIN (VALUES {PAIRS}) m(family, col) ON m.family = d.family GROUP BY 1, 2""",
)
def o13(t):
    out = g.column_risk(table(t, "payroll").dirty, "family", "score", TAU)
    return out.withColumns({c: F.round(c, 6) for c in ("rate", "risk_mass")})


@query(
    "o14_lane_matrix",
    f"""{COMPARED}, r AS (SELECT query_id, CASE bool_or(is_error) FILTER (WHERE condition = 'dirty') WHEN true THEN 'high' WHEN false THEN 'medium' ELSE 'low' END AS data_risk,
      CASE bool_or(is_error) FILTER (WHERE condition = 'clean') WHEN true THEN 'high' WHEN false THEN 'medium' ELSE 'low' END AS sql_risk FROM pq GROUP BY 1)
    SELECT *, CASE WHEN data_risk = 'low' AND sql_risk = 'low' THEN 'auto-promote' WHEN data_risk = 'medium' OR sql_risk = 'medium' THEN 'review' ELSE 'block' END AS outcome FROM r""",
)
def o14(t):
    return g.lane_matrix(per_query(t))


# an outcome table: one attempt per line item
OUTCOMES = """SELECT l_returnflag AS source, l_linestatus AS target, l_linenumber AS difficulty, l_quantity * 25e-1 AS complexity, l_discount < 8e-2 AS ok, l_extendedprice AS latency FROM {lineitem}"""
RATES = "count(*) AS n, round(avg(CAST(ok AS INTEGER)), 6) AS success_rate, round(avg(latency), 4) AS latency_mean, round(quantile_cont(latency, 0.95), 4) AS latency_p95 FROM b GROUP BY ALL"
BUCKET = "CASE " + " ".join(f"WHEN complexity <= {a} THEN '{b}'" for a, b in g.COMPLEXITY) + " ELSE '[100+]' END"


def rates(df):
    return df.withColumns({"success_rate": F.round("success_rate", 6), "latency_mean": F.round("latency_mean", 4), "latency_p95": F.round("latency_p95", 4)})


@query("o15_rates_by_pair", f"WITH b AS ({duck(OUTCOMES)}) SELECT source, target, {RATES}")
def o15(t):
    return rates(g.rate_matrix(t.sql(OUTCOMES), ["source", "target"], "ok", "latency"))


@query("o15_rates_by_difficulty", f"WITH b AS ({duck(OUTCOMES)}) SELECT difficulty, {RATES}")
def o15_difficulty(t):
    return rates(g.rate_matrix(t.sql(OUTCOMES), ["difficulty"], "ok", "latency"))


@query("o15_rates_by_complexity", f"WITH b AS ({duck(OUTCOMES)}) SELECT {BUCKET} AS bucket, {RATES}")
def o15_complexity(t):
    return rates(g.rate_matrix(t.sql(OUTCOMES).withColumn("bucket", g.complexity_bucket(F.col("complexity"))), ["bucket"], "ok", "latency"))


@query(
    "o15_rate_pivot",
    f"""WITH b AS ({duck(OUTCOMES)}) SELECT source, round(avg(CAST(ok AS INTEGER)) FILTER (WHERE target = 'F'), 6) AS F, round(avg(CAST(ok AS INTEGER)) FILTER (WHERE target = 'O'), 6) AS O FROM b GROUP BY 1""",
)
def o15_pivot(t):
    out = g.rate_pivot(t.sql(OUTCOMES), "source", "target", ["F", "O"], "ok")
    return out.withColumns({"F": F.round("F", 6), "O": F.round("O", 6)})


FAILURES = """SELECT event_id, event_type <> 'error' AS ok, CASE user_id % 6 WHEN 0 THEN 'json_extract' WHEN 1 THEN 'date_format' WHEN 2 THEN 'pivot_table' WHEN 3 THEN 'simple_select'
  WHEN 4 THEN 'qualify_clause' ELSE 'insert_ignore' END AS name, CASE WHEN event_id % 13 = 0 THEN 'parse: unexpected token' ELSE 'mismatch' END AS error FROM {events}"""
CAUSE = """CASE WHEN starts_with(error, 'parse:') THEN 'Parse error' WHEN regexp_matches(name, 'json|array|lateral|generate_series|listen_notify|qualify') THEN 'Dialect-specific construct'
  WHEN regexp_matches(name, 'format|convert|date') THEN 'Function semantics' WHEN regexp_matches(name, 'ignore|stream|pivot') THEN 'DML / DDL extension' ELSE 'Decorator / footprint drift' END"""


@query("o16_failure_taxonomy", f"WITH b AS ({duck(FAILURES)}) SELECT {CAUSE} AS cause, count(*) AS n FROM b WHERE NOT ok GROUP BY 1")
def o16(t):
    return g.failure_taxonomy(t.sql(FAILURES), "ok", "name", "error")


@query("o16_top_offenders", f"WITH b AS ({duck(FAILURES)}) SELECT name, count(*) AS n FROM b WHERE NOT ok GROUP BY 1 ORDER BY n DESC, name LIMIT 10")
def o16_top(t):
    return g.top_offenders(t.sql(FAILURES), "ok", "name")


# two versions of a daily summary table
VERSION_A = "SELECT o_orderdate AS day, o_orderstatus AS status, count(*) AS n, CAST(max(o_custkey) AS BIGINT) AS top FROM {orders} GROUP BY o_orderdate, o_orderstatus"
VERSION_B = """SELECT o_orderdate AS day, o_orderstatus AS status, count(*) AS n, CAST(max(CASE WHEN o_custkey % 200 = 7 THEN 0 ELSE o_custkey END) AS BIGINT) AS top FROM {orders}
  WHERE o_orderkey % 97 <> 3 GROUP BY o_orderdate, o_orderstatus"""


@query(
    "o17_table_diff",
    f"""WITH a AS ({duck(VERSION_A)}), b AS ({duck(VERSION_B)}), j AS (SELECT coalesce(a.day, b.day) AS day, coalesce(a.status, b.status) AS status, a.n AS n1, b.n AS n2, a.top AS t1, b.top AS t2
      FROM a FULL JOIN b ON a.day = b.day AND a.status = b.status)
    SELECT day, status, '<row>' AS "column", CASE WHEN n1 IS NOT NULL THEN 'present' END AS a, CASE WHEN n2 IS NOT NULL THEN 'present' END AS b FROM j WHERE n1 IS NULL OR n2 IS NULL
    UNION ALL SELECT day, status, 'n', CAST(n1 AS VARCHAR), CAST(n2 AS VARCHAR) FROM j WHERE n1 <> n2 UNION ALL SELECT day, status, 'top', CAST(t1 AS VARCHAR), CAST(t2 AS VARCHAR) FROM j WHERE t1 <> t2""",
)
def o17(t):
    return g.table_diff(t.sql(VERSION_A), t.sql(VERSION_B), ["day", "status"])
