"""Rules and features on injected tables."""

from pyspark.sql import functions as F

from plumbline.operators import features as f
from plumbline.operators import inject as i
from plumbline.plans.k_injection import injected_sql
from plumbline.plans.registry import query
from plumbline.session import cut_lineage
from plumbline.plans.shapes import CREDIT, LEDGER, SCORED, credit, ledger, payroll, scored, with_


def injected(df, families):
    """An injected table as a stored stage output: later stages scan it instead of redoing it."""
    return cut_lineage(i.inject(df, "row_id", families)[0])


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


LOG = "log10(greatest(abs({c}), 1e-9))"


@query("l1_safe_log10", f"{with_('b', LEDGER)} SELECT row_id, round({LOG.format(c='value')}, 6) AS log_value FROM b")
def l1(t):
    return ledger(t).select("row_id", F.round(f.safe_log10(F.col("value")), 6).alias("log_value"))


def z_ctes(src, value, by):
    """CTE ``z``: src plus the robust z of ``value`` within ``by``."""
    return f"""z1 AS (SELECT *, {value} AS lv FROM {src}), z2 AS (SELECT *, abs(lv - quantile_cont(lv, 0.5) OVER (PARTITION BY {by})) AS dev FROM z1),
      z3 AS (SELECT *, quantile_cont(dev, 0.5) OVER (PARTITION BY {by}) AS mad FROM z2),
      z AS (SELECT *, dev / CASE WHEN mad > 1e-6 THEN 1.4826::DOUBLE * mad ELSE 1 END AS z FROM z3)"""


@query("l2_robust_z", f"{with_('b', LEDGER)}, {z_ctes('b', LOG.format(c='value'), 'tag')} SELECT row_id, tag, round(z, 6) AS z FROM z")
def l2(t):
    logged = ledger(t).withColumn("lv", f.safe_log10(F.col("value")))
    return r6(f.robust_z(logged, "lv", ["tag"]).select("row_id", "tag", "z"), "z")


def rules_sql(rules):
    flags = ", ".join(f"CASE WHEN {r.predicate} THEN 1 ELSE 0 END AS {r.name}" for r in rules)
    total = " + ".join(f"{r.name} * {r.weight}::DOUBLE" for r in rules)
    return flags, f"least(1, greatest(0, {total}))"


LFLAGS, LRULE = rules_sql(f.LEDGER_RULES)
LEDGER_RULED = f"""{injected_sql('ledger', i.LEDGER_FAMILIES)}, {z_ctes('inj', LOG.format(c='value'), 'tag')},
  d AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY adsh, tag, value ORDER BY row_id) > 1 THEN 1 ELSE 0 END AS is_dup FROM z),
  g AS (SELECT *, {LFLAGS} FROM d)"""


def run_ledger(t):
    return f.ledger_rules(injected(ledger(t), i.LEDGER_FAMILIES))


@query("l3_ledger_rules", f"{LEDGER_RULED} SELECT row_id, sign_bad, dup_bad, period_bad, z_bad, round({LRULE}, 6) AS rule FROM g")
def l3(t):
    return r6(run_ledger(t).select("row_id", "sign_bad", "dup_bad", "period_bad", "z_bad", "rule"), "rule")


PFLAGS, PRULE = rules_sql(f.PAYROLL_RULES)
PAYROLL_RULED = f"""{injected_sql('payroll', i.PAYROLL_FAMILIES)}, {z_ctes('inj', LOG.format(c='regular_gross_paid + 1'), 'agency_name')},
  d AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY upper(last_name) || '|' || upper(agency_name) ORDER BY row_id) > 1 THEN 1 ELSE 0 END AS is_dup FROM z),
  g AS (SELECT *, {PFLAGS} FROM d)"""
PNAMES = [r.name for r in f.PAYROLL_RULES]


@query("l4_payroll_rules", f"{PAYROLL_RULED} SELECT row_id, {', '.join(PNAMES)}, round({PRULE}, 6) AS rule FROM g")
def l4(t):
    ruled = f.payroll_rules(injected(payroll(t), i.PAYROLL_FAMILIES))
    return r6(ruled.select("row_id", *PNAMES, "rule"), "rule")


CFLAGS, CRULE = rules_sql(f.CREDIT_RULES)
CREDIT_RULED = f"{injected_sql('credit', i.CREDIT_FAMILIES)}, g AS (SELECT *, {CFLAGS} FROM inj)"
CNAMES = [r.name for r in f.CREDIT_RULES]


@query("l5_credit_rules", f"{CREDIT_RULED} SELECT row_id, {', '.join(CNAMES)}, round({CRULE}, 6) AS rule FROM g")
def l5(t):
    ruled = f.credit_rules(injected(credit(t), i.CREDIT_FAMILIES))
    return r6(ruled.select("row_id", *CNAMES, "rule"), "rule")


@query("l6_feature_matrix", f"{LEDGER_RULED} SELECT row_id, {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in ['z', 'dup_bad', 'sign_bad', 'period_bad', 'qtrs'])}, round(lv, 6) AS log_value FROM g")
def l6(t):
    return r6(f.feature_matrix(run_ledger(t), "row_id", f.LEDGER_FEATURES), *f.LEDGER_FEATURES)


RULES = [
    f.Rule("late", "l_shipdate >= TIMESTAMP '2001-01-01'", 0.3),
    f.Rule("deep_discount", "l_discount >= 9e-2", 0.5),
    f.Rule("bulk", "l_quantity >= 49", 0.4),
    f.Rule("returned_open", "l_returnflag = 'R' AND l_linestatus = 'O'", 0.6),
]
RFLAGS, RRULE = rules_sql(RULES)


@query(
    "l7_rule_engine",
    f"WITH g AS (SELECT *, {RFLAGS} FROM lineitem) SELECT late, deep_discount, bulk, returned_open, round({RRULE}, 6) AS rule, count(*) AS n FROM g GROUP BY ALL",
)
def l7(t):
    out = f.rule_scores(t.lineitem, RULES)
    return out.groupBy("late", "deep_discount", "bulk", "returned_open", F.round("rule", 6).alias("rule")).agg(F.count(F.lit(1)).alias("n"))


FEATURES = ["limit_bal", "age", "bill_amt1", "pay_0", "pay_amt1", "education", "marriage", "sex"]
DEVS = ", ".join(f"abs({c} - quantile_cont({c}, 0.5) OVER ()) AS d_{c}" for c in FEATURES)
MEAN = "(" + " + ".join(
    f"d_{c} / (1.4826::DOUBLE * CASE WHEN quantile_cont(d_{c}, 0.5) OVER () > 1e-9 THEN quantile_cont(d_{c}, 0.5) OVER () ELSE 1 END)" for c in FEATURES
) + f") / {len(FEATURES)}"


@query("m1_stat_score", f"{with_('b', CREDIT)}, d AS (SELECT row_id, {DEVS} FROM b) SELECT row_id, round(1 - exp(-({MEAN}) / 4), 6) AS stat FROM d")
def m1(t):
    return r6(f.stat_score(f.feature_matrix(credit(t), "row_id", FEATURES), FEATURES).select("row_id", "stat"), "stat")


S = with_("s", SCORED)


@query("m2_fixed_hybrid", f"{S} SELECT row_id, round(0.35::DOUBLE * rule + 0.2::DOUBLE * stat + 0.3::DOUBLE * iforest + 0.15::DOUBLE * lof, 6) AS hybrid FROM s")
def m2(t):
    return r6(f.hybrid(scored(t)).select("row_id", "hybrid"), "hybrid")


@query("m3_max_fusion", f"{S} SELECT row_id, greatest(rule, stat, iforest, lof) AS hybrid_max FROM s")
def m3(t):
    return f.max_fusion(scored(t), ["rule", "stat", "iforest", "lof"]).select("row_id", "hybrid_max")
