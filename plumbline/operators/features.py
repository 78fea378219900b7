"""Rule engine, robust z-scores and per-dataset features."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.operators.duplicates import flag_repeats
from plumbline.operators.inject import POSITIVE_LIST
from plumbline.operators.order_stats import bounded_join, clipped, one_row, quantile_name, quantiles
from plumbline.session import is_small


def safe_log10(c: Column) -> Column:
    return F.log10(F.greatest(F.abs(c.cast("double")), F.lit(1e-9)))


def robust_z(df: DataFrame, value: str, by: Sequence[str], name: str = "z") -> DataFrame:
    """|value - group median| / (1.4826 x group MAD); a MAD of at most 1e-6 divides by one."""
    by = list(by)
    scale = lambda mad: F.when(mad > 1e-6, 1.4826 * mad).otherwise(1.0)
    if is_small(df, 2.0):
        w = W.partitionBy(*by)
        out = df.withColumn("_dev", F.abs(F.col(value) - F.median(value).over(w)))
        out = out.withColumn(name, F.col("_dev") / scale(F.median("_dev").over(w)))
        return out.select(*df.columns, name)
    med = quantiles(df, [value], [0.5], by).withColumnRenamed(quantile_name(value, 0), "_med")
    dev = bounded_join(df, med, by).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    mad = quantiles(dev, ["_dev"], [0.5], by).withColumnRenamed(quantile_name("_dev", 0), "_mad")
    out = bounded_join(dev, mad, by)
    return out.withColumn(name, F.col("_dev") / scale(F.col("_mad"))).select(*df.columns, name)


class Rule(NamedTuple):
    name: str
    predicate: str
    weight: float


def rule_scores(df: DataFrame, rules: Sequence[Rule], name: str = "rule") -> DataFrame:
    """Adds one 0/1 flag per rule and the weighted sum clipped to [0, 1]."""
    flagged = df.withColumns({r.name: F.coalesce(F.expr(r.predicate), F.lit(False)).cast("int") for r in rules})
    total = reduce(lambda a, b: a + b, [F.col(r.name) * F.lit(float(r.weight)) for r in rules])
    return flagged.withColumn(name, clipped(total, 0.0, 1.0))


# fixed values: rules and weights of the three datasets
LEDGER_RULES = [
    Rule("sign_bad", f"tag IN ({POSITIVE_LIST}) AND value < 0", 0.6),
    Rule("dup_bad", "is_dup = 1", 0.6),
    Rule("period_bad", "floor(ddate / 10000) < 2018 OR floor(ddate / 10000) > 2026", 0.6),
    Rule("z_bad", "z > 4", 0.4),
]
PAYROLL_RULES = [
    Rule("per_annum_low", "pay_basis = 'per Annum' AND base_salary > 10000 AND regular_gross_paid < 5e-2 * base_salary", 0.6),
    Rule("ot_no_regular", "regular_hours = 0 AND total_ot_paid > 0", 0.6),
    Rule("dup_bad", "is_dup = 1", 0.5),
    Rule(
        "title_wrong",
        "(upper(title_description) LIKE '%TEACHER%' AND upper(agency_name) NOT LIKE '%EDUCATION%' AND upper(agency_name) NOT LIKE '%DEPT OF ED%')"
        " OR (upper(title_description) LIKE '%FIREFIGHTER%' AND upper(agency_name) NOT LIKE '%FIRE%')"
        " OR (upper(title_description) LIKE '%LIBRARIAN%' AND upper(agency_name) NOT LIKE '%LIBRARY%'"
        " AND upper(agency_name) NOT LIKE '%POLICE%' AND upper(agency_name) NOT LIKE '%EDUCATION%')",
        0.5,
    ),
    Rule("z_bad", "z > 4", 0.4),
]
CREDIT_RULES = [
    Rule("education_bad", "education NOT IN (0, 1, 2, 3, 4, 5, 6)", 0.7),
    Rule("limit_bad", "limit_bal = 0 AND bill_amt1 > 0 AND default_next = 0", 0.6),
    Rule("bill_negative", "bill_amt1 < 0", 0.5),
    Rule("pay_conflict", "pay_0 = -2 AND bill_amt1 > 5000", 0.6),
    Rule("age_bad", "age < 18 OR age > 95", 0.7),
]
LEDGER_FEATURES = ["log_value", "z", "dup_bad", "sign_bad", "period_bad", "qtrs"]
PAYROLL_FEATURES = [
    "base_salary", "regular_gross_paid", "regular_hours", "total_ot_paid", "log_gross", "z",
    "per_annum_low", "ot_no_regular", "dup_bad", "title_wrong",
]
CREDIT_FEATURES = [
    "limit_bal", "age", "bill_amt1", "pay_0", "pay_amt1", "education", "marriage", "sex",
    "education_bad", "limit_bad", "bill_negative", "pay_conflict", "age_bad",
]


def ledger_rules(df: DataFrame, key: str = "row_id") -> DataFrame:
    logged = df.withColumn("log_value", safe_log10(F.col("value")))
    flagged = flag_repeats(robust_z(logged, "log_value", ["tag"]), ["adsh", "tag", "value"], key, "is_dup")
    return rule_scores(flagged, LEDGER_RULES)


def payroll_rules(df: DataFrame, key: str = "row_id") -> DataFrame:
    filled = df.fillna(0.0, ["base_salary", "regular_gross_paid", "regular_hours", "total_ot_paid"])
    logged = filled.withColumn("log_gross", safe_log10(F.col("regular_gross_paid") + 1))
    name = F.concat_ws("|", F.upper(F.coalesce("last_name", F.lit(""))), F.upper(F.coalesce("agency_name", F.lit(""))))
    flagged = flag_repeats(robust_z(logged, "log_gross", ["agency_name"]), [name], key, "is_dup")
    return rule_scores(flagged, PAYROLL_RULES)


def credit_rules(df: DataFrame, key: str = "row_id") -> DataFrame:
    return rule_scores(df, CREDIT_RULES)


def feature_matrix(df: DataFrame, key: str, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Key plus one double column per feature; gaps become zero."""
    return df.select(key, *keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])


def stat_score(df: DataFrame, features: Sequence[str], name: str = "stat") -> DataFrame:
    """1 - exp(-mean robust z / 4) over the features, from global medians and MADs."""
    cols = list(features)
    med = quantiles(df, cols, [0.5])
    dev = one_row(df, med).withColumns({f"_d_{c}": F.abs(F.col(c) - F.col(quantile_name(c, 0))) for c in cols})
    mad = quantiles(dev, [f"_d_{c}" for c in cols], [0.5])
    z = [
        F.col(f"_d_{c}") / (1.4826 * F.when(F.col(quantile_name(f"_d_{c}", 0)) > 1e-9, F.col(quantile_name(f"_d_{c}", 0))).otherwise(1.0))
        for c in cols
    ]
    mean = reduce(lambda a, b: a + b, z) / len(cols)
    return one_row(dev, mad).withColumn(name, 1 - F.exp(-mean / 4)).select(*df.columns, name)


# fixed values: weights of the fixed hybrid
HYBRID_WEIGHTS = {"rule": 0.35, "stat": 0.20, "iforest": 0.30, "lof": 0.15}


def hybrid(df: DataFrame, weights: dict[str, float] | None = None, name: str = "hybrid") -> DataFrame:
    w = weights or HYBRID_WEIGHTS
    total = sum(w.values())
    return df.withColumn(name, reduce(lambda a, b: a + b, [F.col(c) * (v / total) for c, v in w.items()]))


def max_fusion(df: DataFrame, columns: Sequence[str], name: str = "hybrid_max") -> DataFrame:
    return df.withColumn(name, F.greatest(*columns))
