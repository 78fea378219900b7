"""Quality scores, issue lists and recommendations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import patterns as P
from plumbline.operators.order_stats import one_row, quantile_name, quantiles
from plumbline.operators.profile import infer_types, long_values, numeric_columns, text_columns


def completeness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    cols = list(columns or df.columns)
    filled = reduce(lambda a, b: a + b, [F.count(c) for c in cols])
    return df.agg((filled * 100.0 / (F.count(F.lit(1)) * len(cols))).alias("completeness"))


def uniqueness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct rows / rows; NULL equals NULL, copies are counted before the shuffle."""
    cols = list(columns or df.columns)
    groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg((F.count(F.lit(1)) * 100.0 / F.sum("_n")).alias("uniqueness"))


def column_validity(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, inferred, score): 100 when storage matches content, 80 for text, 60 otherwise."""
    types = infer_types(df, columns).filter("inferred <> 'unknown'")
    score = (
        F.when(F.col("family") == "text", F.when(F.col("inferred").isin("text", "categorical"), 80.0).otherwise(60.0))
        .when(F.col("family") == F.col("inferred"), 100.0)
        .otherwise(60.0)
    )
    return types.withColumn("score", score)


def validity(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return column_validity(df, columns).agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("validity"))


def column_consistency(df: DataFrame, columns: Sequence[str] | None = None, compat: bool = False) -> DataFrame:
    """(column, shapes, consistency = 100 / number of distinct value shapes)."""
    cols = list(columns or text_columns(df))
    shaped = long_values(df, cols).select("column", P.shape(F.col("value"), compat).alias("shape")).distinct()
    return shaped.groupBy("column").agg(F.count(F.lit(1)).alias("shapes")).withColumn(
        "consistency", 100.0 / F.col("shapes")
    )


def consistency(df: DataFrame, columns: Sequence[str] | None = None, compat: bool = False) -> DataFrame:
    cols = list(columns if columns is not None else text_columns(df))
    if not cols:
        return df.sparkSession.range(1).select(F.lit(100.0).alias("consistency"))
    return column_consistency(df, cols, compat).agg(
        (F.coalesce(F.sum("consistency"), F.lit(0.0)) / len(cols)).alias("consistency")
    )


def accuracy(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """100 - 2 x share of IQR outliers over numeric columns with at least ten values; 85 if none."""
    cols = list(columns if columns is not None else numeric_columns(df))
    if not cols:
        return df.sparkSession.range(1).select(F.lit(85.0).alias("accuracy"))
    wide = one_row(df.select(*cols), quantiles(df, cols, [0.25, 0.75]))
    exprs = []
    for c in cols:
        lo, hi = F.col(quantile_name(c, 0)), F.col(quantile_name(c, 1))
        out = (F.col(c) < lo - 1.5 * (hi - lo)) | (F.col(c) > hi + 1.5 * (hi - lo))
        exprs += [F.count(c).alias(f"{c}__n"), F.count_if(out).alias(f"{c}__o")]
    agg = wide.agg(*exprs)
    ok = lambda c, m: F.when(F.col(f"{c}__n") >= 10, F.col(f"{c}__{m}")).otherwise(0)
    n = reduce(lambda a, b: a + b, [ok(c, "n") for c in cols])
    o = reduce(lambda a, b: a + b, [ok(c, "o") for c in cols])
    return agg.select(
        F.when(n == 0, 85.0).otherwise(F.greatest(F.lit(0.0), 100.0 - 200.0 * o / F.when(n > 0, n))).alias("accuracy")
    )


def overall(scores: DataFrame) -> DataFrame:
    """Weighted mean of a one-row score table."""
    return scores.withColumn(
        "overall",
        F.col("completeness") * 0.25 + F.col("validity") * 0.25 + F.col("uniqueness") * 0.2
        + F.col("consistency") * 0.15 + F.col("accuracy") * 0.15,
    )


METRICS = ["completeness", "validity", "uniqueness", "consistency", "accuracy", "overall"]


def score_row(df: DataFrame, columns: Sequence[str] | None = None, compat: bool = False) -> DataFrame:
    """All scores in one row, from one read of the table."""
    from plumbline.operators.facts import Facts

    found = Facts(df, list(columns or df.columns), compat).scores()
    return df.sparkSession.createDataFrame([tuple(found[m] for m in METRICS)], ", ".join(f"{m} double" for m in METRICS))


def quality_scores(df: DataFrame, columns: Sequence[str] | None = None, compat: bool = False) -> DataFrame:
    """(metric, score), rounded to two digits."""
    return score_row(df, columns, compat).select(
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.round(m, 2).alias("score")) for m in METRICS])
        ).alias("_cell")
    ).select("_cell.*")


def upload_scores(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Heuristic scores shown right after a load."""
    both = one_row(completeness(df, columns), uniqueness(df, columns))
    dup = 100 - F.col("uniqueness")
    return both.select(
        F.round("completeness", 2).alias("completeness"),
        F.round(F.greatest(F.lit(85.0), 100 - dup), 2).alias("accuracy"),
        F.round(F.greatest(F.lit(80.0), F.col("completeness") - 5), 2).alias("consistency"),
        F.lit(90.0).alias("validity"),
        F.round(F.greatest(F.lit(90.0), 100 - dup), 2).alias("uniqueness"),
    )


def improvement(before: DataFrame, after: DataFrame) -> DataFrame:
    """Gain in completeness and uniqueness, and their mean (percentage points)."""
    b = one_row(completeness(before), uniqueness(before)).toDF("c0", "u0")
    a = one_row(completeness(after), uniqueness(after)).toDF("c1", "u1")
    both = one_row(b, a).select(
        F.round(F.col("c1") - F.col("c0"), 2).alias("completeness"),
        F.round(F.col("u1") - F.col("u0"), 2).alias("uniqueness"),
    )
    return both.withColumn("overall", F.round((F.col("completeness") + F.col("uniqueness")) / 2, 2))


def issues(summary: DataFrame) -> DataFrame:
    """(type, severity, count, pct) from (type, count, pct) rows; empty issues are dropped."""
    pct = F.col("pct")
    severity = (
        F.when(F.col("type") == "duplicates", F.when(pct < 10, "medium").otherwise("high"))
        .when(F.col("type") == "outliers", F.when(pct < 5, "low").otherwise("medium"))
        .otherwise(F.when(pct < 20, "medium").otherwise("high"))
    )
    return summary.filter("count > 0").select("type", severity.alias("severity"), "count", "pct")


def issue_breakdown(summary: DataFrame) -> DataFrame:
    """Severity by count."""
    n = F.col("count")
    severity = F.when(
        F.col("type") == "outliers", F.when(n > 50, "medium").otherwise("low")
    ).otherwise(F.when(n > 100, "high").when(n > 10, "medium").otherwise("low"))
    return summary.filter("count > 0").select("type", "count", severity.alias("severity"))


def metric_status(scores: DataFrame) -> DataFrame:
    """(metric, score, status) for a long score table."""
    s = F.col("score")
    status = F.when(
        F.col("metric") == "consistency",
        F.when(s >= 95, "excellent").when(s >= 85, "good").otherwise("warning"),
    ).otherwise(F.when(s >= 90, "good").when(s >= 75, "warning").otherwise("poor"))
    return scores.withColumn("status", status)


def has_keyword(c, words: Sequence[str]):
    low = F.lower(c)
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def recommendations(profile: DataFrame, scores: DataFrame) -> DataFrame:
    """(kind, subject, detail) from a per-column profile (column, family, inferred, null_pct) and a
    one-row score table. Both are bounded by the schema."""
    typed = profile.filter("inferred <> family").select(
        F.lit("type_correction").alias("kind"), F.col("column").alias("subject"), F.col("inferred").alias("detail")
    )
    missing = profile.filter("null_pct > 0")
    facts = one_row(
        scores,
        missing.agg(
            F.coalesce(F.max(has_keyword(F.col("column"), P.BUSINESS_KEYWORDS).cast("int")), F.lit(0)).alias("business"),
            F.max("null_pct").alias("worst"),
        ),
    )
    facts = one_row(facts, typed.agg(F.count(F.lit(1)).alias("typed")))
    prio = lambda name, cond, level: F.when(
        cond, F.struct(F.lit("cleaning_priority").alias("kind"), F.lit(name).alias("subject"), level.alias("detail"))
    )
    auto = lambda text, cond: F.when(
        cond, F.struct(F.lit("automation").alias("kind"), F.lit(text).alias("subject"), F.lit("").alias("detail"))
    )
    rows = F.array_compact(
        F.array(
            prio("missing_values", F.col("completeness") < 95, F.when(F.col("business") == 1, "high").otherwise("medium")),
            prio("duplicates", F.col("uniqueness") < 95, F.lit("medium")),
            prio("format_inconsistency", F.col("consistency") < 85, F.lit("medium")),
            F.when(
                F.col("overall") < 80,
                F.struct(F.lit("quality_improvement").alias("kind"), F.lit("comprehensive_cleaning").alias("subject"), F.lit("15").alias("detail")),
            ),
            auto("Automated data type conversion", F.col("typed") > 0),
            auto("Automated missing value imputation", F.col("worst") > 20),
            auto("Automated duplicate detection and removal", F.col("uniqueness") < 95),
        )
    )
    return typed.unionByName(facts.select(F.explode(rows).alias("_cell")).select("_cell.*"))
