"""Drift between a current and a reference table, or stored reference statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.order_stats import running_totals
from plumbline.operators.profile import long_values, numeric_columns, text_columns

EPS = 1e-8


def _numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("_cell")).select("_cell.*").filter("value IS NOT NULL AND NOT isnan(value)")


def _both(current: DataFrame, reference: DataFrame) -> DataFrame:
    """Counts per (column, value) on both sides: counted map-side, then one shuffle of distinct values."""
    side = current.withColumn("_c", F.lit(1)).unionByName(reference.withColumn("_c", F.lit(0)))
    return side.groupBy("column", "value").agg(
        F.sum("_c").alias("n_cur"), F.sum(1 - F.col("_c")).alias("n_ref")
    )


def ks_statistic(current: DataFrame, reference: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, ks): largest gap between the two empirical distribution functions."""
    counts = _both(_numbers(current, columns), _numbers(reference, columns))
    totals = counts.groupBy("column").agg(F.sum("n_cur").alias("t_cur"), F.sum("n_ref").alias("t_ref"))
    cum = running_totals(counts, ["value"], {"c_cur": "n_cur", "c_ref": "n_ref"}, ["column"])
    gap = F.abs(F.try_divide("c_cur", "t_cur") - F.try_divide("c_ref", "t_ref"))
    # one row per column of the schema
    return cum.join(F.broadcast(totals), "column").groupBy("column").agg(F.coalesce(F.max(gap), F.lit(0.0)).alias("ks"))


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mean, std): the statistics worth storing for a later comparison."""
    return _numbers(df, columns).groupBy("column").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def _score_numeric(cur: DataFrame, ref: DataFrame, ks: DataFrame | None) -> DataFrame:
    both = cur.select("column", F.col("mean").alias("m1"), F.col("std").alias("s1")).join(
        ref.select("column", F.col("mean").alias("m0"), F.col("std").alias("s0")), "column"
    )
    both = both.join(ks, "column", "left").fillna(0.0, ["ks"]) if ks is not None else both.withColumn("ks", F.lit(0.0))
    mean_drift = F.abs(F.col("m1") - F.col("m0")) / (F.col("s0") + EPS)
    std_drift = F.abs(F.col("s1") - F.col("s0")) / (F.col("s0") + EPS)
    return both.select(
        "column", F.lit("statistical").alias("method"),
        F.least(F.lit(1.0), (mean_drift + std_drift + F.col("ks")) / 3).alias("score"),
        mean_drift.alias("mean_drift"), std_drift.alias("std_drift"), "ks",
    )


def numeric_drift(current: DataFrame, reference: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, method, score, mean_drift, std_drift, ks)."""
    ks = ks_statistic(current, reference, columns)
    return _score_numeric(moments(current, columns), moments(reference, columns), ks)


def numeric_drift_from_stats(current: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """As ``numeric_drift`` against stored (column, mean, std); without data KS counts as zero."""
    return _score_numeric(moments(current, columns), stats, None)


def _score_categories(counts: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence from (column, value, n_cur, n_ref)."""
    tot = counts.groupBy("column").agg(
        F.sum("n_cur").alias("t_cur"), F.sum("n_ref").alias("t_ref"), F.count(F.lit(1)).alias("k")
    )
    j = counts.join(F.broadcast(tot), "column")  # one row per column of the schema
    norm = 1 + F.col("k") * EPS
    p = (F.col("n_cur") / F.col("t_cur") + EPS) / norm
    q = (F.col("n_ref") / F.col("t_ref") + EPS) / norm
    m = (p + q) / 2
    js = F.sum(0.5 * p * F.ln(p / m) + 0.5 * q * F.ln(q / m))
    return j.groupBy("column").agg(
        js.alias("js_divergence"),
        F.count_if((F.col("n_ref") == 0) & (F.col("n_cur") > 0)).alias("new_categories"),
        F.count_if((F.col("n_cur") == 0) & (F.col("n_ref") > 0)).alias("missing_categories"),
    ).select(
        "column", F.lit("js_divergence").alias("method"),
        F.least(F.lit(1.0), F.col("js_divergence") / F.ln(F.lit(2.0))).alias("score"),
        "js_divergence", "new_categories", "missing_categories",
    )


def categorical_drift(current: DataFrame, reference: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, method, score, js_divergence, new_categories, missing_categories)."""
    return _score_categories(_both(long_values(current, columns), long_values(reference, columns)))


def categorical_drift_from_counts(current: DataFrame, stored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """As above against stored value counts (column, value, n)."""
    cur = long_values(current, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n_cur"))
    counts = (
        cur.withColumn("n_ref", F.lit(0).cast("bigint"))
        .unionByName(stored.select("column", "value", F.lit(0).cast("bigint").alias("n_cur"), F.col("n").alias("n_ref")))
        .groupBy("column", "value").agg(F.sum("n_cur").alias("n_cur"), F.sum("n_ref").alias("n_ref"))
    )
    return _score_categories(counts)


def category_changes(current: DataFrame, reference: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, change): categories seen on one side only."""
    c = _both(long_values(current, columns), long_values(reference, columns))
    change = F.when(F.col("n_ref") == 0, "new").when(F.col("n_cur") == 0, "missing")
    return c.withColumn("change", change).filter("change IS NOT NULL").select("column", "value", "change")


def drift(current: DataFrame, reference: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, method, score) for every numeric and text column."""
    cols = list(columns or current.columns)
    nums = [c for c in numeric_columns(current) if c in cols]
    text = [c for c in text_columns(current) if c in cols]
    parts = []
    if nums:
        parts.append(numeric_drift(current, reference, nums).select("column", "method", "score"))
    if text:
        parts.append(categorical_drift(current, reference, text).select("column", "method", "score"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def table_drift(columns: DataFrame) -> DataFrame:
    """(overall, detected, high_columns) from per-column scores."""
    return columns.agg(
        F.avg("score").alias("overall"), (F.avg("score") > 0.3).alias("detected"),
        F.count_if(F.col("score") > 0.5).alias("high_columns"),
    )
