"""Missing-value reports, imputation suggestions and statistical fills."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.functions import patterns as P
from plumbline.operators.order_stats import one_row, quantile_name, quantiles
from plumbline.operators.profile import modes, null_stats, numeric_columns, value_counts
from plumbline.operators.scores import has_keyword


def missing_total(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(missing, pct of cells)."""
    cols = list(columns or df.columns)
    gaps = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in cols])
    return df.agg(gaps.alias("missing"), F.round(gaps * 100.0 / (F.count(F.lit(1)) * len(cols)), 2).alias("pct"))


def missing_by_column(df: DataFrame, key: str, columns: Sequence[str] | None = None, n: int = 10) -> DataFrame:
    """(column, missing, pct, first keys) for columns with gaps."""
    cols = [c for c in (columns or df.columns) if c != key]
    holes = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols]))
    w = W.partitionBy("column").orderBy("_key")
    first = (
        df.select(F.col(key).alias("_key"), F.explode(holes).alias("column"))
        .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
        .groupBy("column").agg(F.array_sort(F.collect_list("_key")).alias("first_keys"))
    )
    stats = null_stats(df, cols).groupBy("column").agg(
        F.max(F.when(F.col("metric") == "null_count", F.col("value"))).cast("bigint").alias("missing"),
        F.max(F.when(F.col("metric") == "null_pct", F.col("value"))).alias("pct"),
    )
    return stats.join(first, "column")


def suspected_imputation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, equal_mean, equal_median, suspected): more than one value equal to the mean, or
    more than a tenth equal to the median."""
    cols = list(columns or numeric_columns(df))
    stats = one_row(df.agg(*[F.avg(F.col(c).cast("double")).alias(f"{c}__mean") for c in cols]), quantiles(df, cols, [0.5]))
    agg = one_row(df.select(*cols), stats).agg(
        *[F.count(c).alias(f"{c}__n") for c in cols],
        *[F.count_if(F.col(c) == F.col(f"{c}__mean")).alias(f"{c}__a") for c in cols],
        *[F.count_if(F.col(c) == F.col(quantile_name(c, 0))).alias(f"{c}__m") for c in cols],
    )
    rows = []
    for c in cols:
        a, m, n = F.col(f"{c}__a"), F.col(f"{c}__m"), F.col(f"{c}__n")
        hit = F.when(a > 1, a).otherwise(0) + F.when(m > n * 0.1, m).otherwise(0)
        rows.append(F.struct(F.lit(c).alias("column"), a.alias("equal_mean"), m.alias("equal_median"), hit.alias("suspected")))
    return agg.select(F.explode(F.array(*rows)).alias("_cell")).select("_cell.*")


def missing_patterns(df: DataFrame, columns: Sequence[str] | None = None, top: int = 5) -> DataFrame:
    """The most frequent sets of columns missing together; the complete set takes a rank but is not listed."""
    cols = list(columns or df.columns)
    pattern = F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols])), ",")
    counts = df.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    rows = df.agg(F.count(F.lit(1)).alias("_n"))
    best = counts.orderBy(F.desc("n"), "pattern").limit(top).filter("pattern <> ''")
    return one_row(best, rows).select("pattern", "n", F.round(F.col("n") * 100.0 / F.col("_n"), 2).alias("pct"))


def suggest_imputation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, method, priority, pct) from the per-column profile, for columns with gaps."""
    cols = list(columns or df.columns)
    nums = numeric_columns(df)
    distinct = value_counts(df, cols).groupBy("column").agg(F.count(F.lit(1)).alias("_d"))
    stats = null_stats(df, cols).filter("metric = 'null_pct' AND value > 0").select("column", F.col("value").alias("pct"))
    is_num = F.col("column").isin(*nums) if nums else F.lit(False)
    priority = (
        F.when(has_keyword(F.col("column"), P.BUSINESS_KEYWORDS), F.when(F.col("pct") > 10, "high").otherwise("medium"))
        .when(has_keyword(F.col("column"), P.IDENTITY_KEYWORDS), "high")
        .when(F.col("pct") > 20, "medium")
        .otherwise("low")
    )
    method = F.when(is_num & (F.coalesce("_d", F.lit(0)) >= 10), "median").otherwise("mode")
    return stats.join(distinct, "column", "left").select("column", method.alias("method"), priority.alias("priority"), "pct")


def suggest_statistical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, method, pct): drop, knn, mean, median, mode or constant from distribution and correlation."""
    cols = list(columns or df.columns)
    nums = [c for c in numeric_columns(df) if c in cols]
    pairs = [(a, b) for i, a in enumerate(nums) for b in nums[i + 1:]]
    agg = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}__gaps") for c in cols],
        *[F.skewness(F.col(c).cast("double")).alias(f"{c}__skew") for c in nums],
        *[
            # pairwise-complete correlation
            F.corr(
                F.when(F.col(b).isNotNull(), F.col(a).cast("double")),
                F.when(F.col(a).isNotNull(), F.col(b).cast("double")),
            ).alias(f"{a}__{b}__r")
            for a, b in pairs
        ],
    )
    rows = []
    for c in cols:
        strong = [
            (F.coalesce(F.abs(F.col(f"{a}__{b}__r")), F.lit(0.0)) > 0.7).cast("int") for a, b in pairs if c in (a, b)
        ]
        linked = reduce(lambda x, y: x + y, strong, F.lit(0))
        numeric = (
            F.when(linked >= 2, "knn_imputation").when(F.abs(F.col(f"{c}__skew")) < 0.5, "mean_imputation").otherwise("median_imputation")
            if c in nums else F.lit("")
        )
        rows.append(
            F.struct(
                F.lit(c).alias("column"), F.round(F.col(f"{c}__gaps") * 100.0 / F.col("_n"), 2).alias("pct"),
                numeric.alias("numeric"), (F.col("_n") - F.col(f"{c}__gaps")).alias("filled"),
            )
        )
    base = agg.select(F.explode(F.array(*rows)).alias("_cell")).select("_cell.*").filter("pct > 0")
    top = modes(df, cols).select("column", F.col("n").alias("_top"))
    other = F.when(F.col("_top") / F.col("filled") > 0.5, "mode_imputation").otherwise("constant_imputation")
    return base.join(top, "column", "left").select(
        "column",
        F.when(F.col("pct") > 50, "drop_column").when(F.col("numeric") != "", F.col("numeric")).otherwise(other).alias("method"),
        "pct",
    )


def fill_values(df: DataFrame, plan: dict[str, str], constant=None) -> DataFrame:
    """One row with the fill value of every column in ``plan`` ({column: strategy})."""
    spark = df.sparkSession
    out = spark.range(1).select()
    means = [c for c, s in plan.items() if s == "mean"]
    medians = [c for c, s in plan.items() if s == "median"]
    tops = [c for c, s in plan.items() if s == "mode"]
    if means:
        out = one_row(out, df.agg(*[F.avg(c).alias(f"{c}__fill") for c in means]))
    if medians:
        q = quantiles(df, medians, [0.5])
        out = one_row(out, q.select(*[F.col(quantile_name(c, 0)).alias(f"{c}__fill") for c in medians]))
    if tops:
        m = modes(df, tops)
        out = one_row(out, m.agg(*[F.max(F.when(F.col("column") == c, F.col("mode"))).alias(f"{c}__fill") for c in tops]))
    fixed = [c for c, s in plan.items() if s == "constant"]
    return out.withColumns({f"{c}__fill": F.lit(constant) for c in fixed}) if fixed else out


def impute(df: DataFrame, columns: Sequence[str] | None = None, strategy: str = "auto", constant=None) -> DataFrame:
    """Fill gaps per column: auto (median / mode), mean, median, mode or constant."""
    nums = set(numeric_columns(df))
    plan = {}
    for c in columns or df.columns:
        s = ("median" if c in nums else "mode") if strategy == "auto" else strategy
        if s in ("mean", "median") and c not in nums:
            continue
        plan[c] = s
    return _apply(df, plan, constant)


def _apply(df: DataFrame, plan: dict[str, str], constant=None) -> DataFrame:
    types = dict(df.dtypes)
    filled = {}
    for c, s in plan.items():
        target = "double" if s in ("mean", "median") and types[c] != "float" else types[c]
        filled[c] = F.coalesce(F.col(c).cast(target), F.col(f"{c}__fill").cast(target))
    return one_row(df, fill_values(df, plan, constant)).withColumns(filled).select(*df.columns)


def export_clean(df: DataFrame, key: str) -> DataFrame:
    """Default cleaning of an export: drop exact copies, numbers to their mean, text to its mode or 'Unknown'."""
    from plumbline.operators.duplicates import drop_dups

    cols = [c for c in df.columns if c != key]
    once = drop_dups(df, cols, "first", key)
    nums = [c for c in numeric_columns(df) if c != key]
    text = [c for c in cols if c not in nums]
    out = _apply(once, {**{c: "mean" for c in nums}, **{c: "mode" for c in text}})
    return out.fillna("Unknown", text)


def fill_counts(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, filled)."""
    gaps = lambda d, tag: d.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}__{tag}") for c in columns])
    return one_row(gaps(before, "b"), gaps(after, "a")).select(
        F.explode(
            F.array(
                *[F.struct(F.lit(c).alias("column"), (F.col(f"{c}__b") - F.col(f"{c}__a")).alias("filled")) for c in columns]
            )
        ).alias("_cell")
    ).select("_cell.*")
