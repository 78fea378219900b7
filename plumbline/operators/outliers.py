"""Statistical outliers: IQR and z-score listings, removal, and score scaling."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.operators.order_stats import one_row, quantile_name, quantiles

MIN_VALUES = 10


def _with_stats(df: DataFrame, columns: Sequence[str], method: str) -> DataFrame:
    """Every row plus the one-row statistics its bounds need."""
    cols = list(columns)
    stats = df.agg(
        *[F.count(c).alias(f"{c}__n") for c in cols],
        *[F.avg(F.col(c).cast("double")).alias(f"{c}__mean") for c in cols],
        *[F.stddev_samp(F.col(c).cast("double")).alias(f"{c}__sd") for c in cols],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"{c}__sdp") for c in cols],
    )
    if method == "iqr":
        stats = one_row(stats, quantiles(df, cols, [0.25, 0.75]))
    return one_row(df, stats)


def _is_out(c: str, method: str, threshold: float, population: bool = True) -> Column:
    v = F.col(c).cast("double")
    if method == "iqr":
        lo, hi = F.col(quantile_name(c, 0)), F.col(quantile_name(c, 1))
        out = (v < lo - threshold * (hi - lo)) | (v > hi + threshold * (hi - lo))
    else:
        sd = F.col(f"{c}__sdp" if population else f"{c}__sd")
        out = F.abs(F.try_divide(v - F.col(f"{c}__mean"), sd)) > threshold
    return (F.col(f"{c}__n") >= MIN_VALUES) & F.coalesce(out, F.lit(False))


def outliers(
    df: DataFrame, key: str, columns: Sequence[str], method: str = "iqr", threshold: float | None = None
) -> DataFrame:
    """(key, column, value, z, method): z uses the sample standard deviation."""
    cols = list(columns)
    k = threshold if threshold is not None else (1.5 if method == "iqr" else 3.0)
    wide = _with_stats(df.select(key, *cols), cols, method)
    cells = F.array_compact(
        F.array(
            *[
                F.when(
                    _is_out(c, method, k),
                    F.struct(
                        F.lit(c).alias("column"), F.col(c).cast("double").alias("value"),
                        F.abs(F.try_divide(F.col(c) - F.col(f"{c}__mean"), F.col(f"{c}__sd"))).alias("z"),
                    ),
                )
                for c in cols
            ]
        )
    )
    return wide.select(F.col(key).alias("key"), F.explode(cells).alias("_cell")).select(
        "key", "_cell.*", F.lit(method).alias("method")
    )


def merge_methods(listings: Sequence[DataFrame]) -> DataFrame:
    """Union of listings, one row per (key, column); the alphabetically last method names it."""
    allrows = reduce(lambda a, b: a.unionByName(b), listings)
    return allrows.groupBy("key", "column").agg(
        F.max("value").alias("value"), F.max("z").alias("z"), F.max("method").alias("method")
    )


def listing(merged: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` rows per column by |z| (ties by key)."""
    w = W.partitionBy("column").orderBy(F.desc("z"), "key")
    return merged.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= top)


def listing_totals(merged: DataFrame, df: DataFrame) -> DataFrame:
    """(column, outliers, pct of rows)."""
    rows = df.agg(F.count(F.lit(1)).alias("_n"))
    per = merged.groupBy("column").agg(F.count(F.lit(1)).alias("outliers"))
    return one_row(per, rows).select("column", "outliers", F.round(F.col("outliers") * 100.0 / F.col("_n"), 2).alias("pct"))


def outlier_counts(df: DataFrame, columns: Sequence[str], method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """(column, outliers) per column in one pass."""
    cols = list(columns)
    agg = _with_stats(df.select(*cols), cols, method).agg(
        *[F.count_if(_is_out(c, method, threshold, population=False)).alias(c) for c in cols]
    )
    return agg.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("outliers")) for c in cols])).alias("_cell")
    ).select("_cell.*")


def remove_outliers(df: DataFrame, columns: Sequence[str], method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """Rows with no outlying value in any column; bounds come from the table as given."""
    cols = list(columns)
    wide = _with_stats(df, cols, method)
    bad = reduce(lambda a, b: a | b, [_is_out(c, method, threshold, population=False) for c in cols])
    return wide.filter(~bad).select(*df.columns)


def minmax(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale each column to [0, 1]; a constant column becomes 0."""
    cols = list(columns)
    ends = df.agg(*[F.min(c).alias(f"{c}__lo") for c in cols], *[F.max(c).alias(f"{c}__hi") for c in cols])
    scaled = {
        c: (F.col(c) - F.col(f"{c}__lo")) / F.greatest(F.col(f"{c}__hi") - F.col(f"{c}__lo"), F.lit(1e-9)) for c in cols
    }
    return one_row(df, ends).withColumns(scaled).select(*df.columns)


def scale(df: DataFrame, columns: Sequence[str], method: str = "standard") -> DataFrame:
    """'standard' (population std), 'minmax' or 'robust' (median, IQR); zero spread divides by one."""
    cols = list(columns)
    if method == "minmax":
        return minmax(df, cols)
    if method == "robust":
        stats = quantiles(df, cols, [0.25, 0.5, 0.75])
        mid = {c: F.col(quantile_name(c, 1)) for c in cols}
        spread = {c: F.col(quantile_name(c, 2)) - F.col(quantile_name(c, 0)) for c in cols}
    else:
        stats = df.agg(
            *[F.avg(c).alias(f"{c}__mean") for c in cols],
            *[F.stddev_pop(F.col(c).cast("double")).alias(f"{c}__sd") for c in cols],
        )
        mid = {c: F.col(f"{c}__mean") for c in cols}
        spread = {c: F.col(f"{c}__sd") for c in cols}
    scaled = {c: (F.col(c) - mid[c]) / F.when(spread[c] == 0, 1.0).otherwise(spread[c]) for c in cols}
    return one_row(df, stats).withColumns(scaled).select(*df.columns)
