"""Column profiles as long tables (column, metric, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from plumbline.functions import patterns as P
from plumbline.operators.order_stats import one_row, quantile_name, quantiles


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Fold double NaN into NULL, so that both mean 'missing'."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def rows_of(values: dict[tuple[str, str], Column], names: tuple[str, str] = ("column", "metric")) -> Column:
    """One-row aggregate -> exploded (column, metric, value)."""
    return F.explode(
        F.array(
            *[
                F.struct(F.lit(a).alias(names[0]), F.lit(b).alias(names[1]), v.cast("double").alias("value"))
                for (a, b), v in values.items()
            ]
        )
    ).alias("_cell")


def long_values(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Non-null cells as (keep..., column, value) with text values."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    return df.select(*keep, F.explode(cells).alias("_cell")).select(*keep, "_cell.*").filter("value IS NOT NULL")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n). Counted before the shuffle, so a hot value costs one row per task."""
    return long_values(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def null_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    cols = list(columns or df.columns)
    agg = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    out = {}
    for c in cols:
        out[(c, "null_count")] = F.col(c)
        out[(c, "null_pct")] = F.round(F.col(c) * 100.0 / F.col("_n"), 2)
    return agg.select(rows_of(out)).select("_cell.*")


def distinct_stats(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Distinct non-null count and percentage of rows. ``exact=False`` uses a sketch in one pass."""
    cols = list(columns or df.columns)
    if not exact:
        agg = df.agg(F.count(F.lit(1)).alias("_n"), *[F.approx_count_distinct(c, 0.02).alias(c) for c in cols])
        out = {}
        for c in cols:
            out[(c, "distinct_count")] = F.col(c)
            out[(c, "distinct_pct")] = F.round(F.col(c) * 100.0 / F.col("_n"), 2)
        return agg.select(rows_of(out)).select("_cell.*")
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    distinct = value_counts(df, cols).groupBy("column").agg(F.count(F.lit(1)).alias("_d"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return (
        one_row(names.join(distinct, "column", "left").fillna(0, ["_d"]), n)
        .select(
            "column",
            F.explode(
                F.create_map(
                    F.lit("distinct_count"), F.col("_d").cast("double"),
                    F.lit("distinct_pct"), F.round(F.col("_d") * 100.0 / F.col("_n"), 2),
                )
            ).alias("metric", "value"),
        )
    )


def numeric_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """min, max, mean, median and sample standard deviation."""
    cols = list(columns or numeric_columns(df))
    agg = df.agg(
        *[
            f(F.col(c).cast("double")).alias(f"{c}__{n}")
            for c in cols
            for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_samp))
        ]
    )
    both = one_row(agg, quantiles(df, cols, [0.5]))
    out = {}
    for c in cols:
        for n in ("min", "max", "mean", "std"):
            out[(c, n)] = F.col(f"{c}__{n}")
        out[(c, "median")] = F.col(quantile_name(c, 0))
    return both.select(rows_of(out)).select("_cell.*")


def modes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, mode, n): most frequent value; ties go to the smallest value of the column's type."""
    cols = list(columns or df.columns)
    numeric = set(numeric_columns(df))
    num = F.when(F.col("column").isin(*numeric), F.col("value").try_cast("double")) if numeric else F.lit(None).cast("double")
    return (
        value_counts(df, cols)
        .groupBy("column")
        .agg(F.min(F.struct((-F.col("n")).alias("neg"), num.alias("num"), "value")).alias("m"))
        .select("column", F.col("m.value").alias("mode"), (-F.col("m.neg")).alias("n"))
    )


def pattern_counts(df: DataFrame, columns: Sequence[str] | None = None, patterns: dict[str, str] | None = None) -> DataFrame:
    """(column, pattern, matches, pct of non-null values) for patterns that match at least once."""
    cols = list(columns or text_columns(df))
    pats = patterns or P.TEXT_PATTERNS
    agg = df.agg(
        *[F.count(c).alias(f"{c}__n") for c in cols],
        *[F.count_if(F.col(c).rlike(p)).alias(f"{c}__{n}") for c in cols for n, p in pats.items()],
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"), F.lit(n).alias("pattern"), F.col(f"{c}__{n}").alias("matches"),
                F.round(F.try_divide(F.col(f"{c}__{n}") * 100.0, F.col(f"{c}__n")), 2).alias("pct"),
            )
            for c in cols
            for n in pats
        ]
    )
    return agg.select(F.explode(cells).alias("_cell")).select("_cell.*").filter("matches > 0")


def sample_values(df: DataFrame, key: str, columns: Sequence[str] | None = None, n: int = 10) -> DataFrame:
    """First ``n`` non-null values per column in key order; tasks keep only their own first n."""
    cols = [c for c in (columns or df.columns) if c != key]
    w = W.partitionBy("column").orderBy(key)
    return (
        long_values(df, cols, [key])
        .withColumn("position", F.row_number().over(w))
        .filter(F.col("position") <= n)
        .select("column", "position", "value")
    )


def type_evidence(df: DataFrame, columns: Sequence[str] | None = None, formats: list[str] | None = None) -> DataFrame:
    """Per column: storage family, non-null count and how many values parse as each type."""
    cols = list(columns or df.columns)
    family, parsed, exprs = {}, {}, []
    for f in df.schema:
        if f.name not in cols:
            continue
        c = F.col(f.name)
        exprs.append(F.count(c).alias(f"{f.name}__n"))
        if isinstance(f.dataType, T.StringType):
            family[f.name] = "text"
            parsed[f"{f.name}__v"] = P.to_number(c)  # parsed once, counted twice
            num = F.col(f"{f.name}__v")
            exprs += [
                F.count(num).alias(f"{f.name}__num"),
                F.count_if(num == F.floor(num)).alias(f"{f.name}__whole"),
                F.count(P.to_datetime(c, formats)).alias(f"{f.name}__time"),
                F.count(P.to_boolean(c)).alias(f"{f.name}__bool"),
            ]
        elif isinstance(f.dataType, T.NumericType):
            whole = isinstance(f.dataType, T.IntegralType)
            family[f.name] = "integer" if whole else "float"
            exprs.append(
                F.count(c).alias(f"{f.name}__whole") if whole
                else F.count_if(c.cast("double") == F.floor(c.cast("double"))).alias(f"{f.name}__whole")
            )
        elif isinstance(f.dataType, T.BooleanType):
            family[f.name] = "boolean"
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            family[f.name] = "datetime"
        else:
            family[f.name] = "other"
    df = df.select(*cols).withColumns(parsed) if parsed else df
    agg = df.agg(*exprs)
    have = set(agg.columns)
    part = lambda c, m: (F.col(f"{c}__{m}") if f"{c}__{m}" in have else F.lit(0)).cast("bigint").alias(m)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"), F.lit(family[c]).alias("family"),
                part(c, "n"), part(c, "num"), part(c, "whole"), part(c, "time"), part(c, "bool"),
            )
            for c in cols
        ]
    )
    return agg.select(F.explode(rows).alias("_cell")).select("_cell.*")


def infer_types(df: DataFrame, columns: Sequence[str] | None = None, formats: list[str] | None = None) -> DataFrame:
    """(column, family, inferred): numeric, then datetime, boolean, categorical (< 50 % distinct), text."""
    cols = list(columns or df.columns)
    text = [c for c in cols if c in set(text_columns(df))]
    ev = type_evidence(df, cols, formats)
    if text:
        distinct = value_counts(df, text).groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
        ev = ev.join(F.broadcast(distinct), "column", "left")  # one row per column of the schema
    else:
        ev = ev.withColumn("distinct", F.lit(None).cast("bigint"))
    number = F.when(F.col("whole") == F.col("n"), "integer").otherwise("float")
    inferred = (
        F.when(F.col("n") == 0, "unknown")
        .when(F.col("family").isin("integer", "float"), number)
        .when(F.col("family").isin("boolean", "datetime"), F.col("family"))
        .when(F.col("num") == F.col("n"), number)
        .when(F.col("time") == F.col("n"), "datetime")
        .when(F.col("bool") == F.col("n"), "boolean")
        .when(F.col("distinct") / F.col("n") < 0.5, "categorical")
        .otherwise("text")
    )
    return ev.select("column", "family", inferred.alias("inferred"))


def light_profile(df: DataFrame, key: str | None = None) -> DataFrame:
    """Nulls, distinct counts, mean/std/min/max and the number of repeated rows."""
    cols = [c for c in df.columns if c != key]
    nums = [c for c in numeric_columns(df) if c != key]
    agg = df.agg(
        *[
            f(F.col(c).cast("double")).alias(f"{c}__{n}")
            for c in nums
            for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
        ]
    )
    stats = agg.select(
        rows_of({(c, n): F.col(f"{c}__{n}") for c in nums for n in ("mean", "std", "min", "max")})
    ).select("_cell.*")
    from plumbline.operators.duplicates import exact_duplicates

    dups = exact_duplicates(df, cols).select(
        F.lit("*").alias("column"), F.lit("duplicate_rows").alias("metric"), F.col("duplicates").cast("double").alias("value")
    )
    return null_stats(df, cols).unionByName(distinct_stats(df, cols)).unionByName(stats).unionByName(dups)
