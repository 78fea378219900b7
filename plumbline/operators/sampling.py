"""Seeded samples, folds and splits. All draws are md5 ranks: repeatable in any engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.draws import draw
from plumbline.operators.order_stats import bounded_join, hash_cuts, lowest_cut, quantile_name, quantiles


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42, tag: str = "sample") -> DataFrame:
    """Exactly min(n, rows) rows: those with the smallest draws. No sort of the data."""
    drawn = df.withColumn("_h", draw(seed, tag, key))
    return drawn.filter(F.col("_h") <= lowest_cut(drawn, "_h", n)).drop("_h")


def stratified_sample(df: DataFrame, by: str, total: int, key: str, seed: int = 42) -> DataFrame:
    """Proportional sample per stratum, at least one row each, trimmed or topped up to ``total``."""
    frac = total / max(df.count(), 1)
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("_size"))
    quotas = sizes.select(
        by, F.lit(0).alias("slot"),
        F.least(F.greatest(F.lit(1), F.round(F.col("_size") * frac)), F.col("_size")).cast("bigint").alias("take"),
    )
    drawn = df.withColumn("_h", draw(seed, "strata", key))
    cuts = hash_cuts(drawn, "_h", quotas, [by]).select(by, "cut")
    marked = bounded_join(drawn, cuts, [by]).withColumn("_in", F.col("_h") <= F.col("cut"))
    have = quotas.agg(F.sum("take")).first()[0]
    if have >= total:
        inside = marked.filter("_in").drop("_in", "cut", "_h")
        return sample_n(inside, total, key, seed, "trim")
    rest = marked.filter("NOT _in").withColumn("_t", draw(seed, "topup", key))
    extra = lowest_cut(rest, "_t", total - have)
    return (
        marked.withColumn("_t", draw(seed, "topup", key))
        .filter(F.col("_in") | (F.col("_t") <= extra))
        .drop("_in", "cut", "_h", "_t")
    )


def assign_folds(
    df: DataFrame, k: int, key: str, seed: int = 42, label: str | None = None, name: str = "fold"
) -> DataFrame:
    """Fold 0..k-1. With ``label``, each class is cut into k equal blocks of its draw order."""
    h = draw(seed, "folds", key)
    if label is None:
        return df.withColumn(name, F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), F.lit(k)).cast("int"))
    drawn = df.withColumn("_h", h)
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    # block i of ntile(k): the first n % k blocks hold one row more
    edge = lambda i: (F.floor(F.col("_n") / k) * i + F.least(F.lit(i), F.col("_n") % k)).cast("bigint")
    quotas = sizes.select(
        label,
        F.explode(F.array(*[F.struct(F.lit(i).alias("slot"), edge(i).alias("take")) for i in range(1, k)])).alias("_cell"),
    ).select(label, "_cell.slot", "_cell.take")
    cuts = hash_cuts(drawn, "_h", quotas, [label]).groupBy(label).agg(F.sort_array(F.collect_list("cut")).alias("_cuts"))
    return bounded_join(drawn, cuts, [label]).withColumn(
        name, F.size(F.filter("_cuts", lambda c: c < F.col("_h"))).cast("int")
    ).drop("_h", "_cuts")


def ordered_split(df: DataFrame, order_by: str, frac: float, name: str = "part") -> DataFrame:
    """'first' for rows at or below the ``frac`` quantile of ``order_by``, else 'last'."""
    cut = quantiles(df, [order_by], [frac]).first()[quantile_name(order_by, 0)]
    return df.withColumn(name, F.when(F.col(order_by) <= cut, "first").otherwise("last"))


def prevalence_sample(
    df: DataFrame, label: str, p: float, key: str, drop: str = "neg", seed: int = 42
) -> DataFrame:
    """Reach prevalence ``p`` by dropping negatives (biased form) or positives (corrected form)."""
    n_pos, n_neg = df.agg(F.sum(label), F.sum(1 - F.col(label))).first()
    dropped = 0 if drop == "neg" else 1
    if drop == "neg":
        take = min(int((n_pos or 0) * (1 - p) / max(p, 1e-6)), n_neg or 0)
    else:
        take = min(int((n_neg or 0) * p / max(1 - p, 1e-6)), n_pos or 0)
    drawn = df.withColumn("_h", draw(seed, f"prev-{drop}-{p}", key))
    cut = lowest_cut(drawn.filter(F.col(label) == dropped), "_h", take)
    return drawn.filter((F.col(label) != dropped) | (F.col("_h") <= cut)).drop("_h")


def holdout(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42, name: str = "is_test") -> DataFrame:
    """Exact hold-out: ``floor((1 - test_share) * n)`` training rows, the rest marked as test."""
    drawn = df.withColumn("_h", draw(seed, "holdout", key))
    cut = lowest_cut(drawn, "_h", int((1 - test_share) * df.count()))
    return drawn.withColumn(name, F.col("_h") > cut).drop("_h")
