"""Model-based imputation: iterative ridge regression, forests, and the dispatcher over methods."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import missing
from plumbline.operators.neighbors import knn_impute
from plumbline.operators.profile import numeric_columns
from plumbline.session import cut_lineage


def _ridge(df: DataFrame, target: str, seen: str, predictors: Sequence[str], ridge: float) -> np.ndarray:
    """Intercept and coefficients from one aggregate of cross products over rows where target was seen."""
    cols = [F.lit(1.0), *[F.col(c) for c in predictors]]
    y = F.col(target)
    sums = [F.sum(a * b) for i, a in enumerate(cols) for b in cols[i:]] + [F.sum(a * y) for a in cols]
    row = df.filter(F.col(seen)).agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
    n = len(cols)
    gram, at = np.zeros((n, n)), 0
    for i in range(n):
        for j in range(i, n):
            gram[i, j] = gram[j, i] = row[at] or 0.0
            at += 1
    xty = np.array([row[at + i] or 0.0 for i in range(n)])
    # a relative ridge on the slopes keeps collinear columns solvable
    penalty = np.diag(np.concatenate([[0.0], ridge * np.maximum(np.diag(gram)[1:], 1e-12)]))
    return np.linalg.solve(gram + penalty, xty)


def iterative_impute(
    df: DataFrame, key: str, columns: Sequence[str], rounds: int = 10, tolerance: float = 1e-3, ridge: float = 1e-9
) -> DataFrame:
    """Chained regressions: every column with gaps is predicted from all others, round after round.

    Each step is one aggregate (the normal equations) and one projection; every round is
    checkpointed. Columns go by ascending number of gaps; stops early when no filled value moves
    more than ``tolerance`` times the largest absolute value.
    """
    cols = list(columns)
    typed = df.withColumns({c: F.col(c).cast("double") for c in cols})
    stats = typed.agg(
        *[F.avg(c).alias(f"{c}__m") for c in cols], *[F.count_if(F.col(c).isNull()).alias(f"{c}__g") for c in cols],
        F.max(F.greatest(*[F.coalesce(F.abs(c), F.lit(0.0)) for c in cols])).alias("top"),
    ).first()
    order = sorted([c for c in cols if stats[f"{c}__g"]], key=lambda c: stats[f"{c}__g"])
    if not order:
        return df
    work = typed.withColumns({f"_seen_{c}": F.col(c).isNotNull() for c in order})
    work = work.withColumns({c: F.coalesce(F.col(c), F.lit(stats[f"{c}__m"])) for c in order})
    work = cut_lineage(work.withColumns({f"_old_{c}": F.col(c) for c in order}))
    for _ in range(rounds):
        for c in order:
            others = [x for x in cols if x != c]
            b = _ridge(work, c, f"_seen_{c}", others, ridge)
            guess = reduce(lambda a, x: a + x, [F.col(o) * F.lit(float(w)) for o, w in zip(others, b[1:])], F.lit(float(b[0])))
            work = work.withColumn(c, F.when(F.col(f"_seen_{c}"), F.col(c)).otherwise(guess))
        work = cut_lineage(work)
        moved = work.agg(F.max(F.greatest(F.lit(0.0), *[F.abs(F.col(c) - F.col(f"_old_{c}")) for c in order]))).first()[0]
        work = work.withColumns({f"_old_{c}": F.col(c) for c in order})
        if moved is not None and moved <= tolerance * (stats["top"] or 0.0):
            break
    return work.select(*df.columns)


def forest_impute(df: DataFrame, key: str, columns: Sequence[str], trees: int = 20, depth: int = 8, seed: int = 42) -> DataFrame:
    """One random forest per column with gaps, fitted on rows that have a value; other gaps go in as means."""
    cols = list(columns)
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).first().asDict()
    out = df.withColumns({c: F.col(c).cast("double") for c in cols})
    for c in cols:
        others = [x for x in cols if x != c]
        ready = df.withColumns({f"_x_{o}": F.coalesce(F.col(o).cast("double"), F.lit(float(means[o]))) for o in others})
        ready = VectorAssembler(inputCols=[f"_x_{o}" for o in others], outputCol="_f").transform(ready)
        holes = ready.filter(F.col(c).isNull()).select(key, "_f")
        seen = ready.filter(F.col(c).isNotNull()).select(F.col(c).cast("double").alias("_y"), "_f")
        model = RandomForestRegressor(featuresCol="_f", labelCol="_y", predictionCol="_p", numTrees=trees, maxDepth=depth, seed=seed).fit(seen)
        filled = model.transform(holes).select(key, "_p")
        out = out.join(filled, key, "left").withColumn(c, F.coalesce(F.col(c), F.col("_p"))).drop("_p")
    return out.select(*df.columns)


def ml_impute(df: DataFrame, key: str, columns: Sequence[str] | None = None, method: str = "iterative") -> DataFrame:
    """Numeric columns by 'iterative', 'knn' or 'random_forest', all others by their mode."""
    wanted = [c for c in (columns or df.columns) if c != key]
    nums = [c for c in numeric_columns(df) if c != key]
    gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in wanted]).first()
    todo = [c for c in wanted if gaps[c]]
    num_todo, text_todo = [c for c in todo if c in nums], [c for c in todo if c not in nums]
    out = df
    if num_todo and len(nums) > 1:
        if method == "iterative":
            full = iterative_impute(df, key, nums)
        elif method == "knn":
            full = knn_impute(df, key, num_todo, nums)
        else:
            full = forest_impute(df, key, nums)
        keep = [c for c in nums if c not in num_todo]
        # columns that were not asked for stay as they are
        out = full if not keep else full.drop(*keep).join(df.select(key, *keep), key)
        out = out.select(*df.columns)
    return missing.impute(out, text_todo, "mode") if text_todo else out
