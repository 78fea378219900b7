"""Unsupervised detectors: isolation forest, ECOD, COPOD, HBOS, LODA, and votes over detectors."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.draws import draw
from plumbline.operators.neighbors import dbscan_noise, lof
from plumbline.operators.order_stats import bounded_join, lowest_cut, one_row, quantile_name, quantiles, value_ranks
from plumbline.operators.outliers import minmax, outliers, scale

EULER = 0.5772156649


def path_correction(n):
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = 2 * (np.log(n - 1) + EULER) - 2 * (n - 1) / n
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def _grow(sample: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """(feature, cut, left, right, depth value) per node; leaves have feature -1."""
    nodes: list[tuple] = []
    todo = [(sample, 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        at = len(nodes)
        if parent >= 0:
            f, cut, *links = nodes[parent][:4]
            links[side] = at
            nodes[parent] = (f, cut, links[0], links[1], 0.0)
        lo, hi = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
        wide = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) <= 1 or len(wide) == 0:
            nodes.append((-1, 0.0, 0, 0, float(depth + path_correction(len(rows)))))
            continue
        f = int(rng.choice(wide))
        cut = float(rng.uniform(lo[f], hi[f]))
        nodes.append((f, cut, 0, 0, 0.0))
        left = rows[:, f] < cut
        todo += [(rows[left], depth + 1, at, 0), (rows[~left], depth + 1, at, 1)]
    return nodes


def isolation_forest(
    df: DataFrame, key: str, features: Sequence[str], trees: int = 200, psi: int = 256, seed: int = 42, name: str = "iforest"
) -> DataFrame:
    """(key, score): 2^(-E[path] / c(psi)); higher is more anomalous.

    Trees grow on the executors from a sample of at most trees x psi rows; the forest has a bounded
    size and is broadcast. Scoring is one Arrow map over the table.
    """
    fs = list(features)
    spark = df.sparkSession
    drawn = df.select(F.col(key).alias("key"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in fs]).withColumn(
        "_h", draw(seed, "iforest", "key")
    )
    n = df.count()
    cut = lowest_cut(drawn, "_h", min(n, trees * psi))
    pool = drawn.filter(F.col("_h") <= cut).select("_h", *fs).toPandas().sort_values("_h")[fs].to_numpy(dtype=float)
    size = min(psi, len(pool))
    limit = max(1, math.ceil(math.log2(max(size, 2))))
    sampled = spark.sparkContext.broadcast(pool)

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tree in pdf["id"]:
                rng = np.random.default_rng([seed, int(tree)])
                rows = sampled.value[rng.choice(len(sampled.value), size, replace=False)]
                nodes = _grow(rows, rng, limit)
                yield pd.DataFrame(nodes, columns=["f", "cut", "l", "r", "depth"]).assign(tree=tree, node=range(len(nodes)))

    grown = spark.range(trees).mapInPandas(grow, "f int, cut double, l int, r int, depth double, tree long, node int")
    table = grown.toPandas().sort_values(["tree", "node"])  # at most trees x 2 psi nodes
    forest = [g[["f", "cut", "l", "r", "depth"]].to_numpy() for _, g in table.groupby("tree")]
    shared = spark.sparkContext.broadcast(forest)
    norm = float(path_correction(size)) or 1.0

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[fs].to_numpy(dtype=float)
            total = np.zeros(len(x))
            for nodes in shared.value:
                feat, cutv = nodes[:, 0].astype(int), nodes[:, 1]
                left, right, depth = nodes[:, 2].astype(int), nodes[:, 3].astype(int), nodes[:, 4]
                at = np.zeros(len(x), dtype=int)
                live = np.flatnonzero(feat[at] >= 0)
                while len(live):
                    here = at[live]
                    at[live] = np.where(x[live, feat[here]] < cutv[here], left[here], right[here])
                    live = live[feat[at[live]] >= 0]
                total += depth[at]
            yield pd.DataFrame({"key": pdf["key"], name: np.power(2.0, -(total / len(shared.value)) / norm)})

    key_type = dict(df.dtypes)[key]
    return drawn.select("key", *fs).mapInPandas(score, f"key {key_type}, {name} double")


def flag_top(scores: DataFrame, score: str, contamination: float = 0.1, name: str = "flag") -> DataFrame:
    """1 for the ``contamination`` share with the highest scores (above the 1 - c quantile)."""
    cut = quantiles(scores, [score], [1 - contamination])
    return one_row(scores, cut).withColumn(name, (F.col(score) > F.col(quantile_name(score, 0))).cast("int")).select(*scores.columns, name)


def isolation_outliers(df: DataFrame, key: str, column: str, contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """(key, column, value, z, method) of one column; nothing below 100 values."""
    vals = df.filter(F.col(column).isNotNull()).select(F.col(key), F.col(column).cast("double").alias(column))
    flagged = flag_top(isolation_forest(vals, key, [column], trees=100, seed=seed), "iforest", contamination).filter("flag = 1")
    stats = vals.agg(F.count(F.lit(1)).alias("_n"), F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    rows = one_row(bounded_join(vals.withColumnRenamed(key, "key"), flagged.select("key"), ["key"]), stats).filter("_n >= 100")
    return rows.select(
        "key", F.lit(column).alias("column"), F.col(column).alias("value"),
        F.abs((F.col(column) - F.col("_m")) / F.col("_s")).alias("z"), F.lit("isolation_forest").alias("method"),
    )


# --- tails and histograms --------------------------------------------------------------------------


def tail_sums(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """(key, o_left, o_right, o_auto): sums over columns of -ln of the empirical tail probabilities.

    The automatic side is the left tail where the column's skewness is negative, else the right.
    Ranks come from distributed prefix sums over distinct values.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in features])
    long = df.select(F.col(key).alias("key"), F.explode(cells).alias("_cell")).select("key", "_cell.*").filter("value IS NOT NULL")
    skew = df.agg(*[F.skewness(F.col(c).cast("double")).alias(c) for c in features]).select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0.0)).alias("skew")) for c in features])).alias("_cell")
    ).select("_cell.*")
    ranks = value_ranks(long, "value", ["column"])
    tails = ranks.join(F.broadcast(skew), "column").select(  # one row per column
        "column", "value",
        (-F.ln(F.col("n_le") / F.col("n_total"))).alias("u_left"),
        (-F.ln((F.col("n_total") - F.col("n_lt")) / F.col("n_total"))).alias("u_right"), "skew",
    )
    auto = F.when(F.col("skew") < -1e-9, F.col("u_left")).otherwise(F.col("u_right"))
    return bounded_join(long, tails, ["column", "value"]).groupBy("key").agg(
        F.sum("u_left").alias("o_left"), F.sum("u_right").alias("o_right"), F.sum(auto).alias("o_auto")
    )


def ecod(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """(key, ecod): the largest of the three tail sums."""
    return tail_sums(df, key, features).select("key", F.greatest("o_left", "o_right", "o_auto").alias("ecod"))


def copod(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """(key, o_left, o_right, o_auto, copod): the empirical-copula reading of the same tails."""
    return tail_sums(df, key, features).withColumn("copod", F.greatest("o_left", "o_right", "o_auto"))


FLOOR = 1e-9


def _bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    width = F.when(hi > lo, (hi - lo) / bins).otherwise(F.lit(1.0))
    return F.least(F.greatest(F.floor((v - lo) / width), F.lit(0)), F.lit(bins - 1)).cast("int")


def _densities(wide: DataFrame, names: Sequence[str], bins: int) -> DataFrame:
    """One row with ends and relative bin heights per column; the counts have names x bins rows."""
    ends = wide.agg(*[F.min(c).alias(f"{c}__lo") for c in names], *[F.max(c).alias(f"{c}__hi") for c in names])
    binned = one_row(wide, ends)
    cells = F.array(
        *[F.struct(F.lit(i).alias("i"), _bin(F.col(c), F.col(f"{c}__lo"), F.col(f"{c}__hi"), bins).alias("b")) for i, c in enumerate(names)]
    )
    counts = binned.select(F.explode(cells).alias("_cell")).select("_cell.*").groupBy("i", "b").agg(F.count(F.lit(1)).alias("n"))
    table = counts.agg(F.map_from_entries(F.collect_list(F.struct(F.col("i") * bins + F.col("b"), F.col("n")))).alias("_counts"))
    return one_row(ends, table)


def hbos(df: DataFrame, key: str, features: Sequence[str], bins: int = 10) -> DataFrame:
    """(key, hbos): sum of ln(1 / height) over columns, heights scaled to a maximum of one."""
    fs = list(features)
    wide = df.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(c) for c in fs])
    both = one_row(wide, _densities(wide, fs, bins))
    total = F.lit(0.0)
    for i, c in enumerate(fs):
        count = lambda b: F.coalesce(F.try_element_at("_counts", (F.lit(i * bins) + b).cast("int")), F.lit(0))
        top = F.greatest(*[count(F.lit(j)) for j in range(bins)])
        here = count(_bin(F.col(c), F.col(f"{c}__lo"), F.col(f"{c}__hi"), bins))
        total = total - F.ln(F.greatest(here / top, F.lit(FLOOR)))
    return both.select("key", total.alias("hbos"))


def loda_weights(d: int, projections: int, seed: int) -> np.ndarray:
    """Sparse random projections with round(sqrt(d)) normal weights each."""
    rng = np.random.default_rng(seed)
    w = np.zeros((projections, d))
    for row in w:
        at = rng.choice(d, max(1, round(math.sqrt(d))), replace=False)
        row[at] = rng.normal(size=len(at))
    return w


def loda(df: DataFrame, key: str, features: Sequence[str], projections: int = 100, bins: int = 10, seed: int = 42) -> DataFrame:
    """(key, loda): mean -ln of histogram probabilities over random projections.

    The input is standardised first. Three Arrow maps: ends, histograms and scores. The first two
    hand on one row per partition, and only projections x bins numbers reach the driver.
    """
    fs = list(features)
    base = scale(df.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(c) for c in fs]), fs)
    weights = loda_weights(len(fs), projections, seed).T

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lo, hi, seen = np.full(projections, np.inf), np.full(projections, -np.inf), False
        for pdf in batches:
            if len(pdf):
                p = pdf[fs].to_numpy(dtype=float) @ weights
                lo, hi, seen = np.minimum(lo, p.min(axis=0)), np.maximum(hi, p.max(axis=0)), True
        if seen:
            yield pd.DataFrame({"lo": [lo.tolist()], "hi": [hi.tolist()]})

    part = base.mapInPandas(ends, "lo array<double>, hi array<double>").select(F.posexplode(F.arrays_zip("lo", "hi")).alias("i", "z"))
    limits = part.groupBy("i").agg(F.min("z.lo").alias("lo"), F.max("z.hi").alias("hi")).orderBy("i").toPandas()
    low = limits["lo"].to_numpy()
    step = np.where(limits["hi"].to_numpy() > low, (limits["hi"].to_numpy() - low) / bins, 1.0)

    def cells(pdf: pd.DataFrame) -> np.ndarray:
        at = np.floor((pdf[fs].to_numpy(dtype=float) @ weights - low) / step)
        return np.clip(at, 0, bins - 1).astype(np.int64) + np.arange(projections) * bins

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(projections * bins, dtype=np.int64)
        for pdf in batches:
            total += np.bincount(cells(pdf).ravel(), minlength=projections * bins)
        yield pd.DataFrame({"n": [total.tolist()]})

    counts = base.mapInPandas(count, "n array<long>").select(F.posexplode("n").alias("b", "n")).groupBy("b").agg(F.sum("n").alias("n"))
    table = counts.orderBy("b").toPandas()["n"].to_numpy(dtype=float)
    surprise = -np.log(np.maximum(table, 1.0) / (table.sum() / projections))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "loda": surprise[cells(pdf)].mean(axis=1)})

    return base.mapInPandas(score, f"key {dict(df.dtypes)[key]}, loda double")


# --- several detectors together --------------------------------------------------------------------

METHODS = ("isolation_forest", "local_outlier_factor", "dbscan")


def vote(
    df: DataFrame, key: str, features: Sequence[str], methods: Sequence[str] = METHODS[:2], contamination: float = 0.1, seed: int = 42
) -> DataFrame:
    """(key, votes, anomalous): flags of the named detectors; anomalous needs more than half of them."""
    fs = list(features)
    filled = df.select(F.col(key).alias("key"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in fs])
    flags = []
    if "isolation_forest" in methods:
        flags.append(flag_top(isolation_forest(filled, "key", fs, trees=100, seed=seed), "iforest", contamination).select("key", "flag"))
    if "local_outlier_factor" in methods:
        flags.append(flag_top(lof(filled, "key", fs, 20), "lof", contamination).select("key", "flag"))
    if "dbscan" in methods:
        flags.append(dbscan_noise(scale(filled, fs), "key", fs).select("key", F.col("noise").alias("flag")))
    votes = reduce(lambda a, b: a.unionByName(b), flags).groupBy("key").agg(F.sum("flag").alias("votes"))
    return votes.withColumn("anomalous", F.col("votes") > len(flags) / 2)


def remove_anomalies(df: DataFrame, key: str, features: Sequence[str], **options) -> DataFrame:
    """Rows not voted anomalous."""
    bad = vote(df, key, features, **options).filter("anomalous").select(F.col("key").alias(key))
    return df.join(bad, key, "left_anti")


def anomaly_ranking(df: DataFrame, key: str, features: Sequence[str], top: int = 100, contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """(key, column, detections, score, confidence): cells by number of methods, then score.

    Row-wise methods flag every column of the row.
    """
    fs = list(features)
    filled = df.select(F.col(key).alias("key"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in fs])
    scaled = scale(filled, fs)
    each = F.explode(F.array(*[F.lit(c) for c in fs])).alias("column")

    def rowwise(scores, name, centre):
        hit = flag_top(scores, name, contamination).filter("flag = 1")
        return hit.select("key", each, F.abs(F.col(name) - centre).alias("score"))

    # the published decision function is centred at one half
    parts = [
        rowwise(isolation_forest(scaled, "key", fs, trees=100, seed=seed), "iforest", F.lit(0.5)),
        rowwise(lof(scaled, "key", fs, 20), "lof", F.lit(0.0)),
    ]
    stat = outliers(filled, "key", fs, "iqr").unionByName(outliers(filled, "key", fs, "zscore"))
    parts.append(stat.groupBy("key", "column").agg(F.max("z").alias("score")))
    cells = reduce(lambda a, b: a.unionByName(b), parts).groupBy("key", "column").agg(
        F.count(F.lit(1)).alias("detections"), F.max("score").alias("score")
    )
    return cells.orderBy(F.desc("detections"), F.desc("score"), "key", "column").limit(top).withColumn(
        "confidence", F.lit(min(1.0, len(parts) / 3) * 0.9)
    )


def unit_scores(scores: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Detector scores scaled to [0, 1]."""
    return minmax(scores, columns)
