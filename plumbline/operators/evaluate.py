"""Detector evaluation, calibration and review routing.

Every metric starts from counts per (group, score): the data is read once and combined before the
shuffle; curves are prefix sums over distinct scores.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.functions.draws import draw
from plumbline.operators.order_stats import (
    bounded_join, hash_cuts, one_row, quantile_name, quantiles, ranked, running_totals, value_ranks,
)


def score_counts(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., score, pos, neg)."""
    y = F.col(label).cast("bigint")
    return df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def curve_of(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., threshold, tp, fp, precision, recall, f1) over distinct scores; 'score >= threshold' flags."""
    by = list(by)
    down = counts.withColumn("_neg", -F.col("score"))
    cum = running_totals(down, ["_neg"], {"tp": "pos", "fp": "neg"}, by)
    tot = counts.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    j = bounded_join(cum, tot, by) if by else one_row(cum, tot)
    p = F.col("tp") / (F.col("tp") + F.col("fp"))
    r = F.coalesce(F.try_divide("tp", "n_pos"), F.lit(0.0))
    return j.select(
        *by, F.col("score").alias("threshold"), "pos", "neg", "tp", "fp", "n_pos", "n_neg",
        p.alias("precision"), r.alias("recall"),
    ).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def pr_curve(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    return curve_of(score_counts(df, label, score, by), by)


def summary_of(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average precision and the metrics at the best-F1 threshold (ties: smallest threshold)."""
    best = F.max(F.struct("f1", (-F.col("threshold")).alias("neg"), "precision", "recall", "tp", "fp", "n_neg"))
    return (
        curve.groupBy(*by)
        .agg(best.alias("b"), F.sum(F.col("pos") / F.col("n_pos") * F.col("precision")).alias("auc_pr"))
        .select(
            *by, "auc_pr", (-F.col("b.neg")).alias("threshold"), "b.precision", "b.recall", "b.f1",
            ((F.col("b.recall") + 1 - F.col("b.fp") / F.greatest("b.n_neg", F.lit(1))) / 2).alias("balanced_accuracy"),
            (F.col("b.fp") / F.greatest("b.n_neg", F.lit(1))).alias("fpr"),
        )
    )


def best_f1(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    return summary_of(pr_curve(df, label, score, by), by)


def best_threshold(df: DataFrame, label: str, score: str) -> float:
    """The best-F1 threshold as a number (one value to the driver)."""
    return best_f1(df, label, score).first()["threshold"]


def evaluate(df: DataFrame, label: str, detectors: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per detector, all in one pass, ranked by F1 within ``by``."""
    cells = F.array(*[F.struct(F.lit(d).alias("detector"), F.col(d).cast("double").alias("score")) for d in detectors])
    long = df.select(*by, label, F.explode(cells).alias("_cell")).select(*by, label, "_cell.*")
    out = best_f1(long, label, "score", [*by, "detector"])
    w = W.partitionBy(*by).orderBy(F.desc("f1"), "detector")  # one row per detector
    return out.withColumn("rank", F.row_number().over(w))


def rates(tp: Column, fp: Column, n_pos: Column, n_neg: Column) -> dict[str, Column]:
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return {
        "precision": zero(tp, tp + fp), "recall": zero(tp, n_pos), "f1": zero(2 * tp, tp + fp + n_pos), "fpr": zero(fp, n_neg),
    }


def at_threshold(df: DataFrame, label: str, score: str, threshold: float | Column, by: Sequence[str] = ()) -> DataFrame:
    """(by..., flagged, tp, fp, n_pos, n_neg, precision, recall, f1, fpr) at a fixed threshold."""
    hit = F.col(score) >= threshold
    y = F.col(label) == 1
    agg = df.groupBy(*by).agg(
        F.count_if(hit).alias("flagged"), F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"),
        F.count_if(y).alias("n_pos"), F.count_if(~y).alias("n_neg"),
    )
    return agg.withColumns(rates(*[F.col(c) for c in ("tp", "fp", "n_pos", "n_neg")]))


def nested_threshold(df: DataFrame, label: str, score: str, fold: str, k: int) -> DataFrame:
    """Per fold: threshold chosen on the other folds, metrics on this one."""
    counts = score_counts(df, label, score, [fold])
    # counts, not rows, are repeated for the k-1 training sets
    train = (
        counts.withColumn("test_fold", F.explode(F.array(*[F.lit(i) for i in range(k)])))
        .filter(F.col("test_fold") != F.col(fold))
        .groupBy("test_fold", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    chosen = summary_of(curve_of(train, ["test_fold"]), ["test_fold"]).select(F.col("test_fold").alias(fold), "threshold")
    j = counts.join(F.broadcast(chosen), fold)  # k rows
    hit = F.col("score") >= F.col("threshold")
    agg = j.groupBy(fold, "threshold").agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
    )
    return agg.withColumns(rates(*[F.col(c) for c in ("tp", "fp", "n_pos", "n_neg")]))


def _bands(df: DataFrame, score: str, probs: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """Score quantiles as one row of thresholds, and df with band = thresholds at or below the score."""
    q = quantiles(df, [score], probs).select(F.array(*[quantile_name(score, i) for i in range(len(probs))]).alias("_taus"))
    return q, one_row(df, q).withColumn("_band", F.size(F.filter("_taus", lambda t: t <= F.col(score))))


def threshold_sweep(df: DataFrame, label: str, score: str, probs: Sequence[float] | None = None) -> DataFrame:
    """Metrics at score quantiles: rows fall into bands in one pass, the sweep runs on band counts."""
    ps = list(probs) if probs is not None else [float(p) for p in np.linspace(0.50, 0.99, 25)]
    q, banded = _bands(df, score, ps)
    counts = banded.groupBy("_band").agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    slots = q.select(F.posexplode("_taus").alias("i", "threshold")).withColumn(
        "quantile", F.element_at(F.array(*[F.lit(p) for p in ps]), F.col("i") + 1)
    )
    # at most 26 band rows x 25 thresholds
    agg = slots.crossJoin(F.broadcast(counts)).groupBy("quantile", "threshold").agg(
        F.sum(F.when(F.col("_band") > F.col("i"), F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("_band") > F.col("i"), F.col("neg")).otherwise(0)).alias("fp"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
    )
    r = rates(*[F.col(c) for c in ("tp", "fp", "n_pos", "n_neg")])
    flagged = F.col("tp") + F.col("fp")
    return agg.withColumns(r).select(
        "quantile", "threshold", flagged.alias("flagged"),
        (flagged * 100.0 / (F.col("n_pos") + F.col("n_neg"))).alias("workload_pct"), *r,
    )


def family_recall(df: DataFrame, label: str, family: str, score: str, threshold: float) -> DataFrame:
    """(family, injected, recovered, recall)."""
    pos = df.filter(F.col(label) == 1)
    return pos.groupBy(family).agg(
        F.count(F.lit(1)).alias("injected"), F.count_if(F.col(score) >= threshold).alias("recovered")
    ).withColumn("recall", F.col("recovered") / F.col("injected"))


def confusion(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    return df.groupBy(F.col(label).alias("y"), (F.col(score) >= threshold).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def bin_of(score: str, bins: int) -> Column:
    """Equal-width bin on [0, 1]; the last bin is closed."""
    edges = F.array(*[F.lit(float(e)) for e in np.linspace(0, 1, bins + 1)[1:-1]])
    return F.size(F.filter(edges, lambda e: e <= F.col(score)))


def score_histogram(df: DataFrame, label: str, score: str, bins: int = 59) -> DataFrame:
    return df.groupBy(F.col(label).alias("y"), bin_of(score, bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def calibration(df: DataFrame, label: str, score: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """(by..., ece, ece_unweighted, brier)."""
    y = F.col(label).cast("double")
    per = df.groupBy(*by, bin_of(score, bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("acc"), F.avg(score).alias("conf"), F.sum(F.pow(F.col(score) - y, 2)).alias("sq")
    )
    gap = F.abs(F.col("acc") - F.col("conf"))
    return per.groupBy(*by).agg(
        (F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.avg(gap).alias("ece_unweighted"), (F.sum("sq") / F.sum("n")).alias("brier")
    )


def brier(df: DataFrame, label: str, score: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"))


LANE_COUNTS = ["n_clean", "pos_clean", "n_review", "pos_review", "n_pass", "pos_pass"]


def lane_metrics(counts: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Coverage, precision, accuracy, burden and missed anomalies from lane counts."""
    n = F.col("n_clean") + F.col("n_review") + F.col("n_pass")
    return counts.select(
        *keep,
        F.round(F.col("n_clean") / n, 4).alias("auto_clean_coverage"),
        F.round(F.try_divide("pos_clean", "n_clean"), 4).alias("auto_clean_precision"),
        F.round(F.col("n_review") / n, 4).alias("analyst_burden"),
        F.round(F.col("n_pass") / n, 4).alias("auto_pass_coverage"),
        F.round(F.try_divide(F.col("n_pass") - F.col("pos_pass"), F.col("n_pass")), 4).alias("auto_pass_accuracy"),
        F.col("pos_pass").alias("missed_anomalies"),
    )


def lane(score: str, low: Column | float, high: Column | float) -> Column:
    return F.when(F.col(score) >= high, "auto_clean").when(F.col(score) >= low, "review").otherwise("auto_pass")


def routing(df: DataFrame, label: str, score: str, low: float, high: float) -> DataFrame:
    """Three lanes at fixed thresholds."""
    pos = F.col(label) == 1
    ln = lane(score, low, high)
    names = (("auto_clean", "clean"), ("review", "review"), ("auto_pass", "pass"))
    agg = df.agg(
        *[F.count_if(ln == full).alias(f"n_{s}") for full, s in names],
        *[F.count_if((ln == full) & pos).alias(f"pos_{s}") for full, s in names],
    )
    return lane_metrics(agg.withColumn("low", F.lit(low)).withColumn("high", F.lit(high)), ["low", "high"])


def routing_pairs(df: DataFrame, label: str, score: str, probs: Sequence[float], pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """Lanes for pairs of score quantiles. Rows are counted per band once; pairs run on band counts."""
    q, banded = _bands(df, score, probs)
    counts = banded.groupBy("_band").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("pos"))
    pick = F.explode(
        F.array(
            *[
                F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col("_taus")[a].alias("low"), F.col("_taus")[b].alias("high"))
                for a, b in pairs
            ]
        )
    )
    slots = q.select(pick.alias("_cell")).select("_cell.*")
    is_clean, is_pass = F.col("_band") > F.col("j"), F.col("_band") <= F.col("i")
    total = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0))
    agg = slots.crossJoin(F.broadcast(counts)).groupBy("i", "j", "low", "high").agg(
        total(is_clean, "n").alias("n_clean"), total(is_clean, "pos").alias("pos_clean"),
        total(~is_clean & is_pass, "n").alias("n_pass"), total(~is_clean & is_pass, "pos").alias("pos_pass"),
        total(~is_clean & ~is_pass, "n").alias("n_review"), total(~is_clean & ~is_pass, "pos").alias("pos_review"),
    )
    return lane_metrics(agg, ["i", "j", "low", "high"])


# fixed values: quantiles and index pairs of the routing report, and the size of its grid
ROUTING_QUANTILES = [0.50, 0.60, 0.70, 0.80, 0.90, 0.95, 0.99]
ROUTING_PAIRS = [(0, 4), (1, 4), (1, 5), (2, 5), (2, 6)]
GRID_QUANTILES = [float(p) for p in np.linspace(0.40, 0.99, 15)]


def routing_grid(df: DataFrame, label: str, score: str) -> DataFrame:
    pairs = [(i, j) for i in range(15) for j in range(15) if j > i]
    return routing_pairs(df, label, score, GRID_QUANTILES, pairs).filter("high > low")


def review_budget(df: DataFrame, label: str, score: str) -> DataFrame:
    """Lanes between the median score and the best-F1 threshold."""
    cuts = one_row(
        best_f1(df, label, score).select(F.col("threshold").alias("tau_star")),
        quantiles(df, [score], [0.5]).select(F.col(quantile_name(score, 0)).alias("tau_lo")),
    )
    s, y = F.col(score), F.col(label)
    j = one_row(df, cuts)
    return j.groupBy("tau_lo", "tau_star").agg(
        F.count_if(s < F.col("tau_lo")).alias("n_auto_clean"),
        F.count_if((s >= F.col("tau_lo")) & (s < F.col("tau_star"))).alias("n_review"),
        F.count_if(s >= F.col("tau_star")).alias("n_quarantine"),
        F.round(
            F.count_if((s >= F.col("tau_star")) & (y == 0)) / F.greatest(F.count_if(s >= F.col("tau_star")), F.lit(1)), 4
        ).alias("fp_fraction"),
        F.count_if((s < F.col("tau_star")) & (y == 1)).alias("fn_escaped"),
    )


# fixed values: prevalences of the sweep
PREVALENCES = [0.01, 0.02, 0.03, 0.05, 0.07, 0.10, 0.15, 0.20, 0.25, 0.30]


def prevalence_sweep(
    df: DataFrame, label: str, score: str, key: str, drop: str = "pos", prevalences: Sequence[float] = PREVALENCES, seed: int = 42
) -> DataFrame:
    """Fixed-threshold and oracle metrics at several prevalences in one job.

    All prevalences share one draw order, so their samples nest and the rows carry the list of
    prevalences that keep them.
    """
    tau = best_threshold(df, label, score)
    n_pos, n_neg = df.agg(F.sum(label), F.sum(1 - F.col(label))).first()
    dropped, have = (0, n_neg) if drop == "neg" else (1, n_pos)
    want = {
        p: min(int(n_pos * (1 - p) / max(p, 1e-6)) if drop == "neg" else int(n_neg * p / max(1 - p, 1e-6)), have)
        for p in prevalences
    }
    want = {p: t for p, t in want.items() if t >= (10 if drop == "neg" else 5)}
    drawn = df.withColumn("_h", draw(seed, f"sweep-{drop}", key))
    quotas = df.sparkSession.createDataFrame([(i, t) for i, t in enumerate(want.values())], "slot int, take bigint")
    cuts = {r["slot"]: r["cut"] for r in hash_cuts(drawn.filter(F.col(label) == dropped), "_h", quotas).collect()}
    kept = F.array_compact(
        F.array(*[F.when((F.col(label) != dropped) | (F.col("_h") <= cuts[i]), F.lit(p)) for i, p in enumerate(want)])
    )
    rows = drawn.select(label, score, F.explode(kept).alias("prevalence"))
    counts = score_counts(rows, label, score, ["prevalence"])
    oracle = summary_of(curve_of(counts, ["prevalence"]), ["prevalence"]).select("prevalence", F.col("f1").alias("f1_oracle"), "auc_pr")
    hit = F.col("score") >= tau
    fixed = counts.groupBy("prevalence").agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
    )
    r = rates(*[F.col(c) for c in ("tp", "fp", "n_pos", "n_neg")])
    return fixed.withColumns(r).join(oracle, "prevalence").select(
        "prevalence", "n_pos", "n_neg", F.col("f1").alias("f1_fixed"), F.col("precision").alias("precision_fixed"),
        F.col("recall").alias("recall_fixed"), "f1_oracle", "auc_pr",
    )


def ordered_evaluation(df: DataFrame, label: str, score: str, order_by: str, frac: float = 0.7) -> DataFrame:
    """Metrics of the first ``frac``, the rest and all rows at the threshold of the whole table."""
    tau = best_threshold(df, label, score)
    cut = quantiles(df, [order_by], [frac]).first()[quantile_name(order_by, 0)]
    part = F.when(F.col(order_by) <= cut, "early").otherwise("late")
    rows = df.withColumn("split", F.explode(F.array(part, F.lit("full"))))
    return at_threshold(rows, label, score, tau, ["split"])


# fixed values: two-sided 95 % points of Student's t for 1 to 30 degrees of freedom
T95 = [
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131,
    2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
]


def run_summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, mean, population std, min, max, ci_low, ci_high) with the 95 % t interval."""
    agg = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.stddev_samp(value).alias("_s"), F.min(value).alias("min"), F.max(value).alias("max"),
    )
    t = F.when(F.col("n") > 30, 1.96).otherwise(F.try_element_at(F.array(*[F.lit(v) for v in T95]), F.greatest(F.col("n") - 1, F.lit(1)).cast("int")))
    half = F.coalesce(t * F.col("_s") / F.sqrt("n"), F.lit(0.0))
    return agg.withColumns({"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half}).drop("_s")


def paired_comparison(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, mean_diff, std_diff, t, cohens_d, wilcoxon_w): W is the smaller signed-rank sum, zeros dropped."""
    by = list(by)
    d = df.withColumn("_d", F.col(a) - F.col(b)).filter("_d IS NOT NULL")
    base = d.groupBy(*by).agg(F.count("_d").alias("n"), F.avg("_d").alias("mean_diff"), F.stddev_samp("_d").alias("std_diff"))
    nz = d.filter("_d <> 0").withColumn("_abs", F.abs("_d"))
    signs = nz.groupBy(*by, "_abs").agg(F.count_if(F.col("_d") > 0).alias("_up"), F.count_if(F.col("_d") < 0).alias("_down"))
    ranks = value_ranks(nz, "_abs", by).select(*by, "_abs", ((F.col("n_lt") + 1 + F.col("n_le")) / 2).alias("_rank"))
    sums = signs.join(ranks, [*by, "_abs"]).groupBy(*by).agg(
        F.least(F.sum(F.col("_rank") * F.col("_up")), F.sum(F.col("_rank") * F.col("_down"))).alias("wilcoxon_w")
    )
    out = base.join(sums, by, "left") if by else one_row(base, sums)
    return out.withColumns(
        {
            "t": F.try_divide(F.col("mean_diff"), F.col("std_diff") / F.sqrt("n")),
            "cohens_d": F.try_divide("mean_diff", "std_diff"),
        }
    )


def holm(df: DataFrame, p: str, key: str, name: str = "p_holm") -> DataFrame:
    """Holm-Bonferroni adjustment of a column of p-values."""
    n = df.agg(F.count(p).alias("_m"))
    step = one_row(ranked(df, [p, key], (), "_rn"), n).withColumn(
        "_raw", F.least(F.lit(1.0), F.col(p) * (F.col("_m") - F.col("_rn") + 1))
    )
    # a running maximum over a handful of tests
    return step.withColumn(name, F.max("_raw").over(W.orderBy("_rn").rowsBetween(W.unboundedPreceding, 0))).drop("_rn", "_m", "_raw")


def detection_quality(df: DataFrame, detected: str, actual: str, false_positives: str) -> DataFrame:
    """Precision, recall and F1 from counts of detected, actual and falsely detected items."""
    tp = F.least(F.col(detected), F.col(actual)) - F.col(false_positives)
    p = F.coalesce(F.try_divide(tp, F.col(detected)), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp, F.col(actual)), F.lit(0.0))
    return df.withColumns({"precision": p, "recall": r}).withColumn(
        "f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    )
