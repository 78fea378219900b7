"""Evaluation, calibration and routing of the derived detector scores."""

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import evaluate as e
from plumbline.operators.sampling import assign_folds
from plumbline.plans.registry import query
from plumbline.plans.shapes import SCORED, scored, with_

S = with_("s", SCORED)
DETECTORS = ["rule", "stat", "iforest", "lof", "score"]


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def curve_sql(src, score="score", by=""):
    """CTE body: precision-recall curve per group."""
    part = f"PARTITION BY {by}" if by else ""
    g = f"{by}," if by else ""
    return f"""SELECT *, tp / (tp + fp) AS precision, tp / n_pos AS recall, CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (tp + fp + n_pos) END AS f1 FROM (
      SELECT {g} threshold, pos, sum(pos) OVER ({part} ORDER BY threshold DESC) AS tp, sum(neg) OVER ({part} ORDER BY threshold DESC) AS fp,
        sum(pos) OVER ({part}) AS n_pos, sum(neg) OVER ({part}) AS n_neg
      FROM (SELECT {g} {score} AS threshold, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM {src} GROUP BY {g} {score}) c) d"""


CURVE = f"{S}, c AS ({curve_sql('s')})"
# the tie rule of the best threshold: F1 compared at ten digits, then the smallest threshold
TAU = "(SELECT threshold FROM c ORDER BY round(f1, 10) DESC, threshold LIMIT 1)"


@query("n1_pr_curve", f"{CURVE} SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(precision, 6) AS precision, round(recall, 6) AS recall FROM c")
def n1(t):
    return r6(e.pr_curve(scored(t), "y", "score").select("threshold", "tp", "fp", "precision", "recall"), "precision", "recall")


@query("n2_average_precision", f"{CURVE} SELECT round(sum(pos / n_pos * precision), 6) AS auc_pr FROM c")
def n2(t):
    return r6(e.best_f1(scored(t), "y", "score").select("auc_pr"), "auc_pr")


@query(
    "n3_best_f1",
    f"""{CURVE} SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
    round((recall + 1 - fp / n_neg) / 2, 6) AS balanced_accuracy, round(fp / n_neg, 6) AS fpr FROM c ORDER BY round(c.f1, 10) DESC, threshold LIMIT 1""",
)
def n3(t):
    out = e.best_f1(scored(t), "y", "score").drop("auc_pr")
    return r6(out, "precision", "recall", "f1", "balanced_accuracy", "fpr")


def fixed_sql(src, tau, by=""):
    g = f"{by}," if by else ""
    return f"""SELECT {g} tp + fp AS flagged, tp, fp, n_pos, n_neg, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp * 1.0::DOUBLE / (tp + fp) END, 6) AS precision,
      round(tp * 1.0::DOUBLE / n_pos, 6) AS recall, round(2.0::DOUBLE * tp / (tp + fp + n_pos), 6) AS f1, round(fp * 1.0::DOUBLE / n_neg, 6) AS fpr
      FROM (SELECT {g} count(*) FILTER (WHERE score >= {tau} AND y = 1) AS tp, count(*) FILTER (WHERE score >= {tau} AND y = 0) AS fp,
        count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg FROM {src} {('GROUP BY ' + by) if by else ''}) k"""


RATES = ("precision", "recall", "f1", "fpr")


@query("n4_fixed_threshold", f"{S} {fixed_sql('s', '0.5')}")
def n4(t):
    return r6(e.at_threshold(scored(t), "y", "score", 0.5), *RATES)


FOLD = "ntile(5) OVER (PARTITION BY y ORDER BY md5('42|folds|' || CAST(row_id AS VARCHAR))) - 1"


@query(
    "n5_nested_threshold",
    f"""{S}, f AS (SELECT *, {FOLD} AS fold FROM s),
    tr AS (SELECT k AS test_fold, y, score FROM f, range(5) r(k) WHERE fold <> k), c AS ({curve_sql('tr', by='test_fold')}),
    b AS (SELECT test_fold, threshold FROM (SELECT *, row_number() OVER (PARTITION BY test_fold ORDER BY round(f1, 10) DESC, threshold) AS rn FROM c) z WHERE rn = 1),
    m AS (SELECT fold, threshold, count(*) FILTER (WHERE score >= threshold AND y = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND y = 0) AS fp,
      count(*) FILTER (WHERE y = 1) AS n_pos FROM f JOIN b ON fold = test_fold GROUP BY 1, 2)
    SELECT CAST(fold AS INTEGER) AS fold, threshold, tp, fp, round(tp * 1.0::DOUBLE / (tp + fp), 6) AS precision, round(tp * 1.0::DOUBLE / n_pos, 6) AS recall,
      round(2.0::DOUBLE * tp / (tp + fp + n_pos), 6) AS f1 FROM m""",
)
def n5(t):
    folds = assign_folds(scored(t).select("row_id", "y", "score"), 5, "row_id", label="y")
    out = e.nested_threshold(folds, "y", "score", "fold", 5).select("fold", "threshold", "tp", "fp", "precision", "recall", "f1")
    return r6(out, "precision", "recall", "f1")


SWEEP = [float(p) for p in np.linspace(0.50, 0.99, 25)]


@query(
    "n6_threshold_sweep",
    f"""{S}, q AS ({' UNION ALL '.join(f'SELECT {p!r}::DOUBLE AS quantile, quantile_cont(score, {p!r}::DOUBLE) AS threshold FROM s' for p in SWEEP)}),
    m AS (SELECT quantile, threshold, count(*) FILTER (WHERE score >= threshold AND y = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND y = 0) AS fp,
      count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg FROM q CROSS JOIN s GROUP BY 1, 2)
    SELECT round(quantile, 6) AS quantile, round(threshold, 6) AS threshold, tp + fp AS flagged, round((tp + fp) * 100.0::DOUBLE / (n_pos + n_neg), 6) AS workload_pct,
      round(tp * 1.0::DOUBLE / (tp + fp), 6) AS precision, round(tp * 1.0::DOUBLE / n_pos, 6) AS recall, round(2.0::DOUBLE * tp / (tp + fp + n_pos), 6) AS f1,
      round(fp * 1.0::DOUBLE / n_neg, 6) AS fpr FROM m""",
)
def n6(t):
    return r6(e.threshold_sweep(scored(t), "y", "score"), "quantile", "threshold", "workload_pct", *RATES)


@query(
    "n7_family_recall",
    f"""{CURVE} SELECT family, count(*) AS injected, count(*) FILTER (WHERE score >= {TAU}) AS recovered,
    round(count(*) FILTER (WHERE score >= {TAU}) * 1.0::DOUBLE / count(*), 6) AS recall FROM s WHERE y = 1 GROUP BY 1""",
)
def n7(t):
    s = scored(t)
    return r6(e.family_recall(s, "y", "family", "score", e.best_threshold(s, "y", "score")), "recall")


@query("n8_confusion", f"{CURVE} SELECT y, CAST(score >= {TAU} AS INTEGER) AS predicted, count(*) AS n FROM s GROUP BY 1, 2")
def n8(t):
    s = scored(t)
    return e.confusion(s, "y", "score", e.best_threshold(s, "y", "score"))


def bin_sql(bins):
    edges = ", ".join(repr(float(x)) + "::DOUBLE" for x in np.linspace(0, 1, bins + 1)[1:-1])
    return f"CAST(len(list_filter([{edges}], lambda x: x <= score)) AS INTEGER)"


@query("n9_score_histogram", f"{S} SELECT y, {bin_sql(59)} AS bin, count(*) AS n FROM s GROUP BY 1, 2")
def n9(t):
    return e.score_histogram(scored(t), "y", "score")


@query(
    "n10_calibration_error",
    f"""{S}, b AS (SELECT {bin_sql(10)} AS bin, count(*) AS n, avg(y) AS a, avg(score) AS c FROM s GROUP BY 1)
    SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS ece, round(avg(abs(a - c)), 6) AS ece_unweighted FROM b""",
)
def n10(t):
    return r6(e.calibration(scored(t), "y", "score").select("ece", "ece_unweighted"), "ece", "ece_unweighted")


@query("n11_brier", f"{S} SELECT round(avg((score - y) * (score - y)), 6) AS brier FROM s")
def n11(t):
    return r6(e.brier(scored(t), "y", "score"), "brier")


def lanes_sql(src, low, high, keys):
    """Lane metrics of ``src`` rows at columns or literals low/high."""
    g = f"GROUP BY {keys}" if keys else ""
    k = f"{keys}," if keys else ""
    return f"""SELECT {k} round(nc * 1.0::DOUBLE / n, 4) AS auto_clean_coverage, round(CASE WHEN nc > 0 THEN pc * 1.0::DOUBLE / nc END, 4) AS auto_clean_precision,
      round(nr * 1.0::DOUBLE / n, 4) AS analyst_burden, round(np * 1.0::DOUBLE / n, 4) AS auto_pass_coverage,
      round(CASE WHEN np > 0 THEN (np - pp) * 1.0::DOUBLE / np END, 4) AS auto_pass_accuracy, pp AS missed_anomalies
      FROM (SELECT {k} count(*) AS n, count(*) FILTER (WHERE score >= {high}) AS nc, count(*) FILTER (WHERE score >= {high} AND y = 1) AS pc,
        count(*) FILTER (WHERE score >= {low} AND score < {high}) AS nr, count(*) FILTER (WHERE score < {low}) AS np,
        count(*) FILTER (WHERE score < {low} AND y = 1) AS pp FROM {src} {g}) z"""


@query("n13_three_lanes", f"{S} {lanes_sql('s', '0.45', '0.75', '')}")
def n13(t):
    return e.routing(scored(t), "y", "score", 0.45, 0.75).drop("low", "high")


def pairs_sql(probs, pairs, distinct=False):
    q = ", ".join(f"quantile_cont(score, {p!r}::DOUBLE)" for p in probs)
    rows = " UNION ALL ".join(f"SELECT {a} AS i, {b} AS j, t[{a + 1}] AS low, t[{b + 1}] AS high FROM q" for a, b in pairs)
    keep = "WHERE high > low" if distinct else ""
    return f"""{S}, q AS (SELECT [{q}] AS t FROM s), g AS (SELECT i, j, low, high, score, y FROM ({rows}) r CROSS JOIN s {keep})
      SELECT i, j, round(low, 6) AS low, round(high, 6) AS high, * EXCLUDE (i, j, low, high) FROM ({lanes_sql('g', 'low', 'high', 'i, j, low, high')}) w"""


@query("n14_routing_pairs", pairs_sql(e.ROUTING_QUANTILES, e.ROUTING_PAIRS))
def n14(t):
    return r6(e.routing_pairs(scored(t), "y", "score", e.ROUTING_QUANTILES, e.ROUTING_PAIRS), "low", "high")


@query("n14_routing_grid", pairs_sql(e.GRID_QUANTILES, [(i, j) for i in range(15) for j in range(15) if j > i], True))
def n14_grid(t):
    return r6(e.routing_grid(scored(t), "y", "score"), "low", "high")


@query(
    "n15_review_budget",
    f"""{CURVE}, k AS (SELECT (SELECT quantile_cont(score, 0.5) FROM s) AS tau_lo, {TAU} AS tau_star)
    SELECT tau_lo, tau_star, count(*) FILTER (WHERE score < tau_lo) AS n_auto_clean, count(*) FILTER (WHERE score >= tau_lo AND score < tau_star) AS n_review,
    count(*) FILTER (WHERE score >= tau_star) AS n_quarantine, round(count(*) FILTER (WHERE score >= tau_star AND y = 0) * 1.0::DOUBLE /
      greatest(1, count(*) FILTER (WHERE score >= tau_star)), 4) AS fp_fraction, count(*) FILTER (WHERE score < tau_star AND y = 1) AS fn_escaped FROM s, k GROUP BY 1, 2""",
)
def n15(t):
    return e.review_budget(scored(t), "y", "score")


def sweep_sql(drop):
    d = 0 if drop == "neg" else 1
    take = "least(floor(a * (1 - p) / p), b)" if drop == "neg" else "least(floor(b * p / (1 - p)), a)"
    floor = 10 if drop == "neg" else 5
    return f"""{CURVE}, n AS (SELECT CAST(sum(y) AS DOUBLE) AS a, CAST(sum(1 - y) AS DOUBLE) AS b FROM s),
    w AS (SELECT p, CAST({take} AS BIGINT) AS take FROM (SELECT unnest({e.PREVALENCES})::DOUBLE AS p) v, n WHERE {take} >= {floor}),
    r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42|sweep-{drop}|' || CAST(row_id AS VARCHAR))) AS rn FROM s),
    x AS (SELECT p AS prevalence, y, score FROM r, w WHERE y <> {d} OR rn <= take),
    xc AS ({curve_sql('x', by='prevalence')}),
    o AS (SELECT prevalence, max(f1) AS f1_oracle, sum(pos / n_pos * precision) AS auc_pr FROM xc GROUP BY 1),
    f AS (SELECT prevalence, count(*) FILTER (WHERE score >= {TAU} AND y = 1) AS tp, count(*) FILTER (WHERE score >= {TAU} AND y = 0) AS fp,
      count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg FROM x GROUP BY 1)
    SELECT prevalence, n_pos, n_neg, round(2.0::DOUBLE * tp / (tp + fp + n_pos), 6) AS f1_fixed, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp * 1.0::DOUBLE / (tp + fp) END, 6) AS precision_fixed,
      round(tp * 1.0::DOUBLE / n_pos, 6) AS recall_fixed, round(f1_oracle, 6) AS f1_oracle, round(auc_pr, 6) AS auc_pr FROM f JOIN o USING (prevalence)"""


SWEPT = ("f1_fixed", "precision_fixed", "recall_fixed", "f1_oracle", "auc_pr")


@query("n16_prevalence_sweep", sweep_sql("pos"))
def n16(t):
    return r6(e.prevalence_sweep(scored(t), "y", "score", "row_id", "pos"), *SWEPT)


@query("n16_prevalence_sweep_biased", sweep_sql("neg"))
def n16_biased(t):
    return r6(e.prevalence_sweep(scored(t), "y", "score", "row_id", "neg"), *SWEPT)


@query(
    "n17_ordered_evaluation",
    f"""{CURVE}, o AS (SELECT unnest([CASE WHEN row_id <= (SELECT quantile_cont(row_id, 0.7) FROM s) THEN 'early' ELSE 'late' END, 'full']) AS split, y, score FROM s)
    {fixed_sql('o', TAU, 'split')}""",
)
def n17(t):
    return r6(e.ordered_evaluation(scored(t), "y", "score", "row_id"), *RATES)


RUNS = "SELECT row_id % 12 AS run, family, avg(score) AS value FROM s GROUP BY 1, 2"


@query(
    "n18_run_summary",
    f"""{S}, r AS ({RUNS}), g AS (SELECT family, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, stddev_samp(value) AS ss, min(value) AS lo, max(value) AS hi FROM r GROUP BY 1)
    SELECT family, n, round(mean, 6) AS mean, round(std, 6) AS std, round(lo, 6) AS min, round(hi, 6) AS max,
      round(mean - [{', '.join(map(str, e.T95))}][n - 1] * ss / sqrt(n), 6) AS ci_low, round(mean + [{', '.join(map(str, e.T95))}][n - 1] * ss / sqrt(n), 6) AS ci_high FROM g""",
)
def n18(t):
    runs = scored(t).groupBy((F.col("row_id") % 12).alias("run"), "family").agg(F.avg("score").alias("value"))
    return r6(e.run_summary(runs, "value", ["family"]), "mean", "std", "min", "max", "ci_low", "ci_high")


@query(
    "n19_paired_comparison",
    f"""{S}, d AS (SELECT family, rule - stat AS d FROM s), m AS (SELECT family, count(d) AS n, avg(d) AS mean_diff, stddev_samp(d) AS std_diff FROM d GROUP BY 1),
    k AS (SELECT family, d, rank() OVER (PARTITION BY family ORDER BY abs(d)) + (count(*) OVER (PARTITION BY family, abs(d)) - 1) / 2.0::DOUBLE AS r FROM d WHERE d <> 0),
    w AS (SELECT family, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS wilcoxon_w FROM k GROUP BY 1)
    SELECT family, n, round(mean_diff, 6) AS mean_diff, round(std_diff, 6) AS std_diff, round(mean_diff / (std_diff / sqrt(n)), 4) AS t,
      round(mean_diff / std_diff, 6) AS cohens_d, CAST(wilcoxon_w AS DOUBLE) AS wilcoxon_w FROM m LEFT JOIN w USING (family)""",
)
def n19(t):
    out = e.paired_comparison(scored(t), "rule", "stat", ["family"])
    return r6(out, "mean_diff", "std_diff", "cohens_d").withColumn("t", F.round("t", 4))


PVALUES = f"SELECT family, round(avg(lof) / 20, 4) AS p FROM s GROUP BY 1"


@query(
    "n19_holm_adjustment",
    f"""{S}, p AS ({PVALUES}), k AS (SELECT *, row_number() OVER (ORDER BY p, family) AS rn, count(*) OVER () AS m FROM p)
    SELECT family, p, round(max(least(1, p * (m - rn + 1))) OVER (ORDER BY rn), 6) AS p_holm FROM k""",
)
def n19_holm(t):
    p = scored(t).groupBy("family").agg(F.round(F.avg("lof") / 20, 4).alias("p"))
    return r6(e.holm(p, "p", "family"), "p_holm")


@query(
    "n20_detection_quality",
    f"""{S}, d AS (SELECT family, count(*) FILTER (WHERE rule >= 0.35) AS detected, count(*) FILTER (WHERE stat >= 0.3) AS actual, count(*) FILTER (WHERE rule >= 0.55 AND stat < 0.1) AS fp FROM s GROUP BY 1),
    q AS (SELECT *, (least(detected, actual) - fp) * 1.0::DOUBLE / detected AS precision, (least(detected, actual) - fp) * 1.0::DOUBLE / actual AS recall FROM d)
    SELECT family, detected, actual, fp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM q""",
)
def n20(t):
    d = scored(t).groupBy("family").agg(
        F.count_if(F.col("rule") >= 0.35).alias("detected"), F.count_if(F.col("stat") >= 0.3).alias("actual"), F.count_if((F.col("rule") >= 0.55) & (F.col("stat") < 0.1)).alias("fp")
    )
    return r6(e.detection_quality(d, "detected", "actual", "fp"), "precision", "recall", "f1")


@query(
    "n21_ranked_detectors",
    f"""{S}, l AS ({' UNION ALL '.join(f"SELECT '{d}' AS detector, y, {d} AS score FROM s" for d in DETECTORS)}), c AS ({curve_sql('l', by='detector')}),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY detector ORDER BY round(f1, 10) DESC, threshold) AS rn FROM c) z WHERE rn = 1),
    a AS (SELECT detector, sum(pos / n_pos * precision) AS auc_pr FROM c GROUP BY 1)
    SELECT detector, round(auc_pr, 6) AS auc_pr, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
    CAST(row_number() OVER (ORDER BY round(b.f1, 10) DESC, detector) AS INTEGER) AS rank FROM b JOIN a USING (detector)""",
)
def n21(t):
    out = e.evaluate(scored(t), "y", DETECTORS).select("detector", "auc_pr", "threshold", "precision", "recall", "f1", "rank")
    return r6(out, "auc_pr", "precision", "recall", "f1")
