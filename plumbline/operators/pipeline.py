"""Cleaning pipeline, analysis bundle, report rows and run metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import detectors, duplicates, impute, missing, outliers, profile, sampling, scores, similarity, text
from plumbline.operators.facts import Facts
from plumbline.operators.order_stats import one_row

Step = Callable[[DataFrame, str, dict], DataFrame]


def _columns(df: DataFrame, key: str, given, default) -> list[str]:
    return [c for c in (given or default(df)) if c != key and c in df.columns]


def _remove_duplicates(df, key, p):
    subset = p.get("subset") or [c for c in df.columns if c != key]
    return duplicates.drop_dups(df, subset, p.get("keep", "first"), key)


def _fill_missing(df, key, p):
    cols = _columns(df, key, p.get("columns"), lambda d: d.columns)
    if p.get("strategy") == "knn":
        nums = _columns(df, key, None, profile.numeric_columns)
        from plumbline.operators.neighbors import knn_impute

        return knn_impute(df, key, [c for c in cols if c in nums], nums)
    return missing.impute(df, cols, p.get("strategy", "auto"), p.get("constant_value"))


def _remove_outliers(df, key, p):
    cols = _columns(df, key, p.get("columns"), profile.numeric_columns)
    if p.get("method") == "isolation_forest":
        return detectors.remove_anomalies(df, key, cols, methods=["isolation_forest"])
    return outliers.remove_outliers(df, cols, p.get("method", "iqr"), p.get("threshold", 1.5))


def _standardize_format(df, key, p):
    rules = p.get("format_rules", {})
    return text.standardize_format(df, {c: rules[c] for c in p.get("columns", rules) if c in rules and c in df.columns})


def _correct_types(df, key, p):
    return text.correct_types(df, p.get("type_corrections"), p.get("auto_detect", True))


def _normalize_values(df, key, p):
    return outliers.scale(df, _columns(df, key, p.get("columns"), profile.numeric_columns), p.get("method", "standard"))


def _smart_duplicates(df, key, p):
    cols = _columns(df, key, p.get("columns"), profile.text_columns)
    return similarity.smart_dedup(df, key, cols, p.get("threshold", 0.85))


def _ml_imputation(df, key, p):
    return impute.ml_impute(df, key, p.get("columns"), p.get("method", "iterative"))


def _anomaly_detection(df, key, p):
    cols = _columns(df, key, p.get("columns"), profile.numeric_columns)
    return detectors.remove_anomalies(
        df, key, cols, methods=p.get("methods", detectors.METHODS[:2]), contamination=p.get("contamination", 0.1)
    )


def _text_standardization(df, key, p):
    cols = _columns(df, key, p.get("columns"), profile.text_columns)
    return text.standardize_text(df, cols, p.get("operations", text.DEFAULT_TEXT_OPERATIONS))


def _encoding(df, key, p):
    cols = _columns(df, key, p.get("columns"), profile.text_columns)
    return text.standardize_text(df, cols, ["standardize_encoding"])


OPERATIONS: dict[str, Step] = {
    "remove_duplicates": _remove_duplicates, "fill_missing": _fill_missing, "remove_outliers": _remove_outliers,
    "standardize_format": _standardize_format, "correct_types": _correct_types, "normalize_values": _normalize_values,
    "smart_duplicate_detection": _smart_duplicates, "ml_imputation": _ml_imputation, "anomaly_detection": _anomaly_detection,
    "text_standardization": _text_standardization, "auto_encoding_detection": _encoding,
}
REMOVING = {"remove_duplicates", "remove_outliers", "smart_duplicate_detection", "anomaly_detection"}


def _modifications(before: DataFrame, after: DataFrame, key: str, removing: bool) -> DataFrame:
    """Rows removed, or cells changed (compared by key, NULL-safe, as text)."""
    if removing:
        count = lambda d, n: d.agg(F.count(F.lit(1)).alias(n))
        return one_row(count(before, "b"), count(after, "a")).select((F.col("b") - F.col("a")).alias("modifications"))
    cols = [c for c in before.columns if c != key and c in after.columns]
    pair = before.select(key, *[F.col(c).cast("string").alias(f"{c}__b") for c in cols]).join(
        after.select(key, *[F.col(c).cast("string").alias(f"{c}__a") for c in cols]), key
    )
    changed = reduce(lambda a, b: a + b, [F.count_if(~F.col(f"{c}__b").eqNullSafe(F.col(f"{c}__a"))) for c in cols])
    return pair.agg(changed.alias("modifications"))


def clean(df: DataFrame, key: str, steps: Sequence[dict], report: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Apply ``[{operation, parameters}]`` in order; unknown names are skipped.

    Returns the table and (step, operation, modifications). Each step's report is one aggregate.
    """
    rows = []
    for i, s in enumerate(steps):
        op = OPERATIONS.get(s.get("operation"))
        if op is None:
            continue
        after = op(df, key, s.get("parameters") or {})
        if report:
            rows.append(
                _modifications(df, after, key, s["operation"] in REMOVING).select(
                    F.lit(i).alias("step"), F.lit(s["operation"]).alias("operation"), "modifications"
                )
            )
        df = after
    return df, (reduce(lambda a, b: a.unionByName(b), rows) if rows else None)


def preview(df: DataFrame, key: str, n: int = 100) -> DataFrame:
    return df.orderBy(key).limit(n)


def analyze(
    df: DataFrame, key: str, types: Sequence[str] = ("profile", "scores", "duplicates", "outliers", "missing", "patterns"), sample_size: int | None = None, seed: int = 42
) -> dict[str, DataFrame]:
    """Named long tables of the requested analyses; with ``sample_size`` of that many drawn rows."""
    if sample_size is not None:
        df = sampling.sample_n(df, sample_size, key, seed)
    cols = [c for c in df.columns if c != key]
    nums = [c for c in profile.numeric_columns(df) if c != key]
    txt = profile.text_columns(df)
    out: dict[str, DataFrame] = {}
    if "profile" in types:
        out["profile"] = profile.null_stats(df, cols).unionByName(profile.distinct_stats(df, cols)).unionByName(profile.numeric_stats(df, nums))
    if "scores" in types:
        out["scores"] = scores.quality_scores(df, cols)
    if "duplicates" in types:
        out["duplicates"] = duplicates.exact_duplicates(df, cols)
    if "outliers" in types:
        out["outliers"] = outliers.outlier_counts(df, nums)
    if "missing" in types:
        out["missing"] = missing.missing_total(df, cols)
    if "patterns" in types:
        out["patterns"] = text.pattern_report(df, txt)
    return out


def report(df: DataFrame, key: str) -> DataFrame:
    """(section, subject, metric, value): one row per number of the analysis bundle, from one read of the table."""
    rows = Facts(df, [c for c in df.columns if c != key]).rows_of_report()
    return df.sparkSession.createDataFrame(rows, "section string, subject string, metric string, value double")


# --- runs ------------------------------------------------------------------------------------------

# fixed values: alert thresholds
ERROR_RATE, RESPONSE_MS, QUEUE_LENGTH = 5.0, 2000.0, 100


def run_metrics(runs: DataFrame, status: str, ts: str, now: Column) -> DataFrame:
    """(active, pending, completed, failed, success_rate, error_rate, response_ms): running and pending
    jobs of all times, finished ones of the day before ``now``."""
    day = F.col(ts) >= now - F.expr("INTERVAL 1 DAY")
    n = lambda s, recent=None: F.count_if((F.col(status) == s) & (recent if recent is not None else F.lit(True)))
    agg = runs.agg(
        n("running").alias("active"), n("pending").alias("pending"), n("completed", day).alias("completed"), n("failed", day).alias("failed")
    )
    done = F.col("completed") + F.col("failed")
    err = F.coalesce(F.try_divide(F.col("failed") * 100.0, done), F.lit(0.0))
    return agg.select(
        "*", F.round(F.coalesce(F.try_divide(F.col("completed") * 100.0, done), F.lit(100.0)), 1).alias("success_rate"),
        F.round(err, 1).alias("error_rate"), (450 + err * 50).alias("response_ms"),
    )


def alerts(metrics: DataFrame) -> DataFrame:
    """(id, severity, value) of thresholds that are exceeded."""
    hit = lambda cond, i, sev, v: F.when(cond, F.struct(F.lit(i).alias("id"), F.lit(sev).alias("severity"), v.cast("double").alias("value")))
    rows = F.array_compact(
        F.array(
            hit(F.col("error_rate") > ERROR_RATE, "error_rate_high", "medium", F.col("error_rate")),
            hit(F.col("response_ms") > RESPONSE_MS, "response_time_high", "medium", F.col("response_ms")),
            hit(F.col("pending") > QUEUE_LENGTH, "queue_long", "medium", F.col("pending")),
        )
    )
    return metrics.select(F.explode(rows).alias("_cell")).select("_cell.*")


def rolled_up(services: DataFrame, status: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., status): critical if any error, else degraded, healthy if all operational, else warning."""
    s = F.col(status)
    agg = services.groupBy(*by).agg(
        F.max((s == "error").cast("int")).alias("e"), F.max((s == "degraded").cast("int")).alias("d"), F.min((s == "operational").cast("int")).alias("o")
    )
    out = F.when(F.col("e").isNull(), "unknown").when(F.col("e") == 1, "critical").when(F.col("d") == 1, "degraded").when(F.col("o") == 1, "healthy").otherwise("warning")
    return agg.select(*by, out.alias("status"))


def history(runs: DataFrame, filters: Sequence[str], newest: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of matching runs, newest first, with total and has_next."""
    hits = reduce(lambda d, f: d.filter(f), filters, runs)
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    page = hits.orderBy(*newest).offset(offset).limit(limit)
    return one_row(page, total).withColumn("has_next", F.col("total") > offset + limit)


def run_summary(runs: DataFrame, ok: Column, measure: str, kind: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., total, succeeded, success_rate, average, kinds)."""
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("succeeded"), F.round(F.count_if(ok) * 100.0 / F.count(F.lit(1)), 2).alias("success_rate"),
        F.avg(measure).alias("average"), F.array_sort(F.collect_set(kind)).alias("kinds"),
    )


def latest_per(jobs: DataFrame, parent: str, order: Sequence[str]) -> DataFrame:
    """The last job of each parent; a maximum of structs combines before the shuffle."""
    row = F.struct(*order, *[c for c in jobs.columns if c not in order and c != parent])
    return jobs.groupBy(parent).agg(F.max(row).alias("_r")).select(parent, "_r.*")


def recent_uploads(profiles: DataFrame, jobs: DataFrame, key: str, parent: str, order: Sequence[str], newest: Sequence[Column], n: int) -> DataFrame:
    """The ``n`` newest profiles with their latest job, if any."""
    top = profiles.orderBy(*newest).limit(n)
    # n rows: only their jobs are looked at
    mine = jobs.join(F.broadcast(top.select(F.col(key).alias(parent))), parent, "left_semi")
    return top.join(latest_per(mine, parent, order).withColumnRenamed(parent, key), key, "left")
