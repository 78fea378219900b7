"""Quarantine, repair and downstream-query gates: how wrong are analyst queries on dirty, cleansed,
repaired or partly reinstated tables?"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.order_stats import bounded_join, one_row, quantile_name, quantiles
from plumbline.operators.profile import numeric_columns
from plumbline.session import cut_lineage

STRUCTURAL = "STRUCTURAL"
CONDITIONS = ["dirty", "clean", "repaired", "coupled"]
EPS = 1e-9


def attach_scores(df: DataFrame, scores: DataFrame, key: str, score: str) -> DataFrame:
    return df.join(scores.select(key, score), key)


def quarantine(df: DataFrame, score: str, tau: float) -> DataFrame:
    """Rows that pass: score below ``tau``."""
    return df.filter(F.col(score) < tau)


def repair(dirty: DataFrame, truth: DataFrame, key: str, score: str, tau: float) -> DataFrame:
    """True values for quarantined rows; quarantined rows that the truth does not hold are dropped."""
    cols = truth.columns
    held = dirty.filter(F.col(score) >= tau).select(key)
    return dirty.filter(F.col(score) < tau).select(*cols).unionByName(truth.join(held, key, "left_semi"))


def provenance(
    dirty: DataFrame, truth: DataFrame, key: str, score: str, tau: float, columns: Sequence[str] | None = None, z: float = 3.0
) -> DataFrame:
    """(key, columns): per quarantined row the columns with |z| above ``z`` against the true table;
    added rows carry STRUCTURAL."""
    cols = [c for c in (columns or numeric_columns(truth)) if c != key]
    stats = truth.selectExpr(*[x for c in cols for x in (f"avg(double(`{c}`)) AS `{c}__m`", f"stddev_samp(double(`{c}`)) AS `{c}__s`")])
    held = dirty.filter(F.col(score) >= tau)
    known = held.join(truth.select(F.col(key), F.lit(True).alias("_known")), key, "left")
    odd = [f"CASE WHEN abs((`{c}` - `{c}__m`) / CASE WHEN `{c}__s` = 0 THEN 1.0D ELSE `{c}__s` END) > {float(z)}D THEN '{c}' END" for c in cols]
    implicated = f"array_compact(array({', '.join(odd)}))" if odd else "array()"
    return one_row(known, stats).selectExpr(f"`{key}`", f"CASE WHEN _known THEN {implicated} ELSE array('{STRUCTURAL}') END AS columns")


def reinstated(prov: str, query_columns: Sequence[str]) -> str:
    """SQL condition: whether a quarantined row may be used by a query over ``query_columns``."""
    used = ", ".join(f"'{c}'" for c in query_columns)
    return f"NOT array_contains({prov}, '{STRUCTURAL}') AND (size({prov}) = 0 OR NOT arrays_overlap({prov}, array({used})))"


def coupled(dirty: DataFrame, prov: DataFrame, key: str, score: str, tau: float, query_columns: Sequence[str]) -> DataFrame:
    """Rows that pass, plus quarantined rows whose implicated columns the query does not read."""
    j = dirty.join(prov.withColumnRenamed("columns", "_prov"), key, "left")
    return j.filter(f"`{score}` < {tau} OR ({reinstated('_prov', query_columns)})").drop("_prov")


@dataclass(frozen=True)
class GateQuery:
    """An analyst's query: one aggregate over a table, of all rows or by one column. ``columns`` are the columns it reads.

    ``measure`` is sum, avg, count, ratio (of two sums), distinct or percentile (at ``share``) over the columns ``over``. ``top`` keeps the
    groups with the highest results, ties by group; ``ranked`` adds their rank.
    """

    id: str
    dataset: str
    stratum: str
    columns: tuple[str, ...]
    name: str
    measure: str
    over: tuple[str, ...] = ()
    digits: int | None = None
    where: str | None = None
    by: str | None = None
    top: int | None = None
    ranked: bool = False
    share: float | None = None

    @property
    def kind(self) -> str:
        return "table" if self.by else "scalar"

    @property
    def outputs(self) -> list[str]:
        return [*([self.by] if self.by else []), self.name, *(["rnk"] if self.ranked else [])]

    @property
    def sql(self) -> str:
        """The query as plain SQL over ``{table}``."""
        raw = {
            "sum": "sum({0})", "avg": "avg({0})", "count": "count(*)", "ratio": "sum({0}) / nullif(sum({1}), 0)", "distinct": "count(DISTINCT {0})",
            "percentile": f"percentile_cont({self.share}) WITHIN GROUP (ORDER BY {{0}})",
        }[self.measure].format(*self.over)
        shown = raw if self.digits is None else f"round({raw}, {self.digits})"
        where = f" WHERE {self.where}" if self.where else ""
        if not self.by:
            return f"SELECT {shown} AS {self.name} FROM {{table}}{where}"
        rank = f", rank() OVER (ORDER BY {raw} DESC NULLS LAST) AS rnk" if self.ranked else ""
        order = "rnk" if self.ranked else f"{self.name} DESC NULLS LAST"
        limit = f" ORDER BY {order}, {self.by} LIMIT {self.top}" if self.top else ""
        return f"SELECT {self.by}, {shown} AS {self.name}{rank} FROM {{table}}{where} GROUP BY {self.by}{limit}"


@dataclass(frozen=True)
class GateTables:
    """The true table, the dirty table with its score, and the provenance of quarantined rows."""

    truth: DataFrame
    dirty: DataFrame
    prov: DataFrame
    key: str
    score: str
    tau: float


def _cell(value: Column) -> Column:
    """A number as text for comparison."""
    return F.coalesce((F.round(value.cast("double"), 4) + 0.0).cast("string"), F.lit("NULL"))


def _members(t: GateTables) -> DataFrame:
    """The rows of the true and the dirty table with the conditions ``_in`` that they belong to and, if quarantined, their provenance ``_prov``."""
    cols = t.truth.columns
    held = t.dirty.filter(F.col(t.score) >= t.tau).select(F.col(t.key).alias("_k")).distinct().withColumn("_held", F.lit(True))
    truth = bounded_join(t.truth.withColumn("_k", F.col(t.key)), held, ["_k"], "left").drop("_k")
    own = F.array_compact(F.array(F.lit("true"), F.when(F.col("_held"), F.lit("repaired"))))
    rows = truth.select(*cols, own.alias("_in"), F.lit(None).cast("array<string>").alias("_prov"))
    prov = t.prov.select(F.col(t.key).alias("_k"), F.col("columns").alias("_prov"))
    dirty = bounded_join(t.dirty.withColumn("_k", F.col(t.key)), prov, ["_k"], "left").drop("_k")
    passed = F.col(t.score) < t.tau
    own = F.when(passed, F.array(*[F.lit(c) for c in CONDITIONS])).otherwise(F.array(F.lit("dirty"), F.lit("coupled")))
    return rows.unionByName(dirty.select(*cols, own.alias("_in"), F.when(~passed, F.col("_prov")).alias("_prov")))


def conditioned(t: GateTables, column_sets: Sequence[tuple[str, ...]]) -> DataFrame:
    """One long table for all conditions: the columns of the truth, ``condition`` and ``_u0``, ``_u1``, ...

    A row says which conditions it belongs to, so each table is read once. ``_u<i>`` tells whether a row of the coupled condition may
    be used by queries over the i-th set of columns.
    """
    uses = [f"coalesce({reinstated('_prov', c)}, true) AS _u{i}" for i, c in enumerate(column_sets)]
    return _members(t).selectExpr(*[f"`{c}`" for c in t.truth.columns], *uses, "explode(_in) AS condition")


def _added(queries: Sequence[tuple[int, GateQuery]], t: GateTables) -> DataFrame:
    """(q, condition, text, number, x, nx, d, n): sums and counts of numbered queries by group, percentiles left out.

    Rows of equal conditions and provenance are added up first, each row once for all queries of all rows and once for each column
    that queries group by. What is left, a few rows a group, is then dealt to the conditions and queries that use it.
    """
    rows, parts = _members(t), []
    is_text = lambda c: not isinstance(t.truth.schema[c].dataType, T.NumericType)
    group_of = {k: q.over[0] if q.measure == "distinct" else q.by for k, q in queries}
    groups = list(dict.fromkeys(g for g in group_of.values() if g))

    def sums(k: int, q: GateQuery) -> list[str]:
        on = [*([f"_c.g = {groups.index(group_of[k])}"] if group_of[k] else []), *([f"coalesce({q.where}, false)"] if q.where else [])]
        on = " AND ".join(on) or "true"
        measured = [f"CASE WHEN {on} THEN double(`{c}`) END" for c in q.over] if q.measure in ("sum", "avg", "ratio") else []
        terms = [f"count_if({on}) AS n{k}"]
        if measured:
            terms += [f"sum({measured[0]}) AS x{k}", f"count({measured[0]}) AS nx{k}"]
        return terms + ([f"sum({measured[1]}) AS d{k}"] if q.measure == "ratio" else [])

    def cell(k: int, q: GateQuery) -> str:
        x, nx = (f"x{k}", f"nx{k}") if q.measure in ("sum", "avg", "ratio") else ("double(null)", "bigint(0)")
        return f"named_struct('q', {k}, 'x', {x}, 'nx', {nx}, 'd', {f'd{k}' if q.measure == 'ratio' else 'double(null)'}, 'n', n{k})"

    for mine in ([x for x in queries if not group_of[x[0]]], [x for x in queries if group_of[x[0]]]):
        if not mine:
            continue
        table, by = rows, ["_in", "_prov"]
        if group_of[mine[0][0]]:
            keys = [f"named_struct('g', {i}, 'text', {f'string(`{c}`)' if is_text(c) else 'string(null)'}, 'number', {'double(null)' if is_text(c) else f'double(`{c}`)'})" for i, c in enumerate(groups)]
            table, by = rows.selectExpr("*", f"explode(array({', '.join(keys)})) AS _c"), [*by, "_c.g", "_c.text", "_c.number"]
        met = table.groupBy(*by).agg(*[F.expr(e) for k, q in mine for e in sums(k, q)])
        named = ["text", "number"] if len(by) > 2 else ["string(null) AS text", "double(null) AS number"]
        parts.append(met.selectExpr("_in", "_prov", *named, f"explode(array({', '.join(cell(k, q) for k, q in mine)})) AS c").selectExpr("_in", "_prov", "text", "number", "c.*"))
    may = "CASE q " + " ".join(f"WHEN {k} THEN coalesce({reinstated('_prov', q.columns)}, true)" for k, q in queries) + " END"
    dealt = reduce(lambda a, b: a.unionByName(b), parts).filter("n > 0").selectExpr("*", "explode(_in) AS condition").filter(f"condition <> 'coupled' OR {may}")
    return dealt.groupBy("q", "condition", "text", "number").agg(*[F.sum(c).alias(c) for c in ("x", "nx", "d", "n")])


def _run_dataset(queries: Sequence[tuple[int, GateQuery]], t: GateTables) -> DataFrame:
    """(q, condition, text, number, v): the results of numbered queries over one dataset, by group."""
    kinds = F.expr("CASE q " + " ".join(f"WHEN {k} THEN '{q.measure}'" for k, q in queries) + " END")
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    parts, counted = [], [(k, q) for k, q in queries if q.measure != "percentile"]
    if counted:
        is_set = kinds == "distinct"
        found = F.when(kinds == "sum", F.col("x")).when(kinds == "avg", F.try_divide("x", "nx")).when(kinds == "ratio", F.try_divide("x", "d")).otherwise(F.col("n").cast("double"))
        stored = cut_lineage(_added(counted, t).withColumn("v", found).withColumn("is_set", is_set).select("q", "condition", "text", "number", "v", "is_set"))
        parts.append(stored.filter("NOT is_set").drop("is_set"))
        values = stored.filter("is_set").groupBy("q", "condition").agg(F.count_if(F.col("text").isNotNull() | F.col("number").isNotNull()).cast("double").alias("v"))
        parts.append(values.select("q", "condition", text.alias("text"), number.alias("number"), "v"))
    for k, q in queries:
        if q.measure == "percentile":
            inside = conditioned(t, [q.columns]).filter("(condition <> 'coupled' OR _u0)" + (f" AND coalesce({q.where}, false)" if q.where else "")).selectExpr("condition", f"`{q.over[0]}` AS x")
            values = quantiles(inside, ["x"], [q.share], ["condition"]).withColumnRenamed(quantile_name("x", 0), "v")
            parts.append(values.select(F.lit(k).alias("q"), "condition", text.alias("text"), number.alias("number"), F.col("v").cast("double").alias("v")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def run_gate(spark: SparkSession, queries: Sequence[GateQuery], tables: dict[str, GateTables]) -> DataFrame:
    """Result rows of every query on the true table and under every condition, as one long table
    (query_id, dataset, stratum, kind, condition, first, row, nums). Each table of a dataset is read once for all of them, and once
    more for a percentile."""
    numbered = list(enumerate(queries))
    facts = spark.createDataFrame(
        [(k, q.id, q.dataset, q.stratum, q.kind, q.digits, q.top or 0, q.ranked, q.measure in ("count", "distinct")) for k, q in numbered if q.dataset in tables],
        "q int, query_id string, dataset string, stratum string, kind string, digits int, top int, ranked boolean, counts boolean",
    )
    found = reduce(lambda a, b: a.unionByName(b), [_run_dataset([x for x in numbered if x[1].dataset == name], t) for name, t in tables.items()])
    # a query of all rows has a result where no row is left, too
    grid = facts.filter("kind = 'scalar'").withColumn("condition", F.explode(F.array(*[F.lit(c) for c in ["true", *CONDITIONS]])))
    scalars = grid.join(found, ["q", "condition"], "left").withColumn("v", F.when(F.col("counts"), F.coalesce("v", F.lit(0.0))).otherwise(F.col("v")))
    out = scalars.unionByName(found.join(F.broadcast(facts.filter("kind = 'table'")), "q"))
    digits = sorted({q.digits for q in queries if q.digits is not None})
    value = reduce(lambda a, d: F.when(F.col("digits") == d, F.round("v", d)).otherwise(a), digits, F.col("v"))
    # groups of one query under one condition; ties in the order by group
    best = F.desc_nulls_last(F.when(F.col("ranked"), F.col("v")).otherwise(F.col("value")))
    each = Window.partitionBy("query_id", "condition")
    named = out.withColumn("value", value).withColumn("rnk", F.rank().over(each.orderBy(best))).withColumn(
        "place", F.row_number().over(each.orderBy(best, F.asc_nulls_last("text"), F.asc_nulls_last("number")))
    )
    kept = named.filter((F.col("top") == 0) | (F.col("place") <= F.col("top")))
    is_table = F.col("kind") == "table"
    group = F.when(is_table, F.when(F.col("number").isNotNull(), _cell(F.col("number"))).otherwise(F.coalesce(F.lower(F.trim("text")), F.lit("NULL"))))
    rank = F.when(F.col("ranked"), _cell(F.col("rnk")))
    nums = F.when(F.col("ranked"), F.array("number", "value", F.col("rnk").cast("double"))).when(is_table, F.array("number", "value")).otherwise(F.array("value"))
    return kept.select(
        "query_id", "dataset", "stratum", "kind", "condition", F.coalesce(group, _cell(F.col("value"))).alias("first"),
        F.concat_ws("|", group, _cell(F.col("value")), rank).alias("row"), nums.alias("nums"),
    )


GROUP = ["query_id", "dataset", "stratum", "kind", "condition"]


def compare(results: DataFrame, conditions: Sequence[str] = CONDITIONS, tolerance: float = 1e-4) -> DataFrame:
    """Verdict and error magnitudes of every query and condition against the true table.

    Scalars: |a - r| within max(tolerance, 1e-6 |r|) is a match; relative error |a - r| / max(|r|, eps).
    Tables: row sets on normalised cells (Jaccard, missing, extra) and cell errors aligned on the
    first column; the headline is the larger of 1 - Jaccard and the worst cell error.
    """
    each = F.explode(F.array(*[F.lit(c) for c in conditions]))
    ref = results.filter("condition = 'true'").withColumn("condition", each)
    cand = results.filter(F.col("condition") != "true")
    keys = results.filter("condition = 'true'").select(*GROUP[:-1]).distinct().withColumn("condition", each)

    side = ref.select(*GROUP, "row", F.lit(1).alias("_r"), F.lit(0).alias("_c")).unionByName(
        cand.select(*GROUP, "row", F.lit(0).alias("_r"), F.lit(1).alias("_c"))
    )
    sets = side.groupBy(*GROUP, "row").agg(F.sum("_r").alias("r"), F.sum("_c").alias("c")).groupBy(*GROUP).agg(
        F.sum("r").alias("n_ref"), F.sum("c").alias("n_cand"), F.count(F.lit(1)).alias("n_union"),
        F.count_if((F.col("r") > 0) & (F.col("c") > 0)).alias("n_both"),
        F.count_if((F.col("r") > 0) & (F.col("c") == 0)).alias("missing_rows"),
        F.count_if((F.col("r") == 0) & (F.col("c") > 0)).alias("extra_rows"),
        F.count_if(F.col("r") != F.col("c")).alias("n_uneven"),
    )
    pick = cand.groupBy(*GROUP, "first").agg(F.min_by("nums", "row").alias("other"))
    cells = (
        ref.join(pick, [*GROUP, "first"]).select(*GROUP, F.explode(F.arrays_zip("nums", "other")).alias("z"))
        .filter("z.nums IS NOT NULL AND z.other IS NOT NULL")
        .withColumn("_e", F.abs(F.col("z.nums") - F.col("z.other")) / F.greatest(F.abs(F.col("z.nums")), F.lit(EPS)))
    )
    errs = cells.groupBy(*GROUP).agg(F.avg("_e").alias("mean_cell"), F.median("_e").alias("median_cell"), F.max("_e").alias("max_cell"))
    value = lambda d, n: d.filter("kind = 'scalar'").groupBy(*GROUP).agg(F.max(F.get("nums", 0)).alias(n))
    j = keys
    for part in (sets, errs, value(ref, "ref_value"), value(cand, "cand_value")):
        j = j.join(part, GROUP, "left")
    scalar = F.col("kind") == "scalar"
    delta = F.abs(F.col("ref_value") - F.col("cand_value"))
    off = delta > F.greatest(F.lit(tolerance), 1e-6 * F.abs("ref_value"))
    jac = F.coalesce(F.try_divide("n_both", "n_union"), F.lit(1.0))
    rel_scalar = delta / F.greatest(F.abs("ref_value"), F.lit(EPS))
    rel = F.when(scalar, F.coalesce(rel_scalar, F.lit(1.0))).otherwise(F.greatest(1 - jac, F.coalesce("max_cell", F.lit(0.0))))
    verdict = (
        F.when(F.col("n_ref") != F.col("n_cand"), "row_count_diff")
        .when(scalar, F.when(F.coalesce(off, F.lit(True)), "value_diff").otherwise("within_float_tolerance"))
        .when(F.col("n_uneven") > 0, "value_diff").otherwise("match")
    )
    return j.select(
        *GROUP, verdict.alias("verdict"), verdict.isin("row_count_diff", "value_diff").alias("is_error"),
        F.when(scalar, delta).alias("abs_err"), rel.alias("rel_err"),
        F.when(scalar, (rel < 1e-6).cast("double")).otherwise(jac).alias("jaccard"),
        F.when(scalar, 0).otherwise(F.col("missing_rows")).cast("bigint").alias("missing_rows"),
        F.when(scalar, 0).otherwise(F.col("extra_rows")).cast("bigint").alias("extra_rows"),
        (F.col("n_cand") - F.col("n_ref")).alias("row_delta"),
        F.when(scalar, rel).otherwise(F.col("mean_cell")).alias("mean_cell_err"),
        F.when(scalar, rel).otherwise(F.col("median_cell")).alias("median_cell_err"),
        F.when(scalar, rel).otherwise(F.col("max_cell")).alias("max_cell_err"),
    )


def _strata(per_query: DataFrame) -> DataFrame:
    """Each query counts in its stratum and in 'all'."""
    return per_query.withColumn("stratum", F.explode(F.array(F.col("stratum"), F.lit("all"))))


def error_rates(per_query: DataFrame) -> DataFrame:
    """(condition, stratum, queries, wrong, pct): wrong-answer rates with a total over strata."""
    return (
        per_query.groupBy("condition").agg(F.count(F.lit(1)).alias("queries"), F.count_if("is_error").alias("wrong"))
        .withColumn("stratum", F.lit("all"))
        .unionByName(per_query.groupBy("condition", "stratum").agg(F.count(F.lit(1)).alias("queries"), F.count_if("is_error").alias("wrong")))
        .withColumn("pct", F.round(F.col("wrong") * 100.0 / F.col("queries"), 1))
    )


def joint_required(per_query: DataFrame, a: str, b: str, joint: str) -> DataFrame:
    """(stratum, queries, joint_required): wrong under ``a`` and under ``b`` but right under ``joint``."""
    wrong = lambda c: F.max(F.when(F.col("condition") == c, F.col("is_error").cast("int")))
    flags = _strata(per_query).groupBy("stratum", "query_id").agg(wrong(a).alias("a"), wrong(b).alias("b"), wrong(joint).alias("j"))
    return flags.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("queries"), F.count_if((F.col("a") == 1) & (F.col("b") == 1) & (F.col("j") == 0)).alias("joint_required")
    )


def error_distribution(per_query: DataFrame) -> DataFrame:
    """(condition, stratum, n, min, median, p75, p90, max, mean) of the relative error."""
    q = F.percentile("rel_err", F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9)))
    agg = _strata(per_query).groupBy("condition", "stratum").agg(
        F.count("rel_err").alias("n"), F.min("rel_err").alias("min"), q.alias("q"), F.max("rel_err").alias("max"), F.avg("rel_err").alias("mean")
    )
    r = lambda c: F.round(c, 6)
    return agg.select(
        "condition", "stratum", "n", r(F.col("min")).alias("min"), r(F.col("q")[0]).alias("median"), r(F.col("q")[1]).alias("p75"),
        r(F.col("q")[2]).alias("p90"), r(F.col("max")).alias("max"), r(F.col("mean")).alias("mean"),
    )


# fixed values: relative errors that matter
MATERIALITY = [0.001, 0.01, 0.05]


def materiality(per_query: DataFrame, thresholds: Sequence[float] = MATERIALITY) -> DataFrame:
    """(condition, stratum, threshold, n, pct of queries above)."""
    t = F.explode(F.array(*[F.lit(x) for x in thresholds]))
    return _strata(per_query).withColumn("threshold", t).groupBy("condition", "stratum", "threshold").agg(
        F.count("rel_err").alias("n"), F.round(F.count_if(F.col("rel_err") > F.col("threshold")) * 100.0 / F.count("rel_err"), 1).alias("pct")
    )


def coupled_comparison(per_query: DataFrame) -> DataFrame:
    """Median relative error per stratum, the best single treatment and whether coupling beats it."""
    med = lambda c: F.round(F.median(F.when(F.col("condition") == c, F.col("rel_err"))), 6).alias(c)
    agg = _strata(per_query).groupBy("stratum").agg(F.countDistinct("query_id").alias("queries"), *[med(c) for c in CONDITIONS])
    best = F.least("dirty", "clean", "repaired")
    return agg.withColumn("best_single", best).withColumn("coupled_better", F.col("coupled") < best)


def analyst_cost(df: DataFrame, label: str, score: str, tau: float, by: Sequence[str] = ()) -> DataFrame:
    """Queue size, true and false alarms in it, and escaped anomalies."""
    q, y = F.col(score) >= tau, F.col(label) == 1
    return df.groupBy(*by).agg(
        F.count_if(q).alias("n_quarantined"), F.count_if(q & y).alias("n_tp"), F.count_if(q & ~y).alias("n_fp"),
        F.round(F.try_divide(F.count_if(q & ~y), F.count_if(q)), 4).alias("fp_fraction"),
        F.count_if(~q & y).alias("n_escaped"), F.count_if(y).alias("n_positive"),
    )


# fixed values: columns each family touches
FAMILY_COLUMNS = {
    "A1_sign_flip": ["value"], "A2_magnitude_outlier": ["value"], "A3_tag_mismatch": ["tag"], "A4_period_violation": ["ddate"],
    "A5_duplicate_posting": ["value"], "B1_ot_regular_inconsistency": ["total_ot_paid", "regular_hours"],
    "B2_salary_basis_mismatch": ["regular_gross_paid", "pay_basis"], "B3_near_duplicate_name": ["last_name"],
    "B4_agency_title_violation": ["agency_name", "title_description"], "B5_magnitude_outlier": ["regular_gross_paid"],
    "C1_education_out_of_domain": ["education"], "C2_limitbal_inconsistency": ["limit_bal"], "C3_bill_sign_violation": ["bill_amt1"],
    "C4_pay_temporal_violation": ["pay_0"], "C5_age_range_violation": ["age"],
}


def column_risk(df: DataFrame, family: str, score: str, tau: float) -> DataFrame:
    """(family, column, injected, quarantined, rate, risk_mass): share of the quarantine per column."""
    total = df.agg(F.count_if(F.col(score) >= tau).alias("_total"))
    per = df.filter(F.col(family).isNotNull()).groupBy(F.col(family).alias("family")).agg(
        F.count(F.lit(1)).alias("injected"), F.count_if(F.col(score) >= tau).alias("quarantined")
    )
    names = F.create_map(*[x for k, v in FAMILY_COLUMNS.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])
    return one_row(per, total).select(
        "family", F.explode(F.try_element_at(names, F.col("family"))).alias("column"), "injected", "quarantined",
        (F.col("quarantined") / F.col("injected")).alias("rate"),
        (F.col("quarantined") / F.greatest(F.col("_total"), F.lit(1))).alias("risk_mass"),
    )


def lane_matrix(per_query: DataFrame, data_condition: str = "dirty", sql_condition: str = "clean") -> DataFrame:
    """(query_id, data_risk, sql_risk, outcome): promote, review or block each query."""
    wide = per_query.groupBy("query_id").agg(
        F.max(F.when(F.col("condition") == data_condition, F.col("is_error").cast("int"))).alias("d"),
        F.max(F.when(F.col("condition") == sql_condition, F.col("is_error").cast("int"))).alias("s"),
    )
    risk = lambda c: F.when(F.col(c) == 1, "high").when(F.col(c) == 0, "medium").otherwise("low")
    out = wide.select("query_id", risk("d").alias("data_risk"), risk("s").alias("sql_risk"))
    outcome = (
        F.when((F.col("data_risk") == "low") & (F.col("sql_risk") == "low"), "auto-promote")
        .when((F.col("data_risk") == "medium") | (F.col("sql_risk") == "medium"), "review").otherwise("block")
    )
    return out.withColumn("outcome", outcome)


# --- outcome tables --------------------------------------------------------------------------------


def rate_matrix(df: DataFrame, by: Sequence[str], ok: str, latency: str) -> DataFrame:
    """(by..., n, success_rate, latency_mean, latency_p95)."""
    from plumbline.operators.order_stats import quantile_name, quantiles

    base = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(ok).cast("double")).alias("success_rate"), F.avg(latency).alias("latency_mean"))
    p95 = quantiles(df, [latency], [0.95], by).withColumnRenamed(quantile_name(latency, 0), "latency_p95")
    return bounded_join(base, p95, by) if by else one_row(base, p95)


def rate_pivot(df: DataFrame, source: str, target: str, targets: Sequence[str], ok: str) -> DataFrame:
    """Success rate with one column per target."""
    return df.groupBy(source).pivot(target, list(targets)).agg(F.avg(F.col(ok).cast("double")))


# fixed values: upper ends of the complexity buckets
COMPLEXITY = [(20, "[0-20]"), (40, "[20-40]"), (60, "[40-60]"), (80, "[60-80]"), (100, "[80-100]")]


def complexity_bucket(c: Column) -> Column:
    out = F
    for top, name in COMPLEXITY:
        out = out.when(c <= top, name)
    return out.otherwise("[100+]")


def failure_cause(name: str, error: str) -> Column:
    """First matching cause of a failure."""
    has = lambda words: reduce(lambda a, b: a | b, [F.col(name).contains(w) for w in words])
    return (
        F.when(F.col(error).startswith("parse:"), "Parse error")
        .when(has(["json", "array", "lateral", "generate_series", "listen_notify", "qualify"]), "Dialect-specific construct")
        .when(has(["format", "convert", "date"]), "Function semantics")
        .when(has(["ignore", "stream", "pivot"]), "DML / DDL extension")
        .otherwise("Decorator / footprint drift")
    )


def failure_taxonomy(df: DataFrame, ok: str, name: str, error: str) -> DataFrame:
    """(cause, n) over failures."""
    return df.filter(~F.col(ok)).groupBy(failure_cause(name, error).alias("cause")).agg(F.count(F.lit(1)).alias("n"))


def top_offenders(df: DataFrame, ok: str, name: str, n: int = 10) -> DataFrame:
    return df.filter(~F.col(ok)).groupBy(name).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name).limit(n)


def table_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """(keys..., column, a, b): cells that differ between two tables aligned on their keys; a row on
    one side only is reported under column '<row>'."""
    rest = [c for c in a.columns if c not in keys]
    left = a.select(*keys, *[F.col(c).alias(f"{c}__a") for c in rest], F.lit(True).alias("_a"))
    right = b.select(*keys, *[F.col(c).alias(f"{c}__b") for c in rest], F.lit(True).alias("_b"))
    j = left.join(right, list(keys), "full_outer")
    numeric = set(numeric_columns(a))
    both = F.col("_a") & F.col("_b")

    def differs(c):
        x, y = F.col(f"{c}__a"), F.col(f"{c}__b")
        near = F.abs(x - y) <= tolerance if c in numeric else x == y
        return both & ~(F.coalesce(near, F.lit(False)) | (x.isNull() & y.isNull()))

    cell = lambda name, cond, x, y: F.when(cond, F.struct(F.lit(name).alias("column"), x.cast("string").alias("a"), y.cast("string").alias("b")))
    only = cell("<row>", F.coalesce(~both, F.lit(True)), F.when(F.col("_a"), "present"), F.when(F.col("_b"), "present"))
    cells = F.array_compact(F.array(only, *[cell(c, F.coalesce(differs(c), F.lit(False)), F.col(f"{c}__a"), F.col(f"{c}__b")) for c in rest]))
    return j.select(*keys, F.explode(cells).alias("_cell")).select(*keys, "_cell.*")
