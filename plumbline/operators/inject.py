"""Labelled anomaly injection: declarative families, exact rates, repeatable draws.

A family is SQL text. Ranks come from md5 draws, so two light passes find the cut-off draws of all families, whatever their
number; the injected table itself is a single map over the input.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.draws import draw, draw_int
from plumbline.operators.order_stats import ALL, NONE, hash_cuts, lowest_cut, one_row, ranked
from plumbline.operators.sampling import sample_n
from plumbline.operators.scores import overall
from plumbline.session import cut_lineage, is_small

#: Rows with their draws, ranked in one task, take many times the bytes that the plan's estimate gives their table.
ONE_TASK = 32.0
RANDOM = "{r}"  # placeholder for a non-negative random integer in family texts


@dataclass(frozen=True)
class Family:
    """One kind of anomaly.

    ``changes`` maps columns to SQL expressions over the row; ``{r}`` is a random integer.
    ``column`` is the one recorded in the label mask. A ``copy`` family appends altered copies.
    """

    name: str
    column: str
    changes: dict[str, str]
    eligible: str = "true"
    copy: bool = False
    rate: float | None = None


def _random(h: str) -> str:
    return f"cast(conv(substr({h}, 9, 8), 16, 10) as bigint)"


def _text(df: DataFrame, column: str, value: Column) -> Column:
    """Label values are strings; doubles are written with two decimals."""
    kind = dict(df.dtypes)[column]
    return (value.cast("decimal(28,2)") if kind in ("double", "float") else value).cast("string")


def _key(seeds: Sequence[int]) -> list[str]:
    return ["seed"] if len(seeds) > 1 else []


def _cuts(marked: DataFrame, families: Sequence[Family], take: list[int], differs: list[Column], seeds: Sequence[int]) -> list[Column]:
    """The cut-off draw of every family, as literals (one per seed: a literal map).

    Families draw in order, each from rows that no earlier one changed, so family i takes rows among its ``take_i`` plus all earlier
    takes lowest draws. A histogram of all families' draws finds those few rows in one pass; the order is resolved on them alone.
    """
    by, n = _key(seeds), len(families)
    flags = marked.select(
        *by, *[f"_h{i}" for i in range(n)], *[F.coalesce(F.expr(f.eligible), F.lit(False)).alias(f"_e{i}") for i, f in enumerate(families)],
        *[d.alias(f"_d{i}") for i, d in enumerate(differs)],
    )
    need = [t + sum(x for x, f in zip(take[:i], families) if not f.copy) for i, t in enumerate(take)]
    if not is_small(marked, ONE_TASK):
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.when(F.col(f"_e{i}"), F.substring(f"_h{i}", 1, 4)).alias("b")) for i in range(n)]))
        bins = flags.select(*by, cells.alias("_c")).select(*by, "_c.*").filter("b IS NOT NULL").groupBy(*by, "f", "b").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*by, "f").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
        wanted = F.element_at(F.array(*[F.lit(x) for x in need]), F.col("f") + 1)
        edges = bins.withColumn("_upto", upto).filter(F.col("_upto") >= wanted).groupBy(*by, "f").agg(F.min("b").alias("b")).collect()
        edge = {(r["seed"] if by else seeds[0], r["f"]): r["b"] for r in edges}
        near = [F.col(f"_e{i}") & (F.substring(f"_h{i}", 1, 4) <= _by_seed({s: edge.get((s, i), ALL) for s in seeds})) for i in range(n)]
        flags = cut_lineage(flags.filter(reduce(lambda x, y: x | y, near)))
    if is_small(flags, ONE_TASK):
        used, chosen = F.lit(False), []
        for i, f in enumerate(families):
            free = ~used & F.col(f"_e{i}")
            rank = F.row_number().over(Window.partitionBy(*by, f"_f{i}").orderBy(f"_h{i}"))
            flags = flags.withColumn(f"_f{i}", free).withColumn(f"_c{i}", F.col(f"_f{i}") & (rank <= take[i]))
            chosen.append(F.coalesce(F.max(F.when(F.col(f"_c{i}"), F.col(f"_h{i}"))), F.lit(NONE)).alias(f"c{i}"))
            if not f.copy:
                used = used | (F.col(f"_c{i}") & F.col(f"_d{i}"))
        found = {(r["seed"] if by else seeds[0]): r for r in flags.groupBy(*by).agg(*chosen).collect()}
        return [_by_seed({s: found[s][f"c{i}"] if s in found else NONE for s in seeds}) for i in range(n)]
    used, out = F.lit(False), []
    for i, f in enumerate(families):
        free = flags.filter(~used & F.col(f"_e{i}"))
        if not by:
            cut = F.lit(lowest_cut(free, f"_h{i}", take[i]))
        else:
            quotas = marked.sparkSession.createDataFrame([(s, 0, take[i]) for s in seeds], "seed int, slot int, take bigint")
            cuts = {r["seed"]: r["cut"] for r in hash_cuts(free, f"_h{i}", quotas, by).collect()}
            cut = _by_seed({s: cuts.get(s, NONE) for s in seeds})
        out.append(cut)
        if not f.copy:
            used = used | (~used & F.col(f"_e{i}") & (F.col(f"_h{i}") <= cut) & F.col(f"_d{i}"))
    return out


def _by_seed(values: dict[int, str]) -> Column:
    if len(values) == 1:
        return F.lit(next(iter(values.values())))
    return F.element_at(F.create_map(*[x for s, v in values.items() for x in (F.lit(s), F.lit(v))]), F.col("seed"))


def inject(
    df: DataFrame, key: str, families: Sequence[Family], rate: float = 0.01, seed: int | Sequence[int] = 42
) -> tuple[DataFrame, DataFrame]:
    """(injected, mask). ``injected`` has the columns of ``df`` plus family and y (and seed for a
    list of seeds, one injected copy of the table per seed). Families draw in order from rows not
    used before; a row whose value would not change is not counted."""
    seeds = [seed] if isinstance(seed, int) else list(seed)
    n, top = df.agg(F.count(F.lit(1)), F.max(key)).first()
    offset = (top or 0) + 1
    base = df
    if len(seeds) > 1:
        base = df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    seed_col = F.col("seed") if len(seeds) > 1 else seeds[0]
    marked = base.withColumns({f"_h{i}": draw(seed_col, f.name, key) for i, f in enumerate(families)})
    differs = []
    for i, f in enumerate(families):
        changed = [~F.expr(text.replace(RANDOM, _random(f"_h{i}"))).eqNullSafe(F.col(c)) for c, text in f.changes.items()]
        differs.append(reduce(lambda x, y: x | y, changed, F.lit(False)))
    cuts = _cuts(marked, families, [math.ceil(n * (f.rate or rate)) for f in families], differs, seeds)
    marked = marked.withColumn("_fam", F.lit(None).cast("string"))
    for i, f in enumerate(families):
        chosen = F.col("_fam").isNull() & F.coalesce(F.expr(f.eligible), F.lit(False)) & (F.col(f"_h{i}") <= cuts[i])
        if f.copy:
            marked = marked.withColumn(f"_copy{i}", chosen)
        else:
            marked = marked.withColumn("_fam", F.when(chosen & differs[i], F.lit(f.name)).otherwise(F.col("_fam")))
    keep = [*base.columns]
    fam = F.col("_fam")
    new_values, shown = {}, {}
    for i, f in enumerate(families):
        for c, text in f.changes.items():
            if not f.copy:
                val = F.expr(text.replace(RANDOM, _random(f"_h{i}"))).cast(dict(df.dtypes)[c])
                new_values.setdefault(c, []).append((f.name, val))
    for c, cases in new_values.items():
        e = F
        for name, val in cases:
            e = e.when(fam == name, val)
        shown[c] = e.otherwise(F.col(c))
    parts = [marked.withColumns(shown).select(*keep, fam.alias("family"))]
    masks = []
    changed = marked.filter("_fam IS NOT NULL")
    old = new = F
    for f in families:
        if not f.copy:
            old = old.when(fam == f.name, _text(df, f.column, F.col(f.column)))
            new = new.when(fam == f.name, _text(df, f.column, shown[f.column]))
    tail = ["seed"] if len(seeds) > 1 else []
    if new_values:
        masks.append(changed.select(F.col(key).alias("row_id"), fam.alias("anomaly_type"), old.alias("original_value"), new.alias("perturbed_value"), *tail))
    for i, f in enumerate(families):
        if not f.copy:
            continue
        src = marked.filter(F.col(f"_copy{i}"))
        alt = {c: F.expr(t.replace(RANDOM, _random(f"_h{i}"))).cast(dict(df.dtypes)[c]) for c, t in f.changes.items()}
        new_key = F.col(key) + offset * (1 + sum(x.copy for x in families[:i]))
        parts.append(src.withColumns({**alt, key: new_key}).select(*keep, F.lit(f.name).alias("family")))
        before = _text(df, f.column, F.col(f.column))
        after = _text(df, f.column, alt.get(f.column, new_key if f.column == key else F.col(f.column)))
        masks.append(src.select(new_key.alias("row_id"), F.lit(f.name).alias("anomaly_type"), before.alias("original_value"), after.alias("perturbed_value"), *tail))
    out, mask = parts[0], masks[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    for m in masks[1:]:
        mask = mask.unionByName(m)
    if not tail:
        mask = mask.withColumn("seed", F.lit(seeds[0]))
    y = F.col("family").isNotNull().cast("int")
    return out.withColumn("y", y), mask.withColumnRenamed("seed", "injection_rng_seed")


def manifest(original: DataFrame, injected: DataFrame, mask: DataFrame, rate: float) -> DataFrame:
    """(anomaly_type, n, rows_in, rows_out, total, rate)."""
    counts = mask.groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("n"))
    totals = (
        original.agg(F.count(F.lit(1)).alias("rows_in"))
        .crossJoin(injected.agg(F.count(F.lit(1)).alias("rows_out")))
        .crossJoin(mask.agg(F.count(F.lit(1)).alias("total")))
    )
    return counts.crossJoin(F.broadcast(totals)).withColumn("rate", F.lit(rate))


def expected_metrics(dirty: DataFrame, exact_duplicates: int) -> DataFrame:
    """Scores a checker should report for planted dirt: completeness and uniqueness follow from the
    table and the number of planted copies, the others are fixed estimates."""
    cols = dirty.columns
    filled = sum((F.count(c) for c in cols[1:]), F.count(cols[0]))
    n = F.count(F.lit(1))
    base = dirty.agg(
        (filled * 100.0 / (n * len(cols))).alias("completeness"), F.lit(82.0).alias("validity"),
        ((1 - F.lit(float(exact_duplicates)) / n) * 100).alias("uniqueness"), F.lit(75.0).alias("consistency"), F.lit(85.0).alias("accuracy"),
    )
    return overall(base)


# --- the ledger, payroll and credit families -----------------------------------------------------


def one_of(values: Sequence) -> str:
    """SQL text that picks one literal at random."""
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    cases = " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values[:-1]))
    return f"(CASE {RANDOM} % {len(values)} {cases} ELSE {lit(values[-1])} END)" if cases else lit(values[0])


# fixed values: tags that are never negative, and tags used for mismatches
POSITIVE_TAGS = [
    "Assets", "Revenues", "CashAndCashEquivalents", "CashAndCashEquivalentsAtCarryingValue", "AssetsCurrent",
    "LiabilitiesCurrent", "Liabilities", "RevenueFromContractWithCustomerExcludingAssessedTax", "StockholdersEquity",
    "CommonStockSharesOutstanding",
]
SWAP_TAGS = [
    "Revenues", "CostOfGoodsSold", "GrossProfit", "OperatingExpenses", "InterestExpense",
    "IncomeTaxExpenseBenefit", "EarningsPerShareBasic",
]
# fixed values: titles that do not belong to the agency
WRONG_TITLES = ["FIREFIGHTER", "TEACHER", "CHIEF LIBRARIAN", "ASSISTANT DISTRICT ATTORNEY", "AIRCRAFT MECHANIC"]
POSITIVE_LIST = ", ".join(f"'{t}'" for t in POSITIVE_TAGS)

LEDGER_FAMILIES = [
    Family("A1_sign_flip", "value", {"value": "-value"}, f"tag IN ({POSITIVE_LIST}) AND value > 0"),
    Family("A2_magnitude_outlier", "value", {"value": "value * " + one_of([1000, 10000])}, "value IS NOT NULL"),
    Family("A3_tag_mismatch", "tag", {"tag": one_of(SWAP_TAGS)}),
    Family("A4_period_violation", "ddate", {"ddate": one_of([19500101, 21000101, 18000101])}),
    Family("A5_duplicate_posting", "row_id", {}, copy=True),
]

_LETTER = f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast(1 + {RANDOM} % 26 as int), 1)"
_NEXT = f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast(1 + ({RANDOM} + 1) % 26 as int), 1)"
_POS = f"cast(1 + {RANDOM} % length(last_name) as int)"
# one character of the name replaced by another letter
ONE_CHARACTER = (
    f"substr(last_name, 1, {_POS} - 1) || CASE WHEN substr(upper(last_name), {_POS}, 1) = {_LETTER} THEN {_NEXT} ELSE {_LETTER} END"
    f" || substr(last_name, {_POS} + 1)"
)

PAYROLL_FAMILIES = [
    Family(
        "B1_ot_regular_inconsistency", "total_ot_paid", {"total_ot_paid": f"500 + {RANDOM} % 450001 / 1e2"},
        "coalesce(regular_hours, 0) = 0 AND coalesce(total_ot_paid, 0) = 0",
    ),
    Family(
        "B2_salary_basis_mismatch", "regular_gross_paid", {"regular_gross_paid": "base_salary * 2e-2"},
        "pay_basis = 'per Annum' AND base_salary > 10000",
    ),
    Family("B3_near_duplicate_name", "last_name", {"last_name": ONE_CHARACTER}, "length(last_name) > 0", copy=True),
    Family("B4_agency_title_violation", "title_description", {"title_description": one_of(WRONG_TITLES)}),
    Family("B5_magnitude_outlier", "regular_gross_paid", {"regular_gross_paid": "regular_gross_paid * 10"}, "regular_gross_paid IS NOT NULL"),
]

CREDIT_FAMILIES = [
    Family("C1_education_out_of_domain", "education", {"education": "7"}),
    Family("C2_limitbal_inconsistency", "limit_bal", {"limit_bal": "0"}, "default_next = 0 AND bill_amt1 > 0"),
    Family("C3_bill_sign_violation", "bill_amt1", {"bill_amt1": "-bill_amt1"}, "bill_amt1 > 0"),
    Family("C4_pay_temporal_violation", "pay_0", {"pay_0": "-2"}, "bill_amt1 > 5000"),
    Family("C5_age_range_violation", "age", {"age": one_of([15, 16, 17, 99, 105, 120])}),
]

# the same families kept inside one cohort each
_CODE, _AGE = one_of([7, 8]), one_of([10, 15, 105, 120])
CREDIT_CLUSTERED = [
    Family("C1_education_out_of_domain", "education", {"education": _CODE}, "education = 2"),
    Family("C2_limitbal_inconsistency", "limit_bal", {"limit_bal": "0"}, "education = 3"),
    Family("C3_bill_sign_violation", "bill_amt1", {"bill_amt1": "-abs(bill_amt1)"}, "marriage = 1 AND bill_amt1 > 0"),
    Family("C4_pay_temporal_violation", "pay_0", {"pay_0": "-2", "bill_amt1": "abs(bill_amt1) + 6000"}, "sex = 2"),
    Family("C5_age_range_violation", "age", {"age": _AGE}, "education = 2"),
]

# independent form with other codes and larger changes
CREDIT_INDEPENDENT = [
    Family("C1_education_out_of_domain", "education", {"education": _CODE}, "education BETWEEN 0 AND 6"),
    Family("C2_limitbal_inconsistency", "limit_bal", {"limit_bal": "0"}),
    Family("C3_bill_sign_violation", "bill_amt1", {"bill_amt1": "-abs(bill_amt1)"}, "bill_amt1 > 0"),
    Family("C4_pay_temporal_violation", "pay_0", {"pay_0": "-2", "bill_amt1": "abs(bill_amt1) + 6000"}),
    Family("C5_age_range_violation", "age", {"age": _AGE}),
]

_OVERTIME = f"100 + {RANDOM} % 990001 / 1e2"
_BASIS = "pay_basis = 'per Annum' AND base_salary > 10000"
_SWAPPED = {
    "agency_name": one_of(["DEPT OF EDUCATION", "FIRE DEPARTMENT"]), "title_description": one_of(["FIREFIGHTER", "TEACHER"]),
}
PAYROLL_CLUSTERED = [
    Family("B1_ot_regular_inconsistency", "total_ot_paid", {"total_ot_paid": _OVERTIME}, "agency_name LIKE '%EDUCATION%'"),
    Family("B2_salary_basis_mismatch", "regular_gross_paid", {"regular_gross_paid": "base_salary * 1e-2"}, _BASIS),
    Family("B3_near_duplicate_name", "last_name", {"last_name": ONE_CHARACTER}),
    Family("B4_agency_title_violation", "title_description", _SWAPPED),
    Family("B5_magnitude_outlier", "regular_gross_paid", {"regular_gross_paid": "regular_gross_paid * 1000"}, "agency_name LIKE '%FIRE%'"),
]
PAYROLL_COOCCURRING = [
    Family("B1+B5_cooccurring", "regular_gross_paid", {"total_ot_paid": _OVERTIME, "regular_gross_paid": "regular_gross_paid * 1000"}),
    Family("B2+B4_cooccurring", "regular_gross_paid", {"regular_gross_paid": "base_salary * 1e-2", **_SWAPPED}, _BASIS),
    Family("B3_near_duplicate_name", "last_name", {"last_name": ONE_CHARACTER}, rate=0.02),
]

# several families in the same rows
CREDIT_COOCCURRING = [
    Family(
        "C1+C2+C3_cooccurring", "education", {"education": _CODE, "limit_bal": "0", "bill_amt1": "-abs(bill_amt1)"},
        "education BETWEEN 0 AND 6 AND bill_amt1 > 0",
    ),
    Family("C4+C5_cooccurring", "age", {"pay_0": "-2", "bill_amt1": "abs(bill_amt1) + 6000", "age": _AGE}),
]


# --- generic dirt ----------------------------------------------------------------------------------


def inject_nulls(df: DataFrame, key: str, column: str, pct: float, seed: int = 42) -> DataFrame:
    """NULL in exactly int(n * pct / 100) rows of a column."""
    h = df.withColumn("_h", draw(seed, f"null-{column}", key))
    cut = lowest_cut(h, "_h", int(df.count() * pct / 100))
    return h.withColumn(column, F.when(F.col("_h") > cut, F.col(column))).drop("_h")


def _appended(df: DataFrame, key: str, count: int, tag: str, seed: int) -> DataFrame:
    """Exactly ``count`` copies with new keys: every row as often as the count allows, the rest drawn."""
    n, top = df.agg(F.count(F.lit(1)), F.max(key)).first()
    if not n:
        return df.withColumn("_r", F.lit(0).cast("bigint"))
    whole, rest = divmod(count, n)
    drawn = sample_n(df, rest, key, seed, tag).withColumn("_c", F.lit(whole))
    if whole:
        drawn = df.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(whole - 1)))).unionByName(drawn)
    copies = drawn.withColumn("_r", draw_int(draw(seed, f"{tag}-how", key)))
    return copies.withColumn(key, F.col(key) + F.lit(top + 1) * (F.col("_c") + 1)).drop("_c")


def inject_exact_duplicates(df: DataFrame, key: str, count: int, seed: int = 42) -> DataFrame:
    return df.unionByName(_appended(df, key, count, "exact", seed).drop("_r"))


def inject_fuzzy_duplicates(df: DataFrame, key: str, columns: Sequence[str], count: int, seed: int = 42) -> DataFrame:
    """Append copies with one text column varied: case, separators or a trailing space."""
    src = _appended(df, key, count, "fuzzy", seed)
    which = F.col("_r") % len(columns)
    how = F.floor(F.col("_r") / len(columns)) % 5
    vary = lambda c: (
        F.when(how == 0, F.lower(c)).when(how == 1, F.upper(c)).when(how == 2, F.replace(c, F.lit(" "), F.lit("_")))
        .when(how == 3, F.replace(c, F.lit("."), F.lit("_"))).otherwise(F.concat(c, F.lit(" ")))
    )
    varied = {c: F.when(which == i, vary(F.col(c))).otherwise(F.col(c)) for i, c in enumerate(columns)}
    return df.unionByName(src.withColumns(varied).drop("_r"))


@dataclass(frozen=True)
class Dirt:
    """``count`` rows that match ``eligible`` get ``column`` replaced by the SQL ``value``."""

    name: str
    column: str
    value: str
    count: int
    eligible: str = field(default="true")


def inject_dirt(df: DataFrame, key: str, rules: Sequence[Dirt], seed: int = 42) -> DataFrame:
    """Rows are chosen on the table as given, independently per rule; values change in rule order."""
    marked = df.withColumns({f"_h{i}": draw(seed, r.name, key) for i, r in enumerate(rules)})
    # rules don't exclude each other's rows, like families that append copies: the cut-off draws of all come from the same two passes
    families = [Family(r.name, r.column, {}, r.eligible, copy=True) for r in rules]
    cuts = _cuts(marked, families, [r.count for r in rules], [F.lit(False)] * len(rules), [seed])
    marked = marked.withColumns({f"_on{i}": F.coalesce(F.expr(r.eligible), F.lit(False)) & (F.col(f"_h{i}") <= cuts[i]) for i, r in enumerate(rules)})
    types = dict(df.dtypes)
    for i, r in enumerate(rules):
        value = F.expr(r.value.replace(RANDOM, _random(f"_h{i}"))).cast(types[r.column])
        marked = marked.withColumn(r.column, F.when(F.col(f"_on{i}"), value).otherwise(F.col(r.column)))
    return marked.select(*df.columns)


def swap_values(df: DataFrame, key: str, column: str, count: int, seed: int = 42) -> DataFrame:
    """``count`` chosen rows pass their value to the next chosen row in draw order (the last to the first)."""
    tag = f"swap-{column}"
    drawn = df.withColumn("_h", draw(seed, tag, key))
    cut = lowest_cut(drawn, "_h", count)
    chosen = ranked(drawn.filter(F.col("_h") <= cut).select("_h", key, column), ["_h"], (), "_rn")
    n = chosen.agg(F.count(F.lit(1)).alias("_n"))
    donors = one_row(chosen, n).select((F.col("_rn") % F.col("_n") + 1).alias("_rn"), F.col(column).alias("_new"))
    moved = chosen.select(key, "_rn").join(donors, "_rn").select(key, "_new", F.lit(True).alias("_hit"))
    return df.join(moved, key, "left").withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))).select(*df.columns)
