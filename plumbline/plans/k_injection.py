"""Labelled anomaly injection into the ledger, payroll and credit shapes."""

from pyspark.sql import functions as F

from plumbline.operators import evaluate, features, inject as i
from plumbline.plans.registry import duck, query
from plumbline.plans.shapes import CREDIT, LEDGER, PAYROLL, PEOPLE, credit, ledger, payroll, people, with_

SHAPES = {
    "ledger": (LEDGER, ledger, "row_id adsh tag ddate qtrs value".split()),
    "payroll": (
        PAYROLL, payroll,
        "row_id agency_name last_name first_name title_description pay_basis work_location_borough leave_status base_salary "
        "regular_gross_paid regular_hours total_ot_paid ot_hours total_other_pay".split(),
    ),
    "credit": (
        CREDIT, credit,
        "row_id limit_bal sex education marriage age pay_0 pay_2 bill_amt1 bill_amt2 pay_amt1 pay_amt3 default_next".split(),
    ),
}
DOUBLES = {"value", "base_salary", "regular_gross_paid", "regular_hours", "total_ot_paid", "ot_hours", "total_other_pay"}
TEXT = {"tag", "agency_name", "last_name", "first_name", "title_description", "pay_basis", "work_location_borough", "leave_status"}


def injected_sql(shape, families, rate=0.01, seeds=(42,)):
    """CTEs ending in ``inj`` (rows with family, y) and ``mask``; the SQL twin of ``inject``."""
    text, _, columns = SHAPES[shape]
    kind = lambda c: "DOUBLE" if c in DOUBLES else "VARCHAR" if c in TEXT else "BIGINT"
    rnd = lambda f: f"CAST('0x' || substr(md5(seed || '|{f.name}|' || CAST(row_id AS VARCHAR)), 9, 8) AS BIGINT)"
    val = lambda f, c: f"CAST({f.changes[c].replace('cast(', 'CAST(').replace(i.RANDOM, rnd(f))} AS {kind(c)})" if c in f.changes else c
    ctes = [
        f"b AS ({duck(text)})", "n AS (SELECT count(*) AS n, max(row_id) + 1 AS off FROM b)",
        f"m0 AS (SELECT b.*, CAST(seed AS VARCHAR) AS seed, CAST(NULL AS VARCHAR) AS fam FROM b, (SELECT unnest([{', '.join(map(str, seeds))}]) AS seed) s)",
    ]
    for j, f in enumerate(families):
        take = f"CAST(ceil((SELECT n FROM n) * {f.rate or rate}::DOUBLE) AS BIGINT)"
        free = f"(fam IS NULL AND coalesce({f.eligible}, false))"
        rank = f"row_number() OVER (PARTITION BY seed, {free} ORDER BY md5(seed || '|{f.name}|' || CAST(row_id AS VARCHAR)))"
        if f.copy:
            ctes.append(f"m{j + 1} AS (SELECT *, {free} AND {rank} <= {take} AS copy{j} FROM m{j})")
        else:
            diff = " OR ".join(f"{val(f, c)} IS DISTINCT FROM {c}" for c in f.changes)
            ctes.append(f"m{j + 1} AS (SELECT * REPLACE (CASE WHEN {free} AND rk <= {take} AND ({diff}) THEN '{f.name}' ELSE fam END AS fam) FROM (SELECT *, {rank} AS rk FROM m{j}) z)")
            ctes.append(f"m{j + 1}x AS (SELECT * EXCLUDE (rk) FROM m{j + 1})")
            ctes[-2], ctes[-1] = ctes[-2].replace(f"m{j + 1} AS", f"m{j + 1}y AS", 1), f"m{j + 1} AS (SELECT * EXCLUDE (rk) FROM m{j + 1}y)"
    last = f"m{len(families)}"
    show = lambda c, e: f"CAST(CAST({e} AS DECIMAL(28,2)) AS VARCHAR)" if c in DOUBLES else f"CAST({e} AS VARCHAR)"

    def shown(c):
        cases = " ".join(f"WHEN '{f.name}' THEN {val(f, c)}" for f in families if not f.copy and c in f.changes)
        return f"CASE fam {cases} ELSE {c} END AS {c}" if cases else c

    rows = [f"SELECT {', '.join(shown(c) for c in columns)}, seed, fam AS family FROM {last}"]
    masks = []
    for f in families:
        if not f.copy:
            masks.append(f"SELECT row_id, fam AS anomaly_type, {show(f.column, f.column)} AS original_value, {show(f.column, val(f, f.column))} AS perturbed_value, CAST(seed AS INTEGER) AS injection_rng_seed FROM {last} WHERE fam = '{f.name}'")
    for j, f in enumerate(families):
        if f.copy:
            cols = ", ".join("row_id + (SELECT off FROM n) AS row_id" if c == "row_id" else f"{val(f, c)} AS {c}" for c in columns)
            rows.append(f"SELECT {cols}, seed, '{f.name}' FROM {last} WHERE copy{j}")
            after = "CAST(row_id + (SELECT off FROM n) AS VARCHAR)" if f.column == "row_id" else show(f.column, val(f, f.column))
            masks.append(f"SELECT row_id + (SELECT off FROM n), '{f.name}', {show(f.column, f.column)}, {after}, CAST(seed AS INTEGER) FROM {last} WHERE copy{j}")
    ctes.append(f"inj AS (SELECT *, CASE WHEN family IS NULL THEN 0 ELSE 1 END AS y FROM ({' UNION ALL '.join(rows)}) u)")
    ctes.append(f"mask AS ({' UNION ALL '.join(masks)})")
    return "WITH " + ",\n".join(ctes)


def register_family(qid, shape, families, index):
    name = families[index].name
    sql = f"{injected_sql(shape, families[: index + 1])} SELECT * FROM mask WHERE anomaly_type = '{name}'"

    @query(qid, sql)
    def run(t, shape=shape, families=families[: index + 1], name=name):
        return i.inject(SHAPES[shape][1](t), "row_id", families)[1].filter(F.col("anomaly_type") == name)


for shape, families, names in (
    ("ledger", i.LEDGER_FAMILIES, ["k1_sign_flip", "k2_magnitude", "k3_tag_mismatch", "k4_period_violation", "k5_duplicate_posting"]),
    ("payroll", i.PAYROLL_FAMILIES, ["k6_overtime_without_hours", "k7_salary_basis", "k8_near_duplicate_name", "k9_wrong_title", "k10_gross_times_ten"]),
    ("credit", i.CREDIT_FAMILIES, ["k11_code_out_of_domain", "k12_zero_limit", "k13_negative_bill", "k14_status_conflict", "k15_age_out_of_range"]),
):
    for n, qid in enumerate(names):
        register_family(qid, shape, families, n)


def register_table(qid, shape, families):
    _, _, columns = SHAPES[shape]
    cols = ", ".join(f"round({c}, 4) AS {c}" if c in DOUBLES else c for c in columns)

    @query(qid, f"{injected_sql(shape, families)} SELECT {cols}, family, y FROM inj")
    def run(t, shape=shape, families=families):
        out = i.inject(SHAPES[shape][1](t), "row_id", families)[0]
        return out.withColumns({c: F.round(c, 4) for c in SHAPES[shape][2] if c in DOUBLES})


register_table("k5_injected_ledger", "ledger", i.LEDGER_FAMILIES)
register_table("k10_injected_payroll", "payroll", i.PAYROLL_FAMILIES)
register_table("k15_injected_credit", "credit", i.CREDIT_FAMILIES)
register_table("k16_clustered_credit", "credit", i.CREDIT_CLUSTERED)
register_table("k17_cooccurring_credit", "credit", i.CREDIT_COOCCURRING)
register_table("k16_independent_credit", "credit", i.CREDIT_INDEPENDENT)
register_table("k16_clustered_payroll", "payroll", i.PAYROLL_CLUSTERED)
register_table("k17_cooccurring_payroll", "payroll", i.PAYROLL_COOCCURRING)


def md(tag, key="id"):
    return f"md5('42|{tag}|' || CAST({key} AS VARCHAR))"


P = with_("p", PEOPLE)


@query(
    "k18_nulls",
    f"""{P} SELECT id, CASE WHEN row_number() OVER (ORDER BY {md('null-phone')}) > (SELECT CAST(floor(count(*) * 5.0 / 100) AS BIGINT) FROM p) THEN phone END AS phone FROM p""",
)
def k18(t):
    return i.inject_nulls(people(t), "id", "phone", 5).select("id", "phone")


# 300 copies: every row as often as that allows, the rest by draw
COPIES = "(SELECT * FROM (SELECT *, row_number() OVER (ORDER BY c, {0}) AS rn FROM p, (SELECT unnest(range(0, 301)) AS c) r WHERE c * (SELECT count(*) FROM p) < 300) WHERE rn <= 300)"
COPY = "SELECT id + (SELECT max(id) + 1 FROM p) * (c + 1) AS id, name, segment FROM " + COPIES


@query("k19_exact_duplicates", f"{P} SELECT id, name, segment FROM p UNION ALL SELECT * FROM ({COPY.format(md('exact'))}) c")
def k19(t):
    return i.inject_exact_duplicates(people(t).select("id", "name", "segment"), "id", 300)


def fuzzy_sql():
    r = f"CAST('0x' || substr({md('fuzzy-how')}, 1, 8) AS BIGINT)"
    how = f"CAST(floor({r} / 2) AS BIGINT) % 5"
    vary = lambda c: f"CASE {how} WHEN 0 THEN lower({c}) WHEN 1 THEN upper({c}) WHEN 2 THEN replace({c}, ' ', '_') WHEN 3 THEN replace({c}, '.', '_') ELSE {c} || ' ' END"
    return f"""{P} SELECT id, name, email FROM p UNION ALL SELECT * FROM (SELECT id + (SELECT max(id) + 1 FROM p) * (c + 1), CASE WHEN {r} % 2 = 0 THEN {vary('name')} ELSE name END,
      CASE WHEN {r} % 2 = 1 THEN {vary('email')} ELSE email END FROM {COPIES.format(md('fuzzy'))}) c"""


@query("k20_fuzzy_duplicates", fuzzy_sql())
def k20(t):
    return i.inject_fuzzy_duplicates(people(t).select("id", "name", "email"), "id", ["name", "email"], 300)


DIRT = [
    i.Dirt("phone_formats", "phone", "CASE {r} % 3 WHEN 0 THEN '555-201-' || CAST(1000 + {r} % 9000 AS STRING) WHEN 1 THEN '555.201.' || CAST(1000 + {r} % 9000 AS STRING) ELSE '5552010000' END", 400),
    i.Dirt("invalid_emails", "email", "CASE {r} % 4 WHEN 0 THEN replace(email, '@', '') WHEN 1 THEN replace(email, '@', '@@') WHEN 2 THEN split_part(email, '@', 1) ELSE email || '@invalid' END", 100, "email IS NOT NULL"),
    i.Dirt("impossible_dates", "joined", i.one_of(["1900-01-01", "2030-12-31", "1899-12-31"]), 200),
    i.Dirt("spikes", "balance", "balance * (5 + {r} % 6)", 120, "balance > 0"),
    i.Dirt("invalid_zips", "zip", "'INVALID'", 50),
    i.Dirt("segment_spelling", "segment", "CASE {r} % 3 WHEN 0 THEN lower(segment) WHEN 1 THEN substr(segment, 1, 3) ELSE segment || '.' END", 150, "segment IS NOT NULL"),
]


def dirt_sql():
    out = []
    for d in DIRT:
        rnd = f"CAST('0x' || substr({md(d.name)}, 9, 8) AS BIGINT)"
        rk = f"row_number() OVER (PARTITION BY coalesce({d.eligible}, false) ORDER BY {md(d.name)})"
        out.append(f"CASE WHEN coalesce({d.eligible}, false) AND {rk} <= {d.count} THEN {d.value.replace(i.RANDOM, rnd)} ELSE {d.column} END AS {d.column}")
    return f"{P} SELECT id, {', '.join(out)} FROM p"


@query("k21_domain_dirt", dirt_sql())
def k21(t):
    return i.inject_dirt(people(t), "id", DIRT).select("id", *[d.column for d in DIRT])


@query(
    "k21_swapped_emails",
    f"""{P}, c AS (SELECT id, email, row_number() OVER (ORDER BY {md('swap-email')}) AS rn FROM p ORDER BY rn LIMIT 100)
    SELECT p.id, CASE WHEN c.id IS NULL THEN p.email ELSE d.email END AS email FROM p LEFT JOIN c USING (id) LEFT JOIN c d ON c.rn = d.rn % 100 + 1""",
)
def k21_swap(t):
    return i.swap_values(people(t).select("id", "email"), "id", "email", 100)


@query(
    "k22_manifest",
    injected_sql("payroll", i.PAYROLL_FAMILIES)
    + """ SELECT anomaly_type, count(*) AS n, (SELECT count(*) FROM b) AS rows_in, (SELECT count(*) FROM inj) AS rows_out, (SELECT count(*) FROM mask) AS total,
    0.01::DOUBLE AS rate FROM mask GROUP BY 1""",
)
def k22(t):
    src = payroll(t)
    out, mask = i.inject(src, "row_id", i.PAYROLL_FAMILIES)
    return i.manifest(src, out, mask, 0.01)


@query(
    "k23_expected_metrics",
    f"""{P}, c AS (SELECT name, segment FROM p UNION ALL SELECT name, segment FROM ({COPY.format(md('exact'))}) x),
    q AS (SELECT (count(name) + count(segment)) * 100.0::DOUBLE / (2 * count(*)) AS completeness, (1 - 300.0::DOUBLE / count(*)) * 100 AS uniqueness FROM c)
    SELECT round(completeness, 4) AS completeness, 82.0::DOUBLE AS validity, round(uniqueness, 4) AS uniqueness, 75.0::DOUBLE AS consistency, 85.0::DOUBLE AS accuracy,
    round(CAST(completeness * 0.25 + 82 * 0.25 + uniqueness * 0.2 + 75 * 0.15 + 85 * 0.15 AS DOUBLE), 4) AS overall FROM q""",
)
def k23(t):
    dirty = i.inject_exact_duplicates(people(t).select("id", "name", "segment"), "id", 300).drop("id")
    return i.expected_metrics(dirty, 300).select(*[F.round(c, 4).alias(c) for c in ("completeness", "validity", "uniqueness", "consistency", "accuracy", "overall")])


SEEDS = list(range(42, 52))


def credit_rule_sql():
    return "least(1, " + " + ".join(f"CASE WHEN {r.predicate} THEN {r.weight}::DOUBLE ELSE 0 END" for r in features.CREDIT_RULES) + ")"


@query(
    "k24_seed_sweep",
    injected_sql("credit", i.CREDIT_FAMILIES, seeds=SEEDS)
    + f""", r AS (SELECT CAST(seed AS INTEGER) AS seed, y, round({credit_rule_sql()}, 6) AS threshold FROM inj),
    g AS (SELECT seed, threshold, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM r GROUP BY 1, 2),
    c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY seed) AS n_pos FROM g WINDOW w AS (PARTITION BY seed ORDER BY threshold DESC)),
    f AS (SELECT *, 2 * tp / (tp + fp + n_pos) AS f1, row_number() OVER (PARTITION BY seed ORDER BY round(2 * tp / (tp + fp + n_pos), 10) DESC, threshold) AS rn FROM c)
    SELECT seed, CAST(n_pos AS BIGINT) AS injected, threshold, round(f1, 6) AS f1 FROM f WHERE rn = 1""",
)
def k24(t):
    out, mask = i.inject(credit(t), "row_id", i.CREDIT_FAMILIES, seed=SEEDS)
    scored = features.credit_rules(out).withColumn("rule", F.round("rule", 6))
    best = evaluate.best_f1(scored, "y", "rule", ["seed"]).select("seed", "threshold", F.round("f1", 6).alias("f1"))
    counts = mask.groupBy(F.col("injection_rng_seed").alias("seed")).agg(F.count(F.lit(1)).alias("injected"))
    return best.join(counts, "seed")
