"""Missing values and imputation."""

from pyspark.sql import functions as F

from plumbline.operators import missing as m
from plumbline.plans.c_profile import stack
from plumbline.plans.registry import query
from plumbline.plans.shapes import PEOPLE, PEOPLE_COLUMNS, PEOPLE_COPIES, people, people_copies, with_

P = with_("p", PEOPLE)
GAPS = " + ".join(f"(count(*) - count({c}))" for c in PEOPLE_COLUMNS)
REST = [c for c in PEOPLE_COLUMNS if c != "id"]


@query("g1_missing_total", f"{P} SELECT {GAPS} AS missing, round(({GAPS}) * 100.0::DOUBLE / (count(*) * {len(PEOPLE_COLUMNS)}), 2) AS pct FROM p")
def g1(t):
    return m.missing_total(people(t))


@query(
    "g2_missing_by_column",
    P + " SELECT * FROM (" + stack(
        REST,
        """SELECT '$c' AS "column", count(*) - count($c) AS missing, round((count(*) - count($c)) * 100.0::DOUBLE / count(*), 2) AS pct,
        (SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FROM (SELECT id FROM p WHERE $c IS NULL ORDER BY id LIMIT 10) f) AS first_keys FROM p""",
    ) + ") z WHERE missing > 0",
)
def g2(t):
    return m.missing_by_column(people(t), "id").withColumn("first_keys", F.array_join(F.col("first_keys").cast("array<string>"), ","))


# a column where many gaps were filled with the median and the mean
FILLED = f"""SELECT id, tier, CASE WHEN id % 4 = 0 THEN 1000e0 WHEN id % 2 = 0 THEN 400e0 ELSE CAST(id % 2000 AS DOUBLE) END AS amount,
  CAST(id % 5 AS DOUBLE) AS level FROM ({PEOPLE}) x"""


@query(
    "g3_suspected_imputation",
    with_("p", FILLED) + stack(
        ["amount", "level", "tier"],
        """SELECT '$c' AS "column", a AS equal_mean, m AS equal_median, CASE WHEN a > 1 THEN a ELSE 0 END + CASE WHEN m > 0.1 * n THEN m ELSE 0 END AS suspected
        FROM (SELECT count($c) AS n, count(*) FILTER (WHERE $c = mean) AS a, count(*) FILTER (WHERE $c = med) AS m
          FROM p, (SELECT avg($c) AS mean, quantile_cont($c, 0.5) AS med FROM p) s) z""",
    ),
)
def g3(t):
    return m.suspected_imputation(t.sql(FILLED), ["amount", "level", "tier"])


@query(
    "g4_missing_patterns",
    f"""{P}, z AS (SELECT concat_ws(',', {', '.join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in REST)}) AS pattern, count(*) AS n FROM p GROUP BY 1),
    y AS (SELECT * FROM z ORDER BY n DESC, pattern LIMIT 5)
    SELECT pattern, n, round(n * 100.0::DOUBLE / (SELECT count(*) FROM p), 2) AS pct FROM y WHERE pattern <> ''""",
)
def g4(t):
    return m.missing_patterns(people(t).drop("id"))


SUGGEST = P + " SELECT * FROM (" + stack(
    REST,
    """SELECT '$c' AS "column", CASE WHEN '$c' IN ('nation','balance','tier') AND count(DISTINCT $c) >= 10 THEN 'median' ELSE 'mode' END AS method,
    CASE WHEN regexp_matches('$c', 'age|salary|income|price|cost|revenue') THEN CASE WHEN (count(*) - count($c)) * 100.0 / count(*) > 10 THEN 'high' ELSE 'medium' END
      WHEN regexp_matches('$c', 'name|email|id|key') THEN 'high' WHEN (count(*) - count($c)) * 100.0 / count(*) > 20 THEN 'medium' ELSE 'low' END AS priority,
    round((count(*) - count($c)) * 100.0::DOUBLE / count(*), 2) AS pct FROM p""",
) + ") z WHERE pct > 0"


@query("g5_suggested_imputation", SUGGEST)
def g5(t):
    return m.suggest_imputation(people(t).drop("id"))


# correlated numeric columns with gaps
LINKED = f"""SELECT id, segment, CAST(id % 3 AS STRING) AS kind, CASE WHEN id % 5 <> 0 THEN CAST(NULL AS STRING) ELSE name END AS rare,
  CASE WHEN id % 3 = 1 THEN NULL ELSE 'fixed' || CAST(CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END AS STRING) END AS mostly,
  CASE WHEN id % 9 = 0 THEN NULL ELSE balance END AS balance, balance * 2 + id % 7 AS twice, balance * 3 - id % 11 AS thrice,
  CASE WHEN id % 8 = 0 THEN NULL ELSE CAST(id % 1000 AS DOUBLE) END AS flat,
  CASE WHEN id % 7 = 0 THEN NULL ELSE CAST((id % 100) * (id % 100) * (id % 100) AS DOUBLE) END AS tail FROM ({PEOPLE}) x"""
SKEW = "sqrt(count(c)) * sum((c - a) * (c - a) * (c - a)) / pow(sum((c - a) * (c - a)), 1.5)"


def _corr(a, b):
    return f"coalesce(abs((SELECT corr({a}, {b}) FROM p)), 0) > 0.7"


def _numeric_sql(c, others):
    links = " + ".join(f"CAST({_corr(c, o)} AS INTEGER)" for o in others)
    return f"""SELECT '{c}' AS "column", CASE WHEN ({links}) >= 2 THEN 'knn_imputation'
      WHEN abs((SELECT {SKEW} FROM (SELECT {c} AS c, (SELECT avg({c}) FROM p) AS a FROM p) s)) < 0.5 THEN 'mean_imputation' ELSE 'median_imputation' END AS method,
      round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS pct FROM p"""


NUMS6 = ["balance", "twice", "thrice", "flat", "tail", "id"]


@query(
    "g6_statistical_suggestion",
    with_("p", LINKED) + " SELECT \"column\", CASE WHEN pct > 50 THEN 'drop_column' ELSE method END AS method, pct FROM ("
    + " UNION ALL ".join(_numeric_sql(c, [o for o in NUMS6 if o != c]) for c in NUMS6) + " UNION ALL "
    + stack(
        ["segment", "kind", "rare", "mostly"],
        """SELECT '$c', CASE WHEN (SELECT max(n) FROM (SELECT count(*) AS n FROM p WHERE $c IS NOT NULL GROUP BY $c) y) * 1.0 / count($c) > 0.5
        THEN 'mode_imputation' ELSE 'constant_imputation' END, round((count(*) - count($c)) * 100.0::DOUBLE / count(*), 2) FROM p""",
    ) + ") z WHERE pct > 0",
)
def g6(t):
    return m.suggest_statistical(t.sql(LINKED))


def fill_sql(balance, tier, segment):
    return f"""{P} SELECT id, coalesce(balance, {balance}) AS balance, CAST(coalesce(tier, {tier}) AS DOUBLE) AS tier, coalesce(segment, {segment}) AS segment FROM p"""


MODE = "(SELECT $c FROM p WHERE $c IS NOT NULL GROUP BY $c ORDER BY count(*) DESC, $c LIMIT 1)"


def _filled(df):
    return df.select("id", F.round("balance", 6).alias("balance"), F.col("tier").cast("double").alias("tier"), "segment")


@query("g7_fill_auto", fill_sql("(SELECT quantile_cont(balance, 0.5) FROM p)", "(SELECT quantile_cont(tier, 0.5) FROM p)", MODE.replace("$c", "segment")))
def g7(t):
    return _filled(m.impute(people(t), ["balance", "tier", "segment"]))


@query("g7_fill_mean", f"{P} SELECT id, round(coalesce(balance, (SELECT avg(balance) FROM p)), 6) AS balance FROM p")
def g7_mean(t):
    return m.impute(people(t), ["balance"], "mean").select("id", F.round("balance", 6).alias("balance"))


@query("g7_fill_mode", fill_sql(MODE.replace("$c", "balance"), MODE.replace("$c", "tier"), MODE.replace("$c", "segment")))
def g7_mode(t):
    return _filled(m.impute(people(t), ["balance", "tier", "segment"], "mode"))


@query("g7_fill_constant", f"{P} SELECT id, coalesce(segment, 'none') AS segment, coalesce(email, 'none') AS email FROM p")
def g7_constant(t):
    return m.impute(people(t), ["segment", "email"], "constant", "none").select("id", "segment", "email")


@query(
    "g7_filled_counts",
    f"""{P} SELECT 'balance' AS "column", count(*) - count(balance) AS filled FROM p UNION ALL SELECT 'tier', count(*) - count(tier) FROM p
    UNION ALL SELECT 'segment', count(*) - count(segment) FROM p""",
)
def g7_counts(t):
    cols = ["balance", "tier", "segment"]
    return m.fill_counts(people(t), m.impute(people(t), cols), cols)


@query(
    "g11_export_clean",
    with_("p0", PEOPLE_COPIES)
    + """, p AS (SELECT min(rid) AS rid, name, segment, nation, tier FROM p0 GROUP BY ALL)
    SELECT rid, coalesce(name, (SELECT name FROM p WHERE name IS NOT NULL GROUP BY name ORDER BY count(*) DESC, name LIMIT 1), 'Unknown') AS name,
    coalesce(segment, (SELECT segment FROM p WHERE segment IS NOT NULL GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1), 'Unknown') AS segment,
    CAST(nation AS DOUBLE) AS nation, round(coalesce(tier, (SELECT avg(tier) FROM p)), 6) AS tier FROM p""",
)
def g11(t):
    return m.export_clean(people_copies(t), "rid").withColumn("tier", F.round("tier", 6))
