"""Quality scores, issues and recommendations."""

from pyspark.sql import functions as F

from plumbline.operators import duplicates, missing, outliers, profile, scores
from plumbline.operators.order_stats import one_row
from plumbline.plans.c_profile import infer_sql, stack
from plumbline.plans.registry import query
from plumbline.plans.shapes import PEOPLE, PEOPLE_COLUMNS, PEOPLE_COPIES, PEOPLE_NUMERIC, PEOPLE_TEXT, people, people_copies, with_

P = with_("p", PEOPLE)
COLS = [c for c in PEOPLE_COLUMNS if c != "id"]
NUMS = ["nation", "balance", "tier"]

COMPLETE = f"SELECT ({' + '.join(f'count({c})' for c in PEOPLE_COLUMNS)}) * 100.0::DOUBLE / (count(*) * {len(PEOPLE_COLUMNS)}) AS completeness FROM p"
UNIQUE = f"SELECT (SELECT count(*) FROM (SELECT DISTINCT {', '.join(PEOPLE_COLUMNS)} FROM p) u) * 100.0::DOUBLE / count(*) AS uniqueness FROM p"
SHAPE = "regexp_replace(regexp_replace($c, '[a-zA-Z]', 'A', 'g'), '\\d', 'N', 'g')"
SHAPE_COMPAT = "regexp_replace(regexp_replace($c, '\\d', 'N', 'g'), '[a-zA-Z]', 'A', 'g')"


def consistency_sql(shape):
    each = stack(PEOPLE_TEXT, f"SELECT count(DISTINCT {shape}) AS d FROM p WHERE $c IS NOT NULL")
    return f"SELECT sum(CASE WHEN d > 0 THEN 100.0::DOUBLE / d ELSE 0 END) / {len(PEOPLE_TEXT)} AS consistency FROM ({each}) z"


def accuracy_sql(columns=PEOPLE_NUMERIC):
    each = stack(
        columns,
        """SELECT count($c) AS n, count(*) FILTER (WHERE $c < a - 1.5 * (b - a) OR $c > b + 1.5 * (b - a)) AS o
        FROM p, (SELECT quantile_cont($c, 0.25) AS a, quantile_cont($c, 0.75) AS b FROM p) q""",
    )
    return f"SELECT greatest(0, 100 - 200.0::DOUBLE * sum(o) / sum(n)) AS accuracy FROM ({each}) z WHERE n >= 10"


VALID = """SELECT avg(CASE WHEN family = 'text' THEN CASE WHEN inferred IN ('text', 'categorical') THEN 80 ELSE 60 END
  WHEN family = inferred THEN 100 ELSE 60 END) AS validity FROM inferred WHERE inferred <> 'unknown'"""


@query("d1_completeness", f"{P} SELECT round(completeness, 6) AS completeness FROM ({COMPLETE}) z")
def d1(t):
    return scores.completeness(people(t)).select(F.round("completeness", 6).alias("completeness"))


@query(
    "d2_validity",
    infer_sql()
    + """ SELECT "column", inferred, CAST(CASE WHEN family = 'text' THEN CASE WHEN inferred IN ('text', 'categorical') THEN 80 ELSE 60 END
      WHEN family = inferred THEN 100 ELSE 60 END AS DOUBLE) AS score FROM inferred WHERE inferred <> 'unknown'""",
)
def d2(t):
    return scores.column_validity(people(t)).select("column", "inferred", "score")


@query(
    "d3_uniqueness",
    with_("p", PEOPLE_COPIES)
    + " SELECT round((SELECT count(*) FROM (SELECT DISTINCT name, segment, nation, tier FROM p) u) * 100.0::DOUBLE / count(*), 6) AS uniqueness FROM p",
)
def d3(t):
    return scores.uniqueness(people_copies(t), ["name", "segment", "nation", "tier"]).select(F.round("uniqueness", 6).alias("uniqueness"))


def column_consistency_sql(shape):
    return P + stack(
        [c for c in PEOPLE_TEXT if c != "blank"],
        f"""SELECT '$c' AS "column", count(DISTINCT {shape}) AS shapes, round(100.0::DOUBLE / count(DISTINCT {shape}), 6) AS consistency FROM p""",
    )


@query("d4_consistency", column_consistency_sql(SHAPE))
def d4(t):
    return scores.column_consistency(people(t)).withColumn("consistency", F.round("consistency", 6))


@query("d4_consistency_compat", column_consistency_sql(SHAPE_COMPAT))
def d4_compat(t):
    return scores.column_consistency(people(t), compat=True).withColumn("consistency", F.round("consistency", 6))


@query("d5_accuracy", f"{P} SELECT round(accuracy, 6) AS accuracy FROM ({accuracy_sql()}) z")
def d5(t):
    return scores.accuracy(people(t)).select(F.round("accuracy", 6).alias("accuracy"))


SCORE_ROW = f"""{infer_sql()}, r AS (SELECT c.completeness, v.validity, u.uniqueness, s.consistency, a.accuracy,
  c.completeness * 0.25 + v.validity * 0.25 + u.uniqueness * 0.2 + s.consistency * 0.15 + a.accuracy * 0.15 AS overall
  FROM ({COMPLETE}) c, ({VALID}) v, ({UNIQUE}) u, ({consistency_sql(SHAPE)}) s, ({accuracy_sql()}) a),
  q AS ({stack(scores.METRICS, "SELECT '$c' AS metric, round(CAST($c AS DOUBLE), 2) AS score FROM r")})"""


@query("d6_overall_scores", SCORE_ROW + " SELECT * FROM q")
def d6(t):
    return scores.quality_scores(people(t))


@query(
    "d7_upload_scores",
    f"""{P}, z AS (SELECT completeness, 100 - uniqueness AS dup FROM ({COMPLETE}) a, ({UNIQUE}) b)
    SELECT round(completeness, 2) AS completeness, CAST(round(greatest(85, 100 - dup), 2) AS DOUBLE) AS accuracy,
    CAST(round(greatest(80, completeness - 5), 2) AS DOUBLE) AS consistency, 90.0::DOUBLE AS validity,
    CAST(round(greatest(90, 100 - dup), 2) AS DOUBLE) AS uniqueness FROM z""",
)
def d7(t):
    return scores.upload_scores(people(t))


@query(
    "d8_improvement",
    with_("p", PEOPLE_COPIES)
    + """, c AS (SELECT DISTINCT name, segment, nation, tier FROM p WHERE name IS NOT NULL),
    b AS (SELECT (SELECT (count(name) + count(segment) + count(nation) + count(tier)) * 100.0::DOUBLE / (4 * count(*)) FROM p) AS c0,
      (SELECT (count(name) + count(segment) + count(nation) + count(tier)) * 100.0::DOUBLE / (4 * count(*)) FROM c) AS c1,
      (SELECT count(*) FROM (SELECT DISTINCT name, segment, nation, tier FROM p) x) * 100.0::DOUBLE / (SELECT count(*) FROM p) AS u0)
    SELECT round(c1 - c0, 2) AS completeness, round(100 - u0, 2) AS uniqueness, round((round(c1 - c0, 2) + round(100 - u0, 2)) / 2, 2) AS overall FROM b""",
)
def d8(t):
    src = people_copies(t).select("name", "segment", "nation", "tier")
    return scores.improvement(src, src.filter("name IS NOT NULL").distinct())


def issue_summary(t):
    """(type, count, pct) of the people table with its copies."""
    src = people_copies(t)
    cols = ["name", "segment", "nation", "tier"]
    dup = duplicates.exact_duplicates(src, cols).select(F.lit("duplicates").alias("type"), F.col("duplicates").alias("count"), "pct")
    gaps = missing.missing_total(src, cols).select(F.lit("missing_values").alias("type"), F.col("missing").alias("count"), "pct")
    full = people(t)
    rows = full.agg(F.count(F.lit(1)).alias("_n"))
    out = outliers.outliers(full, "id", NUMS).agg(F.count(F.lit(1)).alias("count"))
    out = one_row(out, rows).select(F.lit("outliers").alias("type"), "count", F.round(F.col("count") * 100.0 / F.col("_n"), 2).alias("pct"))
    return dup.unionByName(gaps).unionByName(out)


ISSUES = f"""WITH p AS ({with_('x', PEOPLE)[len('WITH x AS '):]}), k AS ({with_('x', PEOPLE_COPIES)[len('WITH x AS '):]}),
 o AS ({stack(NUMS, '''SELECT count(*) FILTER (WHERE $c < a - 1.5 * (b - a) OR $c > b + 1.5 * (b - a)) AS o
        FROM p, (SELECT quantile_cont($c, 0.25) AS a, quantile_cont($c, 0.75) AS b FROM p) q''')}),
 i AS (SELECT 'duplicates' AS type, count(*) - (SELECT count(*) FROM (SELECT DISTINCT name, segment, nation, tier FROM k) u) AS "count",
    round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT name, segment, nation, tier FROM k) u)) * 100.0::DOUBLE / count(*), 2) AS pct FROM k
  UNION ALL SELECT 'missing_values', 4 * count(*) - count(name) - count(segment) - count(nation) - count(tier),
    round((4 * count(*) - count(name) - count(segment) - count(nation) - count(tier)) * 100.0::DOUBLE / (4 * count(*)), 2) FROM k
  UNION ALL SELECT 'outliers', CAST(sum(o) AS BIGINT), round(sum(o) * 100.0::DOUBLE / (SELECT count(*) FROM p), 2) FROM o)"""


@query(
    "d9_issues",
    ISSUES
    + """ SELECT type, CASE type WHEN 'duplicates' THEN CASE WHEN pct < 10 THEN 'medium' ELSE 'high' END
    WHEN 'outliers' THEN CASE WHEN pct < 5 THEN 'low' ELSE 'medium' END ELSE CASE WHEN pct < 20 THEN 'medium' ELSE 'high' END END AS severity,
    "count", pct FROM i WHERE "count" > 0""",
)
def d9(t):
    return scores.issues(issue_summary(t))


@query(
    "d10_issue_breakdown",
    ISSUES
    + """ SELECT type, "count", CASE WHEN type = 'outliers' THEN CASE WHEN "count" > 50 THEN 'medium' ELSE 'low' END
    ELSE CASE WHEN "count" > 100 THEN 'high' WHEN "count" > 10 THEN 'medium' ELSE 'low' END END AS severity FROM i WHERE "count" > 0""",
)
def d10(t):
    return scores.issue_breakdown(issue_summary(t))


@query(
    "d10_metric_status",
    SCORE_ROW
    + """ SELECT metric, score, CASE WHEN metric = 'consistency' THEN CASE WHEN score >= 95 THEN 'excellent' WHEN score >= 85 THEN 'good' ELSE 'warning' END
    ELSE CASE WHEN score >= 90 THEN 'good' WHEN score >= 75 THEN 'warning' ELSE 'poor' END END AS status FROM q""",
)
def d10_status(t):
    return scores.metric_status(scores.quality_scores(people(t)))


@query(
    "d11_recommendations",
    f"""{infer_sql()}, r AS (SELECT c.completeness, v.validity, u.uniqueness, s.consistency, a.accuracy,
      c.completeness * 0.25 + v.validity * 0.25 + u.uniqueness * 0.2 + s.consistency * 0.15 + a.accuracy * 0.15 AS overall
      FROM ({COMPLETE}) c, ({VALID}) v, ({UNIQUE}) u, ({consistency_sql(SHAPE)}) s, ({accuracy_sql()}) a),
    g AS ({stack(PEOPLE_COLUMNS, '''SELECT '$c' AS "column", (count(*) - count($c)) * 100.0::DOUBLE / count(*) AS pct FROM p''')})
    SELECT 'type_correction' AS kind, "column" AS subject, inferred AS detail FROM inferred WHERE inferred <> family
    UNION ALL SELECT 'cleaning_priority', 'missing_values', CASE WHEN (SELECT count(*) FROM g WHERE pct > 0 AND regexp_matches("column", 'age|salary|income|price|cost|revenue')) > 0
      THEN 'high' ELSE 'medium' END FROM r WHERE completeness < 95
    UNION ALL SELECT 'cleaning_priority', 'duplicates', 'medium' FROM r WHERE uniqueness < 95
    UNION ALL SELECT 'cleaning_priority', 'format_inconsistency', 'medium' FROM r WHERE consistency < 85
    UNION ALL SELECT 'quality_improvement', 'comprehensive_cleaning', '15' FROM r WHERE overall < 80
    UNION ALL SELECT 'automation', 'Automated data type conversion', '' FROM r WHERE (SELECT count(*) FROM inferred WHERE inferred <> family) > 0
    UNION ALL SELECT 'automation', 'Automated missing value imputation', '' FROM r WHERE (SELECT max(pct) FROM g) > 20
    UNION ALL SELECT 'automation', 'Automated duplicate detection and removal', '' FROM r WHERE uniqueness < 95""",
)
def d11(t):
    src = people(t)
    nulls = profile.null_stats(src).filter("metric = 'null_pct'").select("column", F.col("value").alias("null_pct"))
    return scores.recommendations(profile.infer_types(src).join(nulls, "column"), scores.score_row(src))


@query("d12_total_issues", ISSUES + ' SELECT CAST(sum("count") AS BIGINT) AS total_issues FROM i')
def d12(t):
    return issue_summary(t).agg(F.sum("count").alias("total_issues"))
