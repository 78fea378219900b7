"""Column profiles of the derived people table."""

from pyspark.sql import functions as F

from plumbline.functions.patterns import NUMBER, TEXT_PATTERNS
from plumbline.operators import profile as p
from plumbline.plans.registry import query
from plumbline.plans.shapes import PEOPLE, PEOPLE_COLUMNS, PEOPLE_NUMERIC, PEOPLE_TEXT, people, with_

P = with_("p", PEOPLE)


def stack(columns, template):
    """One SELECT per column, glued with UNION ALL."""
    return " UNION ALL ".join(template.replace("$c", c) for c in columns)


@query(
    "c1_null_stats",
    P + stack(
        PEOPLE_COLUMNS,
        """SELECT '$c' AS "column", 'null_count' AS metric, CAST(count(*) - count($c) AS DOUBLE) AS value FROM p
        UNION ALL SELECT '$c', 'null_pct', round((count(*) - count($c)) * 100.0::DOUBLE / count(*), 2) FROM p""",
    ),
)
def c1(t):
    return p.null_stats(people(t))


DISTINCT = stack(
    PEOPLE_COLUMNS,
    """SELECT '$c' AS "column", 'distinct_count' AS metric, CAST(count(DISTINCT $c) AS DOUBLE) AS value FROM p
    UNION ALL SELECT '$c', 'distinct_pct', round(count(DISTINCT $c) * 100.0::DOUBLE / count(*), 2) FROM p""",
)


@query("c2_distinct_stats", P + DISTINCT)
def c2(t):
    return p.distinct_stats(people(t))


@query(
    "c2_distinct_stats_approx",
    P + stack(PEOPLE_COLUMNS, """SELECT '$c' AS "column", CAST(count(DISTINCT $c) AS DOUBLE) AS distinct_count, TRUE AS within FROM p"""),
)
def c2_approx(t):
    """The sketch's counts lie within 5 % of the exact ones."""
    count = lambda exact, name: p.distinct_stats(people(t), exact=exact).filter("metric = 'distinct_count'").select("column", F.col("value").alias(name))
    near = F.abs(F.col("approx") - F.col("distinct_count")) <= 0.05 * F.col("distinct_count")
    return count(True, "distinct_count").join(count(False, "approx"), "column").select("column", "distinct_count", near.alias("within"))


STATS = {"min": "min($c)", "max": "max($c)", "mean": "avg($c)", "std": "stddev_samp($c)", "median": "quantile_cont($c, 0.5)"}
NUMERIC = stack(
    PEOPLE_NUMERIC,
    " UNION ALL ".join(
        f"""SELECT '$c' AS "column", '{m}' AS metric, round(CAST({e} AS DOUBLE), 4) AS value FROM p""" for m, e in STATS.items()
    ),
)


@query("c3_numeric_stats", P + NUMERIC)
def c3(t):
    return p.numeric_stats(people(t)).withColumn("value", F.round("value", 4))


MODE_COLUMNS = ["name", "phone", "segment", "active", "nation", "tier", "joined"]


@query(
    "c4_modes",
    P + stack(
        MODE_COLUMNS,
        """SELECT * FROM (SELECT '$c' AS "column", CAST($c AS VARCHAR) AS mode, count(*) AS n FROM p WHERE $c IS NOT NULL
        GROUP BY $c ORDER BY n DESC, $c LIMIT 1) m_$c""",
    ),
)
def c4(t):
    return p.modes(people(t), MODE_COLUMNS)


def pattern_sql(columns, patterns):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{n}' AS pattern, count(*) FILTER (WHERE regexp_matches({c}, '{x}')) AS matches,
        round(count(*) FILTER (WHERE regexp_matches({c}, '{x}')) * 100.0::DOUBLE / count({c}), 2) AS pct
        FROM p HAVING count(*) FILTER (WHERE regexp_matches({c}, '{x}')) > 0"""
        for c in columns
        for n, x in patterns.items()
    )


@query("c5_text_patterns", P + pattern_sql(PEOPLE_TEXT, TEXT_PATTERNS))
def c5(t):
    return p.pattern_counts(people(t), PEOPLE_TEXT)


@query(
    "c6_sample_values",
    P + stack(
        ["name", "email", "segment", "tier"],
        """SELECT * FROM (SELECT '$c' AS "column", CAST(row_number() OVER (ORDER BY id) AS INTEGER) AS position, CAST($c AS VARCHAR) AS value
        FROM p WHERE $c IS NOT NULL ORDER BY id LIMIT 10) s_$c""",
    ),
)
def c6(t):
    return p.sample_values(people(t), "id", ["name", "email", "segment", "tier"])


def infer_sql():
    text = stack(
        PEOPLE_TEXT,
        f"""SELECT '$c' AS "column", 'text' AS family, count($c) AS n, count(*) FILTER (WHERE regexp_matches($c, '{NUMBER}')) AS num,
        count(*) FILTER (WHERE regexp_matches($c, '{NUMBER}') AND try_cast($c AS DOUBLE) = floor(try_cast($c AS DOUBLE))) AS whole,
        count(coalesce(try_cast($c AS TIMESTAMP), try_strptime($c, '%m/%d/%Y'))) AS ts,
        count(*) FILTER (WHERE lower($c) IN ('true','false','1','0','yes','no','t','f','y','n')) AS bool, count(DISTINCT $c) AS d FROM p""",
    )
    num = " UNION ALL ".join(
        f"""SELECT '{c}', '{f}', count({c}), 0, count(*) FILTER (WHERE {c} = floor({c})), 0, 0, 0 FROM p"""
        for c, f in (("id", "integer"), ("nation", "integer"), ("balance", "float"), ("tier", "integer"))
    )
    return f"""{P}, e AS ({text} UNION ALL {num}), inferred AS (SELECT "column", family,
      CASE WHEN n = 0 THEN 'unknown' WHEN family <> 'text' OR num = n THEN CASE WHEN whole = n THEN 'integer' ELSE 'float' END
        WHEN ts = n THEN 'datetime' WHEN bool = n THEN 'boolean' WHEN d * 1.0 / n < 0.5 THEN 'categorical' ELSE 'text' END AS inferred FROM e)"""


@query("c7_inferred_types", infer_sql() + " SELECT * FROM inferred")
def c7(t):
    return p.infer_types(people(t))


@query(
    "c8_light_profile",
    P + stack(
        [c for c in PEOPLE_COLUMNS if c != "id"],
        """SELECT '$c' AS "column", 'null_count' AS metric, CAST(count(*) - count($c) AS DOUBLE) AS value FROM p
        UNION ALL SELECT '$c', 'null_pct', round((count(*) - count($c)) * 100.0::DOUBLE / count(*), 2) FROM p
        UNION ALL SELECT '$c', 'distinct_count', CAST(count(DISTINCT $c) AS DOUBLE) FROM p
        UNION ALL SELECT '$c', 'distinct_pct', round(count(DISTINCT $c) * 100.0::DOUBLE / count(*), 2) FROM p""",
    )
    + " UNION ALL " + stack(
        ["nation", "balance", "tier"],
        " UNION ALL ".join(
            f"SELECT '$c', '{m}', round(CAST({e} AS DOUBLE), 4) FROM p" for m, e in STATS.items() if m != "median"
        ),
    )
    + " UNION ALL SELECT '*', 'duplicate_rows', CAST((SELECT count(*) FROM p) - (SELECT count(*) FROM (SELECT DISTINCT "
    + ", ".join(c for c in PEOPLE_COLUMNS if c != "id") + " FROM p) u) AS DOUBLE)",
)
def c8(t):
    return p.light_profile(people(t), "id").withColumn("value", F.round("value", 4))
