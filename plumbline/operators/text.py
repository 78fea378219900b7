"""Format reports, text standardisation, type repair and text classification."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.functions import patterns as P
from plumbline.operators.profile import infer_types, long_values, pattern_counts, text_columns

# fixed values: abbreviations and their expansions
ABBREVIATIONS = {
    "st": "street", "ave": "avenue", "dr": "drive", "rd": "road", "blvd": "boulevard",
    "apt": "apartment", "co": "company", "inc": "incorporated",
}
# fixed values: garbled byte sequences and the characters they stand for
MOJIBAKE = {
    "â€™": "'", "â€œ": '"', "â€\u009d": '"', "â€”": "—", "â€“": "–", "â€": '"',
    "Ã¡": "á", "Ã©": "é", "Ã­": "í", "Ã³": "ó", "Ãº": "ú", "Ã±": "ñ", "Ã¼": "ü",
}
# fixed values: weighted patterns per class of SQL text
DIALECT_PATTERNS = {
    "mysql": [
        (r"AUTO_INCREMENT", 5), (r"ENGINE\s*=\s*(InnoDB|MyISAM)", 5), (r"CHARSET\s*=", 3), (r"`[^`]+`", 3),
        (r"LIMIT\s+\d+\s*,\s*\d+", 4), (r"DATE_FORMAT", 3), (r"IFNULL", 2), (r"TINYINT|MEDIUMINT|LONGTEXT", 3),
    ],
    "postgresql": [
        (r"SERIAL|BIGSERIAL", 5), (r"RETURNING", 4), (r"::", 3), (r"ARRAY\[", 4), (r"JSONB", 4), (r"UUID", 3),
        (r"GENERATE_ALWAYS\s+AS\s+IDENTITY", 5), (r"ILIKE", 3),
    ],
    "sqlserver": [
        (r"IDENTITY\s*\(\s*\d+\s*,\s*\d+\s*\)", 5), (r"\[dbo\]\.", 4), (r"NVARCHAR", 4), (r"GETDATE\(\)", 3),
        (r"TOP\s+\d+", 4), (r"\bGO\b", 5), (r"WITH\s+\(NOLOCK\)", 3),
    ],
    "oracle": [
        (r"VARCHAR2", 5), (r"NUMBER\s*\(\s*\d+", 4), (r"SYSDATE", 4), (r"DUAL", 5), (r"ROWNUM", 4),
        (r"NVL\s*\(", 3), (r"CLOB|BLOB", 3),
    ],
    "snowflake": [
        (r"AUTOINCREMENT", 5), (r"VARIANT", 5), (r"FLATTEN\s*\(", 4), (r"CURRENT_TIMESTAMP\s*\(\)", 3),
        (r"DATEADD\s*\(", 3), (r"TRY_PARSE_JSON", 4), (r"QUALIFY", 5),
    ],
}


def pattern_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, pattern, matches, pct) for the seven format patterns."""
    return pattern_counts(df, columns or text_columns(df), P.FORMAT_PATTERNS)


def _shapes(df, columns, key, first, compat):
    cols = list(columns or text_columns(df))
    if first is None:
        vals = long_values(df, cols)
    else:
        w = W.partitionBy("column").orderBy(key)
        vals = long_values(df, cols, [key]).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= first)
    return vals.groupBy("column", P.shape(F.col("value"), compat).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def format_consistency(
    df: DataFrame, columns: Sequence[str] | None = None, key: str | None = None, first: int | None = None, compat: bool = False
) -> DataFrame:
    """(column, shapes, consistency %). ``first`` limits the report to the first values by key."""
    return _shapes(df, columns, key, first, compat).groupBy("column").agg(F.count(F.lit(1)).alias("shapes")).withColumn(
        "consistency", F.round(100.0 / F.col("shapes"), 2)
    )


def common_shape(
    df: DataFrame, columns: Sequence[str] | None = None, key: str | None = None, first: int | None = None, compat: bool = False
) -> DataFrame:
    """(column, shape, n): the most frequent shape, ties to the smallest."""
    return (
        _shapes(df, columns, key, first, compat).groupBy("column")
        .agg(F.min(F.struct((-F.col("n")).alias("neg"), "shape")).alias("m"))
        .select("column", "m.shape", (-F.col("m.neg")).alias("n"))
    )


def suggestions(consistency: DataFrame, patterns: DataFrame) -> DataFrame:
    """(column, suggestion) from the two reports above."""
    need = consistency.filter("consistency < 80").select("column", F.lit("standardisation").alias("suggestion"))
    rules = patterns.select("column", F.lit("validation_rule").alias("suggestion")).distinct()
    return need.unionByName(rules)


def changed_counts(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """(column, changed): cells whose value differs from the expression, NULL-safe."""
    agg = df.agg(*[F.count_if(~F.col(c).eqNullSafe(e)).alias(c) for c, e in exprs.items()])
    return agg.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("changed")) for c in exprs])).alias("_cell")
    ).select("_cell.*")


def format_expr(column: str, rule: dict) -> Column:
    """Case, trim and regex replacement of one column; NULL stays NULL."""
    c = F.col(column).cast("string")
    case = rule.get("case")
    c = {"lower": F.lower, "upper": F.upper, "title": F.initcap}.get(case, lambda x: x)(c)
    if rule.get("trim", True):
        c = F.trim(c)
    if "regex_replace" in rule:
        c = F.regexp_replace(c, rule["regex_replace"]["pattern"], rule["regex_replace"]["replacement"])
    return c


def standardize_format(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    return df.withColumns({c: format_expr(c, r) for c, r in rules.items()})


DEFAULT_TEXT_OPERATIONS = ("normalize_case", "remove_extra_spaces")


def expand_abbreviations(c: Column) -> Column:
    return reduce(lambda x, kv: F.regexp_replace(x, rf"\b{kv[0]}\b", kv[1]), ABBREVIATIONS.items(), c)


def remove_special(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", "")


def repair_mojibake(c: Column) -> Column:
    """Longest sequences first, so that a short prefix never eats a longer one."""
    pairs = sorted(MOJIBAKE.items(), key=lambda kv: -len(kv[0]))
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), pairs, c)


def text_expr(column: str, operations: Sequence[str] = DEFAULT_TEXT_OPERATIONS) -> Column:
    c = F.col(column)
    if "normalize_case" in operations:
        c = F.lower(c)
    if "remove_extra_spaces" in operations:
        c = F.regexp_replace(F.trim(c), r"\s+", " ")
    if "standardize_abbreviations" in operations:
        c = expand_abbreviations(c)
    if "remove_special_chars" in operations:
        c = remove_special(c)
    if "standardize_encoding" in operations:
        c = repair_mojibake(c)
    return c


def standardize_text(df: DataFrame, columns: Sequence[str], operations: Sequence[str] = DEFAULT_TEXT_OPERATIONS) -> DataFrame:
    return df.withColumns({c: text_expr(c, operations) for c in columns})


def typed(column: str, target: str) -> Column:
    """Column as 'numeric', 'datetime', 'boolean' or 'category'; values that do not parse become NULL."""
    c = F.col(column).cast("string")
    if target in ("numeric", "integer", "float"):
        return P.to_number(c)
    if target == "datetime":
        return P.to_datetime(c)
    if target == "boolean":
        return P.to_boolean(c)
    return F.col(column)


REPAIR_NAMES = {"integer": "numeric", "float": "numeric", "datetime": "datetime", "boolean": "boolean", "categorical": "category"}


def best_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, family, target): the type a column should be repaired to; NULL keeps it."""
    names = F.create_map(*[F.lit(x) for kv in REPAIR_NAMES.items() for x in kv])
    return infer_types(df, columns).select("column", "family", F.try_element_at(names, F.col("inferred")).alias("target"))


def correct_types(df: DataFrame, corrections: dict[str, str] | None = None, auto_detect: bool = True) -> DataFrame:
    """Apply corrections; with ``auto_detect`` the remaining text columns get their best type."""
    plan = dict(corrections or {})
    if auto_detect:
        rest = [c for c in text_columns(df) if c not in plan]
        if rest:  # one row per column of the schema
            plan.update({r["column"]: r["target"] for r in best_types(df, rest).collect() if r["target"]})
    return df.withColumns({c: typed(c, t) for c, t in plan.items() if c in df.columns})


def classify_text(df: DataFrame, column: str, patterns: dict[str, list[tuple[str, int]]] | None = None) -> DataFrame:
    """Adds class, confidence and one score per class: weighted pattern counts, first best class wins."""
    pats = patterns or DIALECT_PATTERNS
    score = {
        k: reduce(lambda a, b: a + b, [F.regexp_count(F.col(column), F.lit("(?i)" + p)) * w for p, w in v])
        for k, v in pats.items()
    }
    out = df.withColumns({f"score_{k}": s for k, s in score.items()})
    names = [f"score_{k}" for k in pats]
    total = reduce(lambda a, b: a + b, [F.col(n) for n in names])
    best = F.greatest(*names)
    label = reduce(lambda acc, k: acc.when(F.col(f"score_{k}") == best, k), list(pats)[1:], F.when(F.col(names[0]) == best, list(pats)[0]))
    return out.withColumns(
        {
            "class": F.when(total == 0, "unknown").otherwise(label),
            "confidence": F.when(total == 0, 0).otherwise(F.least(F.lit(95), F.floor(best * 100 / total))).cast("bigint"),
        }
    )


# fixed values: words left out of the preserved share
PLAIN_WORDS = ["SELECT", "FROM", "WHERE", "JOIN", "AND", "OR", "IN", "ON"]


def token_similarity(a: Column, b: Column, plain: Sequence[str] = PLAIN_WORDS) -> Column:
    """0.6 x Jaccard of the word sets + 0.4 x share of a's own words kept in b."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.upper(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    wa, wb = words(a), words(b)
    own = F.array_except(wa, F.array(*[F.lit(w) for w in plain]))
    jaccard = F.size(F.array_intersect(wa, wb)) / F.size(F.array_union(wa, wb))
    kept = F.size(F.array_intersect(own, wb)) / F.greatest(F.lit(1), F.size(own))
    return F.when(F.size(wa) == 0, 0.0).otherwise(F.least(F.lit(1.0), jaccard * 0.6 + kept * 0.4))
