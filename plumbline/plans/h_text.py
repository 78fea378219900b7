"""Patterns, formats, text repair and classification."""

from pyspark.sql import functions as F

from plumbline.functions.patterns import FORMAT_PATTERNS
from plumbline.operators import text as x
from plumbline.plans.c_profile import infer_sql, pattern_sql, stack
from plumbline.plans.d_scores import SHAPE, SHAPE_COMPAT
from plumbline.plans.registry import duck, query
from plumbline.plans.shapes import PEOPLE, PEOPLE_TEXT, people, with_

P = with_("p", PEOPLE)
COLS = [c for c in PEOPLE_TEXT if c != "blank"]


@query("h1_format_patterns", P + pattern_sql(PEOPLE_TEXT, FORMAT_PATTERNS))
def h1(t):
    return x.pattern_report(people(t), PEOPLE_TEXT)


@query(
    "h2_format_consistency",
    P + stack(COLS, f"""SELECT '$c' AS "column", count(DISTINCT {SHAPE}) AS shapes, round(100.0::DOUBLE / count(DISTINCT {SHAPE}), 2) AS consistency FROM p"""),
)
def h2(t):
    return x.format_consistency(people(t))


@query(
    "h2_format_consistency_first100",
    P + stack(
        COLS,
        f"""SELECT '$c' AS "column", count(DISTINCT {SHAPE_COMPAT}) AS shapes, round(100.0::DOUBLE / count(DISTINCT {SHAPE_COMPAT}), 2) AS consistency
        FROM (SELECT $c FROM p WHERE $c IS NOT NULL ORDER BY id LIMIT 100) f""",
    ),
)
def h2_first(t):
    return x.format_consistency(people(t), key="id", first=100, compat=True)


SHAPES = stack(
    COLS,
    f"""SELECT * FROM (SELECT '$c' AS "column", {SHAPE} AS shape, count(*) AS n FROM p WHERE $c IS NOT NULL GROUP BY 2 ORDER BY n DESC, shape LIMIT 1) m_$c""",
)


@query("h3_common_shape", P + SHAPES)
def h3(t):
    return x.common_shape(people(t))


@query(
    "h4_suggestions",
    P + f""", f AS ({stack(COLS, f'''SELECT '$c' AS "column", 100.0 / count(DISTINCT {SHAPE}) AS consistency FROM p''')})
    SELECT "column", 'standardisation' AS suggestion FROM f WHERE consistency < 80
    UNION ALL SELECT DISTINCT "column", 'validation_rule' FROM ({pattern_sql(PEOPLE_TEXT, FORMAT_PATTERNS)}) r""",
)
def h4(t):
    src = people(t)
    return x.suggestions(x.format_consistency(src), x.pattern_report(src))


RULES = {
    "name": {"case": "upper"},
    "segment": {"case": "title", "trim": True},
    "phone": {"regex_replace": {"pattern": "[^0-9]", "replacement": ""}},
    "email": {"case": "lower", "trim": False},
}


@query(
    "h5_standardized_format",
    f"""{P} SELECT id, trim(upper(name)) AS name, upper(substr(segment, 1, 1)) || lower(substr(segment, 2)) AS segment,
    regexp_replace(trim(phone), '[^0-9]', '', 'g') AS phone, lower(email) AS email FROM p""",
)
def h5(t):
    return x.standardize_format(people(t), RULES).select("id", "name", "segment", "phone", "email")


@query(
    "h5_changed_cells",
    f"""{P} SELECT 'name' AS "column", count(*) FILTER (WHERE name IS DISTINCT FROM trim(upper(name))) AS changed FROM p
    UNION ALL SELECT 'segment', count(*) FILTER (WHERE segment IS DISTINCT FROM upper(substr(segment, 1, 1)) || lower(substr(segment, 2))) FROM p
    UNION ALL SELECT 'phone', count(*) FILTER (WHERE phone IS DISTINCT FROM regexp_replace(trim(phone), '[^0-9]', '', 'g')) FROM p
    UNION ALL SELECT 'email', count(*) FILTER (WHERE email IS DISTINCT FROM lower(email)) FROM p""",
)
def h5_counts(t):
    return x.changed_counts(people(t), {c: x.format_expr(c, r) for c, r in RULES.items()})


@query(
    "h6_text_standardization",
    "SELECT doc_id, md5(regexp_replace(trim(lower(text)), '\\s+', ' ', 'g')) AS text_md5 FROM documents",
)
def h6(t):
    return x.standardize_text(t.documents, ["text"]).select("doc_id", F.md5("text").alias("text_md5"))


# addresses with abbreviations
ADDRESS = """SELECT p_partkey AS id, CAST(p_size AS STRING) || ' ' || p_name || CASE p_partkey % 5 WHEN 0 THEN ' st' WHEN 1 THEN ' ave apt '
  WHEN 2 THEN ' blvd, acme co' WHEN 3 THEN ' rd' ELSE ' stone dr inc.' END || CAST(p_partkey AS STRING) || CASE p_partkey % 5 WHEN 2 THEN ' co' ELSE ' st' END AS address FROM {part}"""


def chain(expr, pairs):
    for a, b in pairs:
        expr = f"regexp_replace({expr}, '\\b{a}\\b', '{b}', 'g')"
    return expr


@query("h7_abbreviations", f"{with_('a', ADDRESS)} SELECT id, {chain('address', x.ABBREVIATIONS.items())} AS address FROM a")
def h7(t):
    return t.sql(ADDRESS).withColumn("address", x.expand_abbreviations(F.col("address")))


@query("h8_special_characters", "SELECT doc_id, md5(regexp_replace(text, '[^\\p{L}\\p{N}_\\s]', '', 'g')) AS text_md5 FROM documents")
def h8(t):
    return t.documents.select("doc_id", F.md5(x.remove_special(F.col("text"))).alias("text_md5"))


# accented letters garbled, quotes replaced by broken sequences
GARBLED = """SELECT doc_id, replace(replace(replace(replace(replace(text, 'é', 'Ã©'), 'ü', 'Ã¼'), 'ñ', 'Ã±'), ', ', 'â€”'), '. ', 'â€™ â€') AS text FROM {documents}"""


def mojibake_sql(c):
    for a, b in sorted(x.MOJIBAKE.items(), key=lambda kv: -len(kv[0])):
        b = b.replace("'", "''")
        c = f"replace({c}, '{a}', '{b}')"
    return c


@query("h9_mojibake", f"{with_('g', GARBLED)} SELECT doc_id, md5({mojibake_sql('text')}) AS text_md5, text <> {mojibake_sql('text')} AS changed FROM g")
def h9(t):
    fixed = x.repair_mojibake(F.col("text"))
    return t.sql(GARBLED).select("doc_id", F.md5(fixed).alias("text_md5"), (F.col("text") != fixed).alias("changed"))


NUMERIC = "CASE WHEN regexp_matches($c, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$') THEN try_cast($c AS DOUBLE) END"


@query(
    "h10_corrected_types",
    f"""{P} SELECT id, {NUMERIC.replace('$c', 'age_text')} AS age_text, {NUMERIC.replace('$c', 'phone')} AS phone, CAST(try_cast(joined AS TIMESTAMP) AS DATE) AS joined,
    CASE WHEN active = 'yes' THEN true WHEN active = 'no' THEN false END AS active, segment FROM p""",
)
def h10(t):
    plan = {"age_text": "numeric", "phone": "numeric", "joined": "datetime", "active": "boolean", "segment": "category"}
    out = x.correct_types(people(t), plan, auto_detect=False)
    return out.select("id", "age_text", "phone", F.col("joined").cast("date").alias("joined"), "active", "segment")


@query(
    "h10_auto_corrected_types",
    f"""{P} SELECT id, CAST(age_text AS DOUBLE) AS age_text, CAST(zip AS DOUBLE) AS zip, CAST(joined AS DATE) AS joined, active = 'yes' AS active, segment FROM p""",
)
def h10_auto(t):
    out = x.correct_types(people(t))
    return out.select("id", "age_text", "zip", F.col("joined").cast("date").alias("joined"), "active", "segment")


@query(
    "h11_best_types",
    infer_sql() + """ SELECT "column", family, CASE inferred WHEN 'integer' THEN 'numeric' WHEN 'float' THEN 'numeric' WHEN 'datetime' THEN 'datetime'
    WHEN 'boolean' THEN 'boolean' WHEN 'categorical' THEN 'category' END AS target FROM inferred""",
)
def h11(t):
    return x.best_types(people(t))


# statements derived from the order table, one dialect flavour per key
STATEMENTS = """SELECT o_orderkey AS id, CASE o_orderkey % 7
  WHEN 0 THEN 'CREATE TABLE t (id INT AUTO_INCREMENT, qty TINYINT) ENGINE=InnoDB CHARSET=utf8'
  WHEN 1 THEN 'insert into t values (' || CAST(o_custkey AS STRING) || '::int, ARRAY[1,2]) returning id'
  WHEN 2 THEN 'SELECT TOP 5 * FROM [dbo].t WITH (NOLOCK) WHERE d < GETDATE() GO'
  WHEN 3 THEN 'SELECT NVL(a, 0), SYSDATE FROM DUAL WHERE ROWNUM < ' || CAST(o_custkey AS STRING)
  WHEN 4 THEN 'SELECT f.value FROM t, FLATTEN (x) f QUALIFY 1 = DATEADD (day, 1, d)'
  WHEN 5 THEN 'SELECT `a`, `b`, x::uuid FROM t LIMIT 1, 2' ELSE 'plain text ' || o_orderpriority END AS statement FROM {orders}"""


def classify_sql():
    def score(ps):
        return " + ".join(f"len(regexp_extract_all(statement, '(?i){p}')) * {w}" for p, w in ps)

    names = list(x.DIALECT_PATTERNS)
    cols = ", ".join(f"{score(ps)} AS {k}" for k, ps in x.DIALECT_PATTERNS.items())
    total, best = " + ".join(names), f"greatest({', '.join(names)})"
    pick = " ".join(f"WHEN {k} = {best} THEN '{k}'" for k in names)
    return f"""{with_('s', STATEMENTS)}, c AS (SELECT id, {cols} FROM s)
      SELECT id, CASE WHEN {total} = 0 THEN 'unknown' {pick} END AS class,
      CAST(CASE WHEN {total} = 0 THEN 0 ELSE least(95, floor({best} * 100 / ({total}))) END AS BIGINT) AS confidence FROM c"""


@query("h12_classified_text", classify_sql())
def h12(t):
    return x.classify_text(t.sql(STATEMENTS), "statement").select("id", "class", "confidence")


WORDS = "list_distinct(regexp_extract_all(upper($c), '[\\p{L}\\p{N}_]+'))"
PAIRS = """SELECT a.conv_id, a.turn, a.text AS left_text, b.text AS right_text FROM {conversations} a JOIN {conversations} b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""
OWN = f"list_filter({WORDS.replace('$c', 'left_text')}, lambda w: w NOT IN ({', '.join(repr(w) for w in x.PLAIN_WORDS)}))"


@query(
    "h13_token_similarity",
    f"""WITH t AS ({duck(PAIRS)}), w AS (SELECT conv_id, turn, {WORDS.replace('$c', 'left_text')} AS a, {WORDS.replace('$c', 'right_text')} AS b, {OWN} AS own FROM t)
    SELECT conv_id, turn, round(CASE WHEN len(a) = 0 THEN 0 ELSE least(1, 0.6::DOUBLE * len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))
      + 0.4::DOUBLE * len(list_intersect(own, b)) / greatest(1, len(own))) END, 6) AS similarity FROM w""",
)
def h13(t):
    pairs = t.sql(PAIRS)
    return pairs.select("conv_id", "turn", F.round(x.token_similarity(F.col("left_text"), F.col("right_text")), 6).alias("similarity"))
