"""Exact, fuzzy and semantic duplicates."""

from pyspark.sql import functions as F

from plumbline.operators import duplicates as d
from plumbline.operators import similarity as s
from plumbline.operators.inject import PAYROLL_FAMILIES
from plumbline.plans.k_injection import injected_sql
from plumbline.plans.l_features import injected
from plumbline.plans.registry import query
from plumbline.plans.shapes import LEDGER, PEOPLE_COPIES, ledger, payroll, people_copies, with_

C = with_("p", PEOPLE_COPIES)
COLS = ["name", "segment", "nation", "tier"]
KEYS = ", ".join(COLS)


@query(
    "e1_exact_duplicates",
    f"""{C}, u AS (SELECT count(*) AS k FROM (SELECT DISTINCT {KEYS} FROM p) x) SELECT count(*) AS rows, count(*) - max(k) AS duplicates,
    round((count(*) - max(k)) * 100.0::DOUBLE / count(*), 2) AS pct FROM p, u""",
)
def e1(t):
    return d.exact_duplicates(people_copies(t), COLS)


def keep_sql(order):
    return f"{C} SELECT rid, {KEYS} FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY rid {order}) AS rn FROM p) z WHERE rn = 1"


@query("e2_keep_first", keep_sql("ASC"))
def e2_first(t):
    return d.drop_dups(people_copies(t), COLS, "first", "rid")


@query("e2_keep_last", keep_sql("DESC"))
def e2_last(t):
    return d.drop_dups(people_copies(t), COLS, "last", "rid")


@query("e2_keep_none", f"{C} SELECT rid, {KEYS} FROM (SELECT *, count(*) OVER (PARTITION BY {KEYS}) AS n FROM p) z WHERE n = 1")
def e2_none(t):
    return d.drop_dups(people_copies(t), COLS, "none", "rid")


@query(
    "e3_repeat_flags",
    f"""{with_('b', LEDGER)} SELECT row_id, CASE WHEN row_number() OVER (PARTITION BY adsh, upper(tag), qtrs ORDER BY row_id) > 1 THEN 1 ELSE 0 END AS is_repeat FROM b""",
)
def e3(t):
    return d.flag_repeats(ledger(t), ["adsh", F.upper("tag"), "qtrs"], "row_id").select("row_id", "is_repeat")


# --- TF-IDF in SQL: every document against every other ---------------------------------------------

STOP = ", ".join(f"'{w}'" for w in s.STOP_WORDS)
TFIDF = f"""WITH k AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{s.TOKEN}')) AS term FROM documents),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM k WHERE term NOT IN ({STOP}) GROUP BY 1, 2),
  voc AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  w AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) * 1.0::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN voc USING (term)),
  u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w),
  sim AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.w * b.w) AS sim FROM u a JOIN u b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2),
  bag AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY words) AS first FROM (SELECT doc_id, string_agg(term || ':' || tf, ' ' ORDER BY term) AS words FROM tf GROUP BY 1) z
    WHERE doc_id IN (SELECT doc_id FROM u))"""
# groups by repeated minimum over the similarity graph
GROUPS = TFIDF.replace("WITH k", "WITH RECURSIVE k", 1) + """, edge AS (SELECT a, b FROM sim WHERE sim > 0.85 UNION SELECT b, a FROM sim WHERE sim > 0.85),
  reach(n, r) AS (SELECT a, a FROM edge UNION SELECT e.b, reach.r FROM reach JOIN edge e ON e.a = reach.n),
  comp AS (SELECT n, min(r) AS c FROM reach GROUP BY 1)"""


@query(
    "e4_fuzzy_pairs",
    f"""{TFIDF} SELECT a AS key_a, b AS key_b, round(sim, 6) AS sim FROM sim JOIN bag x ON x.doc_id = a JOIN bag y ON y.doc_id = b
    WHERE sim > 0.85 AND x.first = a AND y.first = b
    UNION ALL SELECT first, doc_id, 1.0::DOUBLE FROM bag WHERE first <> doc_id""",
)
def e4(t):
    return s.fuzzy_pairs(t.documents, "doc_id", ["text"]).withColumn("sim", F.round("sim", 6))


@query(
    "e5_duplicate_groups",
    f"""{GROUPS} SELECT x.c AS group_id, CAST((SELECT count(*) FROM comp z WHERE z.c = x.c) AS BIGINT) AS size, round(avg(sim), 6) AS mean_sim
    FROM sim JOIN comp x ON x.n = a JOIN comp y ON y.n = b AND x.c = y.c GROUP BY 1""",
)
def e5(t):
    return s.duplicate_groups(t.documents, "doc_id", ["text"]).withColumn("mean_sim", F.round("mean_sim", 6))


@query(
    "e5_top_group_records",
    f"""{GROUPS}, g AS (SELECT c, count(*) AS size FROM comp GROUP BY 1 ORDER BY size DESC, c LIMIT 15)
    SELECT c AS group_id, size, n AS key FROM (SELECT g.c, size, n, row_number() OVER (PARTITION BY g.c ORDER BY n) AS rn FROM g JOIN comp ON comp.c = g.c) z WHERE rn <= 5""",
)
def e5_records(t):
    from plumbline.session import cut_lineage

    rows = cut_lineage(s.group_members(t.documents, "doc_id", ["text"]))
    sizes = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))
    top = s.top_groups(sizes)
    w = s.W.partitionBy("group_id").orderBy("key")
    # 15 groups, and only the five smallest keys of each leave a task
    return rows.join(F.broadcast(top), "group_id").withColumn("_rn", F.row_number().over(w)).filter("_rn <= 5").drop("_rn")


@query(
    "e5_total_fuzzy",
    f"{GROUPS} SELECT CAST(sum(size - 1) AS BIGINT) AS fuzzy_duplicates, count(*) AS groups FROM (SELECT c, count(*) AS size FROM comp GROUP BY 1) z",
)
def e5_total(t):
    g = s.duplicate_groups(t.documents, "doc_id", ["text"])
    return g.agg(F.sum(F.col("size") - 1).alias("fuzzy_duplicates"), F.count(F.lit(1)).alias("groups"))


@query("e6_smart_dedup", f"{GROUPS} SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT n FROM comp WHERE n <> c)")
def e6(t):
    return s.smart_dedup(t.documents.select("doc_id", "lang", "text"), "doc_id", ["text"]).select("doc_id", "lang")


# customers whose email carries somebody else's name
MAILS = """SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 'Anna' WHEN 1 THEN 'Bruno' WHEN 2 THEN 'Carla' WHEN 3 THEN 'David' WHEN 4 THEN 'Al' WHEN 5 THEN 'Felix' ELSE 'Greta' END
  || ' ' || CASE CAST(floor(c_custkey / 7) AS BIGINT) % 5 WHEN 0 THEN 'Stone' WHEN 1 THEN 'Rivers' WHEN 2 THEN 'Woods' WHEN 3 THEN 'Hill, Jr.' ELSE 'Fields' END AS name,
  CASE WHEN c_custkey % 50 = 3 THEN 'rivers_bruno' || CAST(c_custkey AS STRING) WHEN c_custkey % 50 = 8 THEN 'zz.' || CAST(c_custkey AS STRING) WHEN c_custkey % 50 = 13 THEN NULL
  ELSE CASE c_custkey % 7 WHEN 0 THEN 'anna' WHEN 1 THEN 'bruno' WHEN 2 THEN 'carlas' WHEN 3 THEN 'david' WHEN 4 THEN 'x' WHEN 5 THEN 'felix' ELSE 'gret' END
    || '.' || CASE CAST(floor(c_custkey / 7) AS BIGINT) % 5 WHEN 0 THEN 'stone' WHEN 1 THEN 'rivers' WHEN 2 THEN 'woods' WHEN 3 THEN 'hill' ELSE 'fields' END || CAST(c_custkey AS STRING) END || '@example.com' AS email
  FROM {customer}"""


@query(
    "e7_email_name_mismatch",
    with_("m", MAILS)
    + r""", p AS (SELECT id, name, email, list_filter(string_split_regex(trim(regexp_replace(lower(name), '[.,]', ' ', 'g')), '\s+'), lambda w: w <> '') AS np,
      list_filter(string_split_regex(trim(regexp_replace(split_part(lower(trim(email)), '@', 1), '[._-]', ' ', 'g')), '\s+'), lambda w: w <> '') AS ep FROM m WHERE email IS NOT NULL),
    nw AS (SELECT DISTINCT id, unnest(np) AS w FROM p), ew AS (SELECT DISTINCT id, unnest(ep) AS w FROM p),
    fit AS (SELECT DISTINCT a.id AS id, b.id AS other FROM nw a JOIN ew b ON length(a.w) > 2 AND length(b.w) > 2 AND (contains(a.w, b.w) OR contains(b.w, a.w))),
    odd AS (SELECT * FROM p WHERE id NOT IN (SELECT id FROM fit WHERE id = other)),
    c AS (SELECT odd.id, other, row_number() OVER (PARTITION BY odd.id ORDER BY other) AS rn FROM odd JOIN fit ON fit.id = odd.id)
    SELECT odd.id AS key, name, email, string_agg(CAST(other AS VARCHAR), ',' ORDER BY other) AS candidates FROM odd JOIN c ON c.id = odd.id AND rn <= 2 GROUP BY 1, 2, 3""",
)
def e7(t):
    out = d.name_email_mismatch(t.sql(MAILS), "id", "name", "email")
    return out.withColumn("candidates", F.array_join(F.col("candidates").cast("array<string>"), ","))


INJ = injected_sql("payroll", PAYROLL_FAMILIES)


@query("e8_repeated_names", f"{INJ} SELECT agency_name, substr(last_name, 1, 3) AS stem, count(*) AS n FROM inj GROUP BY 1, 2 HAVING count(*) > 1")
def e8(t):
    stems = injected(payroll(t), PAYROLL_FAMILIES).withColumn("stem", F.substring("last_name", 1, 3))
    return d.repeated_names(stems, ["agency_name", "stem"])


@query(
    "e9_near_names",
    f"""{INJ}, g AS (SELECT agency_name, first_name, last_name, count(*) AS n, min(row_id) AS k FROM inj GROUP BY 1, 2, 3)
    SELECT a.agency_name, a.first_name, a.last_name AS name_a, b.last_name AS name_b, a.n AS n_a, b.n AS n_b, a.k AS key_a, b.k AS key_b
    FROM g a JOIN g b ON a.agency_name = b.agency_name AND a.first_name = b.first_name AND a.last_name < b.last_name AND levenshtein(a.last_name, b.last_name) = 1""",
)
def e9(t):
    return d.near_names(injected(payroll(t), PAYROLL_FAMILIES), ["agency_name", "first_name"], "last_name", "row_id")
