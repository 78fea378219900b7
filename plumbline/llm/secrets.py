"""Secret scan with corpus-wide ownership frequency.

Base kinds are always reported. High-recall patterns add candidates; each candidate's hash is counted over the corpus by
distinct repositories and owners. A value that many owners hold is a widely copied example; a value of one or few owners
that looks random is a live-looking credential and adds its span. Counting goes by distinct (value, owner, repository), combined
before the shuffle, so a value that a third of all documents hold costs one row a task. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SPAN, found_spans, hidden, need, placed, quoted, ranked_spans, span_text, whole_text
from plumbline.session import cut_lineage

# fixed values: the base kinds, in order, with what their value must fulfil
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # runs of 32 and more are the same matches as all runs with the short ones dropped
BASE = ("assign", "access", "hex")
# a key block runs to its END line; where that is missing, over the lines of key characters and a shorter last one (line ends may be escaped)
KEY_BEGIN, KEY_END = (rf"-----{edge} [A-Z ]{{0,30}}PRIVATE KEY(?: BLOCK)?-----" for edge in ("BEGIN", "END"))
KEY_LINES = r"(?:(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{16,}+)++(?:(?:\s|\\[nr])++(?=[A-Za-z]*[0-9+/=])[A-Za-z0-9+/=]++)?)?"
# candidate generators: prefixes that issuers give their keys, signed tokens, key blocks, and long mixed words
EXTRA = {
    "issuer": r"(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[rs]k_live_[A-Za-z0-9]{10,}|AIza[A-Za-z0-9_-]{30,}|glpat-[A-Za-z0-9_-]{16,})",
    "signed": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "block": KEY_BEGIN + r"(?:(?:[^-]|-(?!----))*+" + KEY_END + "|" + KEY_LINES + ")",
    "opaque": r"(?<![A-Za-z0-9+/_=-])(?!gh[pousr]_|xox[abprs]-|[rs]k_live_|AIza|glpat-|eyJ)(?=[A-Za-z+/_=-]*[0-9])(?=[A-Z0-9+/_=-]*[a-z])(?=[a-z0-9+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{20,}",
}
MOST_OWNERS, MOST_REPOSITORIES = 2, 3
#: Least share of distinct characters in a value that looks random.
VARIETY = 0.3


def _base_scan(docs: DataFrame, text: str, into: str) -> DataFrame:
    """Add the sorted array of base spans of a text column."""
    steps = hidden(docs, "f_assign", "f_access", "f_hex", "p_assign", "p_access", "p_hex")
    out = docs
    for name, pattern in zip(steps[:3], (ASSIGN, ACCESS, HEX)):
        out = out.withColumn(name, found_spans(F.col(text), pattern))
    for name, found in zip(steps[3:], steps[:3]):
        out = out.withColumn(name, placed(F.col(found)))
    tests = (
        lambda v: F.length(F.regexp_extract(v, ASSIGN, 1)) >= 8,
        lambda v: F.length(v) >= 16,
        lambda v: F.length(v) >= 32,
    )
    arrays = [ranked_spans(F.col(p), kind, k, test) for k, (p, kind, test) in enumerate(zip(steps[3:], BASE, tests))]
    return out.withColumn(into, F.sort_array(F.concat(*arrays))).drop(*steps)


def _candidates(docs: DataFrame, text: str, into: str) -> DataFrame:
    steps = hidden(docs, *[f"x_{k}" for k in EXTRA])
    out = docs
    for name, pattern in zip(steps, EXTRA.values()):
        out = out.withColumn(name, found_spans(F.col(text), pattern))
    for name in steps:
        out = out.withColumn(name, placed(F.col(name)))
    arrays = [ranked_spans(F.col(n), kind, len(BASE) + k, lambda v: F.length(v) > 0) for k, (n, kind) in enumerate(zip(steps, EXTRA))]
    return out.withColumn(into, F.sort_array(F.concat(*arrays))).drop(*steps)


def _secret_value(kind: Column, value: Column) -> Column:
    """The secret itself: of an assignment, its right side; of a key block, its characters without edges and line ends."""
    body = F.regexp_replace(value, rf"{KEY_BEGIN}|{KEY_END}|\\[nr]|[^A-Za-z0-9+/=]", "")
    return F.when(kind == BASE[0], F.regexp_extract(value, ASSIGN, 1)).when(kind == "block", body).otherwise(value)


def looks_random(value: Column) -> Column:
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return distinct >= F.greatest(F.lit(6.0), F.length(value) * F.lit(VARIETY) * F.least(F.lit(1.0), F.lit(40.0) / F.greatest(F.length(value), F.lit(1))))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None,
    most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES, prefix: str = "secret_",
) -> DataFrame:
    """All rows with ``secret_base`` and ``secret_spans`` (arrays of start, rank, kind, end, value, places in code points) and
    ``secret_owned`` (array of span starts that belong to owner-specific, random-looking values).

    ``repo_col`` defaults to the owner's column. Added spans that overlap a base span are left out; mixed words inside a key block
    belong to the block, and a header without key characters is no secret. A null text is an empty
    one; null owners count as one owner; repeated rows get the same spans, and a repeated row raises no owner count. Rows
    with the same id and different texts are told apart by the text's hash. Columns of the input stay, and a prefix that
    clashes is an error. Empty tables give empty results.
    """
    need(docs, id_col, text_col, owner_col, *([repo_col] if repo_col else []))
    names = {n: prefix + n for n in ("base", "spans", "owned")}
    if {n.lower() for n in names.values()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"prefix {prefix!r} clashes with a column of the table")
    text, base, extra, key = hidden(docs, "t_", "b_", "e_", "k_")
    scanned = _candidates(_base_scan(docs.withColumn(text, whole_text(text_col)), text, base), text, extra)
    scanned = scanned.withColumn(key, F.xxhash64(quoted(id_col), F.col(text))).drop(text)

    # spans of the documents that have any: one narrow row a span
    owner = quoted(owner_col).cast("string")
    repo = quoted(repo_col).cast("string") if repo_col else owner
    span_rows = scanned.filter((F.size(base) > 0) | (F.size(extra) > 0)).select(
        F.col(key).alias("key"), F.coalesce(owner, F.lit("")).alias("owner"), F.coalesce(repo, F.lit("")).alias("repo"),
        F.explode(F.concat(F.col(base), F.col(extra))).alias("s"), F.col(base).alias("base"),
        F.filter(extra, lambda x: x["kind"] == "block").alias("block"),
    )
    free = F.filter("block", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    inside = (F.col("s.kind") == "opaque") & F.exists(free, lambda x: (x["start"] <= F.col("s.start")) & (F.col("s.end") <= x["end"]))
    span_rows = span_rows.filter((F.size("block") == 0) | ~inside)
    clash = F.exists("base", lambda b: (b["start"] < F.col("s.end")) & (F.col("s.start") < b["end"]))
    secret = _secret_value(F.col("s.kind"), F.col("s.value"))
    span_rows = cut_lineage(
        span_rows.select(
            "key", "owner", "repo", F.struct("s.start", "s.rank", "s.kind", "s.end", "s.value").alias("s"),
            F.sha2(secret, 256).alias("hash"), looks_random(secret).alias("random"), ((F.col("s.rank") >= len(BASE)) & ~clash).alias("adds"),
        )
    )
    holders = span_rows.select("hash", "owner", "repo").distinct()
    held = holders.groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos"))
    rare = held.filter((F.col("owners") <= most_owners) & (F.col("repos") <= most_repositories)).select("hash")
    owned = span_rows.filter("random").join(rare, "hash").groupBy("key").agg(
        F.sort_array(F.collect_set(F.when(F.col("adds"), F.col("s")))).alias("added"), F.sort_array(F.collect_set("s.start")).alias("starts")
    )
    (other,) = hidden(scanned, "o_key")
    joined = scanned.join(owned.withColumnRenamed("key", other), F.col(key) == F.col(other), "left")
    none = F.array().cast(f"array<{SPAN}>")
    return joined.select(
        *[quoted(c) for c in docs.columns], F.col(base).alias(names["base"]),
        F.sort_array(F.concat(F.col(base), F.coalesce(F.col("added"), none))).alias(names["spans"]),
        F.coalesce(F.col("starts"), F.array().cast("array<bigint>")).alias(names["owned"]),
    )


def digest(found: DataFrame, prefix: str, kinds: tuple[str, ...]) -> list[Column]:
    """Counts of base kinds, the hash of the base spans and all spans as text."""
    base = F.col(prefix + "base")

    def of(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return [*[of(k) for k in kinds], F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col(prefix + "spans")).alias("spans")]
