"""Exact duplicates, repeat flags, near-duplicate names and email/name mismatches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.operators.order_stats import bounded_join
from plumbline.session import is_small


def exact_duplicates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(rows, duplicates, pct): rows beyond the first of each group of equal rows."""
    cols = list(columns or df.columns)
    groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.sum("_n").alias("rows"),
        (F.sum("_n") - F.count(F.lit(1))).alias("duplicates"),
        F.round((F.sum("_n") - F.count(F.lit(1))) * 100.0 / F.sum("_n"), 2).alias("pct"),
    )


def drop_dups(df: DataFrame, subset: Sequence[str], keep: str, key: str) -> DataFrame:
    """Keep the 'first' or 'last' row by key of each group, or only rows without a copy ('none').

    A min/max of whole rows combines before the shuffle, so a group that holds a third of the
    table costs one row per task.
    """
    subset = list(subset)
    rest = [c for c in df.columns if c not in subset]
    row = F.struct(key, *[c for c in rest if c != key])
    pick = F.max(row) if keep == "last" else F.min(row)
    groups = df.groupBy(*subset).agg(pick.alias("_r"), F.count(F.lit(1)).alias("_n"))
    if keep == "none":
        groups = groups.filter("_n = 1")
    return groups.select(*[F.col(f"_r.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def flag_repeats(df: DataFrame, by: Sequence[str | Column], key: str, name: str = "is_repeat") -> DataFrame:
    """1 for every row after the first (by key) that shares the composite key."""
    parts = [F.col(c) if isinstance(c, str) else c for c in by]
    keyed = df.withColumns({f"_k{i}": c for i, c in enumerate(parts)})
    ks = [f"_k{i}" for i in range(len(parts))]
    if is_small(df, 2.0):
        rn = F.row_number().over(W.partitionBy(*ks).orderBy(key))
        return keyed.withColumn(name, (rn > 1).cast("int")).select(*df.columns, name)
    # only keys that repeat travel to the join
    firsts = keyed.groupBy(*ks).agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    out = bounded_join(keyed, firsts, ks, "left")
    flag = (F.col("_first").isNotNull() & (F.col(key) != F.col("_first"))).cast("int")
    return out.withColumn(name, flag).select(*df.columns, name)


def repeated_names(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., n) for combinations held by more than one row."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def near_names(df: DataFrame, block: Sequence[str], name: str, key: str) -> DataFrame:
    """Pairs of distinct names within a block at edit distance one, with row counts.

    Two strings one edit apart share a string with one character deleted, so an equi-join on
    deletion variants finds every pair without comparing all names of a block. Both sides are dealt
    by key: the size estimate doesn't see the explode, and a broadcast would bring all variants to the driver.
    """
    block = list(block)
    names = (
        df.filter(F.col(name).isNotNull()).groupBy(*block, F.col(name).alias("_name"))
        .agg(F.count(F.lit(1)).alias("_rows"), F.min(key).alias("_key"))
    )
    cut = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("_name"), F.lit(1))),
        lambda i: F.concat(F.substring("_name", F.lit(1), i - 1), F.substring(F.col("_name"), i + 1, F.length("_name"))),
    )
    variants = names.withColumn("variant", F.explode(F.array_distinct(F.concat(F.array(F.col("_name")), cut))))
    side = lambda s: variants.select(
        *block, "variant", F.col("_name").alias(f"name_{s}"), F.col("_rows").alias(f"n_{s}"), F.col("_key").alias(f"key_{s}")
    )
    a, b = side("a"), side("b")
    pairs = a.join(b.hint("merge"), [*block, "variant"]).filter(
        (F.col("name_a") < F.col("name_b")) & (F.levenshtein("name_a", "name_b", 1) == 1)
    )
    return pairs.drop("variant").distinct()


# --- email / name agreement ----------------------------------------------------------------------


def name_parts(c: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(c), "[.,]", " ")), r"\s+")
    return F.filter(words, lambda w: w != "")


def email_parts(c: Column) -> Column:
    local = F.substring_index(F.lower(F.trim(c)), "@", 1)
    words = F.split(F.trim(F.regexp_replace(local, "[._-]", " ")), r"\s+")
    return F.filter(words, lambda w: w != "")


def _long(parts: Column) -> Column:
    return F.filter(parts, lambda w: F.length(w) > 2)


def _grams(c: Column) -> Column:
    return F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3)))
    )


def name_email_mismatch(df: DataFrame, key: str, name: str, email: str, candidates: int = 2) -> DataFrame:
    """Rows whose name shares no part with their email although another row's email fits it.

    Output (key, name, email, candidates): up to ``candidates`` other keys, smallest first. Parts
    are matched as a dictionary (distinct words joined through 3-grams, then verified); each
    email word carries only its smallest keys, which is all the answer can need.
    """
    rows = df.filter((F.trim(name) != "") & (F.trim(email) != "")).select(
        F.col(key).alias("key"), F.col(name).alias("name"), F.col(email).alias("email"),
        name_parts(F.col(name)).alias("np"), email_parts(F.col(email)).alias("ep"),
    )
    fits = F.exists(
        _long(F.col("np")),
        lambda a: F.exists(_long(F.col("ep")), lambda b: F.contains(a, b) | F.contains(b, a)),
    )
    odd = rows.filter((F.size("np") > 0) & (F.size("ep") > 0) & ~fits)
    words = rows.select("key", F.explode(F.array_distinct(_long(F.col("ep")))).alias("ew"))
    # `candidates` + 1 smallest keys per email word: one of them may be the row itself
    few = (
        words.withColumn("_rn", F.row_number().over(W.partitionBy("ew").orderBy("key")))
        .filter(F.col("_rn") <= candidates + 1)
        .groupBy("ew").agg(F.collect_list("key").alias("keys"))
    )
    odd_words = odd.select("key", "name", "email", F.explode(F.array_distinct(_long(F.col("np")))).alias("nw"))
    left = odd_words.select("nw").distinct().withColumn("g", F.explode(_grams(F.col("nw"))))
    right = few.select("ew", "keys").withColumn("g", F.explode(_grams(F.col("ew"))))
    matched = (
        left.join(right, "g").filter(F.contains("nw", F.col("ew")) | F.contains("ew", F.col("nw")))
        .select("nw", "ew", "keys").dropDuplicates(["nw", "ew"])
    )
    # per name word, again only its smallest keys
    smallest = (
        matched.select("nw", F.explode("keys").alias("cand")).distinct()
        .withColumn("_rn", F.row_number().over(W.partitionBy("nw").orderBy("cand")))
        .filter(F.col("_rn") <= candidates + 1)
        .groupBy("nw").agg(F.collect_list("cand").alias("cands"))
    )
    hits = bounded_join(odd_words, smallest, ["nw"])
    return (
        hits.groupBy("key", "name", "email")
        .agg(F.flatten(F.collect_list("cands")).alias("c"))  # bounded by the words of one name
        .select(
            "key", "name", "email",
            F.slice(F.array_sort(F.array_distinct(F.filter("c", lambda x: x != F.col("key")))), 1, candidates).alias("candidates"),
        )
        .filter(F.size("candidates") > 0)
    )
