"""Table changes as rewrites: each operation yields the next version of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.order_stats import bounded_join, ranked


def update_where(df: DataFrame, predicate: str, changes: dict[str, str]) -> DataFrame:
    hit = F.coalesce(F.expr(predicate), F.lit(False))
    return df.withColumns({c: F.when(hit, F.expr(e)).otherwise(F.col(c)) for c, e in changes.items()})


def update_matching(df: DataFrame, keys: DataFrame, key: str, changes: dict[str, str]) -> DataFrame:
    """Update rows whose key appears in ``keys`` (a table with that one column)."""
    marks = keys.select(key).distinct().withColumn("_hit", F.lit(True))
    marked = bounded_join(df, marks, [key], "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    return marked.withColumns({c: F.when(F.col("_hit"), F.expr(e)).otherwise(F.col(c)) for c, e in changes.items()}).select(*df.columns)


def delete_where(df: DataFrame, predicate: str) -> DataFrame:
    """Rows for which the predicate is not true (NULL keeps the row)."""
    return df.filter(~F.coalesce(F.expr(predicate), F.lit(False)))


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows)


def insert_ignore(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Insert only rows whose key is new; among new rows with one key the smallest row wins."""
    fresh = rows.join(df.select(key), key, "left_anti")
    rest = [c for c in df.columns if c != key]
    once = fresh.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, "_r.*")
    return df.unionByName(once.select(*df.columns))


def upsert(df: DataFrame, rows: DataFrame, key: str, merge: dict[str, Column]) -> DataFrame:
    """Insert new keys and merge existing ones. ``merge`` gives the new value of a column from
    ``old.<c>`` and ``new.<c>``; other columns take the new value. ``rows`` has unique keys."""
    j = df.alias("old").join(rows.alias("new"), F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    has_old, has_new = F.col(f"old.{key}").isNotNull(), F.col(f"new.{key}").isNotNull()

    def value(c):
        if c == key:
            return F.coalesce(F.col(f"old.{c}"), F.col(f"new.{c}")).alias(c)
        both = merge.get(c, F.col(f"new.{c}"))
        return F.when(has_old & has_new, both).when(has_new, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)

    return j.select(*[value(c) for c in df.columns])


def merge_table(df: DataFrame, rows: DataFrame, key: str, delete_missing: bool = False) -> DataFrame:
    """Update matches, insert the rest; optionally drop rows the source no longer has."""
    out = upsert(df, rows, key, {})
    return out.join(rows.select(key), key, "left_semi") if delete_missing else out


def add_column(df: DataFrame, name: str, value: str = "NULL", kind: str = "string") -> DataFrame:
    return df.withColumn(name, F.expr(value).cast(kind))


def dense_ids(df: DataFrame, order_by: Sequence[str], name: str = "id", start: int = 1) -> DataFrame:
    """Gap-free ids in key order by two-phase offsets, not by one global sort task."""
    return ranked(df, order_by, (), name).withColumn(name, F.col(name) + (start - 1))


def add_uuid(df: DataFrame, name: str = "uuid") -> DataFrame:
    return df.withColumn(name, F.expr("uuid()"))


def as_of(versions: DataFrame, key: str, ts: str, moment: Column, tie: str | None = None) -> DataFrame:
    """The last version of each key at or before ``moment``; combines before the shuffle."""
    rest = [c for c in versions.columns if c not in (key, ts)]
    order = F.struct(ts, tie) if tie else F.struct(ts)
    row = F.struct(ts, *rest)
    return versions.filter(F.col(ts) <= moment).groupBy(key).agg(F.max_by(row, order).alias("_r")).select(key, "_r.*")


def copy_table(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
