"""Registry of runnable queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Lazy readers of the provided parquet tables, plus SQL over them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def sql(self, text: str) -> DataFrame:
        """Run SQL text whose tables are written as ``{orders}``."""
        used = {t: getattr(self, t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used)


def duck(text: str) -> str:
    """The same text with plain table names, for the SQL twin."""
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with an optional SQL twin."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, root: fn(Tables(spark, root))
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap
