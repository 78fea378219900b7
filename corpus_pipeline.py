"""The corpus pipeline: quality rules, near copies, benchmark decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import jaccard_join, mixing, slots, templates, weak_quality
from plumbline.llm.common import quoted
from plumbline.session import cut_lineage

N_SHARDS = 24


def _same(docs: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.select(*[quoted(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return _same(docs, weak_quality.judge(docs).filter("quality_kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8) stays."""
    return jaccard_join.one_of_each_group(docs, width=5, percent=80, keep_null_ids=False)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go."""
    return templates.decontaminate(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: no, one or two rows."""
    taken = mixing.mix(docs).filter("mix_copies > 0")
    return _same(docs, taken.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and virtual slot."""
    rows, _ = slots.shard(docs, N_SHARDS)
    return rows


STAGES = [("quality", quality), ("near_copies", near_copies), ("benchmark", benchmark), ("mixed", mixed), ("sharded", sharded)]

# expectation maximisation and hash draws have no SQL form here; tests/llm checks the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
