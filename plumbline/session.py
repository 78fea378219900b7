"""Session helpers: plan-size checks, lineage cuts and shared scratch folders."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SMALL_BYTES_CONF = "spark.plumbline.smallBytes"
DEFAULT_SMALL_BYTES = 128 * 1024 * 1024


def local_session(cpus: str = "8", partitions: str = "8", memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("plumbline")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate for a plan; runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_small(df: DataFrame, growth: float = 1.0) -> bool:
    """True when the plan fits one task comfortably.

    ``growth`` covers operators whose fan-out the estimate does not see (explode, pandas maps).
    """
    limit = int(df.sparkSession.conf.get(SMALL_BYTES_CONF, str(DEFAULT_SMALL_BYTES)))
    return plan_bytes(df) <= int(limit / growth)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for CPU-heavy work on a small input, which may be a single file split."""
    return df.repartition(shuffle_width(df.sparkSession)) if is_small(df) else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is set (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="plumbline-ckpt-")  # one process: tests and benchmarks
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def freeze(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: keeps the partitions and their row order, survives executor loss."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Stage output: a Parquet table in the shared folder. Unlike a checkpoint it gives later plans
    its true size, column pruning and pushed filters."""
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/plumbline-{name}-{uuid.uuid4().hex}"
