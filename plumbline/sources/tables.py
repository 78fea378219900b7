"""Readers and writers: delimited, JSON and Parquet files, snapshots and run history."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: file extension -> format; anything else is read as delimited text
FORMATS = {".csv": "csv", ".tsv": "tsv", ".txt": "csv", ".json": "json", ".parquet": "parquet"}


def detect_format(path: str) -> str:
    return FORMATS.get(os.path.splitext(path.rstrip("/"))[1].lower(), "csv")


def load(
    spark: SparkSession, path: str, format: str = "auto", delimiter: str | None = None,
    encoding: str = "UTF-8", has_header: bool = True, schema: T.StructType | str | None = None,
) -> DataFrame:
    """Read a table; without a schema, delimited files are inferred (an extra pass)."""
    fmt = detect_format(path) if format == "auto" else format
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "parquet":
        return reader.parquet(path)
    if fmt == "json":
        return reader.option("encoding", encoding).json(path)
    sep = delimiter or ("\t" if fmt == "tsv" else ",")
    return reader.csv(
        path, sep=sep, header=has_header, encoding=encoding, inferSchema=schema is None, escape='"'
    )


def snapshot(df: DataFrame) -> DataFrame:
    """(position, column, type, n_rows, n_columns) of a table."""
    cols = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("type"))
            for i, (c, t) in enumerate(df.dtypes)
        ]
    )
    return (
        df.agg(F.count(F.lit(1)).alias("n_rows"))
        .select(F.explode(cols).alias("_cell"), "n_rows")
        .select("_cell.*", "n_rows", F.lit(len(df.columns)).alias("n_columns"))
    )


def file_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Total size and number of files below a path; contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.agg(F.sum("length").alias("bytes"), F.count("path").alias("files"))


def read_tolerant(
    spark: SparkSession, path: str, columns: Sequence[str], numeric: Sequence[str] = (),
    keep: Sequence[str] = (), first: int | None = None, order_by: Sequence[str] = (),
    delimiter: str = "\t", has_header: bool = True,
) -> DataFrame:
    """Delimited read that skips malformed lines, coerces numbers and drops failing rows."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).csv(path, sep=delimiter, header=has_header, mode="DROPMALFORMED")
    df = df.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in numeric}) if numeric else df
    for predicate in keep:
        df = df.filter(predicate)
    return df.orderBy(*order_by).limit(first) if first is not None else df


def scan(df: DataFrame, columns: Sequence[str], predicate: str) -> DataFrame:
    """Projection and filter, both pushed to the file scan."""
    return df.filter(predicate).select(*columns)


def normalise_name(name: str) -> str:
    for mark in (" ", "/", "-"):
        name = name.replace(mark, "_")
    return name.replace("(", "").replace(")", "")


def normalise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalise_name(c) for c in df.columns])


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    df.write.mode(mode).parquet(path)
    return path


def write_cleaned_csv(df: DataFrame, folder: str, name: str) -> str:
    """Store the cleaned table itself as ``<name>_cleaned.csv``."""
    path = f"{folder.rstrip('/')}/{name}_cleaned.csv"
    df.write.csv(path, header=True, escape='"')
    return path


def append_history(
    spark: SparkSession, path: str, operations: Sequence[str], original: DataFrame, cleaned: DataFrame,
    improvement: DataFrame,
) -> None:
    """Append one run (operations, row counts, improvement) to the history table."""
    row = (
        original.agg(F.count(F.lit(1)).alias("original_rows"))
        .crossJoin(cleaned.agg(F.count(F.lit(1)).alias("cleaned_rows")))
        .crossJoin(improvement)
        .select(
            F.current_timestamp().alias("timestamp"),
            F.array(*[F.lit(o) for o in operations]).alias("operations"),
            "original_rows", "cleaned_rows",
            (F.col("original_rows") - F.col("cleaned_rows")).alias("removed_rows"),
            F.col("overall").alias("improvement"),
        )
    )
    row.write.mode("append").parquet(path)
