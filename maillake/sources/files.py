"""File sources, table sinks and the offline sampler."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_mail_csv(spark: SparkSession, path: str, now: str | None = None) -> DataFrame:
    """A CSV of messages (header; quotes, commas and line ends inside quoted
    fields) with the lineage columns source_path and ingested_at."""
    loaded = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    frame = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return frame.withColumn("source_path", F.col("_metadata.file_path")).withColumn("ingested_at", loaded)


def save_table(df: DataFrame, name: str, append: bool = False) -> None:
    """Overwrite (or extend) a catalog table; schemas may change between runs."""
    df.write.mode("append" if append else "overwrite").option("overwriteSchema", "true").saveAsTable(name)


def require_rows(df: DataFrame, expected: int) -> int:
    """Number of rows; anything but ``expected`` raises."""
    n = df.count()
    if n != expected:
        raise ValueError(f"expected {expected} rows, found {n}")
    return n


def null_audit(df: DataFrame) -> DataFrame:
    """column_name, nulls: one row per column, counted in one pass."""
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return counts.unpivot([], df.columns, "column_name", "nulls")


def sample_rows(df: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """``size`` rows, each as likely as any other and always the same for a seed:
    those whose keyed hash is least. Tasks keep their own least rows, so nothing
    else is shuffled; equal rows are told apart by chance only in the input's order."""
    place = F.xxhash64(F.lit(seed), *(F.col(c).cast("string") for c in df.columns))
    return df.orderBy(place).limit(size)


def sample_csv(spark: SparkSession, source: str, target: str, size: int = 2000, seed: int = 42) -> int:
    """Sample a CSV file whose fields may be very long into one CSV file, all fields quoted; how many rows it has."""
    kept = sample_rows(spark.read.csv(source, header=True, multiLine=True, escape='"', maxCharsPerColumn=-1), size, seed).toPandas()
    kept.to_csv(target, index=False, quoting=csv.QUOTE_ALL)
    return len(kept)
