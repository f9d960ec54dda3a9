"""Bronze as a stream: new mailbox files are parsed and checked as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from maillake.operators.mail import parse_messages, with_reason

RAW_SCHEMA = "file string, message string, source_path string, ingested_at timestamp"


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of raw messages in ``path``, each read once."""
    return spark.readStream.schema(RAW_SCHEMA).parquet(path)


def write_checked(raw: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Parsed messages with ``reason`` appended to ``target``; both paths are on
    shared storage, so a restart goes on where the last run ended."""
    checked = with_reason(parse_messages(raw))
    return checked.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
