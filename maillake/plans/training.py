"""Queries of the general training-data problems (2, 4 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maillake.operators.instants import with_instant
from maillake.operators.packed import recipient_fields, unpack
from maillake.operators.rejects import check_lines, check_messages, load_lines, split_rejects
from maillake.session import scratch_path
from maillake.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = recipient_fields(table(spark, sf_dir, "emails"), table(spark, sf_dir, "recipients"))
    return unpack(fields).select("message_id", "field", "packed", "pos", "item").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = check_messages(table(spark, sf_dir, "raw_emails"), ["file"])
    lines = check_lines(table(spark, sf_dir, "load_lines"), ["line_id"])
    of = lambda df, tbl, key: df.select(F.lit(tbl).alias("tbl"), F.col(key).cast("string").alias("row_key"), F.explode("reasons").alias("reason"))
    return of(messages, "raw_emails", "file").unionByName(of(lines, "load_lines", "line_id")).distinct()


def p4_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that load: messages, and lines of the mail index with their typed fields."""
    messages, _ = split_rejects(table(spark, sf_dir, "raw_emails").select("file", "message"), "message")
    lines = load_lines(table(spark, sf_dir, "load_lines").select("line_id", "line"))
    none = F.lit(None)
    return messages.select(F.lit("raw_emails").alias("tbl"), F.col("file").alias("row_key"), F.md5("message").alias("digest"), none.cast("string").alias("sent_at"), none.cast("bigint").alias("recipients")).unionByName(
        lines.select(F.lit("load_lines").alias("tbl"), F.col("line_id").cast("string").alias("row_key"), F.md5("line").alias("digest"), F.col("fields")[2].alias("sent_at"), F.col("fields")[4].cast("bigint").alias("recipients"))
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    emails = table(spark, sf_dir, "emails").select("message_id", "sent_at_header", "source_system")
    return with_instant(emails, F.col("sent_at_header"), F.col("source_system")).select("message_id", "utc_micros")


def p5_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p5_found`` of two runs that share a dictionary: mail by whether it is a
    reply first, all other mail after that. The rows are those of ``p5_found``."""
    emails = table(spark, sf_dir, "emails").select("message_id", "sent_at_header", "source_system", F.coalesce("is_reply", F.lit(False)).alias("is_reply"))
    kept = scratch_path(spark, "kept-instants")
    runs = [with_instant(emails.where(part), F.col("sent_at_header"), F.col("source_system"), dictionary=kept) for part in ("is_reply", "NOT is_reply")]
    return runs[0].unionByName(runs[1]).select("message_id", "utc_micros")


QUERIES = {"p2_found": p2_found, "p4_found": p4_found, "p4_loaded": p4_loaded, "p5_found": p5_found, "p5_two_runs": p5_two_runs}
ORACLES: dict[str, str] = {}
