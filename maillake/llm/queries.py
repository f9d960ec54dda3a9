"""Queries of the training-data problems of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maillake.llm import authored, copies, digests, encoding, packing, pii, repetition
from maillake.llm.oracles import SQL
from maillake.session import spread
from maillake.sources.tables import table

#: Key of the surrogates in the queries; a deployment brings its own secret.
DEMO_KEY = b"maillake-demo-key"


def p1_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct mention with the surrogate that takes its place, checked over both tables."""
    names = pii.name_model(table(spark, sf_dir, "people"))
    texts = spread(pii.archive_texts(table(spark, sf_dir, "raw_emails"), table(spark, sf_dir, "emails")))
    return pii.with_surrogates(pii.find_entities(texts, names), DEMO_KEY).select("tbl", "row_key", "kind", "found_text", "surrogate").distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mentions that get a surrogate other than what stood there: all of them."""
    return p1_mentions(spark, sf_dir).where("surrogate <> found_text").select("tbl", "row_key", "kind", "found_text").distinct()


def _rewritten(spark: SparkSession, sf_dir: str, key: bytes | None) -> DataFrame:
    names = pii.name_model(table(spark, sf_dir, "people"))
    texts = spread(pii.archive_texts(table(spark, sf_dir, "raw_emails"), table(spark, sf_dir, "emails")))
    return pii.redact(texts, "text", names, key, is_message=F.col("is_message")).select("tbl", "row_key", "redacted")


def p1_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables' texts with placeholders."""
    return _rewritten(spark, sf_dir, None)


def p1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables' texts with surrogates, checked for collisions over both."""
    return _rewritten(spark, sf_dir, DEMO_KEY)


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "reply_pairs")
    found = digests.percentiles(pairs, ["replier"], F.col("response_minutes"), part=F.to_date("reply_sent_at").cast("string"))
    return found.select("replier", "n", *(F.round(c, 4).alias(c) for c in digests.QUANTILES), F.round("rank_error", 6).alias("rank_error"), "certified")


def p3_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of single days, to be combined by ``digests.merge``."""
    days = table(spark, sf_dir, "reply_pairs").withColumn("day", F.to_date("reply_sent_at"))
    return digests.digest(days, ["replier", "day"], F.col("response_minutes"))


def p3_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All repliers and whole years: groups with more values than a digest has
    centroids, from digests of single days; whether each estimate is certified
    by the counting pass (rank error up to 0.005)."""
    pairs = table(spark, sf_dir, "reply_pairs").select("response_minutes", F.to_date("reply_sent_at").cast("string").alias("day"))
    both = pairs.select("*", F.explode(F.array(F.lit("all"), F.coalesce(F.substring("day", 1, 4), F.lit("unknown")))).alias("period"))
    return digests.percentiles(both, ["period"], F.col("response_minutes"), part=F.col("day")).select("period", "n", "certified")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = pii.name_model(table(spark, sf_dir, "people"))
    mails = spread(authored.archive_mails(table(spark, sf_dir, "raw_emails"), table(spark, sf_dir, "emails")))
    return authored.not_own_lines(mails, names).select("tbl", "row_key", "line_no")


def p7_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newly written text of every mail of both tables."""
    names = pii.name_model(table(spark, sf_dir, "people"))
    mails = spread(authored.archive_mails(table(spark, sf_dir, "raw_emails"), table(spark, sf_dir, "emails")))
    return authored.own_texts(mails, names)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    emails = table(spark, sf_dir, "emails")
    grouped = copies.group_copies(emails, "message_id", copies.canonical_mail(emails))
    return grouped.where(F.col("message_id") != F.col("first_id")).select("first_id", F.col("message_id").alias("copy_id"))


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record each with its number of copies."""
    emails = table(spark, sf_dir, "emails")
    grouped = copies.group_copies(emails, "message_id", copies.canonical_mail(emails))
    return grouped.where(F.col("message_id") == F.col("first_id")).select("message_id", "copies")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text").select("doc_id", "ids")


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact round trip: the texts back from their ids (null and empty as empty)."""
    return encoding.decode(p8_ids(spark, sf_dir)).select("doc_id", "decoded")


def p9_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = p8_ids(spark, sf_dir).select("doc_id", F.size("ids").alias("tokens"))
    return packing.pack(sizes, "doc_id", "tokens")


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p9_bins(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetitive(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {
    "p3_percentiles": p3_percentiles, "p3_daily": p3_daily, "p3_overall": p3_overall,
    "p8_ids": p8_ids, "p8_decoded": p8_decoded, "p9_bins": p9_bins, "p9_fill": p9_fill,
    "p7_found": p7_found, "p7_text": p7_text, "p6_found": p6_found, "p6_records": p6_records, "p10_found": p10_found, "p10_shares": p10_shares,
    "p1_found": p1_found, "p1_mentions": p1_mentions, "p1_placeholders": p1_placeholders, "p1_surrogates": p1_surrogates,
}
ORACLES = SQL
