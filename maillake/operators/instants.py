"""Mixed timestamp notations to one instant, through a dictionary of distinct strings.

Each distinct (text, source, zone) is parsed once by the exhaustive parser and
kept in a Parquet dictionary that later runs extend; rows get their instant by
a join. Strings that hold a large share of the rows are joined by broadcast
instead of through the shuffle, so no task gets all rows of one string.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maillake.functions.instants import DEFAULT_ZONE, parse_instant
from maillake.operators.lookup import lookup
from maillake.session import materialise, scratch_path

DICTIONARY_SCHEMA = "text string, source string, zone string, utc_micros bigint, written_year int, n bigint"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, zones = b.column("text").to_pylist(), b.column("zone").to_pylist()
        got = [parse_instant(t, z) for t, z in zip(texts, zones)]
        yield pa.RecordBatch.from_arrays(
            [
                *(b.column(c).cast(pa.string()) for c in ("text", "source", "zone")),
                pa.array([m for m, _ in got], pa.int64()),
                pa.array([y for _, y in got], pa.int32()),
                b.column("n").cast(pa.int64()),
            ],
            ["text", "source", "zone", "utc_micros", "written_year", "n"],
        )


def _read_dictionary(spark: SparkSession, path: str) -> DataFrame | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(DICTIONARY_SCHEMA).parquet(path) if there else None


def extend_dictionary(keys: DataFrame, path: str) -> DataFrame:
    """Parse the strings of ``keys`` (text, source, zone; the last two not null)
    that the dictionary in ``path`` lacks, append them to it, and return its
    entries for these keys with ``n``: how many of these keys have it. Counts of
    earlier runs don't matter: a string that was rare may be hot now."""
    spark = keys.sparkSession
    on = ["text", "source", "zone"]
    seen = keys.where(F.col("text").isNotNull()).groupBy(*on).agg(F.count("*").alias("n"))
    known = _read_dictionary(spark, path)
    if known is None:
        seen.mapInArrow(_parse, DICTIONARY_SCHEMA).write.mode("append").parquet(path)
        return spark.read.schema(DICTIONARY_SCHEMA).parquet(path)
    seen = materialise(spark, seen, "seen")
    seen.join(known.select(*on), on, "left_anti").mapInArrow(_parse, DICTIONARY_SCHEMA).write.mode("append").parquet(path)
    # A kept dictionary may hold an entry twice if two runs extended it at the same time.
    entries = spark.read.schema(DICTIONARY_SCHEMA).parquet(path).groupBy(*on).agg(F.first("utc_micros").alias("utc_micros"))
    return seen.join(entries, on).select(*on, "utc_micros", "n")


def with_instant(
    df: DataFrame,
    text: Column,
    source: Column | None = None,
    zone: Column | None = None,
    dictionary: str | None = None,
    out: str = "utc_micros",
) -> DataFrame:
    """``df`` plus ``out``: the instant that ``text`` states, in microseconds since 1970 UTC.

    Null, empty or unreadable text gives null; rows, repeats and
    other columns stay as they are (columns of the join are named ``_mk_*`` and
    dropped, so clashing names of ``df`` don't matter). ``zone`` is the zone of
    texts that name none (default America/Chicago); a text that names an
    unknown zone gives null. ``dictionary`` is the path of the dictionary that
    is extended and used; without it a new one is written to the shared folder.
    """
    spark = df.sparkSession
    path = dictionary or scratch_path(spark, "instants")
    source = F.lit(None).cast("string") if source is None else source.cast("string")
    zone = F.lit(DEFAULT_ZONE) if zone is None else F.coalesce(zone.cast("string"), F.lit(DEFAULT_ZONE))
    keyed = df.withColumns({"_mk_text": text.cast("string"), "_mk_source": F.coalesce(source, F.lit("")), "_mk_zone": zone})
    keys = keyed.select(F.col("_mk_text").alias("text"), F.col("_mk_source").alias("source"), F.col("_mk_zone").alias("zone"))
    entries = extend_dictionary(keys, path)
    named = entries.select(*(F.col(c).alias(f"_mk_{c}") for c in ("text", "source", "zone")), F.col("utc_micros").alias("_mk_micros"), "n")
    keep = [c for c in df.columns if c != out]
    found = lookup(keyed, named, ["_mk_text", "_mk_source", "_mk_zone"])
    return found.select(*keep, F.col("_mk_micros").alias(out))
