"""Records that are the same but for formatting: one record each and its number of copies.

Every record gets a canonical hash. Hashes go to shards, one task each, by which
every equal pair meets in one shard; a shard keeps two Bloom filters of its own
range, of hashes seen once and seen repeatedly, whose size doesn't depend on
the corpus. The second one holds every hash that occurs twice (it may hold
others, never lacks one). Records that it doesn't hold are single and done; only
possible repeats are shuffled for exact grouping. Nothing is broadcast and
nothing goes through the driver. A record that a batch holds twice is a known
repeat: its hash is sent to the shards once and its rows aren't, so a record
that a third of all rows have is no task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from maillake.operators.lookup import lookup
from maillake.session import materialise

#: Records that a shard has on average, bits of its filters for each, and places that a record sets.
SHARD_RECORDS, BITS_PER_RECORD, PLACES = 1 << 20, 16, 3


def plain(c: Column) -> Column:
    """Letters and digits of a text in lower case; null as empty."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def canonical_mail(df: DataFrame) -> Column:
    """128-bit canonical form of a mail: sender, subject, recipients in any order, text.

    Case and all but letters and digits don't count; null counts as empty. The
    fields are kept apart by a character that none of them holds.
    """
    unordered = lambda c: F.array_join(F.array_sort(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), plain), lambda x: x != "")), "\x1f")
    text = F.concat_ws("\x1e", plain(F.col("sender")), plain(F.col("subject")), unordered(F.col("to_addresses")), unordered(F.col("cc_addresses")), plain(F.col("body_clean")))
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PLACES bit positions of each 64-bit hash (bits is a power of two)."""
    h = hashes.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PLACES)])


def _set(filter_: np.ndarray, at: np.ndarray) -> None:
    at = np.unique(at.ravel())
    np.bitwise_or.at(filter_, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))


def _get(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (filter_[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _find_repeats_in_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows plus ``twice``: the batch holds another one with this hash."""
    for b in batches:
        values, inverse, counts = np.unique(b.column("h").to_numpy(), return_inverse=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(counts[inverse] > 1, pa.bool_())], [*b.schema.names, "twice"])


def _judge_shard(bits: int):
    """Of a shard's rows ``maybe``: whether the filter of repeated hashes holds
    theirs. The shard is read once into the filters, then judged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        held = []
        for b in batches:
            h, known = b.column("h").to_numpy(), b.column("known").to_numpy(zero_copy_only=False)
            at = places(h, bits)
            # Equal hashes of a batch are found exactly, against what came before by the filter.
            _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
            _set(again, at[:, known | (counts[inverse] > 1) | _get(once, at).all(axis=0)])
            _set(once, at)
            held.append(b.filter(pa.array(~known)))
        for b in held:
            maybe = _get(again, places(b.column("h").to_numpy(), bits)).all(axis=0)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("canon"), pa.array(maybe, pa.bool_())], ["key", "canon", "maybe"])

    return run


def mark_repeats(rows: DataFrame, shards: int, bits: int = SHARD_RECORDS * BITS_PER_RECORD) -> DataFrame:
    """key, canon, maybe of ``rows`` (key, canon, h, twice): whether a row's hash may occur again."""
    of_key, of_canon = (f.simpleString() for f in (rows.schema["key"].dataType, rows.schema["canon"].dataType))
    alone = rows.where("NOT twice").select("key", "canon", "h", F.lit(False).alias("known"))
    # One row for each hash of known repeats, whatever the number of its rows: an aggregate with partial results.
    known = rows.where("twice").select("h").distinct().select(F.lit(None).cast(of_key).alias("key"), F.lit(None).cast(of_canon).alias("canon"), "h", F.lit(True).alias("known"))
    judged = alone.unionByName(known).repartition(shards, "h").mapInArrow(_judge_shard(bits), f"key {of_key}, canon {of_canon}, maybe boolean")
    return judged.unionByName(rows.where("twice").select("key", "canon", F.lit(True).alias("maybe")))


def group_copies(df: DataFrame, key: str, canon: Column, shard_records: int = SHARD_RECORDS) -> DataFrame:
    """``key``, ``first_id`` (smallest key of the record's copies, byte order) and ``copies``.

    One row per row of ``df``; a key that comes twice is a copy of itself and
    counts. Null keys are kept and never the smallest unless all are null.
    Null ``canon`` is a value like any other. The result is exact: the filters
    only choose which rows are shuffled for grouping.
    """
    spark = df.sparkSession
    # In a struct, so null is a value too.
    rows = df.select(F.col(key).alias("key"), F.struct(canon.alias("value")).alias("canon")).withColumn("h", F.xxhash64("canon"))
    rows = materialise(spark, rows.mapInArrow(_find_repeats_in_batch, StructType([*rows.schema.fields, StructField("twice", BooleanType())])), "canonical")
    # As many shards as the records need at so many each, and no fewer than other shuffles have.
    shards = max(-(-rows.count() // shard_records), int(spark.conf.get("spark.sql.shuffle.partitions")))
    marked = materialise(spark, mark_repeats(rows, shards), "marked")
    single = marked.where("NOT maybe").select("key", F.col("key").alias("first_id"), F.lit(1).cast("bigint").alias("copies"))
    candidates = marked.where("maybe")
    # A group may hold a third of all rows: it is only aggregated, by partial sums, and looked up again.
    groups = candidates.groupBy("canon").agg(F.min("key").alias("first_id"), F.count("*").alias("copies"), F.count("*").alias("n"))
    repeated = lookup(candidates, groups, ["canon"]).select("key", "first_id", "copies")
    return single.unionByName(repeated).select(F.col("key").alias(key), "first_id", "copies")
