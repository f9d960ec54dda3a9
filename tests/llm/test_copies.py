import numpy as np
import pytest
from pyspark.sql import functions as F

from maillake.llm import copies as C

SCHEMA = "message_id string, sender string, subject string, to_addresses array<string>, cc_addresses array<string>, body_clean string"


def slow(df, key, canon):
    groups = {}
    for r in df.select(key, canon.alias("c")).collect():
        groups.setdefault(r["c"], []).append(r[0])
    return sorted((k, min(ids), len(ids)) for ids in groups.values() for k in ids)


def test_formatting_does_not_count(spark):
    rows = [
        ("b", "A@x.example", "Re: Deal", ["p@x", "Q@x"], None, "Hello,\n World 1"),
        ("a", "a@x.example", "RE:  deal!", ["q@x", "P@X"], [], "hello world-1"),
        ("c", "a@x.example", "Re: Deal", ["p@x"], [], "Hello World 1"),
        ("d", "a@x.example", "Re: Deal", ["p@x", "q@x"], [], "Hello World 2"),
        ("e", None, None, None, None, None),
        ("f", "", " - ", [], [""], "..."),
        ("g", "a@x.example", "Über", [], [], "x" * 200_000),
        ("h", "a@x.example", "ÜBER", [], [], "X " * 200_000),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["message_id"]: (r["first_id"], r["copies"]) for r in C.group_copies(df, "message_id", C.canonical_mail(df)).collect()}
    assert got == {"a": ("a", 2), "b": ("a", 2), "c": ("c", 1), "d": ("d", 1), "e": ("e", 2), "f": ("e", 2), "g": ("g", 2), "h": ("g", 2)}


@pytest.mark.parametrize("shard", [C.SHARD_RECORDS, 100])
def test_like_exact_groups(spark, shard):
    # A third of all rows are copies of one record; the rest repeats now and then.
    df = spark.range(6000).select(F.format_string("m%05d", F.col("id")).alias("message_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.pmod(F.hash("id"), F.lit(9000)).cast("string")).alias("t"), F.lit(1).alias("copies")).repartition(9)
    got = sorted(tuple(r) for r in C.group_copies(df, "message_id", F.col("t"), shard).collect())
    assert got == slow(df, "message_id", F.col("t"))


def test_filter_lacks_no_repeat_in_many_shards(spark):
    rng = np.random.default_rng(1)
    once, again = (set(map(int, rng.integers(-(2**62), 2**62, n))) for n in (20_000, 500))
    hashes = [*once, *again, *again]
    rows = spark.createDataFrame([(str(k), str(h), h, False) for k, h in enumerate(hashes)], "key string, canon string, h bigint, twice boolean").repartition(70)
    judged = C.mark_repeats(rows, 40, 1 << 14).collect()
    assert len(judged) == len(hashes)
    assert all(r["maybe"] for r in judged if int(r["canon"]) in again)
    assert np.mean([r["maybe"] for r in judged if int(r["canon"]) in once]) < 0.02


def test_null_records_and_keys(spark):
    df = spark.createDataFrame([("b", None), ("a", None), (None, "x"), (None, "x"), ("c", "y")], "message_id string, t string")
    got = sorted((str(r[0]), str(r[1]), r[2]) for r in C.group_copies(df, "message_id", F.col("t"), 1).collect())
    assert got == [("None", "None", 2), ("None", "None", 2), ("a", "a", 2), ("b", "a", 2), ("c", "c", 1)]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert C.group_copies(df, "message_id", C.canonical_mail(df)).count() == 0
