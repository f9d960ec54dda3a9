from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from maillake.functions.instants import parse_instant
from maillake.operators.instants import extend_dictionary, with_instant


def utc(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp() * 1_000_000)


@pytest.mark.parametrize(
    "text, want",
    [
        ("Thu, 25 Jun 1998 21:28:11 -0700 (PDT)", utc(1998, 6, 26, 4, 28, 11)),
        ("31 Jan 2001 03:42 -0600", utc(2001, 1, 31, 9, 42)),
        ("1999-07-24T08:55:32.864", utc(1999, 7, 24, 13, 55, 32, 864000)),
        ("20010713193425", utc(2001, 7, 14, 0, 34, 25)),
        ("24-AUG-2000 18:07", utc(2000, 8, 24, 23, 7)),
        ("26.11.1998 14:20", utc(1998, 11, 26, 20, 20)),
        ("19980219T185003Z", utc(1998, 2, 19, 18, 50, 3)),
        ("2000-04-13 07:00:47.756663+00:00", utc(2000, 4, 13, 7, 0, 47, 756663)),
        ("01/16/1999 02:31 PM", utc(1999, 1, 16, 20, 31)),
        ("08/10/1999 12:50 AM PDT", utc(1999, 8, 10, 7, 50)),
        ("891782404923", 891782404923 * 1000),
        ("982019977", 982019977 * 1_000_000),
        ("2001-11-08 19:20:24 America/Los_Angeles", utc(2001, 11, 9, 3, 20, 24)),
        ("Mon, 18 nov 2002 23:02:08 +0530", utc(2002, 11, 18, 17, 32, 8)),
        ("Monday, April 23, 2001 2:56 PM", utc(2001, 4, 23, 19, 56)),
        ("  30 MAR 1999 17:43:25 UT ", utc(1999, 3, 30, 17, 43, 25)),
        ("2/15/02 2:11:07 PM", utc(2002, 2, 15, 20, 11, 7)),
        ("Fri May 31 16:02:18 PDT 2002", utc(2002, 5, 31, 23, 2, 18)),
        ("15 Oct 1999 01:27:46 BST", utc(1999, 10, 15, 0, 27, 46)),
        # the clock shows it twice: the earlier instant; it skips it: the offset before
        ("Sun, 28 Oct 2001 01:30:00", utc(2001, 10, 28, 6, 30)),
        ("Sun, 1 Apr 2001 02:30:00", utc(2001, 4, 1, 8, 30)),
        ("Sun Oct 28 01:30:00 CST 2001", utc(2001, 10, 28, 7, 30)),
        ("2001-10-28 01:30:00 Europe/Berlin", utc(2001, 10, 27, 23, 30)),
    ],
)
def test_every_notation(text, want):
    assert parse_instant(text)[0] == want


@pytest.mark.parametrize(
    "text",
    [None, "", "   ", "sometime", "31 Feb 2001 10:00:00 -0600", "Thu, 31 Sep 2001 19:11:00 -0800", "22 Jun 1999 19:78:00 +0000", "Fri, 28 Foo 2002 00:39:00 -0600", "May 1999", "00/00/0000 00:00", "x" * 100_000, "13/13/2001 10:00", "1 Jan 2001 10:00 XYZ", "2001-01-01 10:00:00 No/Where"],
)
def test_unreadable(text):
    assert parse_instant(text) == (None, None)


def test_rows_keep_their_columns_and_repeats(spark, tmp_path):
    rows = [(1, "31 Jan 2001 03:42 -0600", "a"), (1, "31 Jan 2001 03:42 -0600", "a"), (2, None, "b"), (3, "", "c"), (4, "nonsense", None)]
    df = spark.createDataFrame(rows, "text int, t string, utc_micros string")
    out = with_instant(df, F.col("t"), dictionary=str(tmp_path / "dict"))
    assert out.columns == ["text", "t", "utc_micros"]
    got = sorted((r["text"], r["utc_micros"]) for r in out.collect() if r["utc_micros"] is not None)
    assert got == [(1, utc(2001, 1, 31, 9, 42))] * 2 and out.count() == 5


def test_dictionary_is_extended(spark, tmp_path):
    path = str(tmp_path / "dict")
    of = lambda *ts: spark.createDataFrame([(t,) for t in ts], "t string")
    with_instant(of("982019977"), F.col("t"), dictionary=path).collect()
    out = with_instant(of("982019977", "24-AUG-2000 18:07"), F.col("t"), dictionary=path)
    assert {r["t"]: r["utc_micros"] for r in out.collect()} == {"982019977": 982019977000000, "24-AUG-2000 18:07": utc(2000, 8, 24, 23, 7)}
    kept = spark.read.parquet(path)
    assert sorted(r["text"] for r in kept.collect()) == ["24-AUG-2000 18:07", "982019977"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "t string")
    assert with_instant(df, F.col("t")).count() == 0


@pytest.mark.parametrize("text", ["31 Jan 2001" + " " * 300 + "03:42 -0600", "31 Jan 2001 03:42 -0600 (" + "so it says; " * 50 + "(nested) \\) )", "(" + "x" * 300 + ") 31 Jan 2001 03:42" + "\t" * 300 + "-0600 (CST)", " " * 300 + "31 Jan 2001 03:42 (CST)"])
def test_padded_and_commented(text):
    assert parse_instant(text)[0] == utc(2001, 1, 31, 9, 42)


def test_counts_are_those_of_this_run(spark, tmp_path):
    path = str(tmp_path / "dict")
    of = lambda *ts: spark.createDataFrame([(t, "", "UTC") for t in ts], "text string, source string, zone string")
    assert {r["text"]: r["n"] for r in extend_dictionary(of("982019977", "x"), path).collect()} == {"982019977": 1, "x": 1}
    again = extend_dictionary(of(*["982019977"] * 5000, "y"), path).collect()
    assert {r["text"]: r["n"] for r in again} == {"982019977": 5000, "y": 1}
    assert spark.read.parquet(path).count() == 3


def test_two_runs_give_the_rows_of_one(spark):
    from maillake.plans import training

    of = lambda q: sorted((r[0], r[1] or 0) for r in q(spark, "/root/testdata/sf0.001").collect())
    assert of(training.p5_two_runs) == of(training.p5_found)
