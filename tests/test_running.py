from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maillake.operators.running import earlier_rows, last_seen, running_sum


def rows(spark):
    t0 = datetime(2001, 1, 1)
    data = [(k % 3 if k % 7 else None, None if k % 11 == 0 else t0 + timedelta(minutes=13 * (k % 50)), k, k % 4, f"v{k}" if k % 5 == 0 else None) for k in range(400)]
    return spark.createDataFrame(data, "g int, t timestamp, id int, x int, v string")


def order():
    return [F.asc_nulls_first("t"), F.col("id")]


def test_sums_and_counts_like_a_window(spark):
    df = rows(spark)
    w = Window.partitionBy("g").orderBy(*order()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = {r["id"]: (r["s"], r["n"]) for r in df.withColumns({"s": F.sum("x").over(w), "n": F.count(F.lit(1)).over(w) - 1}).collect()}
    got = earlier_rows(running_sum(df, [F.col("g")], "t", order(), F.col("x"), "s"), [F.col("g")], "t", order(), "n")
    assert {r["id"]: (r["s"], r["n"]) for r in got.collect()} == want


def test_last_value_like_a_window(spark):
    df = rows(spark).where("t IS NOT NULL")
    w = Window.partitionBy("g").orderBy(*order()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = {r["id"]: r["l"] for r in df.withColumn("l", F.last("v", ignorenulls=True).over(w)).collect()}
    rank = F.struct((-F.unix_micros("t")).alias("a"), (-F.col("id")).alias("b"))
    got = {r["id"]: r["v"] for r in last_seen(df, [F.col("g")], "t", order(), "v", rank).collect()}
    assert got == want


def test_empty_table(spark):
    assert earlier_rows(rows(spark).limit(0), [F.col("g")], "t", order(), "n").count() == 0
