from pyspark.sql import functions as F

from maillake.operators.lookup import lookup


def test_hot_and_cold_values(spark):
    rows = spark.createDataFrame([("hot",)] * 3000 + [(f"k{i}",) for i in range(3000)] + [(None,)] * 3, "k string")
    entries = rows.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.max(F.upper("k")).alias("v"))
    out = lookup(rows, entries, ["k"])
    assert out.columns == ["k", "v"] and out.count() == 6003
    assert out.where("v = 'HOT'").count() == 3000 and out.where("k = 'k7' AND v = 'K7'").count() == 1
    assert out.where("k IS NULL AND v IS NULL").count() == 3


def test_values_without_entry(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "k string")
    entries = spark.createDataFrame([("a", 1, 5)], "k string, v int, n bigint")
    assert {(r["k"], r["v"]) for r in lookup(rows, entries, ["k"]).collect()} == {("a", 1), ("b", None)}
