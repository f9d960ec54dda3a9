import numpy as np
import pytest
from pyspark.sql import functions as F

from maillake.llm import digests as D


def rank_range(values, x):
    return np.searchsorted(values, x, "left") / len(values), np.searchsorted(values, x, "right") / len(values)


@pytest.mark.parametrize("shape", ["lognormal", "ties", "sorted", "two", "large"])
def test_error_is_bounded_after_many_merges(shape):
    rng = np.random.default_rng(3)
    v = {
        "lognormal": lambda: rng.lognormal(3, 2, 200_000),
        "ties": lambda: np.where(rng.random(200_000) < 0.4, 7.0, rng.normal(size=200_000) * 20),
        "sorted": lambda: np.sort(rng.normal(size=200_000)),
        "two": lambda: rng.integers(0, 2, 200_000).astype(float),
        "large": lambda: 1e15 + rng.random(200_000),
    }[shape]()
    state = None
    for k in range(0, len(v), 5000):
        part = D.cluster(np.zeros(5000, int), v[k : k + 5000], np.ones(5000), np.ones(5000, bool))
        state = part if state is None else D.cluster(*(np.concatenate(x) for x in zip(state, part)))
    _, m, w, pure = state
    assert w.sum() == len(v) and len(m) <= 2 * D.CENTROIDS and (np.diff(m) >= 0).all()
    s = np.sort(v)
    for q in (0.001, 0.01, 0.25, 0.5, 0.75, 0.99, 0.999):
        lo, hi = rank_range(s, D.estimate(m, w, pure, 0, 0, q))
        assert lo - D.RANK_ERROR <= q <= hi + D.RANK_ERROR, (shape, q)


def frame(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", float(x)) for x in rng.lognormal(2, 1, 20_000)] + [(f"k{i % 50}", float(i)) for i in range(500)]
    rows += [(None, 1.0), (None, 3.0), ("hot", None), ("hot", float("nan")), ("inf", float("inf")), ("inf", float("-inf")), ("inf", 5.0), ("none", None)]
    return spark.createDataFrame(rows, "k string, v double").repartition(7)


def test_percentiles_per_group(spark):
    df = frame(spark)
    got = {r["k"]: r for r in D.percentiles(df, ["k"], F.col("v")).collect()}
    assert len(got) == 53 and "none" not in got
    assert all(r["certified"] for r in got.values())
    assert got["k7"]["p50"] == np.percentile([7 + 50 * i for i in range(10)], 50) and got["k7"]["n"] == 10 and got["k7"]["rank_error"] == 0
    assert got[None]["p50"] == 2.0 and got["inf"]["p50"] == 5.0 and got["inf"]["p99"] == float("inf")
    values = np.sort([r["v"] for r in df.where("k = 'hot' AND v IS NOT NULL AND NOT isnan(v)").collect()])
    lo, hi = rank_range(values, got["hot"]["p90"])
    assert got["hot"]["n"] == 20_000 and lo - 0.005 <= 0.9 <= hi + 0.005


def test_days_are_merged_as_one(spark):
    df = frame(spark).withColumn("day", F.pmod(F.hash("v"), F.lit(4)))
    daily = D.digest(df, ["k", "day"], F.col("v"))
    merged = {r["k"]: r["n"] for r in D.quantiles(D.merge(daily, ["k"]), ["k"]).collect()}
    assert merged == {r["k"]: r["n"] for r in D.quantiles(D.digest(df, ["k"], F.col("v")), ["k"]).collect()}
    assert merged["hot"] == 20_000


def test_certificate_finds_a_wrong_estimate(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(100)], "k string, v double")
    wrong = spark.createDataFrame([("a", 100, 90.0)], "k string, n bigint, p50 double")
    r = D.certify(df, ["k"], F.col("v"), wrong, {"p50": 0.5}).first()
    assert r["rank_error"] == pytest.approx(0.395, abs=0.02)


def test_empty_and_clashing_names(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert D.percentiles(empty, ["k"], F.col("v")).count() == 0
    df = spark.createDataFrame([("a", 1.0, 9)], "k string, v double, n int")
    assert D.percentiles(df, ["k"], F.col("v"), part=F.lit("d")).first()["n"] == 1
