"""Exact values at given ranks of a column of any size, without sorting it in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct values between two bounds that may go to the driver, about.
FEW = 50_000
#: Accuracy of the bounds, and the share of the rows kept on either side: twenty times their error.
ACCURACY, MARGIN = 10_000, 0.002


def values_at(df: DataFrame, value: Column, wanted: Callable[[int], list[int]]) -> tuple[int, list[float]]:
    """(n, values at the ranks ``wanted(n)``, from 0) of the known values; null and NaN are left out.

    Bounds from approximate percentiles close in on each rank, a counting pass
    says how many rows lie below them, until few distinct values are left.
    """
    known = df.select(value.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    n, least, most = known.agg(F.count("*"), F.min("v"), F.max("v")).first()
    return n, [_value_at(known, k, n, least, most) for k in wanted(n)] if n else []


def _value_at(known: DataFrame, rank: int, n: int, low: float, high: float) -> float:
    below, inside = 0, n
    while low < high:
        part = known.where(F.col("v").between(low, high))
        if part.agg(F.approx_count_distinct("v")).first()[0] <= FEW:
            for v, c in part.groupBy("v").agg(F.count("*").alias("c")).orderBy("v").collect():  # about FEW rows
                below += c
                if below > rank:
                    return v
        share = (rank - below) / inside
        bounds = [max(0.0, share - MARGIN), min(1.0, share + MARGIN)]
        low, high = part.agg(F.percentile_approx("v", F.array(*map(F.lit, bounds)), ACCURACY)).first()[0]
        below, inside = known.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high))).first()
    return low


def median(df: DataFrame, value: Column) -> tuple[int, float | None]:
    """(n, exact median), null for no values."""
    n, found = values_at(df, value, lambda n: [(n - 1) // 2, n // 2])
    return n, sum(found) / 2 if found else None
