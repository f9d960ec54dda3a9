"""Running values within groups in time order, for groups of any size.

A window over a whole group would be one task, however many rows the group has.
Here a group is cut into minutes (rows without time by a tie-break column): the
window runs within a cut, cuts are totalled by an aggregate with partial
results, and what came before a cut is a window over totals - half a million
for each year at the most, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: Leading characters of the tie-break by which rows without time are cut.
TIE_PREFIX = 6


def _before_and_within(
    df: DataFrame, keys: list[Column], at: str, order: list[Column], tie: Column, within: Callable[[WindowSpec], Column], total: Column, carry: Callable[[str], Column]
) -> DataFrame:
    """``df`` plus ``_within`` (over the rows of the cut up to this one) and ``_before`` (over earlier cuts).

    ``total`` sums up a cut. Keys go into one struct, in which nulls are equal,
    so rows, totals and join share one partitioning.
    """
    group = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)))
    minute = F.floor(F.unix_seconds(F.col(at)) / 60)
    key = F.struct(group.alias("group"), minute.alias("minute"), F.when(minute.isNull(), F.substring(tie.cast("string"), 1, TIE_PREFIX)).alias("tie"))
    keyed = df.withColumn("_key", key)
    here = Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("_key.group").orderBy(F.asc_nulls_first("_key.minute"), F.asc_nulls_first("_key.tie")).rowsBetween(Window.unboundedPreceding, -1)
    before = keyed.groupBy("_key").agg(total.alias("_total")).select("_key", carry("_total").over(earlier).alias("_before"))
    return keyed.withColumn("_within", within(here)).join(before, "_key").drop("_key")


def running_sum(df: DataFrame, keys: list[Column], at: str, order: list[Column], value: Column, out: str, tie: Column | None = None) -> DataFrame:
    """``df`` plus ``out``: sum of ``value`` over the rows of the group up to this one.

    ``order`` must begin with ``at``, nulls first; rows without time are cut by
    ``tie``, whose order ``order`` must follow (without it they are one task per
    group). Null keys form groups of their own.
    """
    tie = F.lit("") if tie is None else tie
    summed = _before_and_within(df, keys, at, order, tie, lambda w: F.sum(value).over(w), F.sum(value), lambda c: F.sum(c))
    return summed.withColumn(out, F.col("_within") + F.coalesce("_before", F.lit(0))).drop("_within", "_before")


def earlier_rows(df: DataFrame, keys: list[Column], at: str, order: list[Column], out: str, tie: Column | None = None) -> DataFrame:
    """``df`` plus ``out``: how many rows of the group come before this one (int)."""
    return running_sum(df, keys, at, order, F.lit(1), "_n", tie).withColumn(out, (F.col("_n") - 1).cast("int")).drop("_n")


def last_seen(df: DataFrame, keys: list[Column], at: str, order: list[Column], value: str, rank: Column) -> DataFrame:
    """``df`` with ``value`` filled by the last value of the group up to this row.

    ``rank`` orders the values of a minute, the last of them having the least.
    """
    last = F.min_by(value, F.when(F.col(value).isNotNull(), rank))
    seen = _before_and_within(df, keys, at, order, F.lit(""), lambda w: F.last(value, ignorenulls=True).over(w), last, lambda c: F.last(c, ignorenulls=True))
    return seen.withColumn(value, F.coalesce("_within", "_before")).drop("_within", "_before")
