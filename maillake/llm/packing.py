"""Filling containers of fixed capacity with items, splitting only what alone exceeds it.

Sizes are whole numbers up to the capacity, so all that the packing needs is
how many items have each size: at most ``capacity`` counts, however many items
there are. Best-two-fit runs on these counts: a bin is filled greedily, then its
smallest item gives way to two that fit the widened gap more tightly; the
pattern found is used for as many bins as the counts allow. Items get their
place by their rank within their size.
"""

from __future__ import annotations

import bisect
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maillake.session import materialise

CAPACITY = 2048
#: Rows that one ranking task gets on average.
ROWS_PER_BUCKET = 200_000


class Slot(NamedTuple):
    """Items of ``size`` with ranks from ``first`` to ``last`` go into bins from
    ``bin`` on, ``per_bin`` into each."""

    size: int
    first: int
    last: int
    bin: int
    per_bin: int


class _Sizes:
    """Counts of sizes with the largest available size up to a limit."""

    def __init__(self, counts: dict[int, int]):
        self.left = {s: n for s, n in counts.items() if n > 0}
        self.order = sorted(self.left)

    def largest(self, limit: int) -> int | None:
        k = bisect.bisect_right(self.order, limit)
        return self.order[k - 1] if k else None

    def take(self, size: int, n: int) -> None:
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            self.order.pop(bisect.bisect_left(self.order, size))


def _best_two(sizes: _Sizes, used: dict[int, int], gap: int) -> tuple[int, int] | None:
    """Two items that are still free with the largest sum up to ``gap``: pointers
    from both ends over the free sizes, of which two items are enough."""
    free = [s for s in sizes.order[: bisect.bisect_right(sizes.order, gap)] for _ in range(min(2, sizes.left[s] - used.get(s, 0)))]
    best, found = 0, None
    lo, hi = 0, len(free) - 1
    while lo < hi and best < gap:
        total = free[lo] + free[hi]
        if total > gap:
            hi -= 1
            continue
        if total > best:
            best, found = total, (free[lo], free[hi])
        lo += 1
    return found


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Slot]:
    """Where the items of each size go; every size must be from 1 to ``capacity``.

    Each pattern is used until it isn't possible any more, so there are not
    more patterns than a few per size.
    """
    sizes = _Sizes(counts)
    rank = dict.fromkeys(counts, 0)
    slots: list[Slot] = []
    bins = 0
    while sizes.order:
        pattern: dict[int, int] = {}
        room = capacity
        limit = capacity
        while room:  # greedily: always the largest that fits
            size = sizes.largest(min(room, limit))
            if size is None:
                break
            n = min(room // size, sizes.left[size] - pattern.get(size, 0))
            if n <= 0:
                limit = size - 1
                continue
            pattern[size] = pattern.get(size, 0) + n
            room -= n * size
            limit = size - 1
        if room and pattern:
            smallest = min(pattern)
            used = pattern | {smallest: pattern[smallest] - 1}
            two = _best_two(sizes, used, room + smallest)
            if two and sum(two) > smallest:
                pattern = {s: n for s, n in used.items() if n}
                for s in two:
                    pattern[s] = pattern.get(s, 0) + 1
        times = min(sizes.left[s] // n for s, n in pattern.items())
        for size, n in pattern.items():
            slots.append(Slot(size, rank[size], rank[size] + times * n - 1, bins, n))
            rank[size] += times * n
            sizes.take(size, times * n)
        bins += times
    return slots


def pack(df: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """``key``, ``part``, ``start``, ``length`` and ``bin`` of every piece of every item.

    An item up to the capacity is one piece (part 0). A longer one is cut into
    full pieces and a rest; full pieces fill a bin each, the rest is packed like
    an item. Items of size null, 0 or less need no room: they get no row.
    Repeated keys are items of their own.
    """
    if capacity < 1:
        raise ValueError("the capacity must be 1 or more")
    spark = df.sparkSession
    items = df.select(F.col(key).alias("key"), F.col(size).cast("bigint").alias("size")).where("size > 0")
    parts = items.select("key", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(size - 1) div {capacity}"))).alias("part"))
    pieces = parts.select("key", "part", (F.col("part") * capacity).alias("start"), F.least(F.lit(capacity).cast("bigint"), F.col("size") - F.col("part") * capacity).alias("length"))
    pieces = materialise(spark, pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    total = sum(counts.values())
    buckets = max(1, -(-total // ROWS_PER_BUCKET))
    # Ranks within a size: counts of (bucket, size) give each bucket its first rank, so a size that most items have isn't one task.
    spread = pieces.withColumn("bucket", F.pmod(F.xxhash64("key", "part"), F.lit(buckets)))
    per = spread.groupBy("bucket", "length").agg(F.count("*").alias("n"))
    first = per.withColumn("first_rank", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("bucket", "length", F.coalesce("first_rank", F.lit(0)).alias("first_rank"))
    local = spread.withColumn("local", F.row_number().over(Window.partitionBy("bucket", "length").orderBy("key", "part")) - 1)
    ranked = local.join(first, ["bucket", "length"]).select("key", "part", "start", "length", (F.col("local") + F.col("first_rank")).alias("rank"))
    slots = plan(counts, capacity)
    by_size = {}
    for s in slots:
        by_size.setdefault(s.size, []).append((s.first, s.last, s.bin, s.per_bin))
    # The plan goes to the executors with the function; its size is bounded by the capacity (see ``plan``), not by the items.

    @F.pandas_udf("bigint")
    def bin_of(length, rank):
        import numpy as np
        import pandas as pd

        out = np.zeros(len(rank), np.int64)
        ln, rk = length.to_numpy(), rank.to_numpy()
        for s in np.unique(ln):
            own = by_size[int(s)]
            firsts = np.array([o[0] for o in own], np.int64)
            at = np.flatnonzero(ln == s)
            k = np.searchsorted(firsts, rk[at], "right") - 1
            base, per_bin = np.array([o[2] for o in own], np.int64)[k], np.array([o[3] for o in own], np.int64)[k]
            out[at] = base + (rk[at] - firsts[k]) // per_bin
        return pd.Series(out)

    return ranked.withColumn("bin", bin_of("length", "rank")).select(F.col("key").alias(key), "part", "start", "length", "bin")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: bins, pieces, used and the share of the room that is used."""
    bins = packed.groupBy("bin").agg(F.sum("length").alias("used"), F.count("*").alias("pieces"))
    return bins.agg(
        F.count("*").alias("bins"), F.sum("pieces").alias("pieces"), F.sum("used").alias("used"), F.max("used").alias("fullest"), (F.sum("used") / (F.count("*") * capacity)).alias("fill_share")
    )
