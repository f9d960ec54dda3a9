"""Percentiles per group by merging centroid digests, with certified rank error.

A digest holds weighted centroids of sorted values; how much weight a centroid
may have depends on its quantile (few values near the ends, many in the
middle). Digests of partitions, days or files are merged by clustering their
centroids again. A second pass counts the values below each estimate and so
certifies its rank error. Groups with fewer values than centroids are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maillake.operators.lookup import lookup
from maillake.session import materialise

#: Centroids of a digest, about; the rank error falls as its inverse.
CENTROIDS = 400
#: Largest rank error (share of n) that the certificate accepts.
RANK_ERROR = 0.005
#: Centroids that a task gathers before it hands digests on.
FLUSH = 400_000
SALTS = 32
QUANTILES = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
_STATE = "means array<double>, weights array<double>, pure array<boolean>, low bigint, high bigint"


def scale(q: np.ndarray, size: int) -> np.ndarray:
    """The size function: a cluster may span one unit of it."""
    return size / np.pi * np.arcsin(np.clip(2 * q - 1, -1, 1)) + size / 2


def cluster(group: np.ndarray, mean: np.ndarray, weight: np.ndarray, pure: np.ndarray, size: int = CENTROIDS) -> tuple[np.ndarray, ...]:
    """Centroids of every group, clustered again; all groups at once.

    ``group``: numbers from 0. ``pure``: all values of the centroid are its mean.
    Equal pure centroids become one. Groups of up to ``size`` centroids stay as
    they are; so does a pure centroid that alone spans half a unit of the size
    function, or a much repeated value would blur its neighbours.
    """
    if not len(group):
        return group, mean, weight, pure
    order = np.lexsort((pure, mean, group))
    group, mean, weight, pure = group[order], mean[order], weight[order], pure[order]
    joins = (group[1:] == group[:-1]) & (mean[1:] == mean[:-1]) & pure[1:] & pure[:-1]
    at = np.flatnonzero(np.concatenate([[True], ~joins]))
    group, mean, weight, pure = group[at], mean[at], np.add.reduceat(weight, at), pure[at]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    count = np.diff(np.append(starts, len(group)))
    total = np.repeat(np.add.reduceat(weight, starts), count)
    before = np.cumsum(weight) - weight
    before = before - np.repeat(before[starts], count)
    unit = np.floor(scale((before + weight / 2) / total, size))
    heavy = pure & (scale((before + weight) / total, size) - scale(before / total, size) > 0.5)
    alone = np.repeat(count <= size, count) | heavy
    unit = np.where(alone, -1.0 - np.arange(len(unit)), unit)
    at = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (unit[1:] != unit[:-1])]))
    members = np.diff(np.append(at, len(mean)))
    w = np.add.reduceat(weight, at)
    # Means as offsets from the cluster's first: sums of large values keep their digits.
    base = np.repeat(mean[at], members)
    return group[at], mean[at] + np.add.reduceat((mean - base) * weight, at) / w, w, pure[at] & (members == 1)


class _Gather:
    """Digests by key while a task reads."""

    def __init__(self, size: int):
        self.size = size
        self.keys: dict[tuple, int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.low: dict[int, int] = {}
        self.high: dict[int, int] = {}
        self.held = 0

    def number(self, key: tuple) -> int:
        return self.keys.setdefault(key, len(self.keys))

    def add(self, *centroids: np.ndarray) -> None:
        self.parts.append(centroids)
        self.held += len(centroids[0])
        if self.held > FLUSH:
            self.tighten()

    def tighten(self) -> None:
        self.parts = [cluster(*(np.concatenate(x) for x in zip(*self.parts)), self.size)]
        self.held = len(self.parts[0][0])

    def rows(self, names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
        if self.parts:
            self.tighten()
        g, m, w, pure = self.parts[0] if self.parts else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, bool))
        cut = np.searchsorted(g, np.arange(len(self.keys) + 1)).astype(np.int32)
        cols = [pa.array([k[i] for k in self.keys], t) for i, t in enumerate(types)]
        lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in (m, w, pure)]
        ends = [pa.array([d.get(i, 0) for i in range(len(self.keys))], pa.int64()) for d in (self.low, self.high)]
        return pa.RecordBatch.from_arrays([*cols, *lists, *ends], [*names, "means", "weights", "pure", "low", "high"])


def _key_schema(df: DataFrame, keys: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{k}` {types[k]}" for k in keys)


def _merge(df: DataFrame, keys: list[str], extra: list[str], size: int) -> DataFrame:
    """Digests with equal keys (and ``extra``) as one, read as a stream: however
    many come together, a task holds one digest for each of its keys."""
    by = [*keys, *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, types, last = _Gather(size), None, None
        for b in batches:
            types = [b.schema.field(k).type for k in by]
            key_rows = list(zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in by)))
            means, weights, pure = (b.column(b.schema.get_field_index(c)) for c in ("means", "weights", "pure"))
            lengths = means.value_lengths().to_numpy()
            low, high = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("low", "high"))
            if last is not None and held.held > FLUSH // 2 and key_rows and key_rows[0] != last:
                yield held.rows(by, types)
                held = _Gather(size)
            numbers = np.array([held.number(k) for k in key_rows], np.int64)
            for i, lo, hi in zip(numbers, low, high):
                held.low[i] = held.low.get(i, 0) + lo
                held.high[i] = held.high.get(i, 0) + hi
            held.add(np.repeat(numbers, lengths), means.flatten().to_numpy(), weights.flatten().to_numpy(), pure.flatten().to_numpy(zero_copy_only=False))
            last = key_rows[-1] if key_rows else last
        if types:
            yield held.rows(by, types)

    return df.repartition(*[F.col(c) for c in by]).sortWithinPartitions(*by).mapInArrow(run, f"{_key_schema(df, by)}, {_STATE}")


def digest(df: DataFrame, keys: list[str], value: Column, size: int = CENTROIDS) -> DataFrame:
    """One digest per key: ``keys``, means, weights (centroids in order), low and
    high (counts of infinite values, which no centroid holds).

    Null and NaN values are left out; all other rows count as they stand. Null
    keys form groups of their own. Groups without values have no digest.
    """
    kept = df.select(*keys, value.cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, types = _Gather(size), None
        for b in batches:
            types = [b.schema.field(k).type for k in keys]
            frame = pd.DataFrame({i: b.column(i).to_pandas() if pa.types.is_string(b.column(i).type) else pd.Series(b.column(i).to_pylist(), dtype=object) for i in range(len(keys))})
            local = frame.groupby(list(frame.columns), dropna=False, sort=False).ngroup().to_numpy()
            first = np.unique(local, return_index=True)[1]
            own = [tuple(b.column(i)[int(f)].as_py() for i in range(len(keys))) for f in first]
            numbers = np.array([held.number(k) for k in own], np.int64)[local]
            v = b.column(len(keys)).to_numpy(zero_copy_only=False)
            for side, counts in ((v == -np.inf, held.low), (v == np.inf, held.high)):
                for i, n in zip(*np.unique(numbers[side], return_counts=True)):
                    counts[int(i)] = counts.get(int(i), 0) + int(n)
            ok = np.isfinite(v)
            held.add(*cluster(numbers[ok], v[ok], np.ones(ok.sum()), np.ones(ok.sum(), bool), size))
            if held.held > FLUSH or len(held.keys) > FLUSH:
                yield held.rows(keys, types)
                held = _Gather(size)
        if types:
            yield held.rows(keys, types)

    parts = kept.mapInArrow(run, f"{_key_schema(df, keys)}, {_STATE}").withColumn("_salt", F.spark_partition_id() % SALTS)
    return merge(_merge(parts, keys, ["_salt"], size).drop("_salt"), keys, size)


def merge(digests: DataFrame, keys: list[str], size: int = CENTROIDS) -> DataFrame:
    """Digests of days, files or partitions combined: one per ``keys``."""
    return _merge(digests.select(*keys, "means", "weights", "pure", "low", "high"), keys, [], size)


def estimate(means: np.ndarray, weights: np.ndarray, pure: np.ndarray, low: int, high: int, q: float) -> float | None:
    """The value at quantile ``q``, as an interpolated percentile.

    A pure centroid stands at all of its ranks, any other at their middle; in
    between the estimate runs straight. So it is exact where all are pure.
    """
    n = low + high + weights.sum()
    if n == 0:
        return None
    rank = q * (n - 1)  # from 0
    if rank < low:
        return -np.inf
    rank -= low
    if not len(means) or rank > weights.sum() - 1 + 1e-9:
        return np.inf if high else float(means[-1])
    last = np.cumsum(weights) - 1
    first = last - weights + 1
    middle = (first + last) / 2
    # Two knots for each centroid: the ranks between which it stands.
    at = np.stack([np.where(pure, first, middle), np.where(pure, last, middle)], 1).ravel()
    return float(np.interp(rank, at, np.repeat(means, 2)))


def quantiles(digests: DataFrame, keys: list[str], wanted: dict[str, float] = QUANTILES) -> DataFrame:
    """``keys``, n and one column for each wanted quantile."""
    names = list(wanted)

    @F.pandas_udf(f"struct<n:bigint,{','.join(f'`{c}`:double' for c in names)}>")
    def run(means: pd.Series, weights: pd.Series, pure: pd.Series, low: pd.Series, high: pd.Series) -> pd.DataFrame:
        rows = []
        for m, w, p, lo, hi in zip(means, weights, pure, low, high):
            m, w, p = np.asarray(m, float), np.asarray(w, float), np.asarray(p, bool)
            rows.append([int(lo + hi + w.sum()), *(estimate(m, w, p, lo, hi, wanted[c]) for c in names)])
        return pd.DataFrame(rows, columns=["n", *names])

    return digests.select(*keys, run("means", "weights", "pure", "low", "high").alias("_q")).select(*keys, "_q.*")


def certify(df: DataFrame, keys: list[str], value: Column, estimates: DataFrame, wanted: dict[str, float] = QUANTILES) -> DataFrame:
    """``estimates`` plus ``rank_error``: the largest distance, as a share of n, of a
    quantile's rank from the ranks that its estimate has, counted over all rows.

    An estimate between two neighbouring values has the ranks of both. Hot
    groups are looked up by broadcast, so no task gets a group's rows.
    """
    names = list(wanted)
    null_safe = [F.coalesce(F.col(k).cast("string"), F.lit("\x00null")).alias(f"_k{i}") for i, k in enumerate(keys)]
    on = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*null_safe, value.cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    entries = estimates.select(*null_safe, "n", *names)
    found = lookup(rows, entries, on)
    below = [F.sum((F.col("_v") < F.col(c)).cast("bigint")).alias(f"_l_{c}") for c in names]
    upto = [F.sum((F.col("_v") <= F.col(c)).cast("bigint")).alias(f"_u_{c}") for c in names]
    counted = found.groupBy(*on).agg(F.count("*").alias("_n"), *below, *upto)
    error = F.greatest(
        F.lit(0.0),
        # Rank q(n-1) from 0 should lie between the values below and those up to the estimate, within the gap to the next value.
        *(
            F.greatest(F.col(f"_l_{c}") - 1 - F.lit(q) * (F.col("_n") - 1), F.lit(q) * (F.col("_n") - 1) - F.col(f"_u_{c}"), F.lit(0.0)) / F.col("_n")
            for c, q in wanted.items()
        ),
    )
    certified = counted.select(*on, error.alias("rank_error"))
    keyed = estimates.select("*", *null_safe)
    return keyed.join(certified, on, "left").drop(*on)


def percentiles(df: DataFrame, keys: list[str], value: Column, part: Column | None = None, wanted: dict[str, float] = QUANTILES, bound: float = RANK_ERROR) -> DataFrame:
    """Certified percentiles per key: ``keys``, n, the quantiles, rank_error, certified.

    With ``part`` (a day, a file) digests are made per key and part and merged,
    as results that come day by day are. ``certified``: rank_error is within ``bound``.
    """
    frame = df if part is None else df.withColumn("_part", part)
    one = digest(frame, keys if part is None else [*keys, "_part"], value)
    whole = one if part is None else merge(one, keys)
    estimates = materialise(df.sparkSession, quantiles(whole, keys, wanted), "quantiles")
    out = certify(df, keys, value, estimates, wanted)
    return out.withColumn("certified", F.col("rank_error") <= bound)
