"""Join of many rows with a dictionary of their distinct values, safe against hot values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A value with more than one in HOT_SHARE of the rows is hot; so there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000


def lookup(rows: DataFrame, entries: DataFrame, on: list[str], count: str = "n", total: int | None = None) -> DataFrame:
    """``rows`` left-joined with ``entries`` (one row per value of ``on``, with
    ``count``: how many rows have it; any other columns are looked up).

    Hot values - fewer than HOT_SHARE by arithmetic - are looked up by
    broadcast, so a value that holds a third of all rows isn't one task; the
    rest goes through the shuffle. Rows with a null key get nulls.
    """
    if total is None:
        total = entries.agg(F.sum(count)).first()[0] or 0
    values = [c for c in entries.columns if c not in (*on, count)]
    flagged = entries.withColumn("_mk_hot", F.col(count) * HOT_SHARE > total).drop(count)
    hot = flagged.where("_mk_hot").select(*on, *(F.col(v).alias(f"_mk_{v}") for v in values), F.col("_mk_hot"))
    marked = rows.join(F.broadcast(hot), on, "left")
    whole = F.lit(True)
    for c in on:
        whole = whole & F.col(c).isNotNull()
    done = marked.where(F.col("_mk_hot") | ~whole).select(*rows.columns, *(F.col(f"_mk_{v}").alias(v) for v in values))
    cold = flagged.where("NOT _mk_hot").drop("_mk_hot")
    rest = marked.where(F.col("_mk_hot").isNull() & whole).select(*rows.columns).join(cold, on, "left").select(*rows.columns, *values)
    return done.unionByName(rest)
