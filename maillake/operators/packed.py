"""Several values in one field: one row per value, by the dialect of minimum description length.

A delimiter-and-quote dialect describes a field by its items; an item costs
the length of its value code (its structure: address, quoted text, words,
punctuation) under a code that is learned from all fields of the corpus. Each
field is parsed by the dialect with the shortest description.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maillake.functions import packed as P
from maillake.session import materialise

#: Fields that are one bare address: they hold no sign that delimits, so every dialect reads
#: them as one item and the scoring would say "whole" as well.
PLAIN = r"""^[^\s<>"'(),;:|/&]+@[^\s<>"'(),;:|/&]+$"""
#: Value codes that the code table holds, of at most 64 signs each: a bound on what the driver
#: gets. It is a model's size, not a limit on rows: rarer codes cost the escape, wherever they stand.
CODE_TABLE_SIZE = 65_536


def _collect_codes(counts: DataFrame, plain: int) -> P.CodeTable:
    rows = counts.groupBy("sign").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "sign").limit(CODE_TABLE_SIZE).collect()
    table = Counter({r["sign"]: r["n"] for r in rows})
    table["A"] += plain + 1
    return P.CodeTable(dict(table))


def learn_codes(odd: DataFrame, plain: int, rounds: int = 1) -> P.CodeTable:
    """Value-code lengths from every field: first of the finest splits,
    then of the items that the cheapest dialects give (``rounds`` times)."""

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = Counter(s for t in b["packed"] for s in P.first_codes(t))
            yield pd.DataFrame({"sign": list(c), "n": list(c.values())})

    texts = odd.select("packed")
    codes = _collect_codes(texts.mapInPandas(first, "sign string, n bigint"), plain)
    for _ in range(rounds):

        def items(batches: Iterator[pd.DataFrame], codes=codes) -> Iterator[pd.DataFrame]:
            for b in batches:
                c = Counter(P.code_of(P.signature(i)) for t in b["packed"] for i in P.cheapest(t, codes)[1])
                yield pd.DataFrame({"sign": list(c), "n": list(c.values())})

        codes = _collect_codes(texts.mapInPandas(items, "sign string, n bigint"), plain)
    return codes


def unpack(fields: DataFrame, value: str = "packed", rounds: int = 1, singles: bool = False) -> DataFrame:
    """One row per value of the string column ``value``: all columns of ``fields`` plus
    ``dialect``, ``pos`` (bigint from 1, empty items not counted) and ``item``.

    ``item`` is the bare address in lower case, or the item's text in lower
    case, trimmed and unquoted. Fields with one value are left out unless
    ``singles``. Null, empty and blank fields have no values and give no rows;
    repeated rows are each unpacked; a quote that is never closed protects
    nothing. Added columns replace input columns of the same name.
    """
    fields = fields.drop("dialect", "pos", "item")
    held = fields.where(F.col(value).isNotNull())
    is_plain = F.trim(F.col(value)).rlike(PLAIN)
    # Written once: two passes learn from it and one parses it.
    odd = materialise(fields.sparkSession, held.where(~is_plain), "packed")
    plain = held.count() - odd.count()
    codes = learn_codes(odd.select(F.col(value).alias("packed")), plain, rounds)
    at_least = 1 if singles else 2

    @F.pandas_udf("array<struct<dialect:string,pos:bigint,item:string>>")
    def parse(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            k, items = P.cheapest(t, codes)
            name = P.DIALECTS[k].name
            out.append([(name, i + 1, P.bare(x)) for i, x in enumerate(items)] if len(items) >= at_least else [])
        return pd.Series(out)

    parsed = odd.select("*", F.explode(parse(F.col(value))).alias("_v")).select(*fields.columns, "_v.dialect", "_v.pos", "_v.item")
    if singles:
        parsed = parsed.unionByName(
            held.where(is_plain).select(*fields.columns, F.lit("whole").alias("dialect"), F.lit(1).cast("bigint").alias("pos"), F.lower(F.trim(F.col(value))).alias("item"))
        )
    return parsed


def recipient_fields(emails: DataFrame, recipients: DataFrame) -> DataFrame:
    """Every recipient string of the archive: message_id, field, packed."""
    of = lambda c: emails.select("message_id", F.lit(c).alias("field"), F.explode(c).alias("packed"))
    return of("to_addresses").unionByName(of("cc_addresses")).unionByName(
        recipients.select("message_id", F.lit("recipient").alias("field"), F.col("recipient").alias("packed"))
    )
