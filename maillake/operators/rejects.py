"""Rows that can't be loaded: valid rows apart from rejects with their reasons.

Structural indexing: a batch of records is one byte buffer; numpy masks mark
quotes, delimiters and line ends, the prefix parity of the quotes tells which
of them are structure, and counts over the index decide on each record. Types
are checked on whole columns of values. Records that run over several lines of
a file are put together first (``records_of``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType
from pyspark.sql.window import Window

from maillake.functions.instants import parse_instant

FIRST_YEAR, LAST_YEAR = 1998, 2002
#: Names of the reasons for messages, in the order in which they are given.
MESSAGE_REASONS = (
    "missing_message_id", "missing_sender", "unparseable_date", "date_out_of_range",
    "broken_quoting", "no_body_break", "bad_header_line",
)
#: Lines that a record of a file may have, and lines of a file that one task adds up.
MOST_LINES, BLOCK_LINES = 1000, 65_536
LINE_REASONS = ("broken_quoting", "wrong_column_count", "invalid_value")
QUOTE, COMMA, COLON, NEWLINE, BLANK, TAB = (ord(c) for c in '",:\n \t')
_NAME = np.zeros(256, bool)
_NAME[[*range(48, 58), *range(65, 91), *range(97, 123), ord("-")]] = True
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings (null as empty) and n + 1 offsets into them."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _prefix(mask: np.ndarray) -> np.ndarray:
    """Counts before each place: prefix[i] of mask[:i]."""
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


class LineIndex:
    """Structural index of a batch of delimited lines: which quotes and commas are structure."""

    def __init__(self, lines: pa.Array):
        self.data, self.at = data, at = _buffer(lines)
        self.n = n = len(at) - 1
        owner = np.repeat(np.arange(n), np.diff(at))
        quotes = np.flatnonzero(data == QUOTE)
        before = _prefix(data == QUOTE)
        # Prefix parity of the quotes since the record's start: odd means inside quotes.
        rank = np.arange(len(quotes)) - before[at[:-1]][owner[quotes]]
        opens = rank % 2 == 0
        starts, ends = at[:-1][owner[quotes]], at[1:][owner[quotes]]
        prev = np.where(quotes > starts, data[np.maximum(quotes - 1, 0)], COMMA) if len(quotes) else np.zeros(0, np.uint8)
        following = np.where(quotes + 1 < ends, data[np.minimum(quotes + 1, len(data) - 1)], COMMA) if len(quotes) else prev
        # A quote opens at a field's start or as second half of a doubled one; it closes before a delimiter, the end or its double.
        wrong = np.where(opens, (prev != COMMA) & ~((prev == QUOTE) & (rank > 0)), (following != COMMA) & (following != QUOTE))
        self.broken = np.zeros(n, bool)
        self.broken[owner[quotes[wrong]]] = True
        self.broken |= (before[at[1:]] - before[at[:-1]]) % 2 == 1
        commas = np.flatnonzero(data == COMMA)
        self.commas = commas[(before[commas] - before[at[:-1]][owner[commas]]) % 2 == 0]
        self.first = np.searchsorted(self.commas, at[:-1])
        self.count = np.searchsorted(self.commas, at[1:]) - self.first + 1

    def field(self, k: int, rows: np.ndarray) -> pa.Array:
        """Values of field ``k`` of ``rows``, which have it, without outer quotes; no row is looked at alone."""
        start = self.at[rows] if k == 0 else self.commas[self.first[rows] + k - 1] + 1
        last = self.first[rows] + k
        end = np.where(k + 1 < self.count[rows], self.commas[np.minimum(last, max(len(self.commas) - 1, 0))] if len(self.commas) else self.at[rows + 1], self.at[rows + 1])
        quoted = (end - start >= 2) & (self.data[np.minimum(start, max(len(self.data) - 1, 0))] == QUOTE) if len(self.data) else np.zeros(len(rows), bool)
        start, end = start + quoted, end - quoted
        offsets = np.concatenate([[0], np.cumsum(end - start)])
        places = np.repeat(start - offsets[:-1], end - start) + np.arange(offsets[-1])
        values = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(self.data[places].tobytes())])
        return pc.replace_substring(values.cast(pa.large_string()), '""', '"') if quoted.any() else values.cast(pa.large_string())


def existing_times(values: pa.Array) -> np.ndarray:
    """Which of the texts are an existing ``yyyy-MM-dd HH:mm:ss``."""
    shaped = pc.match_substring_regex(values, r"\A[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z").to_numpy(zero_copy_only=False).astype(bool)
    out = shaped.copy()
    if shaped.any():
        digits = np.frombuffer("".join(values.filter(pa.array(shaped)).to_pylist()).encode(), np.uint8).reshape(-1, 19).astype(np.int64) - 48
        of = lambda *at: sum(digits[:, c] * 10 ** (len(at) - 1 - k) for k, c in enumerate(at))
        year, month, day, hour, minute, second = of(0, 1, 2, 3), of(5, 6), of(8, 9), of(11, 12), of(14, 15), of(17, 18)
        leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
        days = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.where(month <= 12, month, 0)] + (leap & (month == 2))
        out[shaped] = (year >= 1) & (month >= 1) & (day >= 1) & (day <= days) & (hour < 24) & (minute < 60) & (second < 60)
    return out


def _matching(pattern: str) -> Callable[[pa.Array], np.ndarray]:
    return lambda values: pc.match_substring_regex(values, pattern).to_numpy(zero_copy_only=False).astype(bool)


#: Checks of the fields of a mail index by their place: sent time, sender, recipient count, size in bytes.
INDEX_FIELDS = {2: existing_times, 3: _matching(r"\A[^\s\pZ@]+@[^\s\pZ@]+\z"), 4: _matching(r"\A[0-9]+\z"), 5: _matching(r"\A[0-9]+\z")}


def line_reasons(lines: pa.Array, columns: int = 7, checks: dict[int, Callable[[pa.Array], np.ndarray]] | None = None) -> list[list[str]]:
    """The first failing reason of each delimited line, as a list of none or one.

    ``checks``: by the place of a field, which of its values (a whole column of
    them) are valid. Null and empty lines have one empty field, so the wrong
    column count.
    """
    index = LineIndex(lines)
    code = np.where(index.broken, 1, np.where(index.count != columns, 2, 0))
    for k, check in (checks or {}).items():
        rows = np.flatnonzero(code == 0)
        if len(rows):
            code[rows[~check(index.field(k, rows))]] = 3
    named = [[], *([r] for r in LINE_REASONS)]
    return [named[c] for c in code]


def message_reasons(headers: pa.Array, has_break: np.ndarray) -> list[list[str]]:
    """All failing reasons of each header block (line ends as \\n, no empty line).

    A null message is an empty block: everything is missing, nothing is out of
    range. Of repeated headers the first counts, but quotes are checked in all.
    """
    data, at = _buffer(headers)
    n = len(at) - 1
    newlines = np.flatnonzero(data == NEWLINE)
    starts = np.union1d(at[:-1][np.diff(at) > 0], newlines + 1)
    starts = starts[starts < len(data)] if len(data) else starts[:0].astype(np.int64)
    owner = np.searchsorted(at, starts, "right") - 1
    lead = data[starts] if len(starts) else np.zeros(0, np.uint8)
    folded = (lead == BLANK) | (lead == TAB)
    line_end = np.minimum(np.append(starts[1:], len(data)), at[owner + 1]) if len(starts) else starts
    colons = np.flatnonzero(data == COLON)
    nth = np.searchsorted(colons, starts)
    colon = np.append(colons, len(data))[np.minimum(nth, len(colons))]
    outside = _prefix(~_NAME[data])
    named = (colon < line_end) & (colon > starts) & (outside[np.minimum(colon, len(data))] == outside[starts])
    bad_line = np.zeros(n, bool)
    empty_line = (data[starts] == NEWLINE) if len(starts) else folded
    bad_line[owner[~folded & ~named & ~empty_line]] = True

    heads = np.flatnonzero(~folded)  # a header's value runs to the next line that isn't folded
    head_end = np.append(starts[heads[1:]], len(data)) if len(heads) else starts[:0]
    head_end = np.minimum(head_end, at[owner[heads] + 1]) if len(heads) else head_end
    quotes, inked = _prefix(data == QUOTE), _prefix(~_WHITE[data])
    lowered = data | ((data >= 65) & (data <= 90)).astype(np.uint8) * 32
    length = (colon - starts)[heads]

    def of(name: str) -> np.ndarray:
        """Places in heads of the headers of that name."""
        k = np.flatnonzero(named[heads] & (length == len(name)))
        for j, c in enumerate(name.encode()):
            k = k[lowered[starts[heads[k]] + j] == c]
        return k

    def present(k: np.ndarray) -> np.ndarray:
        out = np.zeros(n, bool)
        k = first_of(k)
        full = inked[head_end[k]] > inked[colon[heads[k]] + 1]
        out[owner[heads[k[full]]]] = True
        return out

    def first_of(k: np.ndarray) -> np.ndarray:
        return k[np.unique(owner[heads[k]], return_index=True)[1]]

    broken = np.zeros(n, bool)
    for name in ("from", "to", "cc"):
        k = of(name)
        odd = (quotes[head_end[k]] - quotes[colon[heads[k]] + 1]) % 2 == 1
        broken[owner[heads[k[odd]]]] = True
    dates: list[str | None] = [None] * n
    raw = data.tobytes()
    for k in first_of(of("date")):
        dates[owner[heads[k]]] = raw[colon[heads[k]] + 1 : head_end[k]].decode("utf-8", "replace")
    no_id, no_sender = ~present(of("message-id")), ~present(of("from"))
    out = []
    for k in range(n):
        year = parse_instant(re.sub(r"\s+", " ", dates[k]).strip())[1] if dates[k] else None
        failed = (no_id[k], no_sender[k], year is None, year is not None and not FIRST_YEAR <= year <= LAST_YEAR, broken[k], not has_break[k], bad_line[k])
        out.append([r for r, f in zip(MESSAGE_REASONS, failed) if f])
    return out


def _with_reasons(df: DataFrame, key: list[str], columns: dict[str, Column], reasons) -> DataFrame:
    """``key`` columns plus ``reasons``, computed over batches of ``columns``."""
    schema = df.select(*key).schema.add("reasons", ArrayType(StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arrays = [b.column(i) for i in range(len(key))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(reasons(b), pa.list_(pa.string()))], [*key, "reasons"])

    return df.select(*key, *(c.alias(n) for n, c in columns.items())).mapInArrow(run, schema)


def check_messages(df: DataFrame, key: list[str], message: str = "message") -> DataFrame:
    """``key`` and ``reasons`` (empty: the message loads) of every row of ``df``.

    CRLF counts as one line end. A null message lacks everything.
    """
    text = F.replace(F.coalesce(F.col(message), F.lit("")), F.lit("\r\n"), F.lit("\n"))
    at_once = F.startswith(text, F.lit("\n"))
    block = F.when(at_once, F.lit("")).otherwise(F.substring_index(text, "\n\n", 1))
    has_break = at_once | F.contains(text, F.lit("\n\n"))
    return _with_reasons(
        df, key, {"_block": block, "_break": has_break},
        lambda b: message_reasons(b.column(len(key)), b.column(len(key) + 1).to_numpy(zero_copy_only=False)),
    )


def check_lines(df: DataFrame, key: list[str], line: str = "line", columns: int = 7, checks=INDEX_FIELDS) -> DataFrame:
    """``key`` and ``reasons`` (none, or the first that holds) of every delimited line."""
    return _with_reasons(df, key, {"_line": F.col(line).cast("string")}, lambda b: line_reasons(b.column(len(key)), columns, checks))


def split_rejects(df: DataFrame, column: str, kind: str = "message") -> tuple[DataFrame, DataFrame]:
    """(rows that load, rejects with ``reason``: all reasons joined by "; ")."""
    names = df.columns
    checked = (check_messages if kind == "message" else check_lines)(df.withColumn("_mk_value", F.col(column)), [*names, "_mk_value"], "_mk_value")
    good = checked.where(F.size("reasons") == 0).select(*names)
    bad = checked.where(F.size("reasons") > 0).withColumn("reason", F.array_join("reasons", "; ")).select(*[n for n in names if n != "reason"], "reason")
    return good, bad


def load_lines(df: DataFrame, line: str = "line", columns: int = 7) -> DataFrame:
    """The lines that load, with ``fields``: their unquoted values in order."""
    good, _ = split_rejects(df, line, "line")
    schema = StructType([*good.schema.fields]).add("fields", ArrayType(StringType()))
    names = good.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, rows = LineIndex(b.column(names.index(line))), np.arange(b.num_rows)
            values = pa.concat_arrays([index.field(k, rows) for k in range(columns)]).cast(pa.string())
            order = (np.arange(columns)[None, :] * b.num_rows + rows[:, None]).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * columns, pa.int32()), values.take(pa.array(order)))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*names, "fields"])

    return good.mapInArrow(run, schema)


def records_of(lines: DataFrame, source: str, order: str, line: str, most_lines: int = MOST_LINES) -> DataFrame:
    """Records of files whose quoted fields may hold line ends: ``source``,
    ``order`` (of the first line), lines (how many) and ``line`` (joined by \\n).

    A line end is a record's end where the prefix parity of the file's quotes is
    even. Parities are added up by blocks of lines, so a file of any length is
    many tasks. A quote that is never closed would join the rest of its file; a
    record of more than ``most_lines`` isn't joined: its lines stay records of
    their own, with their quoting broken. ``order`` numbers a file's lines, each once.
    """
    block = F.floor(F.col(order) / BLOCK_LINES)
    odd = F.pmod(F.length(F.col(line)) - F.length(F.replace(F.col(line), F.lit('"'), F.lit(""))), F.lit(2))
    # Keys are structs, in which a null source is a source like any other.
    of = F.struct(F.col(source).alias("s"))
    cut = lines.select(of.alias("_s"), F.struct(of.alias("s"), block.alias("b")).alias("_b"), F.col(order).alias("_n"), F.coalesce(F.col(line), F.lit("")).alias("_l"), F.coalesce(odd, F.lit(0)).alias("_odd"))
    here = Window.partitionBy("_b").orderBy("_n")
    earlier = Window.partitionBy("_b.s").orderBy("_b.b").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("_b").agg(F.sum("_odd").alias("_t")).select("_b", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_far"))
    near = cut.withColumn("_near", F.coalesce(F.sum("_odd").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    flagged = near.join(totals, "_b").withColumn("_begins", F.when(F.pmod(F.col("_near") + F.col("_far"), F.lit(2)) == 0, F.col("_n")))
    begun = flagged.withColumn("_start", F.last("_begins", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    lasts = flagged.groupBy("_b").agg(F.max("_begins").alias("_m")).select("_b", F.last("_m", ignorenulls=True).over(earlier).alias("_before"))
    placed = begun.join(lasts, "_b").select("_s", "_n", "_l", F.struct("_s", F.coalesce("_start", "_before").alias("n")).alias("_r"))
    long = placed.groupBy("_r").agg(F.count("*").alias("_size")).where(F.col("_size") > most_lines)
    alone = placed.join(long, "_r", "left").select("_n", "_l", F.when(F.col("_size").isNull(), F.col("_r")).otherwise(F.struct("_s", F.col("_n").alias("n"))).alias("_r"))
    joined = alone.groupBy("_r").agg(F.count("*").alias("lines"), F.sort_array(F.collect_list(F.struct("_n", "_l"))).alias("_ls"))
    return joined.select(F.col("_r._s.s").alias(source), F.col("_r.n").alias(order), "lines", F.array_join(F.transform("_ls", lambda x: x["_l"]), "\n").alias(line))
