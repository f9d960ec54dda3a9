"""Header block, body, addresses and dates of raw messages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notations of Date headers that are read, with and without offset.
WITH_OFFSET = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z"]
WITHOUT_OFFSET = ["d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm"]
# What a Date header may have around the date - a comment at its end, a weekday at its beginning.
NOISE = [r"\s*\([^)]*\)\s*$", r"^[A-Za-z]{3},\s*"]


def unix_lines(message: Column) -> Column:
    return F.regexp_replace(message, "\r\n?", "\n")


def header_block(message: Column) -> Column:
    """Everything before the first empty line, folded lines joined. A message
    without one, or that begins with one, is all header."""
    text = unix_lines(message)
    at = F.instr(text, "\n\n")
    block = F.when(at > 1, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    return F.regexp_replace(block, "\n[ \t]+", " ")


def body_text(message: Column) -> Column:
    """Everything after the first empty line, "" without one."""
    text = unix_lines(message)
    at = F.instr(text, "\n\n")
    return F.when(at > 0, F.substring(text, at + 2, F.length(text))).otherwise(F.when(text.isNotNull(), F.lit("")))


def header(block: Column, name: str) -> Column:
    """Value of the first header of that name (any case), null if absent or blank."""
    return F.nullif(F.trim(F.regexp_extract(block, rf"(?im)^{name}:[ \t]*([^\n]*)", 1)), F.lit(""))


def address(value: Column) -> Column:
    """Lower-case address without display name."""
    low = F.lower(F.trim(value))
    inner = F.regexp_extract(low, "<([^>]*)>", 1)
    return F.when(F.length(inner) == 0, low).otherwise(F.trim(inner))


def addresses(value: Column) -> Column:
    """Addresses of a comma-separated list in order; never null, repeats kept."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), address), lambda a: F.length(a) > 0)


def with_dates(df: DataFrame, value: str) -> DataFrame:
    """``df`` plus ``sent_at`` (the instant of a Date header with numeric offset)
    and ``sent_at_local`` (its wall clock as written); null if it can't be read.

    The tidied header is a step of its own, so it isn't computed for each notation.
    """
    tidy = value
    for pattern in NOISE:
        tidy = F.regexp_replace(tidy, pattern, "")
    read = lambda text, notations: F.coalesce(*(F.try_to_timestamp(text, F.lit(n)) for n in notations))
    step = df.withColumn("_bare", F.trim(F.regexp_replace(tidy, r"\s+", " ")))
    wall = F.regexp_replace("_bare", r"\s*[+-]\d{4}$", "")
    return step.withColumns({"sent_at": read(F.col("_bare"), WITH_OFFSET), "sent_at_local": read(wall, WITHOUT_OFFSET).cast("timestamp_ntz")}).drop("_bare")


def source_system(file_name: Column) -> Column:
    """Exporting program by the mailbox file's extension."""
    name = F.lower(F.trim(file_name))
    return F.when(F.endswith(name, F.lit(".nsf")), "lotus_notes").when(F.endswith(name, F.lit(".pst")), "outlook").otherwise("unknown")
