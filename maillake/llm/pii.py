"""Personal information in free text: found, replaced by placeholders or by keyed surrogates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maillake.llm import entities as E
from maillake.llm import surrogates as S
from maillake.operators.lookup import lookup
from maillake.session import materialise

#: Most given and most family names, each counted once, of the directory that are sent to the executors.
MAX_NAMES = 1_000_000
_BREAK = re.compile(r"\r?\n\r?\n")
ENTITY_SCHEMA = "tbl string, row_key string, kind string, found_text string, canon string, n bigint"


def name_model(people: DataFrame, limit: int = MAX_NAMES) -> E.NameModel:
    """Names of the directory (given_name, family_name); nulls are left out.

    The distinct names are sent to every executor, so their number is checked;
    it grows far slower than that of people. More than ``limit`` given or
    family names raise, as names left out would leave people in the texts.
    """
    held = []
    for column in ("given_name", "family_name"):
        rows = people.select(F.lower(column)).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"{column} has more than {limit} distinct names")
        held.append([r[0] for r in rows if r[0]])
    return E.NameModel(*held)


def body_of(message: str | None) -> str | None:
    """The message after its first empty line; None without one."""
    if message is None:
        return None
    if message[:1] == "\n":
        return message[1:]
    if message[:2] == "\r\n":
        return message[2:]
    m = _BREAK.search(message)
    return message[m.end() :] if m else None


def find_entities(texts: DataFrame, names: E.NameModel) -> DataFrame:
    """One row per distinct entity text of each row of ``texts`` (tbl, row_key,
    text, is_message): kind, found_text exactly as it stands, canon (what its
    spellings share) and n, how often it occurs there.

    Of messages (``is_message``) only the body counts. Null and empty texts,
    and messages without body, have none; a repeated row gives its entities again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for tbl, key, text, is_message in zip(*(b.column(i).to_pylist() for i in range(4))):
                if is_message:
                    text = body_of(text)
                seen: dict[tuple[str, str, str], int] = {}
                for f in E.find(text or "", names):
                    what = (f.kind, text[f.start : f.end], f.canon)
                    seen[what] = seen.get(what, 0) + 1
                for (kind, found, canon), n in seen.items():
                    for c, v in zip(cols, (tbl, key, kind, found, canon, n)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.string()) for c in cols[:5]), pa.array(cols[5], pa.int64())], ["tbl", "row_key", "kind", "found_text", "canon", "n"]
            )

    return texts.select("tbl", "row_key", "text", "is_message").mapInArrow(run, ENTITY_SCHEMA)


def surrogate_parts(parts: DataFrame, key: bytes) -> DataFrame:
    """cls, part, chosen, n of the distinct parts of entities (cls, part, n).

    Collision check over the whole corpus: a surrogate that two parts of a class
    got, or that is a real part itself, is drawn again under the next tweak for
    all but the first of them, until none is left; longer words make room.
    """
    spark = parts.sparkSession

    def draw(attempt: int):
        @F.pandas_udf("string")
        def chosen(cls, part):
            return cls.combine(part, lambda c, p: S.draw(c, p, key, attempt))

        return chosen(F.col("cls"), F.col("part"))

    table = materialise(spark, parts.withColumn("chosen", draw(0)), "surrogates")
    real = table.where(F.col("cls").isin(*S.CHECKED)).select("cls", F.col("part").alias("chosen"))
    attempt = 0
    while True:
        attempt += 1
        shared = table.where("cls <> 'number'").groupBy("cls", "chosen").agg(F.count("*").alias("c"), F.min("part").alias("first")).where("c > 1").drop("c")
        clash = table.join(shared, ["cls", "chosen"]).where("part <> first").select("cls", "part")
        taken = table.join(real, ["cls", "chosen"], "left_semi").select("cls", "part")
        again = materialise(spark, clash.union(taken).distinct(), "clashes")
        if again.isEmpty():
            return table
        redone = table.join(again, ["cls", "part"], "left_semi").withColumn("chosen", draw(attempt))
        table = materialise(spark, table.join(again, ["cls", "part"], "left_anti").unionByName(redone), "surrogates")


def surrogate_table(found: DataFrame, key: bytes) -> DataFrame:
    """kind, canon, chosen, n of every distinct entity of ``found``: put together from
    the checked surrogates of its parts, so what shares a part shares its surrogate."""
    spark = found.sparkSession
    distinct = materialise(spark, found.groupBy("kind", "canon").agg(F.sum("n").alias("n")), "distinct")

    @F.pandas_udf("array<struct<cls:string,part:string>>")
    def split(kind, canon):
        return kind.combine(canon, S.parts_of)

    @F.pandas_udf("string")
    def compose(kind, canon, chosen):
        import pandas as pd

        return pd.Series([S.compose(k, c, [x["chosen"] for x in parts]) for k, c, parts in zip(kind, canon, chosen)], dtype=object)

    at = materialise(spark, distinct.select("kind", "canon", F.posexplode(split("kind", "canon")).alias("pos", "p")).select("kind", "canon", "pos", "p.*"), "parts")
    drawn = surrogate_parts(at.groupBy("cls", "part").agg(F.count("*").alias("n")), key)
    whole = lookup(at, drawn, ["cls", "part"]).groupBy("kind", "canon").agg(F.sort_array(F.collect_list(F.struct("pos", "chosen"))).alias("parts"))
    return distinct.join(whole, ["kind", "canon"]).select("kind", "canon", compose("kind", "canon", "parts").alias("chosen"), "n")


def with_surrogates(found: DataFrame, key: bytes) -> DataFrame:
    """``found`` plus ``surrogate``: the replacement written as the text was."""
    found = materialise(found.sparkSession, found, "entities")
    chosen = lookup(found, surrogate_table(found, key), ["kind", "canon"])

    @F.pandas_udf("string")
    def write(kind, text, canon, new):
        import pandas as pd

        return pd.Series([S.write_like(*x) for x in zip(kind, text, canon, new)], dtype=object)

    return chosen.withColumn("surrogate", write("kind", "found_text", "canon", "chosen")).drop("chosen")


def _known_surrogates(texts: DataFrame, names: E.NameModel, key: bytes) -> DataFrame:
    """row_key, known: of each distinct text (tbl, row_key, text, is_message) the chosen surrogates of its entities."""
    found = materialise(texts.sparkSession, find_entities(texts, names), "entities")
    chosen = lookup(found.select("row_key", "kind", "canon").distinct(), surrogate_table(found, key), ["kind", "canon"])
    return chosen.groupBy("row_key").agg(F.collect_list(F.struct("kind", "canon", "chosen")).alias("known"))


def redact(df: DataFrame, column: str, names: E.NameModel, key: bytes | None = None, out: str = "redacted", is_message: bool | Column = False) -> DataFrame:
    """``df`` plus ``out``: the text with each mention replaced, the rest unchanged.

    Without ``key`` the replacement is the placeholder of the type
    (``<EMAIL>``); with it the keyed surrogate that ``surrogate_table`` chose,
    checked for collisions over all texts of ``df``. Null stays null, empty
    stays empty. Of messages (``is_message``, one value or a column) only the
    body is changed.
    """
    message = is_message if isinstance(is_message, Column) else F.lit(is_message)

    def rewrite(text: str | None, is_message: bool, new) -> str | None:
        if text is None:
            return None
        body = body_of(text) if is_message else text
        head = text[: len(text) - len(body)] if body is not None else text
        parts, at = [head], 0
        for f in E.find(body or "", names):
            parts += [body[at : f.start], new(f, body[f.start : f.end])]
            at = f.end
        parts.append((body or "")[at:])
        return "".join(parts)

    @F.pandas_udf("string")
    def placeholders(texts, messages):
        import pandas as pd

        return pd.Series([rewrite(t, m, lambda f, was: E.PLACEHOLDERS[f.kind]) for t, m in zip(texts, messages)], dtype=object)

    @F.pandas_udf("string")
    def surrogates(texts, messages, known):
        import pandas as pd

        done = []
        for t, m, k in zip(texts, messages, known):
            chosen = {(x["kind"], x["canon"]): x["chosen"] for x in k} if k is not None else {}
            done.append(rewrite(t, m, lambda f, was: S.write_like(f.kind, was, f.canon, chosen[f.kind, f.canon])))
        return pd.Series(done, dtype=object)

    if key is None:
        return df.withColumn(out, placeholders(F.col(column), message))
    # By the text itself, as rows need no key; repeated texts are looked at once.
    rows = df.withColumns({"_mk_is_message": message, "_mk_text": F.when(message, F.sha2(F.concat(F.lit("m"), column), 256)).otherwise(F.sha2(F.col(column), 256))})
    texts = rows.where("_mk_text IS NOT NULL").groupBy(F.col("_mk_text").alias("row_key")).agg(F.min(column).alias("text"), F.first("_mk_is_message").alias("is_message"), F.count("*").alias("n"))
    known = _known_surrogates(texts.withColumn("tbl", F.lit("")), names, key)
    known = known.join(texts.select("row_key", "n"), "row_key").withColumnsRenamed({"row_key": "_mk_text", "known": "_mk_known"})
    joined = lookup(rows, known, ["_mk_text"])
    done = joined.withColumn(out, surrogates(F.col(column), F.col("_mk_is_message"), F.col("_mk_known")))
    return done.select(*df.columns, *([] if out in df.columns else [out]))


def archive_texts(raw_emails: DataFrame, emails: DataFrame) -> DataFrame:
    """The texts of the archive in the form that ``find_entities`` takes."""
    of = lambda df, tbl, key, text, m: df.select(F.lit(tbl).alias("tbl"), F.col(key).alias("row_key"), F.col(text).alias("text"), F.lit(m).alias("is_message"))
    return of(raw_emails, "raw_emails", "file", "message", True).unionByName(of(emails, "emails", "message_id", "body_clean", False))
