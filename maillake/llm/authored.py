"""The text that a mail's sender wrote: lines of earlier messages, signatures and disclaimers told apart.

Structure (``mailtext``) decides the lines that carry marks. What it leaves
open goes through dictionaries from other mails: pieces of what other senders
wrote earlier in the thread, found by fingerprints of their words, the
closings that a sender repeats in several threads, and the footers that many
senders share. Open text that compresses abnormally well with its dictionary is
checked for exact overlaps, word by word and as long as they go; lines that
they cover aren't new. Only hashes are shuffled to find candidates; texts are
fetched for mails that have one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maillake.functions.instants import parse_instant
from maillake.functions.packed import bare
from maillake.llm import mailtext as M
from maillake.llm.entities import NameModel
from maillake.llm.pii import body_of
from maillake.operators.lookup import lookup
from maillake.session import materialise

#: Letters and digits that an overlap must have, and that a line must have to be looked up as a whole.
LEAST_SIGNS = 30
#: Share of its bytes that a dictionary must save for a piece of open text to be checked.
LEAST_GAIN = 0.4
#: Share of a line's letters and digits that overlaps must cover.
LEAST_COVER = 0.8
#: Words of a fingerprint, and fingerprints in a row of which the least one counts:
#: of every SHINGLE + WINDOW - 1 words that two mails share one fingerprint is found in both.
SHINGLE = 4
WINDOW = 4
#: Words that are compressed at a time, and bytes that a dictionary of zlib can have.
PIECE_WORDS = 200
ZLIB_WINDOW = 32_000
#: Threads in which a sender must repeat a line behind the closing words.
LEAST_THREADS = 3
#: Senders that must share a line for it to be a footer, the share of its mails in which it
#: stands in the last open paragraph, below other lines, and that in which there may be no other paragraph.
LEAST_SENDERS, LEAST_LAST, MOST_ALONE = 10, 0.98, 0.5
#: Mails or threads (16 bytes each) whose keys are sent to the executors; more are joined through the shuffle.
MOST_BROADCAST = 250_000

_REPLY_PREFIX = re.compile(r"^(?:\s*(?:re|fw|fwd|aw|wg|tr)\s*(?:\[\d+\])?\s*:)+", re.IGNORECASE)
_FOLD = re.compile(r"\r?\n[ \t]+")
_CLOSING = re.compile(r"\s*(?:thanks|thank you|best|regards|cheers|best regards|kind regards|sincerely|gru[ßs]s?|mit .{0,20}gr[üu][ßs]en|cordialement|saludos)\s*[,.!]?\s*$", re.IGNORECASE)
_KEY = re.compile(r"[\W_]+")
_WORDS = re.compile(r"[^\W_]+")
_MAIL_SCHEMA = (
    "tbl string, row_key string, digest bigint, marked array<bigint>, prints array<bigint>, thread string, sender string, at bigint, "
    "open array<struct<line_key:bigint,text:string,first:bigint,last:bigint,paragraph:bigint,closing:boolean,footer_key:bigint,last_part:boolean,alone:boolean>>"
)


def _header(block: str, name: str) -> str | None:
    m = re.search(rf"^{name}:[ \t]*([^\r\n]*)", block, re.IGNORECASE | re.MULTILINE)
    return m[1].strip() if m else None


def thread_of(subject: str | None) -> str | None:
    """Subject without reply marks, case and spacing; None if nothing is left."""
    if not subject:
        return None
    return re.sub(r"\s+", " ", _REPLY_PREFIX.sub("", subject)).strip().lower() or None


def _open_lines(lines: list[str], spans: list[tuple[int, int]], flags: list[str]) -> list[tuple]:
    """Lines that structure leaves open. Those behind closing words that may be a
    repeated closing have a ``line_key``, those that may be a shared footer a
    ``footer_key``; ``last_part``: it ends the mail below other lines, ``alone``: there
    is no other paragraph."""
    out, paragraph, closing = [], 0, False
    for line, (first, last), flag in zip(lines, spans, flags):
        if not line.strip():
            paragraph += 1
            continue
        if flag:
            continue
        key = None
        if _CLOSING.match(line):
            closing = True
        elif closing:
            signs = _KEY.sub("", line).lower()
            if len(signs) >= LEAST_SIGNS or len(line.split()) > 2:
                key = xxhash.xxh64_intdigest(signs) - (1 << 63)
        out.append((key, line, first, last, paragraph, closing))
    if not out:
        return out
    alone = out[0][4] == out[-1][4]
    return [(*o, _footer_key(o[1]), k > 0 and o[4] == out[-1][4], alone) for k, o in enumerate(out)]


def _footer_key(line: str) -> int | None:
    signs = _KEY.sub("", line).lower()
    return xxhash.xxh64_intdigest(signs) - (1 << 63) if len(signs) >= LEAST_SIGNS else None


def _words(lines: list[str]) -> tuple[list[str], list[int]]:
    """Words of the lines in lower case, and where each line's begin (and the end)."""
    words, starts = [], [0]
    for line in lines:
        words += _WORDS.findall(line.lower())
        starts.append(len(words))
    return words, starts


def _prints(words: list[str], starts: list[int]) -> list[tuple[int, int, int]]:
    """(hash, first word, words) of the fingerprints: the least of every WINDOW
    runs of SHINGLE words, wherever lines break, and of every line of LEAST_SIGNS."""
    out = []
    n = len(words) - SHINGLE + 1
    if n > 0:
        h = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
        runs = np.zeros(n, dtype=np.uint64)
        for k in range(SHINGLE):
            runs = runs * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
        runs = (runs ^ (runs >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        windows = max(1, n - WINDOW + 1)
        width = n - windows + 1
        least = runs[:windows]
        for k in range(1, width):
            least = np.minimum(least, runs[k : k + windows])
        chosen = np.zeros(n, dtype=bool)
        for k in range(width):
            chosen[k : k + windows] |= runs[k : k + windows] == least
        at = np.flatnonzero(chosen)
        out += [(x, k, SHINGLE) for x, k in zip(runs[at].view(np.int64).tolist(), at.tolist())]
    for a, z in zip(starts, starts[1:]):
        signs = "".join(words[a:z])
        if len(signs) >= LEAST_SIGNS:
            out.append((xxhash.xxh64_intdigest(signs) - (1 << 63), a, z - a))
    return out


def mark_structure(mails: DataFrame, names: NameModel) -> DataFrame:
    """Per mail: ``marked`` (physical lines that structure tells apart), its open
    lines with the fingerprints of their words (``prints``), and the ``digest`` of its text.

    ``mails``: tbl, row_key, text, is_message, subject, sender, dated. Null and
    empty bodies, and messages without body, have no lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for b in batches:
            rows = []
            for tbl, key, text, is_message, subject, sender, dated in zip(*(b.column(i).to_pylist() for i in range(7))):
                encoded = False
                if is_message:
                    body = body_of(text)
                    if body is not None:
                        block = _FOLD.sub(" ", text[: len(text) - len(body)])
                        encoded = (_header(block, "content-transfer-encoding") or "").lower() == "quoted-printable"
                        subject, sender, dated = _header(block, "subject"), _header(block, "from"), _header(block, "date")
                    text = body
                if not text:
                    continue
                lines, spans = M.logical_lines(text, encoded)
                flags = M.Structure(lines, names).flags
                physical = text.replace("\r\n", "\n").split("\n") if encoded else lines
                marked = [n for (a, z), f in zip(spans, flags) if f for n in range(a, z + 1) if physical[n - 1].strip()]
                opened = _open_lines(lines, spans, flags)
                thread, at = thread_of(subject), parse_instant(dated)[0]
                prints = [] if thread is None or at is None else list({p for p, _, _ in _prints(*_words([x[1] for x in opened]))})
                rows.append(
                    {
                        "tbl": tbl, "row_key": key, "digest": xxhash.xxh64_intdigest(text) - (1 << 63), "marked": marked,
                        "prints": prints, "thread": thread, "sender": bare(sender or ""), "at": at,
                        "open": [dict(zip(("line_key", "text", "first", "last", "paragraph", "closing", "footer_key", "last_part", "alone"), x)) for x in opened],
                    }
                )
            schema = schema or pa.schema(
                [
                    ("tbl", pa.string()), ("row_key", pa.string()), ("digest", pa.int64()), ("marked", pa.list_(pa.int64())), ("prints", pa.list_(pa.int64())), ("thread", pa.string()), ("sender", pa.string()), ("at", pa.int64()),
                    ("open", pa.list_(pa.struct([("line_key", pa.int64()), ("text", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("paragraph", pa.int64()), ("closing", pa.bool_()), ("footer_key", pa.int64()), ("last_part", pa.bool_()), ("alone", pa.bool_())]))),
                ]
            )
            yield pa.RecordBatch.from_pylist(rows, schema)

    return mails.select("tbl", "row_key", "text", "is_message", "subject", "sender", "dated").mapInArrow(run, _MAIL_SCHEMA)


def _gain(text: str, dictionary: str) -> float:
    """Share of the compressed text that the dictionary saves."""
    data = text.encode()
    plain = len(zlib.compress(data, 6))
    c = zlib.compressobj(6, zdict=dictionary.encode())
    return 1 - len(c.compress(data) + c.flush()) / plain


def _chunks(lines: list[str], wanted: dict[int, int]) -> list[dict]:
    """Of a source's open lines the words around each wanted fingerprint: so many
    that the pieces of a shared text, laid side by side, are all of it."""
    words, starts = _words(lines)
    out, seen = [], set()
    for p, at, size in _prints(words, starts):
        if p in wanted and p not in seen:
            seen.add(p)
            a = max(0, at - WINDOW - SHINGLE)
            out.append({"print": p, "offset": at - a, "words": " ".join(words[a : at + size + WINDOW + SHINGLE]), "n": wanted[p]})
    return out


def _overlapping(opened: list[dict], chunks: dict[int, tuple]) -> list[dict]:
    """first and last of the open lines that exact overlaps with the chunks cover;
    none if they are all lines: that mail is sent again, not an answer that holds it."""
    words, starts = _words([o["text"] for o in opened])
    hits = []
    # What the sender wrote first stays theirs, though another's mail may be the first with a fingerprint at its edge.
    own = np.zeros(len(words), dtype=bool)
    for p, at, size in _prints(words, starts):
        if p in chunks:
            offset, text, *mine = chunks[p]
            theirs = text.split(" ")
            if theirs[offset : offset + size] != words[at : at + size]:
                continue
            a, i = at, offset
            while a and i and words[a - 1] == theirs[i - 1]:
                a, i = a - 1, i - 1
            z, i = at + size, offset + size
            while z < len(words) and i < len(theirs) and words[z] == theirs[i]:
                z, i = z + 1, i + 1
            if any(mine):
                own[a:z] = True
            else:
                hits.append((a, z, text))
    if not hits:
        return []
    hits.sort()
    # Words of the maximal overlaps; too short ones prove nothing.
    covered = np.zeros(len(words), dtype=bool)
    runs: list[list[int]] = []
    for a, z, _ in hits:
        if runs and a < runs[-1][1]:
            runs[-1][1] = max(z, runs[-1][1])
        else:
            runs.append([a, z])
    for a, z in runs:
        covered[a:z] = sum(map(len, words[a:z])) >= LEAST_SIGNS
    covered &= ~own
    # Each piece of the touched lines of a paragraph must compress with the chunks that touch it.
    touched = [bool(covered[a:z].any()) for a, z in zip(starts, starts[1:])]
    first_hit = 0
    k = 0
    while k < len(opened):
        if not touched[k]:
            k += 1
            continue
        end = k + 1
        while end < len(opened) and touched[end] and opened[end]["paragraph"] == opened[k]["paragraph"]:
            end += 1
        for a in range(starts[k], starts[end], PIECE_WORDS):
            z = min(a + PIECE_WORDS, starts[end])
            while first_hit < len(hits) and hits[first_hit][1] <= a:
                first_hit += 1
            near = dict.fromkeys(t for x, y, t in _until(hits, first_hit, z) if y > a)
            dictionary = " ".join(near)
            # A dictionary of giant words that zlib can't hold decides nothing; the overlap alone does.
            if len(dictionary.encode()) <= ZLIB_WINDOW and _gain(" ".join(words[a:z]), dictionary) < LEAST_GAIN:
                covered[a:z] = False
        k = end
    found = []
    for a, z in zip(starts, starts[1:]):
        signs = sum(map(len, words[a:z]))
        found.append(None if not signs else sum(len(words[i]) for i in range(a, z) if covered[i]) >= LEAST_COVER * signs)
    if all(f is not False for f in found):
        return []
    # A line without words, such as a rule, goes with the lines around it.
    out = [o for k, (o, f) in enumerate(zip(opened, found)) if f or (f is None and 0 < k < len(found) - 1 and found[k - 1] and found[k + 1])]
    return [{"first": o["first"], "last": o["last"]} for o in out]


def _until(hits: list[tuple], k: int, end: int) -> Iterator[tuple]:
    while k < len(hits) and hits[k][0] < end:
        yield hits[k]
        k += 1


def _history(marks: DataFrame) -> DataFrame:
    """tbl, row_key, digest, first, last: open lines that another sender wrote earlier in the thread.

    Fingerprints are joined by (thread, fingerprint), hot ones by broadcast, and
    only what they hit is fetched: no thread is ever joined with itself. A row
    that comes twice is one mail.
    """
    spark = marks.sparkSession
    marks = marks.withColumn("mail", F.xxhash64("tbl", "row_key", "digest"))
    mails = marks.where("size(prints) > 0").select("mail", F.xxhash64("tbl", "thread").alias("thread_key"), F.xxhash64("sender").alias("writer"), "at", "prints")
    # Only threads, and then fingerprints, that several senders have can hold history.
    threads = mails.groupBy("thread_key").agg(F.count("*").alias("n"), F.min("writer").alias("a"), F.max("writer").alias("z"))
    threads = materialise(spark, threads.where("a <> z").select("thread_key"), "threads")
    each = _only(mails, threads, "thread_key").select("mail", "thread_key", "writer", "at", F.explode("prints").alias("print"))
    each = each.select("mail", "writer", "at", "print", F.xxhash64("thread_key", "print").alias("place"))
    first = each.groupBy("place").agg(F.min(F.struct("at", "writer", "mail")).alias("o"), F.count("*").alias("n"), F.min("writer").alias("a"), F.max("writer").alias("z"))
    first = first.where("a <> z").select("place", F.col("o.at").alias("origin_at"), F.col("o.writer").alias("origin"), F.col("o.mail").alias("source"), "n")
    origins = materialise(spark, first, "origins")
    shared = materialise(spark, origins.select("place"), "shared")
    hits = lookup(_only(each, shared, "place"), origins, ["place"]).where("origin_at < at").select("mail", "print", "source", F.expr("origin = writer").alias("mine")).distinct()
    hits = materialise(spark, hits, "hits")

    line = "array<struct<first:bigint,last:bigint>>"

    @F.pandas_udf("array<struct<print:bigint,offset:bigint,words:string,n:bigint>>")
    def chunks(opened, wanted):
        import pandas as pd

        return pd.Series([_chunks([o["text"] for o in os], {w["print"]: w["n"] for w in ws}) for os, ws in zip(opened, wanted)], dtype=object)

    @F.pandas_udf(line)
    def overlapping(opened, known):
        import pandas as pd

        return pd.Series([_overlapping(list(os), {c["print"]: (c["offset"], c["words"], c["mine"]) for c in cs}) for os, cs in zip(opened, known)], dtype=object)

    wanted = hits.groupBy("source", "print").agg(F.count("*").alias("n")).groupBy("source").agg(F.collect_list(F.struct("print", "n")).alias("wanted"))
    needed = materialise(spark, hits.select("mail").union(hits.select("source")).distinct(), "needed")
    texts = _only(marks, needed, "mail").select("tbl", "row_key", "digest", "mail", F.transform("open", lambda o: F.struct(o["text"].alias("text"), o["first"].alias("first"), o["last"].alias("last"), o["paragraph"].alias("paragraph"))).alias("open"))
    # Written once: the mails that are looked at twice, as source and as what may hold history.
    texts = materialise(spark, texts, "texts")
    pieces = texts.join(wanted, texts["mail"] == wanted["source"]).select("source", F.explode(chunks("open", "wanted")).alias("c")).select("source", "c.*")
    pieces = pieces.groupBy("source", "print").agg(F.max("n").alias("n"), F.min(F.struct("offset", "words")).alias("c"))
    known = lookup(hits, materialise(spark, pieces, "pieces"), ["source", "print"]).where("c IS NOT NULL")
    known = known.groupBy("mail").agg(F.collect_list(F.struct("print", "c.offset", "c.words", "mine")).alias("known"))
    return texts.join(known, "mail").select("tbl", "row_key", "digest", F.explode(overlapping("open", "known")).alias("l")).select("tbl", "row_key", "digest", "l.*")


def _repeated_closings(marks: DataFrame) -> DataFrame:
    """tbl, row_key, digest, first, last: lines that the sender repeats behind the closing words of several threads."""
    lines = marks.where("sender <> ''").select("tbl", "row_key", "digest", "thread", "sender", F.explode("open").alias("o")).where("o.line_key IS NOT NULL").select("tbl", "row_key", "digest", "thread", "sender", "o.*")
    repeated = lines.groupBy("tbl", "sender", "line_key").agg(F.approx_count_distinct("thread").alias("threads"), F.count("*").alias("n"), F.lit(True).alias("repeated"))
    repeated = repeated.where(F.col("threads") >= LEAST_THREADS).drop("threads")
    return lookup(lines, repeated, ["tbl", "sender", "line_key"]).where("repeated").select("tbl", "row_key", "digest", "first", "last")


def _shared_footers(marks: DataFrame) -> DataFrame:
    """tbl, row_key, digest, first, last: lines at the end of mails that many
    senders share word by word: footers and disclaimers, learned from the corpus."""
    lines = marks.select("tbl", "row_key", "digest", F.xxhash64("sender").alias("writer"), F.explode("open").alias("o")).where("o.footer_key IS NOT NULL")
    lines = lines.select("tbl", "row_key", "digest", "writer", F.col("o.footer_key").alias("footer_key"), F.col("o.last_part").cast("int").alias("last_part"), F.col("o.alone").cast("int").alias("alone"), F.col("o.first").alias("first"), F.col("o.last").alias("last"))
    shared = lines.groupBy("footer_key").agg(F.approx_count_distinct("writer").alias("writers"), F.avg("last_part").alias("last_part"), F.avg("alone").alias("alone"), F.count("*").alias("n"))
    shared = shared.where((F.col("writers") >= LEAST_SENDERS) & (F.col("last_part") >= LEAST_LAST) & (F.col("alone") <= MOST_ALONE)).select("footer_key", "n", F.lit(True).alias("shared"))
    shared = materialise(marks.sparkSession, shared, "footers")
    return lookup(_only(lines, shared.select("footer_key"), "footer_key").drop("last_part", "alone", "writer"), shared, ["footer_key"]).where("shared").select("tbl", "row_key", "digest", "first", "last")


def _only(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is among ``keys`` (one column, written before). Keys are
    broadcast up to MOST_BROADCAST of them, whose size is thereby bounded;
    beyond that both sides meet through the shuffle. The rows are the same."""
    few = keys.count() <= MOST_BROADCAST
    return rows.join(F.broadcast(keys) if few else keys, key, "left_semi")


def sources(marks: DataFrame) -> dict[str, DataFrame]:
    """By the kind of their dictionary, open lines that it proves not new: tbl, row_key, digest, first, last."""
    return {"history": _history(marks), "closings": _repeated_closings(marks), "footers": _shared_footers(marks)}


def known_elsewhere(marks: DataFrame) -> DataFrame:
    """tbl, row_key, digest, first, last: open lines that the dictionaries prove not new."""
    return reduce(DataFrame.unionByName, sources(marks).values())


def _lines_of_others(mails: DataFrame, names: NameModel) -> DataFrame:
    """tbl, row_key, digest, line_no; a key that stands before several texts has lines for each."""
    marks = materialise(mails.sparkSession, mark_structure(mails, names), "marks")
    by_structure = marks.select("tbl", "row_key", "digest", F.explode("marked").alias("line_no"))
    by_others = known_elsewhere(marks).select("tbl", "row_key", "digest", F.explode(F.sequence("first", "last")).alias("line_no"))
    return by_structure.unionByName(by_others)


def not_own_lines(mails: DataFrame, names: NameModel) -> DataFrame:
    """tbl, row_key, line_no of every non-blank line not newly written by the sender."""
    return _lines_of_others(mails, names).drop("digest").distinct()


def own_texts(mails: DataFrame, names: NameModel) -> DataFrame:
    """tbl, row_key, new_text of every mail: its body without the lines of ``not_own_lines``,
    the others as they stand, in order. Null stays null, empty stays empty, and a
    message without body has null."""

    @F.pandas_udf("struct<body:string,digest:bigint>")
    def bodies(texts, messages):
        import pandas as pd

        found = [body_of(t) if m else t for t, m in zip(texts, messages)]
        return pd.DataFrame({"body": pd.Series(found, dtype=object), "digest": pd.Series([xxhash.xxh64_intdigest(x) - (1 << 63) if x else None for x in found], dtype="Int64")})

    @F.pandas_udf("string")
    def without(texts, gone):
        import pandas as pd

        out = []
        for text, lines in zip(texts, gone):
            if text and lines is not None:
                drop = set(lines)
                text = "\n".join(x for n, x in enumerate(text.split("\n"), 1) if n not in drop)
            out.append(text)
        return pd.Series(out, dtype=object)

    # One key for the join, which a null row_key has too.
    key = F.xxhash64("tbl", F.coalesce("row_key", F.lit("")), "digest").alias("mail")
    gone = _lines_of_others(mails, names).groupBy(key).agg(F.collect_set("line_no").alias("gone"))
    held = mails.select("tbl", "row_key", bodies("text", "is_message").alias("b")).select("tbl", "row_key", "b.*").select("tbl", "row_key", "body", key)
    return held.join(gone, "mail", "left").select("tbl", "row_key", without("body", "gone").alias("new_text"))


def archive_mails(raw_emails: DataFrame, emails: DataFrame) -> DataFrame:
    """The mails of the archive in the form that ``not_own_lines`` takes; what comes twice counts once."""
    none = F.lit(None).cast("string")
    raw = raw_emails.select(F.lit("raw_emails").alias("tbl"), F.col("file").alias("row_key"), F.col("message").alias("text"), F.lit(True).alias("is_message"), none.alias("subject"), none.alias("sender"), none.alias("dated"))
    loaded = emails.select(
        F.lit("emails").alias("tbl"), F.col("message_id").alias("row_key"), F.col("body_clean").alias("text"), F.lit(False).alias("is_message"), "subject", "sender", F.col("sent_at_header").alias("dated")
    )
    return raw.unionByName(loaded)


def new_text(df: DataFrame, column: str, names: NameModel, out: str = "new_text") -> DataFrame:
    """``df`` plus ``out``: the text without the lines that structure tells apart,
    in order, line ends as they were. Null stays null, empty stays empty.

    For texts without headers and thread; mails of an archive go through ``own_texts``.
    """

    @F.pandas_udf("string")
    def run(texts):
        import pandas as pd

        def own(text):
            if not text:
                return text
            lines = text.split("\n")
            flags = M.Structure([x.removesuffix("\r") for x in lines], names).flags
            return "\n".join(x for x, f in zip(lines, flags) if not f)

        return pd.Series([own(t) for t in texts], dtype=object)

    return df.withColumn(out, run(F.col(column)))
