"""Encoding of a corpus with a public tokenizer, through a table of its distinct words.

Spark splits the texts into words by the tokenizer's own pattern; each distinct
word is encoded once; ids come back by position. Frequent words are looked up
by broadcast - a bounded table that covers nearly all positions - and only the
positions of rare words go through the shuffle. Decoding joins ids with pieces.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from maillake.operators.lookup import lookup
from maillake.session import materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern of the byte-level vocabularies, for Java (white space as in Unicode).
WORD_PATTERN = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for the encoder.
ENCODER_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Words of the broadcast table and the longest of them: at most some 10 MB.
FREQUENT_WORDS, LONGEST_FREQUENT = 65_536, 48


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    return tiktoken.Encoding("corpus", pat_str=ENCODER_PATTERN, mergeable_ranks=ranks(path), special_tokens={})


def _encode_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(path)._encode_single_piece
        for b in batches:
            ids = [one(w) for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("word").cast(pa.string()), b.column("n").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "word_ids"])

    return run


def words_of(column: str):
    return F.regexp_extract_all(F.col(column), F.lit(WORD_PATTERN), F.lit(0))


def word_table(df: DataFrame, text: str, path: str = TOKENIZER) -> DataFrame:
    """word, n (how often it occurs), word_ids of every distinct word of the corpus."""
    counted = df.where(F.col(text).isNotNull()).select(F.explode(words_of(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return materialise(df.sparkSession, counted.mapInArrow(_encode_words(path), "word string, n bigint, word_ids array<int>"), "words")


def frequent_words(table: DataFrame, most: int = FREQUENT_WORDS) -> tuple[pa.Array, pa.ListArray]:
    """The most frequent words and their ids: ``most`` rows at the most."""
    rows = table.where(F.length("word") <= LONGEST_FREQUENT).orderBy(F.desc("n"), "word").select("word", "word_ids").limit(most).collect()
    return pa.array([r["word"] for r in rows], pa.string()), pa.array([r["word_ids"] for r in rows], pa.list_(pa.int32()))


def _look_up(words: pa.ListArray, known: pa.Array, known_ids: pa.ListArray) -> tuple[pa.ListArray, pa.ListArray]:
    """Per text the ids of its known words, and its other words with their place
    among the words (pos) and among these ids (at). Null texts have neither."""
    counts = pc.fill_null(words.value_lengths(), 0).to_numpy()
    start = np.concatenate([[0], np.cumsum(counts)])
    values = words.flatten()
    codes = pc.index_in(values, value_set=known)
    ids = known_ids.take(codes)
    size = np.concatenate([[0], np.cumsum(pc.fill_null(ids.value_lengths(), 0).to_numpy())])
    flat = pa.ListArray.from_arrays(pa.array(size[start], pa.int32()), ids.flatten())
    other = np.flatnonzero(pc.is_null(codes).to_numpy(zero_copy_only=False))
    text = np.searchsorted(start, other, "right") - 1
    places = pa.StructArray.from_arrays(
        [pa.array(other - start[text], pa.int32()), pa.array(size[other] - size[start[text]], pa.int32()), values.take(pa.array(other)).cast(pa.string())], ["pos", "at", "word"]
    )
    return flat, pa.ListArray.from_arrays(pa.array(np.searchsorted(other, start), pa.int32()), places)


def encode(df: DataFrame, text: str, out: str = "ids", path: str = TOKENIZER, frequent: int = FREQUENT_WORDS) -> DataFrame:
    """``df`` plus ``out``: the token ids of ``text`` without special tokens.

    Null and empty texts get the empty list. Every row is encoded whole,
    repeated rows each; a column named ``out`` is replaced, other columns stay.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c != out]
    table = word_table(df, text, path)
    known = spark.sparkContext.broadcast(frequent_words(table, frequent))

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, rare = _look_up(b.column(len(kept)), *known.value)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), flat, rare], [*kept, "_mk_flat", "_mk_rare"])

    split = df.select(*kept, words_of(text).alias("_mk_words"))
    schema = StructType([*split.schema.fields[: len(kept)]]).add("_mk_flat", ArrayType(IntegerType())).add("_mk_rare", ArrayType(StructType().add("pos", IntegerType()).add("at", IntegerType()).add("word", StringType())))
    rows = split.mapInArrow(first_pass, schema)
    # Written once, so the row numbers stay the same for all that follows.
    rows = materialise(spark, rows.withColumn("_mk_row", F.monotonically_increasing_id()), "encoded")
    done = rows.where(F.size("_mk_rare") == 0).select(*kept, F.col("_mk_flat").alias(out))
    open_ = rows.where(F.size("_mk_rare") > 0)
    positions = open_.select("_mk_row", F.explode("_mk_rare").alias("r")).select("_mk_row", F.col("r.at").alias("at"), F.col("r.pos").alias("pos"), F.col("r.word").alias("word"))
    found = lookup(positions, table, ["word"]).groupBy("_mk_row").agg(F.sort_array(F.collect_list(F.struct("pos", "at", "word_ids"))).alias("_mk_found"))

    @F.pandas_udf("array<int>")
    def second_pass(flat, found):
        import pandas as pd

        out = []
        for ids, rare in zip(flat, found):
            parts, at = [], 0
            for r in rare:
                parts += [ids[at : r["at"]], np.asarray(r["word_ids"], np.int32)]
                at = r["at"]
            out.append(np.concatenate([*parts, ids[at:]]).astype(np.int32))
        return pd.Series(out)

    filled = open_.drop("_mk_rare").join(found, "_mk_row").withColumn(out, second_pass("_mk_flat", "_mk_found")).select(*kept, out)
    return done.unionByName(filled)


def piece_table(spark: SparkSession, path: str = TOKENIZER) -> DataFrame:
    """id, piece (hex of its bytes): as many rows as the vocabulary."""
    return spark.createDataFrame([(i, p.hex()) for p, i in ranks(path).items()], "id int, piece string")


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str = TOKENIZER) -> DataFrame:
    """``df`` plus ``out``: the text of the ids, by a join with the pieces.

    Null gives null, the empty list the empty text; the vocabulary is broadcast
    (a fixed size). Unknown ids are left out; bytes that aren't UTF-8 become
    replacement characters.
    """
    rows = materialise(df.sparkSession, df.withColumn("_mk_row", F.monotonically_increasing_id()), "to-decode")
    at = rows.select("_mk_row", F.posexplode(ids).alias("pos", "id"))
    named = at.join(F.broadcast(piece_table(df.sparkSession, path)), "id")
    texts = named.groupBy("_mk_row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "").alias("_mk_hex"))
    text = F.when(F.col(ids).isNotNull(), F.decode(F.unhex(F.coalesce("_mk_hex", F.lit(""))), "UTF-8"))
    kept = [c for c in df.columns if c != out]
    return rows.join(texts, "_mk_row", "left").select(*kept, text.alias(out))
