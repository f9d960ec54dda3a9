"""Repetition inside single documents: shares of repeated content.

Rolling hashes of word n-grams of several lengths, in numpy: a run of n words
that began earlier in the document marks its words (and their characters) as
repeated. Runs that share a hash are compared word by word, so no collision counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Runs of letters and digits.
WORD = re.compile(r"[^\W_]+")
LENGTHS = (2, 3, 5, 10)
RUN = 5
LEAST_SHARE = 0.3
#: Words that are hashed and sorted at once.
CHUNK_WORDS = 400_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_APART = np.uint64(0xC2B2AE3D27D4EB4F)


def repeated_words(ids: np.ndarray, n: int, doc: np.ndarray | None = None) -> np.ndarray:
    """Which words lie in a run of ``n`` words that began earlier too.

    ``ids``: equal numbers for equal words. ``doc``: the document of each word,
    ascending; runs lie within one document. Runs may overlap.
    """
    m = len(ids) - n + 1
    if m < 2:
        return np.zeros(len(ids), bool)
    doc = np.zeros(len(ids), np.int64) if doc is None else doc
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = h * _BASE + ids[k : k + m].astype(np.uint64) + np.uint64(1)
    h ^= (doc[:m].astype(np.uint64) + np.uint64(1)) * _APART
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    order = np.argsort(h[at], kind="stable")
    sorted_h = h[at][order]
    new = np.flatnonzero(np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]])) if len(at) else order
    origin = np.empty(len(at), np.int64)
    origin[order] = np.repeat(at[order[new]], np.diff(np.append(new, len(at))))
    again, first = at[origin < at], origin[origin < at]
    same = doc[again] == doc[first]
    for k in range(n):
        same &= ids[again + k] == ids[first + k]
    if not same.all():  # a collision: the runs are compared exactly
        seen: dict[tuple, int] = {}
        again = np.array([i for i in at.tolist() if seen.setdefault((doc[i], *ids[i : i + n].tolist()), i) < i], np.int64)
    edges = np.zeros(len(ids) + 1, np.int64)
    edges[: m] += np.bincount(again, minlength=m)
    edges[n : n + m] -= np.bincount(again, minlength=m)
    return np.cumsum(edges[:-1]) > 0


def _line_share(text: str) -> float:
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    seen: set[str] = set()
    again = 0
    for x in lines:
        if x in seen:
            again += len(x)
        else:
            seen.add(x)
    return again / sum(map(len, lines)) if lines else 0.0


def measure_all(texts: list[str | None]) -> list[dict | None]:
    """Shares of repeated words, characters and lines of each text; None for null.

    A text without words has no repeated share (0). Many texts are measured
    together, so short ones cost no more than their words.
    """
    out: list[dict | None] = []
    k = 0
    while k < len(texts):
        words: list[str] = []
        counts: list[int] = []
        first = k
        while k < len(texts) and len(words) < CHUNK_WORDS:
            own = WORD.findall(texts[k]) if texts[k] else []
            words += own
            counts.append(len(own))
            k += 1
        numbers: dict[str, int] = {}
        ids = np.array([numbers.setdefault(w.lower(), len(numbers)) for w in words], np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        doc = np.repeat(np.arange(len(counts)), counts)
        total = np.bincount(doc, weights=size, minlength=len(counts))
        shares, repeated = {}, None
        for n in LENGTHS:
            mask = repeated_words(ids, n, doc)
            chars = np.bincount(doc[mask], weights=size[mask], minlength=len(counts))
            shares[n] = np.divide(chars, total, out=np.zeros(len(counts)), where=total > 0)
            if n == RUN:
                repeated = np.bincount(doc[mask], minlength=len(counts))
        for i, text in enumerate(texts[first:k]):
            if text is None:
                out.append(None)
                continue
            row = {"n_words": counts[i], "n_repeated": int(repeated[i]), "line_chars": _line_share(text)}
            out.append(row | {f"chars_{n}": float(shares[n][i]) for n in LENGTHS})
    return out


def measure(text: str | None) -> dict | None:
    return measure_all([text])[0]


SHARE_COLUMNS = ["n_words", "n_repeated", *(f"chars_{n}" for n in LENGTHS), "line_chars"]


def repetition(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and the repetition of ``text`` for every row of ``df``.

    n_words, n_repeated (words in repeated runs of five), ``repeated_share``
    of the words, chars_n (share of the words' characters in repeated runs of n
    words) and line_chars (share of the characters in lines that came before).
    Null text gives nulls; empty and blank text give zeros.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = measure_all(b.column(1).to_pylist())
            cols = [pa.array([None if g is None else g[c] for g in got], pa.int64() if c.startswith("n_") else pa.float64()) for c in SHARE_COLUMNS]
            share = pa.array([None if g is None else g["n_repeated"] / g["n_words"] if g["n_words"] else 0.0 for g in got], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, share], [key, *SHARE_COLUMNS, "repeated_share"])

    types = ", ".join(f"{c} {'bigint' if c.startswith('n_') else 'double'}" for c in SHARE_COLUMNS)
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, {types}, repeated_share double")


def repetitive(df: DataFrame, key: str, text: str, share: float = LEAST_SHARE) -> DataFrame:
    """``key`` of the rows of which at least ``share`` of the words are repeated."""
    measured = repetition(df, key, text)
    # In whole numbers: 3 of 10 words are 30 %.
    return measured.where((measured.n_words > 0) & (measured.n_repeated * 1000 >= measured.n_words * round(share * 1000))).select(key)
