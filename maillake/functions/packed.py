"""Dialects of packed fields and their description length (pure Python, per string)."""

from __future__ import annotations

import math
import re
from hashlib import blake2b
from typing import NamedTuple

ADDRESS = re.compile(r"[^\s<>\"'(),;:|/&]+@[^\s<>\"'(),;:|/&]+")
_LABEL = re.compile(r"\s*[^\W\d_][\w .\-]*:\s+(?=\S)")
_SIGN = re.compile(r'(?P<Q>"[^"]*")|(?P<A>[^\s<>"\'(),;:|/&]+@[^\s<>"\'(),;:|/&]+)|(?P<W>\w+)|(?P<S>\s)|(?P<P>.)', re.DOTALL)

#: (name, delimiter pattern, signs one of which a text needs for it, bits of choosing it).
DELIMITERS = [
    ("comma", r",", ",", 3.0),
    ("semicolon", r";", ";", 3.0),
    ("bar", r"\|", "|", 3.0),
    ("slash", r"/", "/", 3.5),
    ("ampersand", r"&", "&", 3.5),
    ("and", r"\s+and\s+", " \t\n", 3.5),
    ("tab", r"\t", "\t", 3.0),
    ("line", r"\r?\n", "\n", 3.0),
    ("space", r"\s+", " \t\n\r", 4.0),
    ("comma+semicolon", r"[,;]", ",;", 4.5),
    ("comma+semicolon+bar", r"[,;|]", ",;|", 5.5),
    ("semicolon+space", r"[;\s]+", "; \t\n\r", 6.0),
    ("all", r"[,;|/&\t\n]|\s+and\s+", ",;|/& \t\n", 7.0),
]
#: (name, pattern of what no delimiter splits, the sign that a text needs for it, bits of choosing
#: it). The first is tried always: with double quotes that protect, or that nothing has.
QUOTES = [
    ("double", r'"[^"]*"', "", 0.5),
    ("double, doubled inside", r'"(?:[^"]|"")*"', '""', 3.0),
    ("double, backslash", r'"(?:[^"\\]|\\.)*"|\\.', "\\", 3.0),
    ("single", r"'[^']*'", "'", 6.0),
    ("single, doubled inside", r"'(?:[^']|'')*'", "''", 8.0),
    ("single, backslash", r"'(?:[^'\\]|\\.)*'|\\.", "\\", 8.0),
    ("none", r"(?!)", '"', 6.0),
    ("none, backslash", r"\\.", "\\", 8.0),
]
_ESCAPES = {"doubled inside": re.compile(r"([\"'])\1"), "backslash": re.compile(r"\\(.)", re.DOTALL)}
_ESCAPED_QUOTES = re.compile(r"\\[\"']|([\"'])\1")


class Dialect(NamedTuple):
    """How a string is read: what delimits, what protects from it, how a quote inside is written."""

    name: str
    splitter: re.Pattern | None
    signs: str
    quote_sign: str
    escape: re.Pattern | None
    bits: float


DIALECTS = [Dialect("whole", None, "", "", None, 1.0)] + [
    Dialect(d if q == "double" else f"{d}, {q}", re.compile(rf"({protected})|({delimiter})", re.IGNORECASE | re.DOTALL), signs, sign, _ESCAPES.get(q.partition(", ")[2]), bits + more)
    for q, protected, sign, more in QUOTES
    for d, delimiter, signs, bits in DELIMITERS
]
FINEST = len(DELIMITERS)
#: Codes longer than this stand in the code table by their digest.
LONGEST = 64
EMPTY_ITEM_BITS = 1.0
SIGN_BITS = 4.0
#: Signs up to which an unknown code is cheaper to spell out by its signs than by its letters.
MANY_SIGNS = 14


def signature(item: str) -> str:
    """Value code of an item: A address, Q quoted text, W word, else the character.
    Quoted is also E: an address that isn't the item's other one, so no name of it."""
    signs = []
    for m in _SIGN.finditer(item.strip()):
        k = m.lastgroup
        if k == "Q" and "@" in m[0] and (quoted := ADDRESS.fullmatch(m[0][1:-1].strip())) and item.lower().count(quoted[0].lower()) < 2:
            k = "E"
        s = m[0] if k == "P" else " " if k == "S" else k
        if not (s == " " and signs and signs[-1] == " "):
            signs.append(s)
    return "".join(signs)


def code_of(sign: str) -> str:
    """What a value code is called in the code table: itself, or its digest and length."""
    return sign if len(sign) <= LONGEST else f"{blake2b(sign.encode(), digest_size=12).hexdigest()}:{len(sign)}"


def _length(code: str) -> int:
    head, colon, size = code.rpartition(":")
    return int(size) if colon and len(head) == 24 and size.isdigit() and int(size) > LONGEST else len(code)


def split(text: str, dialect: int) -> list[str]:
    """Raw items (with empty ones) of ``text`` in a dialect."""
    splitter = DIALECTS[dialect].splitter
    if splitter is None:
        return [text]
    items, start = [], 0
    for m in splitter.finditer(text):
        if m[2] is not None:
            items.append(text[start : m.start()])
            start = m.end()
    items.append(text[start:])
    return items


def without_label(item: str) -> str:
    """``label: rest`` of a group without its label."""
    m = _LABEL.match(item)
    return item[m.end() :] if m and "@" not in m[0] else item


class CodeTable:
    """Code lengths (bits) of value codes, from their counts in the whole corpus.

    A code's own description is shared by its uses, so a structure seen once
    costs more than its well-known parts.
    """

    def __init__(self, counts: dict[str, int]):
        self.total = sum(counts.values()) + 2
        self.bits = {s: math.log2(self.total / n) + SIGN_BITS * _length(s) / n for s, n in counts.items()}
        self.escape = math.log2(self.total)

    def cost(self, sign: str, length: int) -> float:
        """Bits of an item of that value code and ``length`` letters: an unknown
        code is spelled out, sign by sign, or letter by letter if it has many."""
        known = self.bits.get(code_of(sign))
        return known if known is not None else self.escape + SIGN_BITS * (len(sign) if len(sign) <= MANY_SIGNS else max(length, len(sign)))


def first_codes(text: str) -> list[str]:
    """Value codes to start from: of the items of the finest split, as far as
    they hold at most one address."""
    found = [signature(without_label(i)) for i in split(text, FINEST)]
    return [code_of(s) for s in found if s and s.count("A") + s.count("E") < 2]


def cheapest(text: str, codes: CodeTable) -> tuple[int, list[str]]:
    """The dialect with the least description length and its non-empty items.

    Ties go to the dialect named first, the plainer one. Dialects whose
    delimiter or quote the text lacks read it as an earlier one does.
    """
    best, best_bits, best_items = 0, math.inf, [text]
    there = set(text)
    for k, dialect in enumerate(DIALECTS):
        bits = dialect.bits
        if k and (there.isdisjoint(dialect.signs) or dialect.quote_sign not in text or bits >= best_bits):
            continue
        raw = split(text, k)
        if k and len(raw) == 1:
            continue
        items = []
        for r in raw:
            item = (without_label(r) if k else r).strip()
            if not item or item in "'\"":
                bits += EMPTY_ITEM_BITS
                continue
            # An escaped quote is text like any other inside its quotes.
            bits += codes.cost(signature(_ESCAPED_QUOTES.sub("", item) if dialect.escape else item), len(item))
            items.append(dialect.escape.sub(r"\1", item) if dialect.escape else item)
            if bits >= best_bits:
                break
        if bits < best_bits:
            best, best_bits, best_items = k, bits, items
    return best, best_items


def bare(item: str) -> str:
    """The address in lower case; without one the text in lower case, trimmed and unquoted."""
    if m := ADDRESS.search(item):
        return m[0].strip(".").lower()
    text = item.strip()
    while len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        text = text[1:-1].strip()
    return text.strip().lower()
