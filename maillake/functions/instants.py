"""Exhaustive parser for written dates: one string to one instant.

Pure Python on purpose: it runs once per *distinct* string (see
``operators/instants.py``), so its cost follows the dictionary, not the rows.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
DEFAULT_ZONE = "America/Chicago"

# Zone abbreviations and their offset from UTC in minutes.
ABBREVIATED_ZONES = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0,
    "EST": -300, "EDT": -240,
    "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600,
    "BST": 60, "CET": 60, "WEST": 60, "MET": 60,
    "CEST": 120, "MEST": 120, "EET": 120,
    "EEST": 180, "MSK": 180,
    "JST": 540,
}
# English month names.
MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
MONTH_NUMBER = {name: i + 1 for i, name in enumerate(MONTHS)}
MONTH_NUMBER |= {name[:3]: i + 1 for i, name in enumerate(MONTHS)}
MONTH_NUMBER["sept"] = 9

_DAY = r"(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?"
_MON = r"(?P<mon>[a-z]{3,9})\.?"
_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?(?:\s*(?P<ap>[ap])\.?m\.?(?![a-z]))?"
_OFF = r"[+-]\d{2}:?\d{2}"
_ZONE = rf"(?:\s*(?P<off>{_OFF})(?:\s*\([^()]*\))?|\s*\(?(?P<abbr>[a-z]{{1,5}})\)?|\s*(?P<region>[a-z]+(?:/[a-z_]+)+))?"

_FORMS = [
    re.compile(p + r"\s*$", re.IGNORECASE)
    for p in (
        # 2 Jan 2002 20:59:11 -0800 (PST), 24-AUG-2000 18:07, with or without weekday
        rf"\s*(?:{_DAY},?\s+)?(?P<d>\d{{1,2}})[\s-]+{_MON}[\s-]+(?P<y>\d{{4}}|\d{{2}}),?\s+{_TIME}{_ZONE}",
        # Monday, April 23, 2001 2:56 PM
        rf"\s*(?:{_DAY},?\s+)?{_MON}\s+(?P<d>\d{{1,2}}),?\s+(?P<y>\d{{4}}),?\s+{_TIME}{_ZONE}",
        # Fri May 31 16:02:18 PDT 2002
        rf"\s*(?:{_DAY},?\s+)?{_MON}\s+(?P<d>\d{{1,2}})\s+{_TIME}{_ZONE}\s+(?P<y>\d{{4}})",
        # 2001-10-25T13:46:31Z, 2001/12/13 9:21, 1999.12.31 08:00
        rf"\s*(?P<y>\d{{4}})(?P<sep>[-/.])(?P<m>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}})(?:t|\s+){_TIME}{_ZONE}",
        # 01/16/1999 02:31 PM: month first
        rf"\s*(?:{_DAY},?\s+)?(?P<m>\d{{1,2}})/(?P<d>\d{{1,2}})/(?P<y>\d{{4}}|\d{{2}}),?\s+{_TIME}{_ZONE}",
        # 26.11.1998 14:20: day first
        rf"\s*(?:{_DAY},?\s+)?(?P<d>\d{{1,2}})\.(?P<m>\d{{1,2}})\.(?P<y>\d{{4}}|\d{{2}}),?\s+{_TIME}{_ZONE}",
        # 19980219T185003Z
        rf"\s*(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})t(?P<h>\d{{2}})(?P<mi>\d{{2}})(?P<s>\d{{2}})?(?:[.,](?P<f>\d{{1,9}}))?(?P<ap>(?!))?{_ZONE}",
    )
]
#: Longer texts are squeezed before they are read, as those with comments are.
LONG = 200
_SPACE = re.compile(r"\s+")
_ZONE_COMMENT = re.compile(r"\([a-z]{1,5}\)", re.IGNORECASE)
_DIGITS = re.compile(r"\s*(\d+)\s*$")


@lru_cache(maxsize=64)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:  # unknown names and malformed keys alike
        return None


def _region(name: str) -> ZoneInfo | None:
    return _zone("/".join("_".join(w.capitalize() for w in part.split("_")) for part in name.split("/"))) or _zone(name)


def _full_year(text: str) -> int:
    """Two digits mean 1969-2068; the archive only uses 98-02."""
    y = int(text)
    return y if len(text) > 2 else y + (1900 if y >= 69 else 2000)


def _micros(moment: datetime) -> int:
    return (moment - EPOCH) // timedelta(microseconds=1)


def squeezed(text: str) -> str:
    """``text`` with one blank for each run of white space, and without comments
    in brackets (which nest, with escapes) but the ones that hold only a zone."""
    out, depth, start, k = [], 0, 0, 0
    while k < len(text):
        c = text[k]
        if c == "\\" and depth:
            k += 1
        elif c == "(":
            if not depth:
                start, kept = k, len(out)
            depth += 1
            out.append(c)
        elif c == ")" and depth:
            depth -= 1
            out.append(c)
            if not depth and not _ZONE_COMMENT.fullmatch(text[start : k + 1]):
                del out[kept:]
        else:
            out.append(c)
        k += 1
    return _SPACE.sub(" ", "".join(out)).strip()


def parse_instant(text: str | None, zone: str = DEFAULT_ZONE) -> tuple[int | None, int | None]:
    """``(microseconds since 1970 UTC, year as written)`` or ``(None, None)``.

    Null, empty and text without an existing date and a time of day give
    ``(None, None)``. Without zone the text is wall clock of ``zone``; a time
    that the clock shows twice means the earlier instant, one that it skips is
    read with the offset before the change.
    """
    if not text:
        return None, None
    if len(text) > LONG or "(" in text:
        text = squeezed(text)
    if m := _DIGITS.match(text):
        digits = m[1]
        if len(digits) == 14:
            parts = [int(digits[a:b]) for a, b in ((0, 4), (4, 6), (6, 8), (8, 10), (10, 12), (12, 14))]
            return _wall(parts, 0, zone)
        if 8 <= len(digits) <= 13:  # up to ten digits are seconds, more are milliseconds
            micros = int(digits) * (1_000_000 if len(digits) <= 10 else 1000)
            return micros, (EPOCH + timedelta(microseconds=micros)).year
        return None, None
    for form in _FORMS:
        if m := form.match(text):
            got = m.groupdict()
            month = MONTH_NUMBER.get(got["mon"].lower()) if got.get("mon") else int(got["m"])
            if month is None:
                continue
            hour = int(got["h"])
            if got.get("ap"):
                if not 1 <= hour <= 12:
                    return None, None
                hour = hour % 12 + 12 * (got["ap"].lower() == "p")
            micro = int((got.get("f") or "0")[:6].ljust(6, "0"))
            parts = [_full_year(got["y"]), month, int(got["d"]), hour, int(got["mi"]), int(got.get("s") or 0)]
            if off := got.get("off"):
                digits = off[1:].replace(":", "")
                if int(digits[:2]) > 18 or int(digits[2:]) > 59:
                    return None, None
                return _fixed(parts, micro, (-1 if off[0] == "-" else 1) * (int(digits[:2]) * 60 + int(digits[2:])))
            if abbr := got.get("abbr"):
                if abbr.upper() not in ABBREVIATED_ZONES:
                    continue
                return _fixed(parts, micro, ABBREVIATED_ZONES[abbr.upper()])
            if got.get("region"):
                return _wall(parts, micro, got["region"]) if _region(got["region"]) else (None, None)
            return _wall(parts, micro, zone)
    return None, None


def _fixed(parts: list[int], micro: int, minutes: int) -> tuple[int | None, int | None]:
    try:
        moment = datetime(*parts, micro, tzinfo=timezone.utc)
    except ValueError:
        return None, None
    return _micros(moment) - minutes * 60_000_000, parts[0]


def _wall(parts: list[int], micro: int, zone: str) -> tuple[int | None, int | None]:
    try:
        local = datetime(*parts, micro, tzinfo=_region(zone), fold=0)
        return _micros(local), parts[0]
    except (ValueError, OverflowError):
        return None, None
