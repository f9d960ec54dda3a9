"""Structure of mail bodies (pure Python, per mail): which lines their sender wrote.

Decides what structure alone tells: quoted lines, lead-ins, headers and markers
of earlier messages, signature blocks, disclaimers and their rules. What only
other mails can tell (``authored``) is left open.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import ahocorasick

from maillake.llm.entities import NameModel

_QUOTED = re.compile(r"\s*(?:>|\||:(?:\s|$)|[A-Za-z]{1,3}>(?:\s|$))")
_SOFT_TAIL = re.compile(r"[^=]=$")
_ESCAPE = re.compile(r"((?:=[0-9A-Fa-f]{2})+)")

# Lines before quoted text, in the languages of the archive.
_LEAD_IN = re.compile(
    r"\s*(?:on\b.{4,}\bwrote\s*:|le\b.{4,}\ba\s+[ée]crit\s*:|am\b.{4,}\bschrieb\b.*:|op\b.{4,}\bschreef\b.*:|at\s+\d{1,2}:\d\d\s.{4,}\bsaid\s*:|el\b.{4,}\bescribi[óo]\s*:|.+<[^<>\s]+@[^<>\s]+>\s+(?:wrote|schrieb|schreef|a\s+[ée]crit|escribi[óo])\s*:)\s*$",
    re.IGNORECASE,
)
_LEAD_WORD = re.compile(r"\s*(?:on|le|am|op|at|el)\s", re.IGNORECASE)
# Marker lines of earlier messages.
_MARKER = re.compile(
    r"\s*(?:-{2,}\s*(?:original message|urspr[üu]ngliche nachricht|message d['’]origine|mensaje original|forwarded (?:message|by)\b.*)\s*-*.*|-{5,}\s*forwarded\b.*|begin forwarded message:?|-{3,}\s*forwarded message\s*-*)\s*$",
    re.IGNORECASE,
)
_BEGIN = re.compile(r"\s*<{2,}\s*begin\b.*>{2,}\s*$", re.IGNORECASE)
_END = re.compile(r"\s*<{2,}\s*end\b.*>{2,}\s*$", re.IGNORECASE)
_FROM = re.compile(r"\s*(?:from|von|de)\s*:\s*\S", re.IGNORECASE)
_HEAD = re.compile(r"\s*(?:from|sent|date|to|cc|bcc|subject|von|gesendet|an|betreff|datum|de|envoy[ée]|[àa]|objet|para|asunto|enviado)\s*:", re.IGNORECASE)
_HEAD_DATED = re.compile(r"\s*(?:sent|date|gesendet|datum|envoy[ée]|enviado)\s*:", re.IGNORECASE)
_HEAD_TO = re.compile(r"\s*(?:to|an|[àa]|para)\s*:", re.IGNORECASE)
_DIR_DATE = re.compile(r"\s*\d{1,2}/\d{1,2}/\d{2,4}\s+\d{1,2}:\d\d(?::\d\d)?\s*(?:[ap]m)?\s*-*\s*$", re.IGNORECASE)
_DIR_NAME_DATE = re.compile(r"\s*\S.{2,80}\s+on\s+\d{1,2}/\d{1,2}/\d{2,4}\s+\d{1,2}:\d\d\s*(?:[ap]m)?\s*$", re.IGNORECASE)
_RULE = re.compile(r"\s*(?:[-_=*~#]{2,})\s*$")
_LONG_RULE = re.compile(r"\s*([-_=*~#])\1{7,}\s*$")
_SIGN_DELIMITER = re.compile(r"\s*--\s*$")

# Lines that devices and services add.
_DEVICE = re.compile(r"\s*(?:sent (?:from|by|via|with) (?:my|a|the|handheld|mobile)\b|sent by handheld|get mail anywhere|get \w+ (?:mail|mobile)\b|von (?:meinem|unterwegs) .*gesendet|envoy[ée] (?:de|depuis) mon)\b.*", re.IGNORECASE)
# Phrases of disclaimers and footers, in lower case.
DISCLAIMER_PHRASES = [
    "confidentiality notice", "privileged and confidential", "notice to reader", "vertraulich", "confidentiel", "confidencial",
    "solely for the", "meant only for the", "not an intended", "not the intended", "not the person this was sent", "intended reader", "intended recipient",
    "exclusive use of the addressee", "exclusively for the addressee", "use of the addressee", "must not be disclosed", "may not be disclosed", "proprietary information",
    "bestemd voor de geadresseerde", "received this message in error", "received this email in error", "received this e-mail in error",
    "no liability", "for viruses", "indicative and bind nobody", "contract arises", "opinions are personal", "views stated", "replying means you accept",
    "copying or passing on", "destroy it and tell", "erase all copies", "delete every copy", "unauthorised review", "unauthorized review",
    "consider the environment", "leave this list", "to unsubscribe", "unsubscribe here", "unsubscribe at", "unsubscribe:", "mail passing its", "mail passing this", "mail passing our", "mail passing the",
    "mail sent through its", "mail sent through this", "mail sent through our", "mail sent through the", "this transmission may",
    "weitergabe ist untersagt", "diffusion non autoris", "merci de le détruire", "merci de le detruire", "löschen sie sie", "loschen sie sie",
]
_PHRASES = ahocorasick.Automaton()
for _phrase in DISCLAIMER_PHRASES:
    _PHRASES.add_word(_phrase, len(_phrase))
_PHRASES.make_automaton()
_CONTACT = re.compile(r"\d{3}[-./ )]?\s?\d{4}|@[\w-]+\.|\b(?:tel|ph|phone|fax|cell|mobile|office|e-?mail)\b\s*[.:]?|\+\d{2}", re.IGNORECASE)
_SENTENCE_END = re.compile(r"[.!?]\s*$")
#: Twice so many lines belong to a signature whatever they hold, more only if they hold contacts.
_SIGN_LINES = 7
_BLANKS = re.compile(r"[ \t\u00a0]+")
_FIRST_WORD = re.compile(r"[^\W\d_]+")


def decode(line: str) -> str:
    """Quoted-printable escapes of one logical line resolved (UTF-8, else Latin-1)."""
    if "=" not in line:
        return line

    def text(m: re.Match) -> str:
        raw = bytes.fromhex(m[1].replace("=", ""))
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return raw.decode("latin-1")

    return _ESCAPE.sub(text, line)


def logical_lines(body: str, encoded: bool) -> tuple[list[str], list[tuple[int, int]]]:
    """Lines with soft breaks joined and escapes resolved (of ``encoded``
    bodies), and for each its first and last physical line, from 1."""
    physical = body.replace("\r\n", "\n").split("\n")
    if not encoded:
        return physical, [(i + 1, i + 1) for i in range(len(physical))]
    lines, spans, k = [], [], 0
    while k < len(physical):
        first, parts = k, []
        while k < len(physical) - 1 and _SOFT_TAIL.search(physical[k]):
            parts.append(physical[k][:-1])
            k += 1
        parts.append(physical[k])
        k += 1
        lines.append(decode("".join(parts)))
        spans.append((first + 1, k))
    return lines, spans


def _blank(line: str) -> bool:
    return not line.strip()


class Structure:
    """Flags of the lines: '' own, or history, signature, disclaimer."""

    def __init__(self, lines: list[str], names: NameModel):
        # One kind of blank: copies of mail differ in their spacing.
        self.lines = [_BLANKS.sub(" ", x) if "  " in x or "\t" in x or "\u00a0" in x else x for x in lines]
        self.names = names
        self.flags = [""] * len(lines)
        self.disclaiming = self._lines_with_phrases()
        self._history()
        self._disclaimers()
        self._signatures()

    def _lines_with_phrases(self) -> set[int]:
        """Lines in which a phrase of a disclaimer begins; it may go on in the next one."""
        low = [x.lower() for x in self.lines]
        starts = list(accumulate((len(x) + 1 for x in low), initial=0))
        return {bisect_right(starts, end + 1 - size) - 1 for end, size in _PHRASES.iter(" ".join(low))}

    def _next_text(self, k: int) -> int:
        while k < len(self.lines) and _blank(self.lines[k]):
            k += 1
        return k

    def _is_head_block(self, k: int) -> bool:
        """A From line with a date and a To line among the next header lines."""
        if not _FROM.match(self.lines[k]):
            return False
        dated = to = 0
        j, seen = self._next_text(k + 1), 0
        while j < len(self.lines) and _HEAD.match(self.lines[j]):
            dated |= bool(_HEAD_DATED.match(self.lines[j]))
            to |= bool(_HEAD_TO.match(self.lines[j]))
            seen += 1
            j = self._next_text(j + 1)
        return bool(dated and (to or seen > 1))

    def _is_directory_block(self, k: int) -> bool:
        """Name, date (one line or two), then To: without a From line."""
        line = self.lines[k]
        if _DIR_NAME_DATE.match(line):
            j = self._next_text(k + 1)
        elif len(line) < 80 and not _blank(line):
            j = self._next_text(k + 1)
            if j >= len(self.lines) or not _DIR_DATE.match(self.lines[j]):
                return False
            j = self._next_text(j + 1)
        else:
            return False
        return j < len(self.lines) and bool(_HEAD_TO.match(self.lines[j]))

    def _history(self) -> None:
        k, n = 0, len(self.lines)
        while k < n:
            line = self.lines[k]
            if _blank(line):
                k += 1
                continue
            if _BEGIN.match(line):
                end = next((j for j in range(k + 1, n) if _END.match(self.lines[j])), n - 1)
                self._flag(k, end + 1, "history")
                k = end + 1
                continue
            if _QUOTED.match(line):
                self.flags[k] = "history"
            elif (_LEAD_IN.match(line) or (k + 1 < n and not _blank(self.lines[k + 1]) and _LEAD_WORD.match(line) and _LEAD_IN.match(line + " " + self.lines[k + 1].lstrip()))):
                size = 1 if _LEAD_IN.match(line) else 2
                j = self._next_text(k + size)
                if j < n and (_QUOTED.match(self.lines[j]) or size == 1):
                    self._flag(k, k + size, "history")
                    if j >= n or not any(_QUOTED.match(x) for x in self.lines[j : j + 3]):
                        self._flag(j, n, "history")  # earlier message below without marks
                        return
                elif j >= n:
                    self._flag(k, k + size, "history")
                k += size
                continue
            elif _MARKER.match(line) or self._is_head_block(k) or self._is_directory_block(k):
                start = k
                prev = k - 1
                while prev >= 0 and _blank(self.lines[prev]):
                    prev -= 1
                if prev >= 0 and not self.flags[prev] and _LONG_RULE.match(self.lines[prev]) and not _MARKER.match(line):
                    start = prev
                end = next((j for j in range(k, n) if _END.match(self.lines[j])), n - 1)
                self._flag(start, end + 1, "history")
                k = end + 1
                continue
            k += 1

    def _flag(self, a: int, b: int, what: str) -> None:
        for j in range(a, min(b, len(self.lines))):
            if not self.flags[j]:
                self.flags[j] = what

    def _disclaimers(self) -> None:
        n = len(self.lines)
        for k in range(n):
            line = self.lines[k]
            if self.flags[k] or _blank(line):
                continue
            if _DEVICE.match(line):
                self.flags[k] = "signature"
            elif k in self.disclaiming:
                end = k + 1
                while end < n and not self.flags[end] and not _blank(self.lines[end]) and self._goes_on_disclaiming(end):
                    end += 1
                self._flag(k, end, "disclaimer")
                a = k - 1
                while a >= 0 and _blank(self.lines[a]):
                    a -= 1
                if a >= 0 and not self.flags[a] and _LONG_RULE.match(self.lines[a]):
                    self.flags[a] = "disclaimer"
                b = self._next_text(end)
                if b < n and not self.flags[b] and _LONG_RULE.match(self.lines[b]) and not self._rule_opens_signature(b):
                    self.flags[b] = "disclaimer"

    def _goes_on_disclaiming(self, k: int) -> bool:
        """A phrase of its own, or the rest of a long line that didn't end its sentence."""
        before = self.lines[k - 1]
        return k in self.disclaiming or (len(before) > 55 and not _SENTENCE_END.search(before))

    def _rule_opens_signature(self, k: int) -> bool:
        j = self._next_text(k + 1)
        return j < len(self.lines) and self._starts_signature(j)

    def _name_size(self, line: str) -> int:
        """Length of the full name that the line starts with, 0 without one."""
        text = line.strip()
        first = _FIRST_WORD.match(text)
        if not first or len(text) > 120:
            return 0
        word = first[0].lower()
        if word not in self.names.given and not self.names.is_family(word):
            return 0
        found = self.names.find(text, text.lower()) if len(text.lower()) == len(text) else []
        return found[0].end if found and found[0].start == 0 and not found[0].canon.startswith("?") else 0

    def _starts_signature(self, k: int) -> bool:
        """A line with a full name alone, before a title, or before bars."""
        line = self.lines[k].strip()
        size = self._name_size(line)
        if not size:
            return False
        rest = line[size:].strip()
        return not rest or rest[0] == "|" or (rest[0] == "," and len(rest) < 40 and not _SENTENCE_END.search(rest))

    def _signatures(self) -> None:
        n = len(self.lines)
        k = 0
        while k < n:
            if self.flags[k] or _blank(self.lines[k]) or not self._starts_signature(k):
                k += 1
                continue
            line = self.lines[k].strip()
            alone = not line[self._name_size(line) :].strip()
            a = k - 1
            while a >= 0 and _blank(self.lines[a]):
                a -= 1
            ruled = a >= 0 and not self.flags[a] and bool(_RULE.match(self.lines[a]))
            end = k + 1
            while end < n and not self.flags[end] and (end - k < 2 * _SIGN_LINES or _CONTACT.search(self.lines[end])):
                if _blank(self.lines[end]):
                    if not self._signature_goes_on(end, ruled):
                        break
                    end += 1
                    continue
                text = self.lines[end].strip()
                if _RULE.match(text):
                    end += 1
                    break
                if len(text) > 90 or (_SENTENCE_END.search(text) and not _CONTACT.search(text) and not re.search(r"(?i)\b(?:st|rd|ln|dr|ave|blvd)\.$", text)):
                    break
                end += 1
            # Contact lines close a signature; what follows them is text again.
            contacts = [j for j in range(k, end) if _CONTACT.search(self.lines[j]) or _RULE.match(self.lines[j])]
            end = contacts[-1] + 1 if contacts else end
            if alone and end == k + 1 and not ruled and not self._closes(k):
                k += 1  # a name on a line of its own in running text
                continue
            self._flag(k, end, "signature")
            if ruled:
                self.flags[a] = "signature"
            b = self._next_text(end)
            if ruled and b < n and not self.flags[b] and self.lines[b].strip() == self.lines[a].strip() and _RULE.match(self.lines[b]):
                self.flags[b] = "signature"
            k = end

    def _signature_goes_on(self, k: int, ruled: bool) -> bool:
        """Behind the blank line k come short lines up to a contact line (or the closing rule)."""
        j, seen = self._next_text(k), 0
        while j < len(self.lines) and seen < 4 and not self.flags[j]:
            text = self.lines[j].strip()
            if ruled and _RULE.match(text):
                return True
            if len(text) > 70 or _SENTENCE_END.search(text) or _LONG_RULE.match(text):
                return False
            if _CONTACT.search(text) and not re.search(r"(?i)\b(?:i|you|we|my|is|to|for|the)\b", text):
                return True
            j, seen = self._next_text(j + 1), seen + 1
        return False

    def _closes(self, k: int) -> bool:
        """Nothing of the sender's own text follows line k."""
        return all(self.flags[j] or _blank(self.lines[j]) for j in range(k + 1, len(self.lines)))
