"""Finding personal information in free text (pure Python, per text).

Matches are found in a view of the text without soft line breaks (``=`` at a
line's end) and mapped back, so ``found`` is always the text exactly as it
stands.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from typing import NamedTuple

import ahocorasick

KINDS = ("email", "street_address", "id_number", "phone", "person_name")
#: Placeholder of each kind.
PLACEHOLDERS = {k: f"<{k.upper()}>" for k in KINDS}

_S = r"[ \t\u00a0]"
_LABEL = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
_LOCAL = r"[a-z0-9_](?:[a-z0-9._%+-]*[a-z0-9_])?"
EMAIL_DOMAIN = re.compile(rf"@{_LABEL}(?:\.{_LABEL})+", re.IGNORECASE)
_LOCAL_SIGNS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# Spelled out: an "at" in brackets, or the bare word if "dot" is spelled as well.
_DOT = rf"(?:\.|{_S}*[(\[{{]{_S}*dot{_S}*[)\]}}]{_S}*|{_S}+dot{_S}+)"
_DOT_WORD = rf"(?:{_S}*[(\[{{]{_S}*dot{_S}*[)\]}}]{_S}*|{_S}+dot{_S}+)"
EMAIL_SPELLED = re.compile(
    rf"(?<![a-z0-9._%+-]){_LOCAL}{_S}*(?:[(\[{{]{_S}*at{_S}*[)\]}}]{_S}*{_LABEL}(?:{_DOT}{_LABEL})+|(?<={_S})at{_S}+{_LABEL}(?:{_DOT_WORD}{_LABEL})+)",
    re.IGNORECASE,
)

_EXT = rf"(?:,?{_S}*(?:ext\.?|extension|x){_S}*\d{{1,5}}(?!\d))?"
PHONE = re.compile(
    r"(?<![\w+/.-])(?:"
    rf"(?:\+|00)(?!1[ .(-]?\(?\d{{3}})\d{{2,3}}{_S}*(?:\(0\))?(?:[ \t\u00a0.-]{{0,2}}\d{{1,5}}){{2,6}}"  # other countries
    rf"|0\d{{2,4}}{_S}+\d{{3,4}}{_S}+\d{{3,4}}"  # national, trunk zero
    rf"|(?:\+?1{_S}*[ .-]?)?(?:\(\d{{3}}\){_S}*|\d{{3}}(?:[./-]|{_S}+))\d{{3}}(?:[.-]|{_S}+)?\d{{4}}"  # ten digits
    rf"|\+1\d{{10}}"
    rf"|\d{{3}}-\d{{4}}"
    rf")(?![\d-]|[./]\d){_EXT}",
    re.IGNORECASE,
)
_LONGEST_PHONE, _FEWEST_DIGITS = 15, 7

# Words before a number that say it identifies a person.
_ID_WORDS = (
    r"passport|reisepass|pasaporte|passeport|personalausweis|ausweis|ssn|social security|soc\.?\s*sec|security number"
    r"|tax id|tin|national insurance|ni number|nino|driver'?s licen[cs]e|licen[cs]e number|licen[cs]e|identity card|id card|id number|her number|his number|my number"
)
ID_SHAPED = re.compile(
    r"(?<![\w-])(?:"
    rf"\d{{3}}-\d\d-\d{{4}}|9\d\d{_S}\d\d{_S}\d{{4}}"  # social security, tax
    rf"|[a-z]{{2}}{_S}?\d\d{_S}?\d\d{_S}?\d\d{_S}?[a-d]"  # national insurance
    r"|[a-z]\d{3}-\d{4}-\d{4}"  # driving licence
    r"|l[a-z]\d{7}|[xz][a-z]?\d{8}"  # identity card, passport
    rf"|[xz][a-z]{_S}\d{{7}}"
    r")(?![\w-])",
    re.IGNORECASE,
)
ID_NAMED = re.compile(
    rf"\b(?:{_ID_WORDS})\b\.?(?:{_S}*(?:no|nr|number|nummer)\b\.?)?(?:{_S}*is\b)?{_S}*[:#]*{_S}*#?{_S}*(?P<id>(?:[a-z]{{1,2}}{_S}?)?\d(?:[ \t\u00a0-]?\d){{5,13}}(?:{_S}?[a-d]\b)?)(?![\w-])",
    re.IGNORECASE,
)

# Words that end a street's name.
_STREET_WORDS = (
    r"street|avenue|road|drive|lane|terrace|boulevard|blvd|court|way|quay|place|square|parkway|highway|circle|close|crescent"
    r"|ave|st\.|rd\.|ln\.|dr\.|ct\.|pl\.|st|rd|ln|dr|ct|pl"
)
_UNIT = rf"(?:,{_S}*(?:(?:suite|ste\.?|apt\.?|apartment|unit|room|floor){_S}*#?{_S}*|#{_S}*)\d{{1,5}}[a-z]?(?!\w))?"
_WORD = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
# Words that can't be the name of a street.
_NOT_STREET = r"(?!(?:and|or|of|the|to|in|on|at|for|from|by|with|is|are|was|were|came|went|moved|stayed|units?|days?|hours?|rows?|boxes|trucks|miles|percent|copies|files|drums|tons|pages|seats)\b)"
STREET = re.compile(
    r"(?<![\w.,/-])(?:"
    rf"\d{{1,5}}[a-z]?{_S}+(?:[nsew]\.?{_S}+)?{_NOT_STREET}{_WORD}(?:{_S}+{_NOT_STREET}{_WORD})?{_S}+(?:{_STREET_WORDS})(?![^\W_]){_UNIT}"
    rf"|\d{{1,5}}[a-z]?,?{_S}+(?:rue|avenue|boulevard|place|quai|chemin|allée){_S}+(?:d[eu]{_S}+(?:la{_S}+)?|des{_S}+|d['’])?(?P<r>{_WORD}(?:{_S}+{_WORD})?)(?![^\W_]){_UNIT}"
    r")",
    re.IGNORECASE,
)
# Number behind the name: -weg, -straße, Allee, Calle. Street names of two words have capitals in both, or are all of one case.
STREET_NUMBER_LAST = re.compile(
    rf"(?<![^\W_])(?:(?P<two>{_WORD}{_S}+)?{_WORD}(?:weg|stra(?:ß|ss)e|str\.|gasse|platz|{_S}+allee){_S}+\d{{1,4}}[a-z]?|(?:calle|avenida|plaza|paseo){_S}+{_WORD}(?:{_S}+{_WORD})?{_S}+\d{{1,4}}[a-z]?)(?![\w-]){_UNIT}",
    re.IGNORECASE,
)

# Titles before a family name.
TITLES = ["mr", "mrs", "ms", "miss", "dr", "prof", "herr", "frau", "fräulein", "mme", "mlle", "monsieur", "madame", "señor", "señora", "sr", "sra"]
# Common given names of several languages that are hardly ever other words; people beside the directory have such names.
COMMON_GIVEN = frozenset(
    "aaron abdul adriana agnieszka ahmed aisha alejandro alexander alexandra alfredo ali alice amanda amir amit amy ana andrea andreas andrew angela anil anita anja anna anne anthony antoine antonio arjun arthur barbara beatriz benjamin bernd brian bruno camille carlos "
    "carmen caroline catherine charlotte christian christina christopher claire claudia cristina daniel daniela david deborah deepak diego dmitri dorothy eduardo edward elena elizabeth emily emma enrique eric erik esther eva fatima felipe fernando florian francisco "
    "francois frederic friedrich gabriela georg george gerhard giovanni giulia gonzalo gregory guillaume hans hassan heather heinrich helen helga hiroshi ibrahim igor ingrid irina isabel ivan jacqueline james jan jane javier jean jennifer jessica joanna johannes john "
    "jorge jose joseph josef juan julia juergen karen karl kateryna katherine kenji kevin kumar laura lena leonardo linda lucia luis magdalena manuel marek margaret maria marie mario martin martina mary matthew mehmet michael michel miguel mohammed monika natalia".split()
    + "nadia nicolas nicole olga oliver olivier omar pablo patricia paul paula pedro peter philippe pierre priya rachel rafael rajesh ramon rebecca ricardo richard robert roberto sabine samuel sandra sanjay sarah sergei sofia stefan stephanie stephen sunita susan svetlana takashi tatiana thomas ursula vijay vladimir wei wolfgang yusuf".split()
)
# Capitalised words that follow a given name or a title without being a family name.
_NOT_FAMILY = frozenset(
    "and or the of to in on at for from by with is was has will can may not says said wrote asked called sent thinks if but so as who that this please thanks dear hello hi re cc "
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday street road avenue lane drive "
    "company inc corp ltd bank group university school hospital college center centre president chairman speaker director secretary".split()
)
_TITLE = re.compile(rf"(?<![^\W_])(?:{'|'.join(TITLES)})\b\.*{_S}+", re.IGNORECASE)
_NEXT_WORD = re.compile(rf",{_S}*([^\W\d_]+)")
_SOFT = re.compile(r"(?<!=)=\r?\n")
_DIGIT = re.compile(r"\d")
# Parts of the words that ID_NAMED and STREET_NUMBER_LAST need, for a quick look.
_ID_STEMS = ("passport", "reisepass", "pasaporte", "passeport", "ausweis", "ssn", "secur", "sec", "tax id", "tin", "insur", "number", "nino", "licen", "card")
_NUMBER_LAST_WORDS = ("weg", "straße", "strasse", "str.", "gasse", "platz", "allee", "calle", "avenida", "plaza", "paseo")
# First words of street names of two words.
_FIRST_OF_TWO = frozenset(("cinder", "old", "new", "upper", "lower", "grand", "alte", "alter", "am", "saint", "st"))


#: A name ends here: no letter goes on and no mailbox begins; "@OFFICE" of a directory may follow.
_NAME_ENDS = r"(?![^\W\d]|@[\w-]+\.\w)"
_VOWELS = frozenset("aeiouäöüy")


class Found(NamedTuple):
    kind: str
    start: int
    end: int
    #: Canonical parts: what all spellings of one entity share.
    canon: str


class NameModel:
    """Names of known correspondents and the shapes that their family names have.

    A token is like a family name if it is one, or if it is built from a
    beginning that several known family names share and an ending of a known
    one - unlisted people of the same communities have such names.
    """

    def __init__(self, given: list[str], family: list[str]):
        self.given = {g.lower() for g in given if g}
        self.family = {f.lower() for f in family if f}
        following: dict[str, set[str]] = {}
        for f in self.family:
            for k in range(2, len(f) - 1):
                following.setdefault(f[:k], set()).add(f[k])
        # A beginning is one where several endings branch off, or where a consonant meets a vowel.
        self.starts = {s for s, letters in following.items() if len(letters) > 1 or (len(s) > 2 and s[-1] not in _VOWELS and letters <= _VOWELS)}
        self.ends = {f[k:] for f in self.family for k in range(2, len(f) - 1)}
        # The vowel that links both parts varies freely before a longer ending.
        self.cores = {e[1:] for e in self.ends if len(e) > 3 and e[0] in _VOWELS}
        self.is_family = lru_cache(maxsize=100_000)(self._is_family)
        self.automaton = ahocorasick.Automaton()
        for g in self.given:
            self.automaton.add_word(g, len(g))
        for g in COMMON_GIVEN - self.given:
            self.automaton.add_word(g, len(g))
        for t in TITLES:
            for tail in (" ", ".", "\t", "\u00a0"):
                self.automaton.add_word(t + tail, 0)
        self.automaton.make_automaton()
        given_words = "|".join(sorted(map(re.escape, self.given), key=len, reverse=True)) or r"(?!)"
        initial = rf"(?:{_S}+[^\W\d_]\.?)?"
        word = r"[^\W\d_]+"
        #: Right of a given name: more given names, an initial, then the word that may be the family name.
        self.after = re.compile(rf"(?:-(?:{given_words}))?{initial}{_S}+(?P<f>{word}){_NAME_ENDS}", re.IGNORECASE)
        self.tail = re.compile(rf"(?:-(?:{given_words}))?(?:{_S}+[^\W\d_]\.)?(?![^\W\d_])", re.IGNORECASE)
        self.full = re.compile(rf"(?P<f>{word}){_NAME_ENDS}")

    def __reduce__(self):
        return NameModel, (sorted(self.given), sorted(self.family))

    def _is_family(self, token: str) -> bool:
        if token in self.family:
            return True
        if not 5 <= len(token) <= 16 or token in self.given:
            return False
        # A beginning of two letters says little, so it needs an ending of three.
        return any(
            token[:k] in self.starts and (token[k:] in self.ends or (token[k] in _VOWELS and token[k + 1 :] in self.cores))
            for k in range(2, len(token) - 1)
            if k > 2 or len(token) - k > 2
        )

    def find(self, text: str, lower: str) -> list[Found]:
        out: list[Found] = []
        done = 0
        for end, size in self.automaton.iter(lower):
            if size:
                start = end + 1 - size
                if start < done or (start and (lower[start - 1].isalnum() or lower[start - 1] in "._@")) or (end + 1 < len(lower) and (lower[end + 1].isalnum() or lower[end + 1] in "_@.") and not lower[end + 1 : end + 3].startswith(". ")):
                    # Inside a word or an address; "Family, Given@OFFICE" and "Family, Given." are names.
                    ends = lower[end + 1 : end + 2] in ("@", ".") and not (start and (lower[start - 1].isalnum() or lower[start - 1] in "._@"))
                    if start < done or not ends or self._family_before(text, start) is None:
                        continue
                m = self.after.match(text, end + 1)
                if m and (self.is_family(m["f"].lower()) or self._is_unlisted(text, start, end + 1, m["f"])):
                    out.append(Found("person_name", start, m.end(), f"{lower[start:end + 1]} {m['f'].lower()}"))
                    done = m.end()
                    continue
                family = self._family_before(text, start)
                if family is not None and family >= done:
                    stop = self.tail.match(text, end + 1)
                    stop = stop.end() if stop else end + 1
                    name = self.full.match(text, family)["f"].lower()
                    out.append(Found("person_name", family, stop, f"{lower[start:end + 1]} {name}"))
                    done = stop
            else:
                start = end
                while start and lower[start - 1].isalpha():
                    start -= 1
                m = _TITLE.match(text, start)
                if m and m.end() >= done and (start == 0 or lower[start - 1] not in "@._-"):
                    f = self.full.match(text, m.end())
                    if f and f["f"].lower() not in self.given and self.is_family(f["f"].lower()):
                        nxt = _NEXT_WORD.match(text, f.end())
                        if nxt and nxt[1].lower() in self.given:
                            continue  # "Title Family, Given" is found at the given name
                        out.append(Found("person_name", f.start(), f.end(), f"? {f['f'].lower()}"))
                        done = f.end()
        return out

    def _is_unlisted(self, text: str, start: int, end: int, family: str) -> bool:
        """A common given name and a family name that no list has: both capitalised, or both in capitals."""
        given = text[start:end]
        if given.lower() in self.given or given.lower() not in COMMON_GIVEN or len(family) < 3 or family.lower() in _NOT_FAMILY:
            return False
        return given.istitle() and family[0].isupper() and not family.isupper() or given.isupper() and family.isupper()

    def _family_before(self, text: str, start: int) -> int | None:
        end = start
        while end and text[end - 1] in " \t\u00a0":
            end -= 1
        if not end or text[end - 1] != ",":
            return None
        first = end - 1
        while first and text[first - 1].isalpha():
            first -= 1
        return first if first < end - 1 and self.is_family(text[first : end - 1].lower()) else None


def _mailbox_start(text: str, at: int) -> int:
    """Where the mailbox before the ``@`` at ``at`` begins, however long it is; ``at`` without one."""
    start = at
    while start and text[start - 1] in _LOCAL_SIGNS:
        start -= 1
    while start < at and text[start] in ".%+-":
        start += 1
    return start


def _lower(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip().lower()


def email_canon(text: str) -> str:
    t = re.sub(r"\s*[(\[{]\s*at\s*[)\]}]\s*|\s+at\s+", "@", text.lower())
    return re.sub(r"\s*[(\[{]\s*dot\s*[)\]}]\s*|\s+dot\s+", ".", t)


def _two_word_start(m: re.Match) -> int:
    """Start of a street whose number comes last: the word before its name
    belongs to it only where street names begin with such a word."""
    two = m["two"]
    return m.start() if not two or two.strip().lower() in _FIRST_OF_TWO else m.start() + len(two)


def _two_word_end(m: re.Match) -> int:
    """End of ``rue de ...``, which no word closes: two words only as above."""
    words = m["r"].split()
    if len(words) < 2 or words[0].lower() in _FIRST_OF_TWO:
        return m.end()
    return m.start("r") + len(words[0])


def _lines_with_digits(text: str):
    """Spans of the lines that hold a digit."""
    at = 0
    while m := _DIGIT.search(text, at):
        a, b = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.start())
        yield a, (at := len(text) if b < 0 else b)


def _numbered(text: str, lower: str, a: int, b: int) -> list[Found]:
    """Entities with numbers in the line from a to b."""
    found: list[Found] = []
    for m in STREET.finditer(text, a, b):
        end = m.end() if not m["r"] else _two_word_end(m)
        found.append(Found("street_address", m.start(), end, _squeeze(text[m.start() : end])))
    if any(lower.find(w, a, b) >= 0 for w in _NUMBER_LAST_WORDS):
        for m in STREET_NUMBER_LAST.finditer(text, a, b):
            start = _two_word_start(m)
            found.append(Found("street_address", start, m.end(), _squeeze(text[start : m.end()])))
    for m in ID_SHAPED.finditer(text, a, b):
        found.append(Found("id_number", m.start(), m.end(), re.sub(r"\W", "", m[0]).lower()))
    if any(lower.find(w, a, b) >= 0 for w in _ID_STEMS):
        for m in ID_NAMED.finditer(text, a, b):
            found.append(Found("id_number", m.start("id"), m.end("id"), re.sub(r"\W", "", m["id"]).lower()))
    for m in PHONE.finditer(text, a, b):
        digits = re.sub(r"\D", "", re.split(r"(?i)e?x", m[0])[0])
        if _FEWEST_DIGITS <= len(digits) <= _LONGEST_PHONE + 1:
            found.append(Found("phone", m.start(), m.end(), phone_canon(m[0])))
    return found


def find(text: str, names: NameModel | None) -> list[Found]:
    """All entities of ``text``, in order, none overlapping; earlier kinds win.

    Null and empty text have none. Offsets refer to ``text`` as it stands.
    """
    if not text:
        return []
    view, cuts = text, None
    if "=\n" in text or "=\r\n" in text:
        view, cuts = _without_soft_breaks(text)
    lower = _lower(view)
    found: list[Found] = []
    if "@" in view:
        for m in EMAIL_DOMAIN.finditer(view):
            if (start := _mailbox_start(view, m.start())) < m.start():
                found.append(Found("email", start, m.end(), lower[start : m.end()]))
    if " dot " in lower or "dot)" in lower or "dot]" in lower or "at)" in lower or "at]" in lower or "at}" in lower:
        for m in EMAIL_SPELLED.finditer(view):
            # With a bare "at" only what has the look of a mailbox counts, not a sentence.
            if any(c in m[0] for c in "([{") or not m[0].split(None, 1)[0].isalpha():
                found.append(Found("email", m.start(), m.end(), email_canon(m[0])))
    for a, b in _lines_with_digits(view):
        found += _numbered(view, lower, a, b)
    if names is not None:
        found += names.find(view, lower)
    rank = {k: i for i, k in enumerate(KINDS)}
    found.sort(key=lambda f: (f.start, rank[f.kind], -f.end))
    out: list[Found] = []
    for f in found:
        if out and f.start < out[-1].end:
            if rank[f.kind] < rank[out[-1].kind]:
                out[-1] = f
            continue
        out.append(f)
    if cuts:
        out = [Found(f.kind, _back(f.start, cuts, False), _back(f.end, cuts, True), f.canon) for f in out]
    return out


def _without_soft_breaks(text: str) -> tuple[str, tuple[list[int], list[int]]]:
    """The text without soft breaks; their places in it and how much was cut up to each."""
    kept, places, cut, at, size = [], [], [0], 0, 0
    for m in _SOFT.finditer(text):
        kept.append(text[at : m.start()])
        size += m.start() - at
        places.append(size)
        cut.append(cut[-1] + m.end() - m.start())
        at = m.end()
    kept.append(text[at:])
    return "".join(kept), (places, cut)


def _back(at: int, cuts: tuple[list[int], list[int]], is_end: bool) -> int:
    """Place in the text as it stands of a place in the view."""
    places, cut = cuts
    return at + cut[bisect_left(places, at) if is_end else bisect_right(places, at)]


def phone_canon(text: str) -> str:
    """Digits with country code (1 if none is written), without extension."""
    number = re.split(r"(?i),?\s*e?x", text)[0].replace("(0)", "")
    digits = re.sub(r"\D", "", number)
    if number.startswith("00"):
        digits = digits[2:]
    elif not number.startswith("+"):
        digits = "44" + digits[1:] if digits.startswith("0") else digits if len(digits) == 11 else "1" + digits if len(digits) == 10 else digits
    return digits
