"""Keyed surrogates of entities: same type, script and format, distinct for distinct entities.

An entity is made of parts - name words, domains, numbers - and each part is
replaced on its own, wherever it occurs: "Doe, Jane", "JANE DOE", "Mr Doe" and
jane.doe@... stay one person, also when a part had to be drawn again. Numbers
go through a keyed permutation of the numbers with as many digits; words become
keyed invented words of their script. Whether two parts met, or one became
another real one, is checked over the whole corpus (``pii.surrogate_parts``), so
entities of distinct parts keep distinct surrogates.
"""

from __future__ import annotations

import re
import unicodedata
from hashlib import blake2b

# Sounds that invented words are made of, by script, and endings that
# make a name read as female, as male or as neither.
SCRIPTS = {
    "LATIN": (
        "b br d dr f g gl h k l m n p pr r s st t tr v w z".split(), "a e i o u ai ea ou".split(),
        {"f": ["a", "ine", "elle"], "m": ["or", "an", "us"], "": ["", "n", "l"]},
    ),
    "CYRILLIC": (
        "б бр в г гл д др з к л м н п пр р с ст т тр ф".split(), "а е и о у ю я".split(),
        {"f": ["ина", "ана", "ева"], "m": ["ов", "ин", "ор"], "": ["", "н", "л"]},
    ),
    "GREEK": (
        "β γ δ ζ θ κ λ μ ν π πρ ρ σ στ τ τρ φ χ".split(), "α ε η ι ο υ ου αι".split(),
        {"f": ["α", "ια", "ινη"], "m": ["ος", "ης", "ας"], "": ["", "ν", "ς"]},
    ),
}
_FEMALE = re.compile(r"(?:a|ette|beth|ine|une|one|ane|wyn|а|я|α|η)$")
# Titles of women.
_HER_TITLES = ("mrs", "ms", "miss", "frau", "mme", "mlle", "madame", "señora", "sra")
_WORD = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_PIECE = re.compile(r"[^\W\d_]+|\d+")

#: Classes of parts whose surrogates are distinct and none of them a real part. Numbers are
#: permuted, so they are distinct by themselves; where most numbers of a length are real,
#: their surrogates are as well.
CHECKED = ("word", "domain")


def digest(key: bytes, *parts: str) -> int:
    return int.from_bytes(blake2b("\x1f".join(parts).encode(), key=key, digest_size=16).digest(), "big")


def permute_digits(digits: str, key: bytes, tweak: str) -> str:
    """Keyed permutation of the digit strings of that length (balanced Feistel, ten rounds)."""
    n = len(digits)
    if n < 2:
        return str((int(digits) + digest(key, tweak)) % 10) if digits else ""
    half = n // 2
    a, b = int(digits[:half]), int(digits[half:])
    sizes = [10**half, 10 ** (n - half)]
    for i in range(10):
        a, b = b, (a + digest(key, tweak, str(i), str(b), str(n))) % sizes[i % 2]
    return str(a).zfill(half) + str(b).zfill(n - half)


def gender(name: str, title: str = "") -> str:
    """f or m by title, else by the ending of a given name: a rule, not knowledge."""
    if title.lower().rstrip(".") in _HER_TITLES:
        return "f"
    return "f" if _FEMALE.search(name.lower()) else "m"


def script_of(word: str) -> str:
    """Script of the word's first letter, by its name in Unicode; LATIN without one."""
    letter = next((c for c in word if c.isalpha()), "a")
    return unicodedata.name(letter, "LATIN").split()[0]


def invented_word(word: str, key: bytes, tweak: str, attempt: int = 0) -> str:
    """An invented lower-case word of the script and the apparent gender of ``word``;
    each second attempt is a syllable longer, so there is always a free one."""
    script = script_of(word)
    h = digest(key, tweak, str(attempt), word)
    if script not in SCRIPTS:
        return _letters_of_script(word, script, h, attempt // 2)
    onsets, vowels, endings = SCRIPTS[script]
    out = []
    for _ in range(3 + h % 2 + attempt // 2):
        h, o = divmod(h, len(onsets))
        h, v = divmod(h, len(vowels))
        out += [onsets[o], vowels[v]]
    ends = endings[gender(word)]
    return "".join(out) + ends[h % len(ends)]


def _letters_of_script(word: str, script: str, h: int, more: int) -> str:
    """For scripts without sounds above: each letter gives way to another of the same script and case."""
    out = []
    for k, c in enumerate(word + word[-1] * more):
        h, step = divmod(h, 61)
        near = [x for d in range(1, 64) for x in (chr(ord(c) + d), chr(max(1, ord(c) - d))) if x.isalpha() and x == x.lower() and script_of(x) == script]
        out.append(near[(step + k) % len(near)] if c.isalpha() and near else c)
        h = h or digest(b"more", word, str(k))
    return "".join(out)


def like(model: str, word: str) -> str:
    """``word`` in the case of ``model``."""
    if model.isupper() and len(model) > 1:
        return word.upper()
    return word.capitalize() if model[:1].isupper() else word


def parts_of(kind: str, canon: str) -> list[tuple[str, str]]:
    """(class, part) of an entity, in order: what gets a surrogate of its own."""
    if kind == "phone":
        keep = max(0, len(canon) - 7)
        return [("phone", canon[keep:])]
    if kind == "id_number":
        return [("id", re.sub(r"\D", "", canon))]
    if kind == "person_name":
        return [("word", w) for w in canon.split(" ") if w != "?"]
    if kind == "email":
        local, _, domain = canon.partition("@")
        return [("word", m[0]) for m in _WORD.finditer(local) if len(m[0]) > 1] + [("number", m[0]) for m in _DIGITS.finditer(local)] + [("domain", domain)]
    return [("word", w) for w in _words_of_address(canon)] + [("number", m[0]) for m in _DIGITS.finditer(canon)]


def _words_of_address(canon: str) -> list[str]:
    return [m[0] for m in _WORD.finditer(canon) if m[0] not in _KEPT and len(m[0]) > 1]


def draw(cls: str, part: str, key: bytes, attempt: int = 0) -> str:
    """The surrogate of one part."""
    if cls == "word":
        return invented_word(part, key, cls, attempt)
    if cls == "domain":
        return f"{invented_word(part, key, cls, attempt)}.example"
    drawn = permute_digits(part, key, f"{cls}/{attempt}")
    # The few that a permutation leaves in place are moved, and then checked like words.
    return permute_digits(part, key, f"{cls}/{attempt}/moved") if drawn == part and cls != "number" else drawn


def compose(kind: str, canon: str, chosen: list[str]) -> str:
    """The surrogate's canonical form from the surrogates of ``parts_of``, in order."""
    new = iter(chosen)
    if kind == "phone":
        return canon[: max(0, len(canon) - 7)] + chosen[0]
    if kind == "id_number":
        digits = iter(chosen[0])
        return "".join(next(digits) if c.isdigit() else c for c in canon)
    if kind == "person_name":
        return " ".join(w if w == "?" else next(new) for w in canon.split(" "))
    if kind == "email":
        local = _WORD.sub(lambda m: next(new) if len(m[0]) > 1 else m[0], canon.partition("@")[0])
        return f"{_DIGITS.sub(lambda m: next(new), local)}@{next(new)}"
    text = _WORD.sub(lambda m: next(new) if m[0] not in _KEPT and len(m[0]) > 1 else m[0], canon)
    return _DIGITS.sub(lambda m: next(new), text)


def surrogate(kind: str, canon: str, key: bytes, attempt: int = 0) -> str:
    """The surrogate's canonical form without a check for collisions."""
    return compose(kind, canon, [draw(c, p, key, attempt) for c, p in parts_of(kind, canon)])


# Words of an address that say its type.
_KEPT = frozenset(
    "street avenue road drive lane terrace boulevard blvd court way quay place square st rd ln ave dr ct pl rue de la du des le les calle avenida plaza paseo allee allée straße strasse str weg gasse platz quai chemin suite ste apt apartment unit room floor".split()
)


def write_like(kind: str, found: str, canon: str, chosen: str) -> str:
    """The surrogate ``chosen`` written as ``found`` was: order, case, separators."""
    if kind in ("phone", "id_number"):
        code, ext = found, ""
        if kind == "phone" and (m := re.search(r"(?i),?\s*e?xt?\w*\.?\s*\d+$", found)):
            code, ext = found[: m.start()], found[m.start() :]
        digits = list(re.sub(r"\D", "", chosen))
        out = []
        for c in reversed(code):  # from the right: a trunk zero or country code may not be written
            out.append(digits.pop() if c.isdigit() and digits else c)
        return "".join(reversed(out)) + ext
    if kind == "person_name":
        swap = dict(zip(canon.split(" "), chosen.split(" ")))
        return _WORD.sub(lambda m: like(m[0], swap.get(m[0].lower(), m[0])) if len(m[0]) > 1 else m[0], found)
    if kind == "email":
        return chosen.upper() if found.isupper() else chosen
    # An address word by word and number by number, so abbreviations and commas stay; not where a line break cuts a word.
    old, new = _PIECE.findall(found), _PIECE.findall(chosen)
    if len(old) == len(new):
        it = iter(new)
        return _PIECE.sub(lambda m: like(m[0], next(it)), found)
    return chosen.upper() if found.isupper() else chosen if found.islower() else chosen.title()
