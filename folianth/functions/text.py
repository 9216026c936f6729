"""Row-local name logic in plain Python, for use inside Arrow UDFs; ``columns`` has the same scalars as Spark expressions."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Iterable
from functools import cached_property

from . import fixed
from .rowwise import remembered

_latin = {}
for _big, _out in fixed.CYRILLIC.items():
    _latin[ord(_big)] = _out
    _latin[ord(_big.lower())] = _out.lower()
_dj = {0x110: "Dj", 0x111: "dj"}

JUNK_NAMES = frozenset(fixed.JUNK_NAMES)
JUNK_WORDS = frozenset(fixed.JUNK_WORDS)
FIRST_NAMES = frozenset(fixed.FIRST_NAMES)

_web = re.compile(fixed.WEB, re.I)
_foreign = re.compile(fixed.FOREIGN)
_separator = re.compile(fixed.SEPARATOR)
_dashed = re.compile(fixed.DASHED)
_credit = re.compile(fixed.CREDIT)
_az = re.compile("[a-z]+")


def latin(s: str | None) -> str:
    """Composed form, Cyrillic spelt in Latin letters."""
    return unicodedata.normalize("NFC", s or "").translate(_latin)


@remembered(1 << 14)
def fold(s: str | None) -> str:
    """Latin, lower case, without marks: one form for every script and spelling of a word."""
    bare = unicodedata.normalize("NFKD", latin(s).translate(_dj).lower())
    return "".join(filter(lambda c: not unicodedata.combining(c), bare))


def one_space(s: str) -> str:
    return re.sub(r"\s+", " ", s)


@remembered(1 << 14)
def tidy_name(raw: str | None) -> str:
    """A name as it is shown: spaced initials, no titles of honour, given name first."""
    s = re.sub(fixed.IRISH, r"\1'", latin(raw).strip(" .,-_"))
    s = re.sub(fixed.HONORIFIC, "", s, flags=re.I)
    s = re.sub(fixed.INITIAL_DOT, r"\1. ", s)
    halves = s.split(",")
    if len(halves) == 2:
        s = f"{halves[1].strip()} {halves[0].strip()}"
    s = one_space(s.replace("_", " ")).strip()
    return " ".join(map(str.capitalize, s.split())) if s.isupper() or s.islower() else s


def initial(token: str) -> bool:
    return token in fixed.DIGRAPHS or len(token) == 1


def sound(token: str) -> str:
    """The sound that a token begins with, whatever the script it was written in."""
    two = token[:2]
    if two in ("dz", "dj", "ge", "gi", "gy"):
        return "j"
    return {"ch": "c", "lj": "lj", "nj": "nj"}.get(two, token[0])


@remembered(1 << 14)
def skeleton(token: str) -> str:
    """The consonants that outlast transcription."""
    for old, new in fixed.SOUNDS:
        token = token.replace(old, new)
    first, tail = token[:1], token[1:]
    tail = re.sub("[aeiouyjh]" if first == "j" else "[aeiouyjhv]", "", tail)
    if first and first in "aeiou":
        first = ""
    elif first == "y":
        first = "j"
    return re.sub(r"(.)\1+", r"\1", first + tail)


def foreignness(s: str) -> int:
    """How many marks of an untranscribed spelling it bears."""
    return sum(1 for _ in _foreign.finditer(s.lower()))


def has_serbian_letter(s: str) -> bool:
    return not set("čćšžđČĆŠŽĐ").isdisjoint(s)


class Name:
    """A spelling, with what comparisons ask of it computed once."""

    def __init__(self, raw: str):
        self.raw = raw

    @cached_property
    def tokens(self) -> tuple[str, ...]:
        return tuple(_az.findall(fold(self.raw)))

    @cached_property
    def key(self) -> str:
        return " ".join(sorted(self.tokens))

    @cached_property
    def foreign(self) -> int:
        return foreignness(self.raw)

    @cached_property
    def full(self) -> tuple[str, ...]:
        """Tokens that are more than an initial."""
        return tuple(t for t in self.tokens if not initial(t))

    @cached_property
    def middle_initials(self) -> int:
        t = self.tokens
        return sum(map(initial, t[1:-1])) if len(t) > 2 and not initial(t[0]) else 0

    @property
    def given(self) -> str:
        return self.tokens[0] if len(self.tokens) > 1 else ""

    @cached_property
    def transcribed(self) -> bool:
        return has_serbian_letter(self.raw) or re.search(fixed.TRANSCRIBED, self.raw) is not None


@remembered(1 << 14)
def name(raw: str) -> Name:
    return Name(raw)


def key(raw: str) -> str:
    return name(raw).key


@remembered(1 << 14)
def is_name(raw: str | None) -> bool:
    """The gate that a candidate passes: two to four words, none of them a digit, a web address or a word of books."""
    if _web.search(raw or ""):
        return False
    s = tidy_name(raw)
    if not s or fold(s) in JUNK_NAMES or any(map(str.isdigit, s)):
        return False
    found = name(s).tokens
    if len(found) not in (2, 3, 4) or max(map(len, found)) < 3:
        return False
    plain = (w for w in s.split() if not w.endswith(".") and not (w.isupper() and len(w) == 1))
    return JUNK_WORDS.isdisjoint(map(fold, plain))


def _initials_agree(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Token by token: the same surname (or its transcription), and an initial for a word of its sound elsewhere."""
    if len(a) != len(b) or not a:
        return False
    if a[-1] != b[-1] and (skeleton(a[-1]) != skeleton(b[-1]) or not (foreignness(" ".join(a)) or foreignness(" ".join(b)))):
        return False
    pairs = zip(a[:-1], b[:-1])
    return all(x == y or (initial(x) or initial(y)) and sound(x) == sound(y) for x, y in pairs)


@remembered(1 << 14)
def ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def _typos_apart(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Each word of the one is close to a word of the other; each takes the closest that is left."""
    left, total = sorted(b), 0.0
    for x in sorted(a):
        near = [ratio(x, y) for y in left]
        best = max(near)
        if best < 0.75:
            return False
        total += best
        del left[near.index(best)]
    return total / len(a) >= 0.85


def _alike(a: tuple[str, ...], b: tuple[str, ...], foreign: int) -> bool:
    if not a or not b:
        return False
    if sorted(a) == sorted(b):
        return True
    if len(a) == len(b):
        if foreign:
            heard = sorted(map(skeleton, a))
            if heard == sorted(map(skeleton, b)) and sum(map(len, heard)) > 3:
                return True
        if _typos_apart(a, b):
            return True
    return _initials_agree(a, b)


@remembered(1 << 15)
def same_person(first: str, second: str) -> bool:
    """Whether two spellings name one person. Neither symmetric nor transitive: keep the order of the arguments."""
    x, y = name(first), name(second)
    a, b = x.tokens, y.tokens
    even = len(a) == len(b)
    if even and any(initial(p) and initial(q) and sound(p) != sound(q) for p, q in zip(a, b)):
        return False
    foreign = max(x.foreign, y.foreign)
    if _alike(a, b, foreign):
        return True
    if even:
        return False
    ends = lambda t: tuple(w for i, w in enumerate(t) if not initial(w) or i in (0, len(t) - 1))
    p, q = ends(a), ends(b)
    if len(p) == len(q) > 1 and _initials_agree(p, q):
        return True
    if min(len(x.full), len(y.full)) < 2 or (x.full, y.full) == (a, b):
        return False
    return _alike(x.full, y.full, max(foreign, foreignness(" ".join(x.full)), foreignness(" ".join(y.full))))


def any_same(raw: str, others: Iterable[str]) -> bool:
    return any(same_person(raw, o) for o in others)


def without_credits(folded: str) -> str:
    return _credit.sub(" ", folded)


def occurs(raw: str, words: frozenset[str] | set[str]) -> bool:
    """Surname and another word are among the words of a folded text; case endings of up to three letters don't matter."""
    wanted = [t for t in name(raw).tokens if len(t) > 1]
    if not wanted or not words:
        return False

    def there(t: str) -> bool:
        # A word that begins with t and has at most three letters more.
        return t in words or any(w.startswith(t) for w in words if 0 < len(w) - len(t) < 4 and w[:3] == t[:3])

    *given, surname = wanted
    return there(surname) and (not given or any(map(there, given)))


def words_of(folded: str) -> frozenset[str]:
    return frozenset(_az.findall(folded))


def like_title(raw: str, title: str | None) -> bool:
    """The candidate is the title: at least 0.6 of their words in common. A title with a dash or colon tells nothing."""
    if not title or _dashed.search(title) or re.search(r"\s:\s", title):
        return False
    a, b = set(name(raw).tokens), set(name(title).tokens)
    return bool(a and b) and len(a & b) >= 0.6 * len(a | b) - 1e-12


def split_names(raw: str | None) -> list[str]:
    """The names that a string lists, if each part is one; else the string."""
    parts = [tidy_name(p) for p in _separator.split(raw or "") if p and not p.isspace()]
    return parts if len(parts) > 1 and all(map(is_name, parts)) else [raw]


def ordered(raw: str, given: frozenset[str] | set[str], seen: dict[str, int] | None = None) -> str:
    """Two words, given name first: by known given names, else by the order seen more often (``seen`` by folded spelling)."""
    parts = raw.split()
    if len(parts) != 2:
        return raw
    back = " ".join(reversed(parts))
    front, rear = (fold(p) in given for p in parts)
    if front != rear:
        return raw if front else back
    return back if seen and seen.get(fold(back), 0) > seen.get(fold(raw), 0) else raw


def _cut_short(raw: str, all_: Iterable[str]) -> bool:
    return any(o.startswith(raw) for o in all_ if o != raw)


def best_spelling(counts: dict[str, int]) -> str:
    """One spelling to show: originals before their transcriptions, then whole, plain, accented, frequent and long ones.

    What still ties goes to the first in the order of ``counts``.
    """
    def beaten(n: Name) -> bool:
        return any(
            len(o.full) == len(n.full) and o.foreign > n.foreign or n.transcribed and not o.transcribed and o.key != n.key
            for o in map(name, counts)
        )

    left = [c for c in counts if not beaten(name(c))] or list(counts)
    return max(left, key=lambda c: (not _cut_short(c, counts), -name(c).middle_initials, has_serbian_letter(c), counts[c], len(c)))
