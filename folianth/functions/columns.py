"""The scalar name functions as Spark expressions: no Python per row, pushed through whole-stage code where Spark can.

``text`` holds the same functions for row-local Python. Folding covers Latin, Greek-free Cyrillic and full-width
letters (see ``_plain``); marks of any script are dropped. Null stays null unless said otherwise.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import JUNK_NAMES, JUNK_WORDS, fold as py_fold

# Java's patterns are of ASCII unless told otherwise; (?d) gives the dot its plain meaning.
U = "(?U)"
UI = "(?Uiu)"
SERBIAN = "[čćšžđČĆŠŽĐ]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def _by_rule(pairs: dict[str, str]) -> tuple[str, str, dict[str, str]]:
    """Translations of one character to one, in two strings (those to none come last), and the others."""
    one = {k: v for k, v in pairs.items() if len(v) == 1}
    none = [k for k, v in pairs.items() if not v]
    return "".join([*one, *none]), "".join(one.values()), {k: v for k, v in pairs.items() if len(v) > 1}


_cyrillic = _by_rule({x: y for k, v in fixed.CYRILLIC.items() for x, y in ((k, v), (k.lower(), v.lower()))})


def _plain() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition makes of letters, by rule."""
    spans = ((0xC0, 0x250), (0x400, 0x530), (0x1E00, 0x1F00), (0xFB00, 0xFB07), (0xFF21, 0xFF5B))
    found = {}
    for a, b in spans:
        for ch in map(chr, range(a, b)):
            out = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
            if out != ch and ch == ch.lower() and ch.isalpha():
                found[ch] = out
    return _by_rule(found)


_folding = _plain()
#: Cyrillic letters that may come as a letter and a mark; no other composition changes the spelling in Latin letters.
_composed = {unicodedata.normalize("NFD", x): x for x in "ЙйЁё"}
_composed |= {unicodedata.normalize("NFD", x): x for x in "čćšžČĆŠŽ"}


def once(value: Column, body) -> Column:
    """``body(value)``, with ``value`` evaluated once, and ``body`` called rather than written into the generated code.

    Dozens of nested replacements, copied wherever a filter is pushed down, would pass the size limit of a method.
    """
    return F.transform(F.array(value), body)[0]


def latin(c: Column | str) -> Column:
    """Cyrillic spelt in Latin letters, and the letters of Serbian composed."""
    return once(col(c), _latin)


def _latin(c: Column) -> Column:
    # Long chains run only over texts that hold what they change.
    composed = F.when(c.rlike(r"\p{Mn}"), _each(c, _composed)).otherwise(c)
    src, dst, more = _cyrillic
    return once(composed, lambda x: F.when(x.rlike(r"[\u0400-\u04FF]"), F.translate(_each(x, more), src, dst)).otherwise(x))


def _each(c: Column, pairs: dict[str, str]) -> Column:
    for old, new in pairs.items():
        c = _replace(c, old, new)
    return c


def fold(c: Column | str) -> Column:
    """``text.fold``: Latin, lower case, no marks."""
    return once(col(c), lambda x: F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(_fold(x)))


def _fold(c: Column) -> Column:
    src, dst, more = _folding
    low = F.lower(_each(_latin(c), {"đ": "dj", "Đ": "Dj"}))
    plain = once(low, lambda x: F.translate(F.when(x.rlike("[" + "".join(more) + "]"), _each(x, more)).otherwise(x), src, dst))
    return F.regexp_replace(plain, r"\p{Mn}", "")


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(fold(c), F.lit("[a-z]+"), F.lit(0))


def key(c: Column | str) -> Column:
    """Sorted tokens: one identity for any order of the words."""
    return key_of(tokens(c))


def key_of(t: Column | str) -> Column:
    return F.array_join(F.array_sort(t), " ")


def one_space(c: Column) -> Column:
    return F.regexp_replace(c, U + r"\s+", " ")


def strip(c: Column, chars: str) -> Column:
    return F.trim(c, F.lit(chars))


def tidy_name(c: Column | str) -> Column:
    s = strip(latin(c), " .,-_")
    s = F.regexp_replace(s, U + fixed.IRISH, "$1'")
    s = F.regexp_replace(s, UI + fixed.HONORIFIC, "")
    s = F.regexp_replace(s, U + fixed.INITIAL_DOT, "$1. ")
    flipped = once(F.split(s, ",", -1), lambda h: F.when(F.size(h) == 2, F.concat_ws(" ", F.trim(F.get(h, F.lit(1))), F.trim(F.get(h, F.lit(0))))).otherwise(F.array_join(h, ",")))
    spaced = F.trim(one_space(_replace(flipped, "_", " ")))
    one_case = lambda x: (F.upper(x) != F.lower(x)) & ((x == F.upper(x)) | (x == F.lower(x)))
    return once(spaced, lambda x: F.when(one_case(x), F.initcap(x)).otherwise(x))


def has_diacritics(c: Column | str) -> Column:
    return col(c).rlike(SERBIAN)


def looks_transcribed(c: Column | str) -> Column:
    return has_diacritics(c) | col(c).rlike(U + fixed.TRANSCRIBED)


def is_initial(t: Column) -> Column:
    return (F.length(t) == 1) | t.isin(*fixed.DIGRAPHS)


def initial_sound(t: Column) -> Column:
    two = F.substring(t, 1, 2)
    return F.when(two.isin("dz", "dj", "ge", "gi", "gy"), "j").when(two == "ch", "c").when(two.isin("lj", "nj"), two).otherwise(F.substring(t, 1, 1))


def is_name(c: Column | str) -> Column:
    """The gate of ``text.is_name``; null and empty are no names."""
    raw = F.coalesce(col(c), F.lit(""))

    def passes(s: Column, t: Column) -> Column:
        plain = F.filter(F.split(s, " "), lambda w: ~w.endswith(".") & ~((F.length(w) == 1) & (w == F.upper(w)) & (w != F.lower(w))))
        junk = F.exists(plain, lambda w: fold(w).isin(*sorted(JUNK_WORDS)))
        longest = F.array_max(F.transform(t, lambda x: F.length(x)))
        return F.size(t).between(2, 4) & (F.coalesce(longest, F.lit(0)) >= 3) & ~s.rlike(r"\p{Nd}") & ~fold(s).isin(*sorted(JUNK_NAMES)) & ~junk

    shown = once(tidy_name(raw), lambda s: (s != "") & once(tokens(s), lambda t: passes(s, t)))
    return ~raw.rlike(UI + fixed.WEB) & shown


def skeleton(t: Column) -> Column:
    for old, new in fixed.SOUNDS:
        t = _replace(t, old, new)
    first, tail = F.substring(t, 1, 1), F.substring(t, 2, 1 << 20)
    tail = F.when(first == "j", F.regexp_replace(tail, "[aeiouyjh]", "")).otherwise(F.regexp_replace(tail, "[aeiouyjhv]", ""))
    first = F.when(first.isin(*"aeiou"), "").when(first == "y", "j").otherwise(first)
    return F.regexp_replace(F.concat(first, tail), r"(.)\1+", "$1")


def phonetic_key(c: Column | str) -> Column:
    return F.array_join(F.array_sort(F.transform(tokens(c), skeleton)), " ")


def foreignness(c: Column | str) -> Column:
    return F.regexp_count(F.lower(col(c)), F.lit(fixed.FOREIGN))


def drop_initials(c: Column | str) -> Column:
    return F.array_join(F.filter(tokens(c), lambda t: ~is_initial(t)), " ")


def without_credits(folded: Column | str) -> Column:
    return F.regexp_replace(col(folded), "(?Ud)" + fixed.CREDIT, " ")


def first_name(c: Column | str) -> Column:
    return first_of(tokens(c))


def first_of(t: Column | str) -> Column:
    return F.when(F.size(t) >= 2, F.element_at(t, 1)).otherwise("")


def like_title(c: Column | str, title: Column | str) -> Column:
    """At least 0.6 of the words in common; false where the title holds a dash or colon between words."""
    a, b = F.array_distinct(tokens(c)), F.array_distinct(tokens(title))
    union = F.size(F.array_union(a, b))
    plain = ~col(title).rlike(U + fixed.DASHED) & ~col(title).rlike(U + r"\s:\s")
    return F.coalesce(plain & (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_intersect(a, b)) * 10 >= union * 6), F.lit(False))


def occurs(c: Column | str, folded: Column | str) -> Column:
    """Surname and another word stand in a folded text, with case endings of up to three letters."""
    wanted = F.filter(tokens(c), lambda t: F.length(t) > 1)
    words = F.regexp_extract_all(col(folded), F.lit("[a-z]+"), F.lit(0))

    def there(t: Column) -> Column:
        return F.exists(words, lambda w: w.startswith(t) & (F.length(w) - F.length(t) <= 3) & ((F.length(t) > 2) | (w == t) | (F.substring(w, 1, 3) == F.substring(t, 1, 3))))

    given = F.slice(wanted, 1, F.greatest(F.size(wanted) - 1, F.lit(0)))
    return F.coalesce((F.size(wanted) > 0) & there(F.element_at(wanted, -1)) & ((F.size(wanted) == 1) | F.exists(given, there)), F.lit(False))


def split_names(c: Column | str) -> Column:
    pieces = F.filter(F.split(col(c), U + fixed.SEPARATOR), lambda p: F.trim(p) != "")
    whole = F.array(col(c))
    named = lambda p: once(F.transform(p, tidy_name), lambda shown: F.when(F.forall(shown, is_name), shown).otherwise(whole))
    return once(pieces, lambda p: F.when(F.size(p) > 1, named(p)).otherwise(whole))


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def parent(path: Column | str) -> Column:
    return F.regexp_replace(col(path), "/[^/]*$", "")


def stem(path: Column | str) -> Column:
    base = file_name(path)
    suffix = F.regexp_extract(base, r"(?<=[^.])(\.[^.]*)$", 1)
    return F.when((F.length(suffix) > 0) & (F.length(suffix) <= 6), F.substring(base, F.lit(1), F.length(base) - F.length(suffix))).otherwise(base)


def bare_stem(c: Column | str) -> Column:
    s = F.regexp_replace(latin(c), U + r"\b([OoDd])_(?=[A-Z])", "$1'")
    s = _replace(_replace(F.regexp_replace(s, fixed.BRACKETED, " "), " _ ", " & "), "_", " ")
    return strip(one_space(F.regexp_replace(s, U + fixed.NUMBERS, " ")), " -.")


def n_segments(path: Column | str) -> Column:
    return F.size(F.split(bare_stem(stem(path)), U + r"\s*-\s+|\s+-\s*", -1))


def safe_name(c: Column | str) -> Column:
    """Fit for a file: without reserved and control characters; "Unknown" if nothing is left."""
    s = one_space(strip(F.regexp_replace(col(c), r'[<>:"/\\|?*\x00-\x1f]', ""), " ."))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("Unknown"))


def file_stem(path: Column | str) -> Column:
    """The stem without the leftovers of downloads."""
    s = F.regexp_replace(F.regexp_replace(stem(path), r"\.original_epub$", ""), U + r"\s*\(\d+\)\s*$", "")
    return safe_name(strip(F.rtrim(s, F.lit(" +")), " .-_"))


def genre_norm(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))


def series_key(author: Column | str, file_stem_: Column | str) -> Column:
    """struct(author, series) where the title holds a volume number that something follows; else null."""
    s = col(file_stem_)
    at = F.instr(s, " - ")
    title = F.when(at > 0, F.substring(s, at + 3, F.length(s))).otherwise(s)
    pattern = "(?Ud)" + fixed.SERIES
    return F.when(title.rlike(pattern), F.struct(col(author).alias("author"), genre_norm(F.regexp_extract(title, pattern, 1)).alias("series")))


def collection_hint(tags: Column | str, hints: list[tuple[str, str]] | None = None) -> Column:
    low = fold(F.coalesce(col(tags), F.lit("")))
    out = F.lit("")
    for pattern, genre in reversed(fixed.COLLECTION_HINTS if hints is None else hints):
        out = F.when(F.contains(low, F.lit(py_fold(pattern))), F.lit(genre)).otherwise(out)
    return out


def strip_html(c: Column | str) -> Column:
    """Text of a page by patterns alone: no script, style or head, no tags; character references stay."""
    s = F.regexp_replace(col(c), r"(?is)<(script|style|head)[^>]*>.*?</\1>", " ")
    return F.trim(one_space(F.regexp_replace(s, "<[^>]+>", " ")))
