"""Text expressions. Positions and lengths count code points."""

from __future__ import annotations

import string
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The pattern of a financial value, and of an inline citation.
VALUE = r"(?<!\d)[+-]?(?:\(\s*)?(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+\.\d+|\d{4,})(?:\s*\))?%?(?!\d)"
CITATION = r"\[(E[1-9][0-9]*)\]"


def normalize_page_text(c: Column) -> Column:
    """Drop NUL, line ends to LF, trim line ends, at most one blank line in a row, strip."""
    c = F.regexp_replace(c, "\\x00", "")
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, "[ \t]+(?=\n|\\z)", "")
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


#: Ranges of CJK ideographs.
CJK = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0x2CEB0, 0x2EBEF), (0x30000, 0x3134F))
CJK_CLASS = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in CJK)
#: Below U+0130 these characters alone have a compatibility form or are ASCII; other Latin text is left as it is.
MAYBE_COMPATIBLE = r"[^\x00-\xA9\xAB-\xB1\xB4-\xB8\xBB\xBF-\x{12F}]"
#: A text without one of them, as a match of the whole: one possessive run, many times faster than a search for one.
NONE_COMPATIBLE = rf"\A{MAYBE_COMPATIBLE.replace('[^', '[')}*+\z"


def _counts(c: str) -> bool:
    """Whether a character can be part of a search token."""
    return (c.isascii() and c.isalnum()) or any(a <= ord(c) <= b for a, b in CJK)


def _class(characters) -> str:
    """A character class of code points, as ranges."""
    codes, parts = sorted(map(ord, characters)), []
    for o in codes:
        if parts and parts[-1][1] == o - 1:
            parts[-1][1] = o
        else:
            parts.append([o, o])
    return "[" + "".join(rf"\x{{{a:X}}}" + (rf"-\x{{{b:X}}}" if b > a else "") for a, b in parts) + "]"


def _compatible() -> dict[str, str]:
    """Every character beyond ASCII whose compatibility form holds a character of a search token or is made of marks, and
    that form."""
    forms = ((c, unicodedata.normalize("NFKC", c)) for c in map(chr, range(0x80, sys.maxunicode + 1)))
    return {c: n for c, n in forms if n != c and any(unicodedata.combining(x) or _counts(x) for x in n.lower())}


def _composed() -> str:
    """A pattern of ASCII letters that a mark after them turns into one accented letter: marks of other classes may
    stand between, marks of the same class (or of class 0) block it."""
    marks: dict[int, list[str]] = {}
    for c in map(chr, range(0x300, sys.maxunicode + 1)):
        if unicodedata.combining(c):
            marks.setdefault(unicodedata.combining(c), []).append(c)
    found: dict[tuple[int, str], list[str]] = {}
    for letter in string.ascii_letters:
        for kind, members in marks.items():
            takes = "".join(m for m in members if len(unicodedata.normalize("NFC", letter + m)) == 1)
            if takes:
                found.setdefault((kind, takes), []).append(letter)
    others = {kind: _class([m for k, ms in marks.items() if k != kind for m in ms]) for kind, _ in found}
    return "|".join(f"[{''.join(letters)}](?={others[kind]}*{_class(takes)})" for (kind, takes), letters in found.items())


COMPATIBLE, COMPOSED = _compatible(), _composed()
ONE_TO_ONE = {c: n for c, n in COMPATIBLE.items() if len(n) == 1}
LONGER = {c: n for c, n in COMPATIBLE.items() if len(n) > 1}


def compatible(c: Column) -> Column:
    """A text as compatibility composition leaves it, as far as search tokens can tell: characters with compatibility forms
    of letters, digits and CJK are replaced by them, ASCII letters that a mark makes another letter become a blank. One case is left out: a capital I
    with a dot that takes a further mark."""
    table = F.create_map(*[F.lit(x) for pair in LONGER.items() for x in pair])
    special = _class(LONGER)
    pieces = F.regexp_extract_all(F.translate(c, "".join(ONE_TO_ONE), "".join(ONE_TO_ONE.values())), F.lit(f"{special}|[^{special[1:-1]}]+"), 0)
    mapped = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.element_at(table, p), p)), "")
    return F.regexp_replace(mapped, COMPOSED, " ")


def ascii_tokens(c: Column) -> Column:
    """Runs of letters and digits of the lower-cased text; anything else is a boundary."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]++", " "), " "), "")


def tokens(c: Column) -> Column:
    """Search tokens of normalised, lower-cased text: character pairs of runs of CJK characters (a lone one stays), and
    ASCII runs, in order and with repeats. Built-in functions alone."""
    def parts(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substr(run, i, F.lit(2)))
        return F.when(run.rlike("^[a-z0-9]"), F.array(run)).otherwise(pairs)

    every = F.flatten(F.transform(F.regexp_extract_all(F.lower(compatible(c)), F.lit(f"[{CJK_CLASS}]+|[a-z0-9]+"), 0), parts))
    return F.when(c.rlike(NONE_COMPATIBLE), ascii_tokens(c)).otherwise(every)


def search_text(c: Column) -> Column:
    """A text whose lower-cased runs of ASCII letters and digits and of CJK characters are those that tokens() takes."""
    return F.when(c.rlike(NONE_COMPATIBLE), c).otherwise(F.lower(compatible(c)))


def lexical_tokens(c: Column) -> Column:
    """Lower-cased words of letters or underscores and CJK runs, of 2 characters or more."""
    found = F.regexp_extract_all(F.lower(c), F.lit("[A-Za-z_]+|[\\x{4E00}-\\x{9FFF}]{2,}"), 0)
    return F.filter(found, lambda x: F.length(x) >= 2)


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def bigrams(c: Column, digits: bool = False) -> Column:
    """Distinct character pairs of the letters (and digits, if wished) of a text."""

    def pairs(chars: Column) -> Column:
        n = F.size(chars)
        two = F.zip_with(F.slice(chars, F.lit(1), n - 1), F.slice(chars, F.lit(2), n - 1), lambda a, b: F.concat(a, b))
        return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(two))

    plain = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]" if digits else r"[^\p{L}]", "")
    return let(F.filter(F.split(plain, ""), lambda x: x != ""), pairs)


def compact(c: Column) -> Column:
    """Without white space and case, for containment."""
    return F.lower(F.regexp_replace(c, r"\s+", ""))


def values(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(VALUE), 0)


def citations(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(CITATION), 1)


def near_value(text: Column, metric: Column, year: Column, reach: int = 120) -> Column:
    """Whether a value that is not the year follows an occurrence of the metric within `reach` characters."""
    pieces = F.split(compact(text), F.concat(F.lit("\\Q"), compact(metric), F.lit("\\E")))
    windows = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.substr(p, F.lit(1), F.lit(reach)))
    whole = lambda v: F.split_part(F.regexp_replace(F.regexp_replace(v, r"[(),%]", ""), r"^[+-]+", ""), F.lit("."), F.lit(1))
    is_value = lambda v: whole(v) != year.cast("string")
    return F.exists(windows, lambda w: F.exists(values(w), is_value))


def clean_number(c: Column) -> Column:
    """A table cell as a decimal: full-width digits, thousands commas and spaces, (x) for -x; dashes, blanks and n/a are null."""
    plain = F.regexp_replace(F.translate(c, "０１２３４５６７８９．，（）－", "0123456789.,()-"), r"[\s,]", "")
    signed = F.regexp_replace(plain, r"^\((.*)\)$", "-$1")
    return signed.try_cast("decimal(38,4)")


def grouped(c: Column, unit: Column) -> Column:
    """A decimal with thousands commas and a unit, without trailing zeros."""
    plain = F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    whole, part = F.split_part(plain, F.lit("."), F.lit(1)), F.regexp_extract(plain, r"\.\d+$", 0)
    return F.concat(F.regexp_replace(whole, r"(?<=\d)(?=(\d{3})+$)", ","), part, unit)
