"""People's names: last names, abbreviations, folded spellings, BibTeX name lists."""

from __future__ import annotations

import re
import unicodedata

from .latex import to_unicode
from .text import arrow, ascii_lower, strip_latex

#: Particles that belong to a last name, and suffixes after it.
PARTICLES = frozenset("van von de der den da del della di du dos das le la ten ter zu".split())
SUFFIXES = ("Jr.", "Sr.", "II", "III")
#: Letters without a decomposition, and what they fold to.
FOLDED = {"đ": "d", "Đ": "d", "ð": "d", "ø": "o", "Ø": "o", "ł": "l", "Ł": "l", "æ": "ae", "œ": "oe", "ß": "ss", "ı": "i", "þ": "th"}

_letters = re.compile("[^a-z]")


def without_number(name: str) -> str:
    return re.sub(r"\s+\d{4}$", "", name)


def last_name(name: str | None) -> str:
    """The last name in lower-case ASCII letters; a suffix is skipped unless it is all there is."""
    parts = without_number(name or "").split()
    if len(parts) > 1 and parts[-1] in SUFFIXES:
        del parts[-1]
    return _letters.sub("", ascii_lower(parts[-1])) if parts else ""


def bib_last_names(value: str | None) -> list[str]:
    """Last names of a BibTeX name list with the LaTeX stripped: before the comma, or the last word."""
    out = []
    for name in re.split(r"\s+and\s+", strip_latex(value)):
        name = name.strip()
        if name and name.lower() != "others":
            part = name.partition(",")[0] if "," in name else name
            words = part.split()
            out.append(_letters.sub("", ascii_lower(words[-1] if words else part)))
    return out


def overlap(wanted: list[str], names: list[str] | None) -> float:
    """Part of the wanted last names that names have, by the longer of both lists; 0 if one is empty."""
    if wanted is None or names is None or not len(wanted) or not len(names):
        return 0.0
    have = {last_name(n) for n in names}
    return sum(w in have for w in wanted) / max(len(wanted), len(names))


def overlap_of_names(left: list[str] | None, right: list[str] | None) -> float:
    """overlap() of two lists of full names; 1 if one is empty, as nothing speaks against it."""
    if left is None or right is None or not len(left) or not len(right):
        return 1.0
    return overlap([last_name(n) for n in left], right)


def abbreviate(name: str | None) -> str | None:
    """First names as initials; particles, the last name and a suffix stay."""
    parts = (name or "").split()
    if len(parts) < 2:
        return name
    tail = [parts.pop()] if parts[-1] in (*SUFFIXES, "IV") else []
    at = max(len(parts) - 1, 0)
    while at > 1 and parts[at - 1] in PARTICLES:
        at -= 1
    initials = [w if len(w) <= 3 and w[-1] == "." else "-".join(f"{p[0]}." for p in w.split("-") if p) for w in parts[:at]]
    return " ".join([*initials, *parts[at:], *tail])


def fold_name(name: str | None) -> str:
    """A name's letters without accents, case, spaces and number: equal for spellings of one name."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", without_number(name or "")) if not unicodedata.combining(c))
    return _letters.sub("", "".join(FOLDED.get(c, c) for c in plain).lower())


def split_names(value: str | None) -> list[str]:
    """The names of a BibTeX list: separated by "and" outside braces; "others" is no name."""
    names, level, now = [], 0, ""
    for piece in re.split(r"([{}]|\s+and\s+)", value or ""):
        if level == 0 and piece not in "{}" and piece.strip() == "and" and piece != "and":
            names.append(now)
            now = ""
            continue
        level += (piece == "{") - (piece == "}")
        now += piece
    return [n.strip() for n in [*names, now] if n.strip() and n.strip().lower() != "others"]


def plain_name(name: str | None) -> str:
    """A BibTeX name as "First Last" in Unicode; "Last, Jr, First" gives "First Last Jr"."""
    parts = [p.strip() for p in to_unicode(name or "").split(",")]
    if len(parts) in (2, 3):
        return " ".join([parts[-1], *parts[:-1]]).strip()
    return parts[0]


def accented_names(value: str | None) -> list[tuple[str, str]]:
    """(folded, plain) of the names of a list that have characters beyond ASCII."""
    plain = [plain_name(n) for n in split_names(value)]
    return [(fold_name(p), p) for p in plain if not p.isascii() and fold_name(p)]


last_name_udf = arrow(last_name, "string")
bib_last_names_udf = arrow(bib_last_names, "array<string>")
overlap_udf = arrow(overlap, "double")
overlap_of_names_udf = arrow(overlap_of_names, "double")
abbreviate_udf = arrow(abbreviate, "string")
fold_name_udf = arrow(fold_name, "string")
plain_name_udf = arrow(plain_name, "string")
split_names_udf = arrow(split_names, "array<string>")
accented_names_udf = arrow(accented_names, "array<struct<folded:string,name:string>>")
