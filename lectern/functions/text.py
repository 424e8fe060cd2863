"""Folding, normalising and comparing text. Column expressions run in the JVM; the rest are Arrow UDFs."""

from __future__ import annotations

import difflib
import html
import re
import unicodedata
from html.entities import html5
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def arrow(fn: Callable, returns: str | DataType) -> Callable[..., Column]:
    """A pure function of scalars (null in, the function decides) as an Arrow-batched UDF."""

    def batch(*columns: pd.Series) -> pd.Series:
        return pd.Series([fn(*row) for row in zip(*columns)], dtype=object)

    made: list = []

    def call(*columns) -> Column:
        if not made:
            made.append(F.pandas_udf(batch, returns))
        return made[0](*columns)

    call.__name__, call.__doc__ = getattr(fn, "__name__", "udf"), fn.__doc__
    return call


# ---------------------------------------------------------------- folding for search (JVM)


def _fold_table() -> tuple[str, str]:
    """Characters and what they fold to: Latin letters to their base letter, combining marks to nothing.

    Built from canonical decompositions; letters without one (o with stroke, sharp s) stay.
    """
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code).lower())[:1].lower()
        if base != chr(code) and base.isascii() and base.isalpha():
            source.append(chr(code))
            target.append(base)
    marks = [chr(c) for c in range(0x300, 0x370)]
    return "".join(source) + "".join(marks), "".join(target)


FOLD_TABLE = _fold_table()


def fold(text: Column) -> Column:
    """Lower case without the diacritics of Latin letters; only texts beyond ASCII are looked up character by character."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(F.lower(text), *FOLD_TABLE)).otherwise(F.lower(text))


def tokens(text: Column) -> Column:
    """Search tokens: runs of letters, digits and private-use characters of the folded text."""
    return F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), F.lit(1))


# ---------------------------------------------------------------- markup


_CLOSED = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|(\w+));", re.ASCII)


def strip_markup(raw: str | None, closed: bool = False) -> str | None:
    """Text of a marked-up value: tags go, entities are decoded, white space is folded, in this order.

    With closed only entities that end in a semicolon are decoded, as where a text may be cut inside one;
    else also those names that browsers accept without.
    """
    if raw is None:
        return None
    text = re.sub(r"<[^>]+>", "", raw)
    # unescape() would take the beginning of an unknown name for a known one
    text = _CLOSED.sub(lambda m: html5.get(f"{m[1]};", m[0]) if m[1] else html.unescape(m[0]), text) if closed else html.unescape(text)
    return " ".join(text.split())


def strip_closed_markup(raw: str | None) -> str | None:
    return strip_markup(raw, closed=True)


_COMMAND = re.compile(r"\\[a-zA-Z]+\s*")
_LATEX_MARKS = dict.fromkeys(map(ord, "{}\\\"'`^~"))


def strip_latex(text: str | None) -> str:
    """Text without commands (and the space after them), braces, quotes, accents and ties."""
    return (_COMMAND.sub("", text) if "\\" in text else text).translate(_LATEX_MARKS) if text else ""


def strip_latex_column(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\\[a-zA-Z]+[\s\x1C-\x1F\x{85}\p{Z}]*", ""), "[{}\\\\\"'`^~]", "")


def norm_title(title: str | None) -> str:
    """A title as lower-case ASCII words; a combining mark left by the decomposition ends a word."""
    return " ".join(re.findall("[a-z0-9]+", unicodedata.normalize("NFKD", strip_latex(title)).lower()))


def norm_title_column(title: Column) -> Column:
    """norm_title() of ASCII titles in the JVM, of others in Python: Latin letters by translate() took twice as long."""
    foreign = title.rlike(r"[^\x00-\x7F]")
    words = F.trim(F.regexp_replace(F.lower(strip_latex_column(title)), "[^a-z0-9]+", " "))
    return F.when(foreign, norm_title_udf(F.when(foreign, title))).otherwise(words)


def ascii_lower(text: str | None) -> str:
    """Lower case; what does not decompose to ASCII is dropped."""
    return unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode().lower()


def title_words(title: str | None, most: int = 12) -> list[str]:
    """The first words of more than two characters, lower-cased: what a title candidate must contain."""
    return [w for w in re.findall(r"\w+", (title or "").lower()) if len(w) > 2][:most]


# ---------------------------------------------------------------- similarity


def similarity(left: str | None, right: str | None) -> float:
    """Matching-blocks ratio of two strings (twice the matched characters over all characters); not symmetric."""
    return difflib.SequenceMatcher(None, left or "", right or "").ratio()


def word_diff(before: str | None, after: str | None, most_cells: int = 250_000) -> tuple[list[tuple[str, bool]], list[tuple[str, bool]]]:
    """Both texts as (piece, changed) lists: pieces outside a longest common subsequence of words are changed.

    White space counts as words. Beyond most_cells pairs of words the texts count as changed whole.
    """
    a, b = re.split(r"(\s+)", before or ""), re.split(r"(\s+)", after or "")
    if len(a) * len(b) > most_cells:
        return [(before or "", True)], [(after or "", True)]
    table = [[0] * (len(b) + 1)]
    for x in reversed(a):
        below, row = table[-1], [0] * (len(b) + 1)
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if x == b[j] else max(below[j], row[j + 1])
        table.append(row)
    table.reverse()
    i = j = 0
    left, right = [], []
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            left.append((a[i], False))
            right.append((b[j], False))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and table[i + 1][j] >= table[i][j + 1]:
            left.append((a[i], True))
            i += 1
        else:
            right.append((b[j], True))
            j += 1
    return left, right


markup_udf = arrow(strip_markup, "string")
closed_markup_udf = arrow(strip_closed_markup, "string")
norm_title_udf = arrow(norm_title, "string")
ascii_lower_udf = arrow(ascii_lower, "string")
similarity_udf = arrow(similarity, "double")


def _words(title):
    return title_words(title)


title_words_udf = arrow(_words, "array<string>")


# ---------------------------------------------------------------- identifiers (JVM)


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def doi_of_url(url: Column) -> Column:
    """The DOI of a resolver's URL."""
    return extract(url, r"(?i)^https?://(?:dx\.)?doi\.org/(10\..+)$")


def doi_in(text: Column) -> Column:
    """The first DOI in a value, braces removed."""
    return extract(F.trim(F.regexp_replace(text, "[{}]", "")), r"(10\.\d{4,}/\S+)")


def first_year(text: Column) -> Column:
    """The first four digits in a row, as a number."""
    return extract(text, r"(\d{4})").cast("int")


def strip_number(name: Column) -> Column:
    """A name without the four digits that tell namesakes apart."""
    return F.regexp_replace(name, r"\s+\d{4}$", "")


def dash_pages(pages: Column) -> Column:
    """Page ranges with double dashes."""
    return F.regexp_replace(pages, r"\s*-+\s*", "--")


def venue_acronym(venue: Column) -> Column:
    """A venue without the number of its volume in brackets; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(venue, r"\s*\(\d+\)$", "")), F.lit(""))


def http_time(value: Column) -> Column:
    """Seconds since the epoch of an HTTP date, null for anything else."""
    # the name of the day cannot be parsed, so its form is checked instead
    shaped = F.when(value.rlike(r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun), \d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} GMT$"), value)
    return F.unix_timestamp(F.try_to_timestamp(F.concat(F.substring(shaped, 6, 20), F.lit(" UTC")), F.lit("dd MMM yyyy HH:mm:ss VV")))


def is_current(mtime: Column, size: Column, remote_modified: Column, remote_size: Column) -> Column:
    """Whether a copy is the remote file or newer: an hour of slack in time, then the same size."""
    known = (F.coalesce(mtime, F.lit(0)) != 0) & (F.coalesce(remote_modified, F.lit(0)) != 0)
    newer = mtime > remote_modified + 3600
    same = (F.abs(mtime - remote_modified) <= 3600) & F.coalesce(size, F.lit(0)).eqNullSafe(remote_size)
    return F.coalesce(known & (newer | same), F.lit(False))
