"""Ranked full-text search: a positional inverted index as tables, a query language, BM25 over weighted fields."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FOLD_TABLE, tokens
from .records import in_categories, in_years

#: Searched fields with their weights, names of fields in queries, ranking constants.
WEIGHTS = {"title": 8.0, "authors": 6.0, "editors": 2.0, "venue": 3.0, "year": 2.0}
ALIASES = {
    "author": "authors", "authors": "authors", "a": "authors", "editor": "editors", "title": "title", "t": "title",
    "venue": "venue", "v": "venue", "year": "year", "y": "year",
}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


# ---------------------------------------------------------------- query language


@dataclass(frozen=True)
class Term:
    """Words that must (or, if excluded, must not) stand one after another in a field, or in any field.

    shown are the words as written, words their search tokens; with prefix the last is a beginning.
    """

    shown: tuple[str, ...]
    words: tuple[str, ...]
    prefix: bool
    field: str | None
    excluded: bool


_FOLDS = {ord(c): (FOLD_TABLE[1][i] if i < len(FOLD_TABLE[1]) else None) for i, c in enumerate(FOLD_TABLE[0])}


def search_tokens(text: str) -> tuple[str, ...]:
    """What tokens() makes of a text, in Python."""
    if text.isascii():
        return tuple(re.findall("[a-z0-9]+", text.lower()))
    import regex

    return tuple(regex.findall(r"[\p{L}\p{N}\p{Co}]+", text.lower().translate(_FOLDS)))


# a part of a query: a minus, a name with a colon, then a quoted phrase or a word.
_PART = re.compile(r'(-)?(?:(\w+):)?(?:"([^"]*)"|(\S+))')


def parse_query(query: str | None) -> list[Term]:
    """The terms of a query: words, "phrases", field:term and -term; all must hold.

    A word's last token is a beginning unless the word is a single character; a word with punctuation
    is a phrase. A prefix that names no field belongs to the word, and is lost before a phrase in quotes.
    """
    terms = []
    for minus, name, phrase, word in _PART.findall(query or ""):
        field = ALIASES.get(name.lower())
        quoted = not word
        text = phrase if quoted else word
        if name and not field and not quoted:
            text = f"{name}:{word}"
        shown = tuple(re.findall(r"\w+", text))
        if not shown:
            continue
        prefix = not quoted and (len(shown) > 1 or len(shown[-1]) > 1)
        terms.append(Term(shown, search_tokens(" ".join(shown)), prefix, field, bool(minus)))
    return terms if any(not t.excluded for t in terms) else []


def describe(terms: list[Term]) -> str:
    """The terms in the notation of a match expression."""
    def one(t):
        return (f"{t.field} : " if t.field else "") + '"%s"' % " ".join(t.shown) + "*" * t.prefix

    wanted, unwanted = [one(t) for t in terms if not t.excluded], [one(t) for t in terms if t.excluded]
    return " NOT ".join([" AND ".join(wanted), *unwanted])


# ---------------------------------------------------------------- index


@dataclass
class Index:
    """postings: (field, term, id, positions); lengths: (id, n) tokens over all fields of every record."""

    postings: DataFrame
    lengths: DataFrame

    def cache(self) -> Index:
        self.postings, self.lengths = self.postings.cache(), self.lengths.cache()
        return self


def field_text(name: str) -> Column:
    """A field's indexed text; names of a list follow each other in one stream of tokens."""
    if name in ("authors", "editors"):
        return F.array_join(name, "\n")
    return F.col(name).cast("string")


def build_index(pubs: DataFrame, fields: tuple[str, ...] = tuple(WEIGHTS)) -> Index:
    """The positional index of a publications table: one pass tokenises, one shuffle groups.

    Linkage needs the title only; with fewer fields lengths count the tokens of those.
    """
    tokenised = pubs.select("id", *[F.coalesce(tokens(field_text(f)), F.array().cast("array<string>")).alias(f) for f in fields])
    by_field = tokenised.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("words")) for f in fields])).alias("t"))
    placed = by_field.select("id", "t.field", F.posexplode("t.words").alias("pos", "term"))
    postings = placed.groupBy("field", "term", "id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    lengths = tokenised.select("id", reduce(Column.__add__, [F.size(f) for f in fields]).cast("long").alias("n"))
    return Index(postings, lengths)


# ---------------------------------------------------------------- matching and ranking


def _is(slot: tuple[str, bool]) -> Column:
    word, beginning = slot
    return F.col("term").startswith(word) if beginning else F.col("term") == word


def matches(index: Index, terms: list[Term]) -> DataFrame:
    """(id, tf of each term): weighted occurrences of the terms in the records that have any of them.

    The postings of all query words are read once, with the words as a pushed filter, and grouped
    once by record and field; phrases are then found by their positions.
    """
    slots = sorted({(w, t.prefix and i == len(t.words) - 1) for t in terms for i, w in enumerate(t.words)})
    wanted_fields = {t.field for t in terms}
    hits = index.postings.where(reduce(Column.__or__, [_is(s) for s in slots]))
    if None not in wanted_fields:
        hits = hits.where(F.col("field").isin(*wanted_fields))
    places = [F.flatten(F.collect_list(F.when(_is(s), F.col("positions")))).alias(f"p{i}") for i, s in enumerate(slots)]
    by_field = hits.groupBy("id", "field").agg(*places)

    def occurrences(t: Term) -> Column:
        at = [F.col(f"p{slots.index((w, t.prefix and i == len(t.words) - 1))}") for i, w in enumerate(t.words)]
        if len(at) == 1:
            n = F.size(at[0])
        else:
            follows = lambda p: reduce(Column.__and__, [F.array_contains(a, p + i) for i, a in enumerate(at[1:], 1)])
            n = F.size(F.filter(at[0], follows))
        weight = F.element_at(F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair]), F.col("field"))
        return n * weight if t.field is None else F.when(F.col("field") == t.field, n * weight).otherwise(0.0)

    sums = by_field.groupBy("id").agg(*[F.sum(occurrences(t)).alias(f"tf{i}") for i, t in enumerate(terms)])
    return sums


def scan_matches(pubs: DataFrame, terms: list[Term]) -> DataFrame:
    """(id, n, tf of each term) of every record, from the records themselves: one pass, no shuffle.

    What a search costs where no index is kept: building one for a single query would cost more.
    """
    made = F.struct(*[F.coalesce(tokens(field_text(f)), F.array().cast("array<string>")).alias(f) for f in WEIGHTS])
    # generated, not projected: a projection would be merged into each use and tokenise again for every word
    rows = pubs.select("id", F.inline(F.array(made)))

    def occurrences(t: Term, name: str) -> Column:
        last = len(t.words) - 1

        def here(word: Column, i: Column) -> Column:
            at = [word, *[F.get(F.col(name), i + k) for k in range(1, len(t.words))]]
            tests = [a.startswith(w) if t.prefix and k == last else a == w for k, (a, w) in enumerate(zip(at, t.words))]
            return reduce(Column.__and__, tests)

        return F.size(F.filter(F.col(name), here)) * F.lit(WEIGHTS[name])

    sums = [reduce(Column.__add__, [occurrences(t, f) for f in WEIGHTS if t.field in (None, f)]).alias(f"tf{i}") for i, t in enumerate(terms)]
    return rows.select("id", reduce(Column.__add__, [F.size(f) for f in WEIGHTS]).cast("long").alias("n"), *sums)


def rank(table: DataFrame, terms: list[Term]) -> DataFrame:
    """(id, score) of the records that have every wanted term and no unwanted one; a higher score is better.

    table: (id, n, tf of each term) of all records; a record without a term may have null or 0.
    """
    tf = [F.coalesce(F.col(f"tf{i}"), F.lit(0.0)) for i in range(len(terms))]
    has = reduce(Column.__and__, [tf[i] == 0 if t.excluded else tf[i] > 0 for i, t in enumerate(terms)])
    # the corpus figures of all terms are one row of one aggregation
    figures = F.struct(F.count("*").alias("records"), F.avg("n").alias("mean"), *[F.count_if(x > 0).alias(f"d{i}") for i, x in enumerate(tf)])
    figures = table.agg(figures.alias("f")).select("f").scalar()
    found = table.where(has).select("id", "n", *[x.alias(f"tf{i}") for i, x in enumerate(tf)]).withColumn("f", figures)
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        if not t.excluded:
            rows, own = F.col(f"f.d{i}"), F.col(f"tf{i}")
            idf = F.ln((F.col("f.records") - rows + 0.5) / (rows + 0.5))
            idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
            score = score + idf * own * (K1 + 1) / (own + K1 * (1 - B + B * F.col("n") / F.col("f.mean")))
    return found.select("id", score.alias("score"))


def search(
    pubs: DataFrame, index: Index | None, query: str, offset: int = 0, limit: int = 50, types: list[str] | None = None,
    year_from: int | None = None, year_to: int | None = None, sort: str = "relevance", digits: int | None = 6,
) -> DataFrame:
    """The records that match a query, ranked, with their score; a page of limit rows from offset.

    With an index the postings of the query's words are read, without one the records' texts.

    Order: score (rounded to digits) falling, then year falling, then id; with sort="year" year and id
    falling. An empty query, one of exclusions only, or a term without search tokens finds nothing.
    """
    terms = parse_query(query)
    if not terms or any(not t.words for t in terms if not t.excluded):
        return pubs.limit(0).withColumn("score", F.lit(0.0))
    terms = [t for t in terms if t.words]
    hits = rank(index.lengths.join(matches(index, terms), "id", "left") if index else scan_matches(pubs, terms), terms)
    hits = hits.withColumn("score", F.round("score", digits)) if digits is not None else hits
    rows = pubs.join(hits, "id")
    for condition in (in_categories(types), in_years(year_from, year_to)):
        rows = rows.where(condition) if condition is not None else rows
    order = [F.desc("year"), F.desc("id")] if sort == "year" else [F.desc("score"), F.desc("year"), F.asc("id")]
    return rows.orderBy(*order).offset(offset).limit(limit)


def search_page(pubs: DataFrame, index: Index, query: str, offset: int = 0, limit: int = 50, **options) -> dict:
    """{results, more[, error]}: a page as rows, and whether there are more; errors are told, not raised."""
    try:
        rows = search(pubs, index, query, offset, limit + 1, **options).collect()
    except (ValueError, AnalysisException, ParseException) as problem:  # what the query itself got wrong; a failing cluster raises
        return {"results": [], "more": False, "error": str(problem)}
    return {"results": rows[:limit], "more": len(rows) > limit}


def title_candidates(pubs: DataFrame, index: Index, entries: DataFrame, most: int | None = None) -> DataFrame:
    """(entry, id) of the records whose title has all of the words of an entry's title.

    entries has entry and words (array of search tokens). Entries meet records by the rarest of their words alone; the other
    words are then looked for in the titles met, so a common word makes no pairs. With most, only so many records of the
    lowest ids are kept for an entry; without, all are.
    """
    asked = entries.select("entry", F.array_distinct("words").alias("words"))
    each = asked.select("entry", F.size("words").alias("k"), F.explode("words").alias("term"))
    posted = index.postings.where("field = 'title'").select("term", "id")
    often = posted.join(each.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("records"))
    # a word that no title has rules an entry out
    rarest = each.join(often, "term").groupBy("entry").agg(
        F.min_by("term", F.struct("records", "term")).alias("term"), F.count("*").alias("n"), F.first("k").alias("k")
    ).where("n = k").select("entry", "term")
    met = posted.join(rarest, "term").select("entry", "id").join(asked, "entry")
    titles = pubs.select("id", tokens(field_text("title")).alias("has"))
    full = met.join(titles, "id").where(F.size(F.array_except("words", "has")) == 0).select("entry", "id")
    if most is None:
        return full
    from pyspark.sql import Window

    return full.withColumn("r", F.row_number().over(Window.partitionBy("entry").orderBy("id"))).where(F.col("r") <= most).drop("r")
