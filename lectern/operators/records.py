"""Lookups, filters and listings over the publications table."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_number
from ..schema import SUMMARY

# ---------------------------------------------------------------- predicates


def informal() -> Column:
    """Informal by the kind of publication alone, in any case."""
    return F.coalesce("publtype", F.lit("")).ilike("%informal%")


def informal_strict() -> Column:
    """Informal by venue or kind of publication, in lower case only: what linkage calls a preprint."""
    return F.coalesce(F.col("venue") == "CoRR", F.lit(False)) | F.contains(F.coalesce("publtype", F.lit("")), F.lit("informal"))


def display_category() -> Column:
    """The one category a record is shown under."""
    by_type = F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for pair in {
            "article": "journal", "inproceedings": "conference", "proceedings": "editorship", "book": "book",
            "incollection": "part", "phdthesis": "thesis", "mastersthesis": "thesis", "data": "data",
        }.items() for x in pair]), F.col("type")), F.lit("journal"),
    )
    return F.when(informal_strict(), "informal").otherwise(by_type)


#: Search categories; they overlap: informal proceedings are in informal and in editorship.
CATEGORIES = {
    "journal": lambda: (F.col("type") == "article") & ~informal(),
    "conference": lambda: (F.col("type") == "inproceedings") & ~informal(),
    "informal": informal,
    "editorship": lambda: F.col("type") == "proceedings",
    "book": lambda: (F.col("type") == "book") & ~informal(),
    "part": lambda: F.col("type") == "incollection",
    "thesis": lambda: F.col("type").isin("phdthesis", "mastersthesis"),
    "data": lambda: F.col("type") == "data",
}


def in_categories(names: list[str] | None) -> Column | None:
    """Any of the named categories; unknown names are ignored, and with none left there is no filter."""
    known = [CATEGORIES[n]() for n in names or () if n in CATEGORIES]
    return reduce(Column.__or__, known) if known else None


def in_years(first: int | None = None, last: int | None = None) -> Column | None:
    """A range of years, both ends included; records without a year are in no range."""
    ends = [F.col("year") >= int(first)] if first else []
    ends += [F.col("year") <= int(last)] if last else []
    return reduce(Column.__and__, ends) if ends else None


def by_person(name: str) -> Column:
    """Records of exactly this author or editor."""
    member = lambda c: F.coalesce(F.array_contains(c, name), F.lit(False))
    return member("authors") | member("editors")


# ---------------------------------------------------------------- lookups


def get(pubs: DataFrame, key: str) -> DataFrame:
    return pubs.where(F.col("key") == key).limit(1)


def get_many(pubs: DataFrame, keys: DataFrame) -> DataFrame:
    """One row for each row of keys (column key); records that do not exist are null beside their key."""
    return keys.select("key").join(pubs, "key", "left")


def by_doi(pubs: DataFrame, doi: str) -> DataFrame:
    return pubs.where(F.lower("doi") == doi.lower())


def by_arxiv(pubs: DataFrame, arxiv_id: str) -> DataFrame:
    return pubs.where((F.col("venue") == "CoRR") & (F.col("volume") == f"abs/{arxiv_id}"))


def summary(pubs: DataFrame, *more: str) -> DataFrame:
    """What listings show: the first three links and the series beside the plain columns."""
    return pubs.select(*SUMMARY, F.slice(F.coalesce("extra.ee", F.array().cast("array<string>")), 1, 3).alias("ee"), F.col("extra.series").alias("series"), *more)


# ---------------------------------------------------------------- listings


def with_crossref(pubs: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """records (all by default) with the record they refer to as a struct xref, null without one."""
    records = pubs if records is None else records
    parents = pubs.select(F.col("key").alias("x_key"), F.struct(*pubs.columns).alias("xref"))
    return records.join(parents, F.col("crossref") == F.col("x_key"), "left").drop("x_key")


def children(pubs: DataFrame, keys: DataFrame) -> DataFrame:
    """(parent, record columns) of the records that refer to a key of keys."""
    return pubs.join(keys.select(F.col("key").alias("parent")), F.col("crossref") == F.col("parent"))


def volume_mates(pubs: DataFrame, keys: DataFrame) -> DataFrame:
    """(of, record columns) of the articles in the venue and volume of the articles of keys; no volume is a volume."""
    own = pubs.join(keys.select("key"), "key", "left_semi").where("type = 'article' and venue is not null and venue <> ''")
    own = own.select(F.col("key").alias("of"), F.col("venue").alias("v"), F.col("volume").alias("w"))
    return pubs.where("type = 'article'").join(own, (F.col("venue") == F.col("v")) & F.col("volume").eqNullSafe(F.col("w"))).drop("v", "w")


def resolve_parents(pubs: DataFrame, keys: DataFrame, most_steps: int = 8) -> DataFrame:
    """(key, head): the record at whose contents each key's listing stands.

    A proceedings or book is its own head; any other record that refers to one goes on with that, at
    most so many steps (a cycle ends there). A record whose parent does not exist has a null head.
    """
    place = pubs.select("key", "type", F.nullif("crossref", F.lit("")).alias("crossref"))
    step = place.select(F.col("key").alias("k"), F.when(F.col("type").isin("proceedings", "book"), F.lit(None)).otherwise(F.col("crossref")).alias("up"))
    cur = keys.select("key").join(step, F.col("key") == F.col("k")).select("key", F.col("k").alias("head"), "up")
    for _ in range(most_steps):
        ahead = step.select(F.col("k").alias("k2"), F.col("up").alias("up2"))
        cur = cur.join(ahead, F.col("up") == F.col("k2"), "left").select(
            "key", F.when(F.col("up").isNull(), F.col("head")).otherwise(F.col("k2")).alias("head"), F.col("up2").alias("up")
        )
    return cur.select("key", "head")


def toc(pubs: DataFrame, key: str) -> tuple[dict | None, DataFrame]:
    """The head and the contents of a record's volume, in the order of the dump.

    A proceedings or book lists what refers to it; a record that refers to one lists that one; an
    article with a venue lists its journal volume, whose head is made up; anything else lists itself.
    """
    record = get(pubs, key).select("key", "type", "title", "year", "venue", "volume", "crossref").first()
    for _ in range(8):
        if record is None or record["type"] in ("proceedings", "book") or not record["crossref"]:
            break
        record = get(pubs, record["crossref"]).select("key", "type", "title", "year", "venue", "volume", "crossref").first()
    if record is None:
        return None, pubs.limit(0)
    if record["type"] in ("proceedings", "book"):
        return record.asDict(), pubs.where(F.col("crossref") == record["key"]).orderBy("id")
    if record["type"] == "article" and record["venue"]:
        title = record["venue"] + (f", Volume {record['volume']}" if record["volume"] else "")
        own = (F.col("type") == "article") & (F.col("venue") == record["venue"]) & F.col("volume").eqNullSafe(F.lit(record["volume"]))
        return {"key": None, "type": "volume", "title": title, "year": record["year"]}, pubs.where(own).orderBy("id")
    return record.asDict(), pubs.where(F.col("key") == record["key"])


def author_page(pubs: DataFrame, name: str) -> DataFrame:
    """A person's records, newest first; a name without letters or digits is nobody's."""
    if not re.search(r"\w", name):
        return pubs.limit(0)
    return pubs.where(by_person(name)).orderBy(F.desc("year"), F.desc("id"))


def coauthors(pubs: DataFrame, name: str, most: int = 12) -> DataFrame:
    """(name, shown, n) of the people who share most records with a person; ties by where they first occur."""
    rows = pubs.where(by_person(name)).select(
        F.coalesce("year", F.lit(-(1 << 30))).alias("y"), "id",
        F.posexplode(F.concat(F.coalesce("authors", F.array().cast("array<string>")), F.coalesce("editors", F.array().cast("array<string>")))).alias("pos", "name"),
    )
    counts = rows.where(F.col("name") != name).groupBy("name").agg(
        F.count("*").alias("n"), F.min(F.struct((-F.col("y")).alias("y"), (-F.col("id")).alias("id"), "pos")).alias("first")
    )
    return counts.orderBy(F.desc("n"), "first").limit(most).select("name", strip_number(F.col("name")).alias("shown"), "n")


def year_sections(listing: DataFrame, *order: Column) -> DataFrame:
    """listing with begins_year: whether a row's year differs from that of the row before it in the order."""
    window = Window.orderBy(*order)
    return listing.withColumn("begins_year", (F.row_number().over(window) == 1) | ~F.col("year").eqNullSafe(F.lag("year").over(window)))
