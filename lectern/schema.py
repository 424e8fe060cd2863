"""Types of the tables: publications, dump rows, document items."""

from __future__ import annotations

#: Record types, in the order of the format.
RECORD_TYPES = ("article", "inproceedings", "proceedings", "book", "incollection", "phdthesis", "mastersthesis", "data")
#: Fields kept in the extra struct, first value each.
EXTRA_FIELDS = ("series", "publisher", "isbn", "school", "note", "month", "address", "chapter", "publnr", "url")

EXTRA_DDL = ", ".join(f"{name}: string" for name in EXTRA_FIELDS) + ", title_xml: string, ee: array<string>"
PUBS_DDL = (
    "id bigint, key string, type string, publtype string, title string, authors array<string>, editors array<string>, "
    "venue string, year int, volume string, number string, pages string, crossref string, doi string, mdate string, "
    f"extra struct<{EXTRA_DDL}>"
)
COLUMNS = tuple(part.strip().split(" ")[0] for part in PUBS_DDL.split(" extra ")[0].split(",") if part.strip()) + ("extra",)

#: What search results and candidates show of a record.
SUMMARY = ("key", "type", "publtype", "title", "authors", "editors", "venue", "year", "volume", "number", "pages", "crossref", "doi")

FIELDS_DDL = "array<struct<name:string,value:string>>"
