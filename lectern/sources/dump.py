"""Record dumps: a Spark data source over the line-oriented XML of a bibliography, plain or gzipped."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import strip_markup
from ..schema import EXTRA_FIELDS, PUBS_DDL, RECORD_TYPES

#: Bytes of an uncompressed file that one task scans.
SPLIT_BYTES = 64 << 20

#: How records, fields, attributes and resolver addresses are written in dumps.
_TYPES = "|".join(RECORD_TYPES)
_OPENS = re.compile(rf"<({_TYPES})\s([^>]*)>")
_RECORD_END = re.compile(rf"(</(?:{_TYPES}|www)>)")
_WHOLE_FIELD = re.compile(r"<(\w+)(?:\s[^>]*)?>(.*)</\1>\s*$", re.S)
_OPEN_FIELD = re.compile(r"<(\w+)[\s>]")
_ATTRIBUTE = re.compile(r'(\w+)="([^"]*)"')
_DOI_URL = re.compile(r"https?://(?:dx\.)?doi\.org/(10\..+)$", re.I)


@dataclass
class Raw:
    """A record as it is read: its type, attributes and fields with all their raw values."""

    type: str
    attributes: dict[str, str]
    place: int
    fields: dict[str, list[str]] = field(default_factory=dict)


class Scanner:
    """Reads lines into records.

    A record opens at the beginning of a line and counts if its own tag closes it and it has a title.
    A field that is not closed on its line goes on, joined by spaces, until its close tag.
    Several records may share a line; two different fields on one line are not told apart.
    """

    def __init__(self):
        self.record: Raw | None = None
        self.open_field: tuple[str, str] | None = None

    def feed(self, line: str, place: int) -> Iterator[Raw]:
        pieces = [line]
        if "</" in line and "><" in line:
            cut = _RECORD_END.split(line)
            pieces = [a + b for a, b in zip(cut[::2], [*cut[1::2], ""])]
        for piece in pieces:
            if self.open_field:
                name, before = self.open_field
                piece = f"{before} {piece}"
                self.open_field = (name, piece)
                if f"</{name}>" not in piece:
                    continue
                self.open_field = None
            if piece.startswith("</"):
                done, self.record = self.record, None
                if done and piece.startswith(f"</{done.type}>") and "title" in done.fields:
                    yield done
            elif piece.startswith("<"):
                self._tag(piece, place)

    def _tag(self, piece: str, place: int) -> None:
        opens = _OPENS.match(piece)
        if opens:
            self.record = Raw(opens[1], dict(_ATTRIBUTE.findall(opens[2])), place)
        elif self.record:
            whole = _WHOLE_FIELD.match(piece)
            if whole:
                self.record.fields.setdefault(whole[1], []).append(whole[2])
                return
            begins = _OPEN_FIELD.match(piece)
            if begins and begins[1] not in (*RECORD_TYPES, "www") and f"</{begins[1]}>" not in piece:
                self.open_field = (begins[1], piece.rstrip("\n"))


def finish(raw: Raw) -> tuple:
    """A record's row: columns of the publications table after id."""
    first = {name: values[0] for name, values in raw.fields.items()}
    links = [html.unescape(v) for v in raw.fields.get("ee", [])]
    extra = {name: html.unescape(first[name]).strip() if name in first else None for name in EXTRA_FIELDS}
    extra |= {"title_xml": first["title"] if "<" in first["title"] else None, "ee": links or None}
    venue = first.get("journal") or first.get("booktitle")
    if raw.type == "data" and not venue:
        venue = first.get("publisher")
    year = first.get("year", "")
    doi = next((m[1] for m in map(_DOI_URL.match, links) if m), None)
    people = [[strip_markup(n) for n in raw.fields.get(role, [])] for role in ("author", "editor")]
    plain = [strip_markup(first.get(name)) for name in ("volume", "number", "pages", "crossref")]
    return (
        raw.attributes.get("key", ""), raw.type, raw.attributes.get("publtype"), strip_markup(first["title"]), *people,
        strip_markup(venue), int(year) if year.isdigit() else None, *plain, doi, raw.attributes.get("mdate"),
        tuple(extra.values()) if any(v is not None for v in extra.values()) else None,
    )


def scan(lines: Iterable[tuple[int, str]]) -> Iterator[tuple[int, tuple]]:
    """(place, row) of the records in (place, line) pairs."""
    scanner = Scanner()
    for place, line in lines:
        for raw in scanner.feed(line, place):
            yield raw.place, finish(raw)


def _filesystem(path: str):
    """A file system for the path and the path in it: any store that Arrow knows by URI, else local files."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Part(InputPartition):
    path: str
    number: int
    begin: int
    end: int | None


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self):
        from pyarrow import fs

        store, place = _filesystem(self.path)
        info = store.get_file_info(place)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(place)) if f.type == fs.FileType.File]
        parts = []
        for number, f in enumerate(sorted(files, key=lambda f: f.path)):
            if f.path.endswith(".gz"):
                parts.append(Part(f.path, number, 0, None))  # one stream: cannot be split
            else:
                parts += [Part(f.path, number, at, min(at + self.split, f.size)) for at in range(0, max(f.size, 1), self.split)]
        return parts

    def _lines(self, part: Part):
        import gzip

        store, _ = _filesystem(self.path)
        with store.open_input_file(part.path) as raw:
            # a task takes the records that open in its range and reads on until the last one closes
            at = 0
            if part.end is None:
                lines = gzip.GzipFile(fileobj=raw)
            else:
                import io

                lines = io.BufferedReader(raw, 1 << 20)
                if part.begin:
                    lines.seek(part.begin - 1)
                    at = part.begin - 1 + len(lines.readline())
            for line in lines:
                yield at, line.decode("latin-1")
                at += len(line)

    def read(self, part: Part):
        scanner = Scanner()
        for place, line in self._lines(part):
            if part.end is not None and place >= part.end and not scanner.record:
                return
            for raw in scanner.feed(line, place):
                if part.end is None or raw.place < part.end:
                    yield (part.number, raw.place, *finish(raw))
            if part.end is not None and scanner.record and scanner.record.place >= part.end:
                return


class RecordDump(DataSource):
    """spark.read.format("record_dump").load(path): a file or a folder of files, ISO-8859-1."""

    @classmethod
    def name(cls):
        return "record_dump"

    def schema(self):
        return f"file int, place bigint, {PUBS_DDL.removeprefix('id bigint, ')}"

    def reader(self, schema):
        return Reader(self.options)


def read_dump(spark: SparkSession, path: str, **options) -> DataFrame:
    """The publications of a dump, with file and place (byte offset of its record's line) instead of an id."""
    spark.dataSource.register(RecordDump)
    return spark.read.format("record_dump").options(**options).load(path)


def number_rows(df: DataFrame, *order: str, to: str = "id") -> DataFrame:
    """df with consecutive numbers from 1 in the given order.

    Rows are range-partitioned and sorted by the order; a partition's numbers start where the sizes of
    the partitions before it end, so only one count per partition is gathered.
    """
    dealt = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("n__", F.monotonically_increasing_id())
    part, index = F.shiftright("n__", 33), F.col("n__").bitwiseAND((1 << 33) - 1)
    sizes = dealt.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
    starts, total = {}, 0
    for p, n in sizes:
        starts[p], total = total, total + n
    if not starts:
        return dealt.withColumn(to, F.lit(0).cast("bigint")).drop("n__")
    begin = F.element_at(F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]), part)
    return dealt.withColumn(to, (begin + index + 1).cast("bigint")).drop("n__")
