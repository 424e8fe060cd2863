"""The published catalogue: staged as a new version, checked, then made current by a pointer."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm_title_column
from ..operators import link, records, search
from ..schema import COLUMNS
from .dump import number_rows, read_dump

POINTER = "CURRENT"


class DuplicateKey(ValueError):
    """Two records of a dump have one key; nothing is published."""


def _store(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, first under another name, then renamed, so that readers see the old or the new one."""
    jvm, target, fs = _store(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    if fs.exists(target):
        fs.delete(target, False)
    fs.rename(part, target)


def _read_text(spark: SparkSession, path: str) -> str | None:
    _, target, fs = _store(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def duplicate_keys(pubs: DataFrame) -> DataFrame:
    """(key, n) of keys that occur more than once."""
    return pubs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def build(spark: SparkSession, dump: str, target: str, **options) -> int:
    """Publish a dump under target and return its number of records.

    Tables of the new version: pubs (with lower-cased doi and normalised title, sorted by key so that
    a lookup prunes row groups), postings (by field, in ranges of term and id, so that a common word is
    many tasks' work) and lengths. The version becomes
    current only when all of it is written and keys are unique; on failure its folder goes and the
    version before stays.
    """
    begun, version = time.time(), f"{target.rstrip('/')}/v-{uuid.uuid4().hex}"
    _, folder, fs = _store(spark, version)
    try:
        # staged once: numbers, tables and checks read the stage, not the dump again
        read_dump(spark, dump, **options).write.parquet(f"{version}/stage")
        staged = spark.read.parquet(f"{version}/stage")
        if duplicate_keys(staged).limit(1).count():
            raise DuplicateKey(", ".join(r["key"] for r in duplicate_keys(staged).limit(5).collect()))
        pubs = number_rows(staged, "file", "place").select(*COLUMNS, F.lower("doi").alias("doi_lc"), norm_title_column(F.col("title")).alias("norm_title"))
        pubs.repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{version}/pubs")
        pubs = spark.read.parquet(f"{version}/pubs")
        index = search.build_index(pubs)
        index.postings.repartitionByRange("field", "term", "id").sortWithinPartitions("field", "term", "id").write.partitionBy("field").parquet(f"{version}/postings")
        index.lengths.write.parquet(f"{version}/lengths")
        n = pubs.count()
        meta = {"source": dump.rpartition("/")[2], "records": n, "built": int(time.time()), "build_seconds": int(time.time() - begun)}
        _write_text(spark, f"{version}/meta.json", json.dumps(meta))
        fs.delete(_store(spark, f"{version}/stage")[1], True)
        _write_text(spark, f"{target.rstrip('/')}/{POINTER}", version)
        return n
    except BaseException:
        fs.delete(folder, True)
        raise


@dataclass
class Catalog:
    """The current version of a target: its tables and the queries over them."""

    spark: SparkSession
    pubs: DataFrame
    index: search.Index
    meta: dict

    @classmethod
    def open(cls, spark: SparkSession, target: str) -> Catalog | None:
        """None where nothing has been published."""
        version = _read_text(spark, f"{target.rstrip('/')}/{POINTER}")
        if version is None:
            return None
        tables = [spark.read.parquet(f"{version}/{name}") for name in ("pubs", "postings", "lengths")]
        return cls(spark, tables[0], search.Index(*tables[1:]), json.loads(_read_text(spark, f"{version}/meta.json")))

    def get(self, key: str) -> DataFrame:
        return records.get(self.pubs, key)

    def search(self, query: str, **options) -> dict:
        return search.search_page(self.pubs, self.index, query, **options)

    def author(self, name: str) -> DataFrame:
        return records.author_page(self.pubs, name)

    def coauthors(self, name: str, most: int = 12) -> DataFrame:
        return records.coauthors(self.pubs, name, most)

    def toc(self, key: str):
        return records.toc(self.pubs, key)

    def match(self, entries: DataFrame) -> DataFrame:
        return link.match(self.pubs, self.index, entries)

    def render(self, items: DataFrame, **options) -> DataFrame:
        from ..operators import document
        from ..operators.transform import Options

        return document.render(self.pubs, items, Options.of(**options))
