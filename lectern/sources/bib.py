"""BibTeX files as tables of items, and documents written as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.bibtex import parse as parse_bib

ITEM_DDL = (
    "pos int, kind string, type string, key string, fields array<struct<name:string,value:string>>, "
    "exprs array<struct<name:string,value:string>>, raw string, error string"
)


class ParseBib:
    """All items of a text, in order."""

    def eval(self, text: str):
        for pos, i in enumerate(parse_bib(text)):
            pairs = [[{"name": n, "value": v} for n, v in p] for p in (i.fields, i.exprs.items())]
            yield pos, i.kind, i.type, i.key, *pairs, i.raw, i.error


def parse(df: DataFrame, text: str = "text") -> DataFrame:
    """df joined with the items of its text column: (columns of df, columns of ITEM_DDL)."""
    table = udtf(ParseBib, returnType=ITEM_DDL)
    return df.lateralJoin(table(F.col(text).outer()))


def read_bib(spark: SparkSession, path: str) -> DataFrame:
    """The items of .bib files, one group a file; bytes that are no UTF-8 become replacement characters."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bib").load(path)
    return parse(files.select("path", F.col("content").cast("string").alias("text"))).drop("text")


def write_bib(documents: DataFrame, path: str) -> None:
    """(doc, bib) as one text file for each document, in folders by document."""
    documents.select("doc", F.expr("rtrim('\n', bib)").alias("value")).write.partitionBy("doc").mode("errorifexists").text(path)
