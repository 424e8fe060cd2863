"""Views of the test tables in the shape of records, documents and entries, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EXTRA_DDL, RECORD_TYPES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, by: str) -> Column:
    """The value at a place counted from 0, by an expression of integers that Spark and DuckDB read alike."""
    return F.element_at(F.array(*map(F.lit, values)), (F.expr(by) + 1).cast("int"))


def pick_sql(values, by: str) -> str:
    """pick() for DuckDB."""
    return "([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"])[(({by}) + 1)::INTEGER]"


def _empty_extra(**given: Column) -> Column:
    parts = []
    for piece in EXTRA_DDL.split(", "):
        name, kind = piece.split(": ")
        parts.append(given.get(name, F.lit(None)).cast(kind).alias(name))
    return F.struct(*parts)


def text_records(spark: SparkSession, sf_dir: str, starts: bool = False) -> DataFrame:
    """documents and their labels as publications: the whole text, white space folded, is the title, the source the venue.

    With starts there is a column title_start, a beginning of the title, for linkage.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    doc = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, RECORD_TYPES)), (doc % 8 + 1).cast("int"))
    poor = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    year = F.when(doc % 50 != 0, 2000 + doc % 25).cast("int")
    folded = lambda text: F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))
    # folding whole texts costs more than reading them, so the beginning is folded by itself
    if starts:
        # before labels are joined, so that the join need not carry whole texts
        docs = docs.withColumn("title_start", folded(F.substring("text", 1, 400)))
    start = ["title_start"] * starts
    return docs.join(poor, "doc_id", "left").select(
        doc.alias("id"), F.concat(F.lit("text/"), doc.cast("string")).alias("key"), kind.alias("type"),
        F.when(F.col("quality") == 0, F.lit("Informal")).alias("publtype"), folded(F.col("text")).alias("title"), *start,
        F.array(F.concat(F.lit("Writer "), (doc % 37).cast("string")), F.concat(F.lit("Helper "), (doc % 11).cast("string"))).alias("authors"),
        F.array(F.concat(F.lit("Editor "), (doc % 7).cast("string"))).alias("editors"),
        F.when(doc % 5 == 0, "CoRR").otherwise(F.col("source")).alias("venue"), year.alias("year"),
        F.when(doc % 3 != 0, (doc % 9).cast("string")).alias("volume"), F.lit(None).cast("string").alias("number"),
        F.concat((doc % 90).cast("string"), F.lit(" - "), (doc % 90 + 9).cast("string")).alias("pages"),
        F.lit(None).cast("string").alias("crossref"), F.concat(F.lit("10.1000/Doc."), doc.cast("string")).alias("doi"),
        F.lit("2024-01-01").alias("mdate"),
        _empty_extra(
            series=F.when(doc % 4 == 0, F.lit("Lecture Notes in Computer Science")).otherwise(F.col("source")),
            ee=F.array(F.concat(F.lit("https://doi.org/10.1000/Doc."), doc.cast("string"))),
        ).alias("extra"),
    )


#: The same view for DuckDB, without extra.
TEXT_SQL = r"""
pubs AS (
  SELECT d.doc_id AS id, 'text/' || d.doc_id AS key,
    (['article', 'inproceedings', 'proceedings', 'book', 'incollection', 'phdthesis', 'mastersthesis', 'data'])[(d.doc_id % 8)::INTEGER + 1] AS type,
    CASE WHEN l.quality = 0 THEN 'Informal' END AS publtype, trim(regexp_replace(d.text, '[ \t\n\r\f]+', ' ', 'g')) AS title,
    ['Writer ' || (d.doc_id % 37), 'Helper ' || (d.doc_id % 11)] AS authors, ['Editor ' || (d.doc_id % 7)] AS editors,
    CASE WHEN d.doc_id % 5 = 0 THEN 'CoRR' ELSE d.source END AS venue,
    (CASE WHEN d.doc_id % 50 <> 0 THEN 2000 + d.doc_id % 25 END)::INTEGER AS year,
    CASE WHEN d.doc_id % 3 <> 0 THEN (d.doc_id % 9)::VARCHAR END AS volume,
    (d.doc_id % 90) || ' - ' || (d.doc_id % 90 + 9) AS pages, '10.1000/Doc.' || d.doc_id AS doi,
    CASE WHEN d.doc_id % 4 = 0 THEN 'Lecture Notes in Computer Science' ELSE d.source END AS series,
    'https://doi.org/10.1000/Doc.' || d.doc_id AS url
  FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id
)
"""


def star_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as proceedings, their lines as papers by suppliers: crossref is the order, venue the part's brand."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    parts, suppliers = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    none = F.lit(None).cast("string")
    papers = lines.groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.min("l_linenumber").alias("n")).join(
        parts, F.col("l_partkey") == F.col("p_partkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(
        orders, F.col("l_orderkey") == F.col("o_orderkey"))
    order_key = lambda c: F.concat(F.lit("order/"), F.col(c).cast("string"))
    paper_key = F.concat_ws("/", F.lit("line"), F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    papers = papers.select(
        paper_key.alias("key"), F.when(F.col("n") == 7, "article").otherwise("inproceedings").alias("type"), F.col("p_name").alias("title"),
        F.array("s_name", F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"))).alias("authors"),
        F.col("p_brand").alias("venue"), F.year("o_orderdate").cast("int").alias("year"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_size").cast("string")).alias("volume"),
        F.when(F.col("n") != 7, order_key("l_orderkey")).alias("crossref"),
    )
    heads = orders.select(
        order_key("o_orderkey").alias("key"), F.lit("proceedings").alias("type"), F.concat(F.lit("Proceedings of "), F.col("o_orderpriority")).alias("title"),
        F.array().cast("array<string>").alias("authors"), none.alias("venue"), F.year("o_orderdate").cast("int").alias("year"), none.alias("volume"), none.alias("crossref"),
    )
    both = papers.unionByName(heads)
    return both.select(
        F.xxhash64("key").alias("id"), "key", "type", none.alias("publtype"), "title", "authors", F.array().cast("array<string>").alias("editors"), "venue",
        "year", "volume", none.alias("number"), none.alias("pages"), "crossref", none.alias("doi"), none.alias("mdate"), _empty_extra().alias("extra"),
    )


STAR_SQL = """
pubs AS (
  SELECT 'line/' || l_orderkey || '/' || l_partkey || '/' || l_suppkey AS key, CASE WHEN n = 7 THEN 'article' ELSE 'inproceedings' END AS type,
    p_name AS title, [s_name, 'Customer ' || o_custkey] AS authors, p_brand AS venue, year(o_orderdate)::INTEGER AS year,
    CASE WHEN p_size % 3 <> 0 THEN p_size::VARCHAR END AS volume, CASE WHEN n <> 7 THEN 'order/' || l_orderkey END AS crossref
  FROM (SELECT l_orderkey, l_partkey, l_suppkey, min(l_linenumber) AS n FROM lineitem GROUP BY ALL)
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
  UNION ALL
  SELECT 'order/' || o_orderkey, 'proceedings', 'Proceedings of ' || o_orderpriority, []::VARCHAR[], NULL, year(o_orderdate)::INTEGER, NULL, NULL FROM orders
)
"""


def doc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as bibliography documents: a turn is an item, its key repeats now and then."""
    turns = table(spark, sf_dir, "conversations")
    mixed = F.col("conv_id") * 7 + F.col("turn") * 3
    kind = F.when(F.col("role") == "system", "other").when(mixed % 4 == 0, "record").otherwise("raw")
    return turns.select(
        F.col("conv_id").alias("doc"), F.col("turn").cast("int").alias("pos"), kind.alias("kind"),
        F.when(F.col("role") != "system", F.concat(F.lit("key"), (mixed % 3).cast("string"))).alias("key"), F.col("text").alias("raw"),
        F.when(mixed % 5 == 0, F.lit("old")).alias("orig"), (mixed % 2 == 0).alias("same"), (mixed % 6 < 3).alias("has_alt"),
        (mixed % 3).cast("int").alias("n_candidates"), (mixed % 7 != 0).alias("checked"), (mixed % 8 > 5).alias("has_subst"),
        (2000 + mixed % 20).cast("int").alias("year"),
    )


DOC_SQL = """
items AS (
  SELECT conv_id AS doc, turn::INTEGER AS pos, CASE WHEN role = 'system' THEN 'other' WHEN m % 4 = 0 THEN 'record' ELSE 'raw' END AS kind,
    CASE WHEN role <> 'system' THEN 'key' || (m % 3) END AS key, text AS raw, CASE WHEN m % 5 = 0 THEN 'old' END AS orig, m % 2 = 0 AS same,
    m % 6 < 3 AS has_alt, (m % 3)::INTEGER AS n_candidates, m % 7 <> 0 AS checked, m % 8 > 5 AS has_subst, (2000 + m % 20)::INTEGER AS year
  FROM (SELECT *, conv_id * 7 + turn * 3 AS m FROM conversations)
)
"""
