"""Mixing sources to target weights: token counts by source, repetition rates, seeded copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.dump import number_rows
from .common import WORD, cut

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A target is joined by broadcast up to this many sources, else by a shuffle.
BROADCAST_SOURCES = 20_000
#: Parts that rows alike in id, source and text are dealt into.
SALTS = 64


def size_of(text: Column) -> Column:
    """Number of words; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """(source, source_size, weight, target, rate) from rows (source, source_size), one per source.

    Sources stand in code point order, null last, and take the weights in turn. Together they get
    share times the sum of all sizes; a target that would exceed most times its source's size stops
    there and the excess is shared again by weight, until none exceeds it. Each round is an aggregation
    over the sources that gives the driver two sums; no task holds all sources. A source of size 0 has
    target 0 and rate 0; no sources give no rows. share must not exceed most.
    """
    if share > most:
        raise ValueError("share must not exceed most: the targets could not hold it")
    numbered = number_rows(sizes.withColumn("last", F.col("source").isNull()), "last", "source", to="k")
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(F.col("k") - 1, F.lit(len(weights))).cast("int"))
    ranked = cut(numbered.select("source", "source_size", weight.alias("weight")))
    cap = F.col("source_size") * F.lit(most)
    size, parts = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    full_size, full_parts, level = 0, 0.0, 0.0
    while size is not None and parts > full_parts:
        level = (size * share - full_size * most) / (parts - full_parts)
        full = cap < F.lit(level) * F.col("weight")
        got = ranked.agg(F.sum(F.when(full, F.col("source_size")).otherwise(0)), F.sum(F.when(full, F.col("weight")).otherwise(0.0))).first()
        if tuple(got) == (full_size, full_parts):
            break
        full_size, full_parts = got
    target = F.least(cap, F.lit(level) * F.col("weight")).cast("double")
    return ranked.select(
        "source", "source_size", "weight", target.alias("target"),
        F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(most)))).otherwise(0.0).alias("rate"),
    )


def draw(seed: int, *ids: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the ids alone: the same in every run and order."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in ids])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def plan(
    docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
    weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17,
    whole_rows: bool = False,
) -> DataFrame:
    """(doc_id, size, source_size, target, rate, copies): how often each document is taken.

    copies is floor(rate) plus one with probability rate - floor(rate), drawn by a hash of the seed and of the
    document's id, source and text, so reruns agree and rows that share an id, or have none, draw apart; rows alike in all
    three are numbered and draw by their number too. Sizes and rates count all documents. Null texts have size 0; null
    sources are a source of their own; an empty table gives no rows. With whole_rows a struct named row holds the
    document's columns, whatever their names.
    """
    own = F.struct(F.col(doc_id).alias("id"), F.col(source).alias("source"))
    null = F.lit("null")
    # id, source and text in one: what a draw depends on
    key = F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), null) for c in (doc_id, source, text)]))
    small = cut(docs.select(own.alias("d"), size_of(F.col(text)).alias("size"), key.alias("key")))
    work = docs.select(own.alias("d"), size_of(F.col(text)).alias("size"), key.alias("key"), F.struct(*docs.columns).alias("row")) if whole_rows else small
    sums = cut(targets(
        small.groupBy(F.col("d.source").alias("source")).agg(F.sum("size").alias("source_size")), weights, share, most
    ))
    few = sums.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    sums = sums.withColumnRenamed("source", "s")
    joined = _numbered(work, small).join(F.broadcast(sums) if few else sums, F.col("d.source").eqNullSafe(sums["s"]))
    whole = F.floor("rate")
    copies = whole + F.when(draw(seed, F.col("key"), F.col("copy")) < F.col("rate") - whole, 1).otherwise(0)
    return joined.select(
        F.col("d.id").alias(doc_id), "size", "source_size", "target", "rate", copies.cast("long").alias("copies"),
        *(["row"] if whole_rows else []),
    )


def _numbered(work: DataFrame, small: DataFrame) -> DataFrame:
    """work with a column copy that tells rows of one key apart; only such rows are shuffled to be numbered.

    They are dealt by their key and a salt, so that no task holds all rows of a key.
    """
    same = cut(small.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("k")))
    if not same.limit(1).count():
        return work.withColumn("copy", F.lit(0).cast("long"))
    salted = work.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    found = salted.join(same, salted["key"] == same["k"], "left")
    single = found.where("k is null").withColumn("copy", F.lit(0).cast("long"))
    several = found.where("k is not null").drop("k")
    # numbers run on from salt to salt, so the rows of a key have the same ones however they are dealt
    before = Window.partitionBy("key").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = several.groupBy("key", "salt").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    number = F.row_number().over(Window.partitionBy("key", "salt").orderBy("size")) + F.col("before") - 1
    several = several.join(parts.drop("n"), ["key", "salt"]).withColumn("copy", number.cast("long"))
    return single.drop("k", "salt").unionByName(several.drop("salt", "before"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """The mixed documents, in the columns of docs: each row as often as plan() says, perhaps never."""
    planned = plan(docs, text, source, doc_id, whole_rows=True, **options)
    return planned.where("copies > 0").select(
        "row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("n")
    ).select("row.*")
