"""Closed-syncmer fingerprints of whole texts, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE

#: Words of a k-mer and of its inner substrings; the expressions below are written for these.
K, S = 5, 2
#: Rows of one run of neighbouring ids, and the most runs: the driver holds one id for each.
RUN_ROWS, MOST_RUNS = 2000, 10_000

# scripts written without spaces: each such character is a word of its own
_UNSPACED = "[\\u2E80-\\u9FFF\\uAC00-\\uD7AF\\uF900-\\uFAFF]"


def words(text: Column) -> Column:
    """The words of a text: runs without ASCII white space; characters of unspaced scripts stand alone."""
    spaced = F.when(text.rlike(_UNSPACED), F.regexp_replace(text, f"({_UNSPACED})", " $1 ")).otherwise(text)
    return F.array_remove(F.split(spaced, f"[{SPACE}]+"), "")


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _inner(h: Column) -> Column:
    """Hashes of the inner substrings: one for each pair of neighbouring words."""
    n = F.size(h) - 1
    return F.zip_with(F.slice(h, 1, n), F.slice(h, 2, n), lambda a, b: F.xxhash64(a, b))


def _choose(h: Column, g: Column, made, other: Column) -> Column:
    """made(i, hash) for each closed syncmer, other for the rest: i is the place of its first word.

    A k-mer of five words has four inner substrings; it is chosen if the smallest stands first or last.
    """
    at = lambda a, i, d: F.get(a, i + d if d else i)

    def one(i):
        edge, middle = F.least(at(g, i, 0), at(g, i, 3)), F.least(at(g, i, 1), at(g, i, 2))
        kmer = F.shiftrightunsigned(F.xxhash64(at(g, i, 0), at(h, i, 2), at(g, i, 3)), 32)
        return F.when(edge <= middle, made(i, kmer)).otherwise(other)

    return F.transform(F.sequence(F.lit(0), F.size(h) - K), one)


def anchors(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, position, hash): the closed syncmers of every text, by the place of their first word.

    A k-mer's choice depends on its own words alone, so equal passages of any texts give equal
    anchors, at places that differ by a constant. Null, empty and short texts have none. Repeated
    rows give repeated anchors.
    """
    none = F.lit(None).cast("struct<position:int,hash:bigint>")
    made = lambda i, x: F.struct(i.alias("position"), x.alias("hash"))
    work = docs.select(F.col(doc_id).alias("doc_id"), _hashes(F.col(text)).alias("h")).where(F.size("h") >= K)
    work = work.withColumn("g", _inner(F.col("h")))
    return work.select("doc_id", F.explode(F.array_compact(_choose(F.col("h"), F.col("g"), made, none))).alias("a")).select("doc_id", "a.*")


def _sketch(df: DataFrame, text: str, to: str) -> DataFrame:
    """df with a column to: the anchors of a text column, sorted, each hash once at its first place.

    An anchor is one number: 32 bits of hash, above the place of its first word. A text without syncmers has one
    anchor at 0, the hash of all its words, or of itself if it has no words.
    """
    df = df.withColumn("h__", _hashes(F.col(text)))
    df = df.withColumn("g__", F.when(F.size("h__") >= K, _inner(F.col("h__"))))
    packed = lambda i, x: F.shiftleft(x - (1 << 31), 32).bitwiseOR(i.cast("long"))
    chosen = F.when(
        F.col("g__").isNotNull(), F.array_compact(_choose(F.col("h__"), F.col("g__"), packed, F.lit(None).cast("long")))
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("c__", F.sort_array(chosen))
    first = F.filter("c__", lambda x, i: (i == 0) | (F.shiftright(x, 32) != F.shiftright(F.get("c__", i - 1), 32)))
    whole = F.shiftrightunsigned(F.xxhash64(F.when(F.size("h__") > 0, F.array_join(F.col("h__").cast("array<string>"), " ")).otherwise(F.col(text))), 32)
    return df.withColumn(to, F.when(F.size("c__") > 0, first).otherwise(F.array(packed(F.lit(0), whole)))).drop("h__", "g__", "c__")


def as_text(sketch: Column) -> Column:
    """A fingerprint as a string: sixteen hex digits for each anchor, its hash and its place."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def matched(a: Column, b: Column) -> Column:
    """How many anchors of two fingerprints stand for the same passage.

    Each hash that both hold votes for the shift between its places; anchors count whose shift another
    anchor votes for too, or the only one in common. Sorted arrays side by side make this linear but for sorting.
    """
    other = F.lit(1 << 31)
    both = F.sort_array(F.concat(a, F.transform(b, lambda x: x.bitwiseOR(other))))
    place = lambda x: x.bitwiseAND(F.lit((1 << 31) - 1))
    head = lambda x: F.shiftright(x, 32)
    shifts = lambda m: F.sort_array(F.array_compact(F.transform(m, lambda x, i: F.when(head(x) == head(F.get(m, i + 1)), place(F.get(m, i + 1)) - place(x)))))
    agreed = lambda s: F.when(F.size(s) == 1, 1).otherwise(F.size(F.filter(s, lambda x, i: x.eqNullSafe(F.get(s, i - 1)) | x.eqNullSafe(F.get(s, i + 1)))))
    once = lambda value, f: F.get(F.transform(F.array(value), f), 0)
    return once(once(both, shifts), agreed)


def likeness(a: Column, b: Column) -> Column:
    """The part of all anchors of two fingerprints that matched() finds in both, 0 to 1; 1 for equal texts."""
    return F.transform(F.array(matched(a, b)), lambda m: m / (F.size(a) + F.size(b) - m))[0]


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint) for every row; null texts count as empty. Equal texts have equal fingerprints."""
    work = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return _sketch(work, "text", "s").select("doc_id", as_text(F.col("s")).alias("fingerprint"))


def _run_of(value: Column, bounds: list) -> Column:
    """How many of the bounds, largest first, a value is below: searched in two levels; null comes last."""
    if not bounds:
        return F.lit(0)
    wide = math.isqrt(len(bounds) - 1) + 1
    groups = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    tops = F.array(*[F.lit(g[0]) for g in groups])
    inner = F.array(*[F.array(*map(F.lit, g)) for g in groups])
    below = lambda xs: F.size(F.filter(xs, lambda x: value < x))
    whole = below(tops)
    return F.when(value.isNull(), F.lit(len(bounds))).when(whole == 0, F.lit(0)).otherwise(
        (whole - 1) * wide + below(F.get(inner, whole - 1))
    )


def with_next(rows: DataFrame, doc_id: str, own: str) -> DataFrame:
    """rows with a column next: column own of the next row in descending doc_id, after the last the first.

    Null ids come last; rows of one id stand in the order of the hash of own. The ids are
    dealt into runs of neighbours whose bounds are quantiles of all ids; the first row of a run is
    also sent to the end of the run before it, so each row moves once, but for one in a run.
    """
    total = rows.count()
    if not total:
        return rows.withColumn("next", F.col(own))
    runs = max(1, min(MOST_RUNS, -(-total // RUN_ROWS)))
    ids = rows.where(F.col(doc_id).isNotNull())
    cuts = ids.agg(F.percentile_approx(doc_id, [i / runs for i in range(1, runs)], 20 * runs)).first()[0] if runs > 1 else None
    bounds = sorted(set(cuts or []), reverse=True)
    run = _run_of(F.col(doc_id), bounds)
    found = rows.select(run.alias("run"), doc_id).groupBy("run").agg(F.max(doc_id).alias("head")).orderBy("run").collect()
    # the head of each run also ends the run before; the first head ends the last run, or its own
    goes = [(r["head"], r["run"], found[i - 1]["run"]) for i, r in enumerate(found)]
    starts = F.create_map(*[F.lit(v) for _, own, to in goes for v in (own, to)])
    firsts = F.create_map(*[c for h, own, _ in goes for c in (F.lit(own), F.lit(h).cast(rows.schema[doc_id].dataType))])
    mine = F.struct(F.col("run").alias("run"), F.lit(0).alias("end"))
    dealt = rows.withColumn("run", run).withColumn(
        "to",
        F.explode(F.when(
            F.col(doc_id).eqNullSafe(F.element_at(firsts, F.col("run"))),
            F.array(mine, F.struct(F.element_at(starts, F.col("run")).alias("run"), F.lit(1).alias("end"))),
        ).otherwise(F.array(mine))),
    )
    order = Window.partitionBy("to.run").orderBy(F.col("to.end"), F.col(doc_id).desc_nulls_last(), F.xxhash64(own))
    return dealt.withColumn("next", F.lead(own).over(order)).where("to.end = 0").drop("run", "to")


def edited_fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """For every row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last third (floor of n_chars / 3) replaced by as many first
    code points of the next document in descending doc_id, or all if it has fewer; after the last comes
    the first. Null texts count as empty. A single row is its own next. Repeated ids follow the
    order of with_next(); other columns are not read; an empty table gives no rows.
    """
    work = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # one struct, so that the text moves once and not again as a window's argument
    work = _sketch(work, "text", "sketch").select("doc_id", F.struct("text", "sketch").alias("own"))
    work = with_next(work, "doc_id", "own").select("doc_id", "own.*", "next")
    third = F.floor(F.length("text") / 3).cast("int")
    work = work.withColumn("edited", F.concat(
        F.substring(F.col("text"), F.lit(1), (F.length("text") - third).cast("int")), F.substring(F.col("next.text"), F.lit(1), third)
    ))
    work = _sketch(work.select("doc_id", F.length("text").cast("long").alias("n_chars"), "edited", "sketch", F.col("next.sketch").alias("after")), "edited", "changed")
    return work.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("sketch"), F.col("changed")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("after")).alias("near_next"),
    )
