"""WARC fixity: Merkle trees over records in ordered offset ranges, compared from the roots down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Bytes of a leaf's offset range, children of an inner node, records of an archive file.
RANGE_BYTES, FANOUT, FILE_RECORDS = 65_536, 16, 512
#: Files that records without an id are dealt into.
NAMELESS_FILES = 4096

_DATE = "2024-01-01T00:00:00Z"


def record(target: Column, record_id: Column, payload: Column) -> Column:
    """The bytes of a WARC/1.1 resource record; null targets and payloads count as empty."""
    body = F.coalesce(payload, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(target, F.lit("")),
        F.lit(f"\r\nWARC-Date: {_DATE}\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(file, record_id, content) of pages as WARC records; each file holds FILE_RECORDS neighbouring ids.

    Rows with a null id go to files of their own, -1 and below, dealt by the length of url and payload.
    """
    long = F.length(F.coalesce(F.col(url), F.lit(""))) + F.length(F.coalesce(F.col(payload), F.lit("")))
    return pages.select(
        F.coalesce(F.floor(F.col(page_id) / FILE_RECORDS), -1 - long % NAMELESS_FILES).cast("long").alias("file"), F.col(page_id).alias("record_id"),
        record(F.col(url), F.col(page_id), F.col(payload)).alias("content"),
    )


def digests(records: DataFrame) -> DataFrame:
    """(file, record_id, copy, size, digest, start): the SHA-256 of each record and its offset in its file.

    Records stand in the order of record_id (null first) and digest. Contents are hashed where they
    are read; only digests move. copy numbers rows of one id and file. Offsets are running sums
    within a file: a window over one file's digests, never over contents. A file's size is
    bounded by the writer of the archive (FILE_RECORDS ids here).
    """
    work = records.select("file", "record_id", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("digest"))
    order = Window.partitionBy("file").orderBy(F.col("record_id").asc_nulls_first(), "digest")
    start = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.row_number().over(Window.partitionBy("file", "record_id").orderBy("digest"))
    return work.select("file", "record_id", number.alias("copy"), "size", "digest", start.alias("start"))


def _parents(nodes: DataFrame, width: int) -> DataFrame:
    """One level up: (file, node, hash, children), the hash of the children's hashes in order."""
    parts = F.array_sort(F.collect_list(F.struct("node", "hash")))
    return nodes.groupBy("file", F.floor(F.col("node") / width).cast("long").alias("up")).agg(parts.alias("p")).select(
        "file", F.col("up").alias("node"), F.sha2(F.concat_ws("", F.transform("p", lambda x: F.concat_ws(":", x["node"].cast("string"), x["hash"]))), 256).alias("hash")
    )


def tree(found: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels of the trees of digests(), leaves first, the file's root level last: (file, node, hash).

    A leaf covers the records that start in one range of offsets; its hash is that of their offsets,
    sizes and digests in order. A group never exceeds one range's records or fanout children. The
    number of levels follows the longest file.
    """
    own = F.struct("start", "size", "digest", "record_id", "copy")
    leaves = found.groupBy("file", F.floor(F.col("start") / range_bytes).cast("long").alias("node")).agg(F.array_sort(F.collect_list(own)).alias("p"))
    text = F.transform("p", lambda x: F.concat_ws(":", x["start"].cast("string"), x["size"].cast("string"), x["digest"]))
    levels = [cut(leaves.select("file", "node", F.sha2(F.concat_ws(";", text), 256).alias("hash")))]
    highest = levels[0].agg(F.max("node")).first()[0] or 0
    while highest:
        levels.append(_parents(levels[-1], fanout))
        highest //= fanout
    return levels


def audit(first: DataFrame, second: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """For every record of two replicas: where it stands, both digests and what is wrong with it.

    Columns: file, record_id, copy, start and size (of the first replica, else the second), digest,
    replica_digest, leaf, checked, status. Roots are compared file by file; only below differing
    nodes are children compared, down to the leaves; checked says whether a record's leaf was reached.
    A record of an unreached leaf is intact by its tree. status: ok, corrupt (other bytes),
    missing (only in the first), extra (only in the second) or moved (same bytes, other offset).
    Null ids are matched with null ids; an empty replica makes all records missing or extra.
    """
    a, b = cut(digests(first)), cut(digests(second))
    left, right = tree(a, range_bytes, fanout), tree(b, range_bytes, fanout)
    top = max(len(left), len(right))
    for levels in (left, right):
        while len(levels) < top:
            levels.append(_parents(levels[-1], fanout))
    bad = None
    for x, y in zip(reversed(left), reversed(right)):
        x, y = x.select("file", "node", F.col("hash").alias("h1")), y.select("file", "node", F.col("hash").alias("h2"))
        if bad is not None:
            below = lambda d: d.withColumn("up", F.floor(F.col("node") / fanout).cast("long")).join(bad, ["file", "up"], "left_semi").drop("up")  # noqa: E731, B023
            x, y = below(x), below(y)
        differ = x.join(y, ["file", "node"], "full").where(~F.col("h1").eqNullSafe(F.col("h2")))
        bad = cut(differ.select("file", F.col("node").alias("up")))
    leaf = F.floor(F.col("start") / range_bytes).cast("long")
    reached = bad.select("file", F.col("up").alias("leaf"))
    inside = lambda d: d.withColumn("leaf", leaf).join(reached, ["file", "leaf"], "left_semi")
    mark = lambda d, n: d.select("file", "record_id", "copy", *[F.col(c).alias(c + n) for c in ("size", "digest", "start", "leaf")])
    # only records below differing leaves are held against each other; a record there may have moved from or to an equal leaf
    x, y = mark(inside(a), "1"), mark(inside(b), "2")
    intact = a.withColumn("leaf", leaf).join(reached, ["file", "leaf"], "left_anti")
    y = y.select(*[F.col(c).alias("y_" + c) for c in ("file", "record_id", "copy")], "size2", "digest2", "start2", "leaf2")
    both = x.join(y, (F.col("file") == F.col("y_file")) & F.col("record_id").eqNullSafe(F.col("y_record_id")) & (F.col("copy") == F.col("y_copy")), "full")
    status = (
        F.when(F.col("digest2").isNull(), "missing").when(F.col("digest1").isNull(), "extra")
        .when(F.col("digest1") != F.col("digest2"), "corrupt").when(F.col("start1") != F.col("start2"), "moved").otherwise("ok")
    )
    found = both.select(
        F.coalesce("file", "y_file").alias("file"), F.coalesce("record_id", "y_record_id").alias("record_id"), F.coalesce("copy", "y_copy").alias("copy"),
        F.coalesce("start1", "start2").alias("start"), F.coalesce("size1", "size2").alias("size"), F.col("digest1").alias("digest"),
        F.col("digest2").alias("replica_digest"), F.coalesce("leaf1", "leaf2").alias("leaf"), F.lit(True).alias("checked"), status.alias("status"),
    )
    return found.unionByName(intact.select(
        "file", "record_id", "copy", "start", "size", "digest", F.col("digest").alias("replica_digest"), "leaf", F.lit(False).alias("checked"), F.lit("ok").alias("status")
    ))
