"""Near copies by SimHash: the pigeonring filter at a radius that reaches a Jaccard similarity, which exact counts decide.

A part of the SimHash operator: texts whose word shingles are alike have close fingerprints. The first 64 bits of a
fingerprint stand on the ring; pairs whose chains of segments keep to their budgets meet, the full distance over all
128 bits prunes them, and the similarity of the whole sets of shingles decides.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import connected_components, cut, small_batches
from .simhash import classes_of, keep_one, word_bounds

#: Words of a shingle and the least similarity of near copies.
WORDS, LEAST = 5, 0.8
#: Segments of the ring and their width; differing bits of the ring, and of the whole fingerprint, of a candidate pair.
SEGMENTS, WIDTH, RADIUS, WHOLE = 16, 4, 14, 28
#: Differences allowed in the first 1, 2, ... segments of a chain.
BUDGETS = [RADIUS * n // SEGMENTS for n in range(1, SEGMENTS + 1)]
#: Fingerprints compared at once; a larger product of two sides is split by the next segment of the chain.
AT_ONCE = 1 << 20
#: A bucket with more candidate pairs a node than this is a crowd: its nodes are compared in blocks of so many.
FEW, CROWD_BLOCK = 4, 512
#: Shingles counted at once in a block.
COLUMNS = 4096
#: Words of 64 bits of the bitmap that tells which texts are compared.
BITMAP = 1 << 18

_RATIO = math.log(1 / LEAST)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct XXH64 hashes of a text's shingles, words folded and split as in simhash.fingerprint().

    Fewer words make one shingle of all; null, empty and blank texts have none.
    """
    joined, starts, ends = word_bounds(text)
    if not len(starts):
        return np.zeros(0, np.uint64)
    most = max(1, len(starts) - words + 1)
    starts, ends = starts[:most], ends[-most:]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, most))


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """The 128-bit fingerprint of a set of hashes, as two signed numbers: majorities of its bits, and of those of its mixed hashes."""
    out = []
    with np.errstate(over="ignore"):
        mixed = (hashes ^ hashes >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
    for h in (hashes, mixed ^ mixed >> np.uint64(31)):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 14):
            counts += np.unpackbits(h[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(counts * 2 > len(h)).tobytes(), "big", signed=True))
    return out[0], out[1]


def sets(docs: DataFrame, text: str, doc_id: str, words: int, prints: bool = False, grams: bool = False, whole_rows: bool = False) -> DataFrame:
    """(doc_id, fp[, n, ring, rest][, grams][, row]) for every row; fp is a hash of the text's set of shingles."""
    small_batches(docs.sparkSession)
    row = [F.struct(*docs.columns).alias("row")] if whole_rows else []
    work = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), *row)
    added = ["n int, ring bigint, rest bigint"] * prints + ["grams array<bigint>"] * grams
    added = StructType.fromDDL(", ".join(added)).fields if added else []
    schema = StructType([work.schema["doc_id"], StructField("fp", LongType()), *added, *([work.schema["row"]] if whole_rows else [])])

    def run(batches):
        for b in batches:
            found = [shingles(t.as_py(), words) for t in b.column(1)]
            fps = np.array([xxhash.xxh64_intdigest(h.tobytes(), 42) for h in found], np.uint64).view(np.int64)
            out = [b.column(0), pa.array(fps)]
            if prints:
                both = np.array([fingerprint(h) for h in found], np.int64).reshape(-1, 2)
                out += [pa.array([len(h) for h in found], pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1])]
            if grams:
                out.append(pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([*out, *b.columns[2:]], schema.names)

    return work.mapInArrow(run, schema)


def turned(ring: np.ndarray, start: int) -> np.ndarray:
    """Rings turned so that the segment of the start stands first, from the highest bits down."""
    at = np.uint64(WIDTH * start)
    return ring if not start else ring << at | ring >> (np.uint64(64) - at)


def chained(differ: np.ndarray) -> np.ndarray:
    """Whether the chains from the first segment of turned differences keep to their budgets at every length."""
    sums = np.zeros(len(differ), np.int64)
    good = np.ones(len(differ), bool)
    for n, most in enumerate(BUDGETS):
        sums += np.bitwise_count(differ >> np.uint64(64 - WIDTH * (n + 1)) & np.uint64((1 << WIDTH) - 1))
        good &= sums <= most
    return good


class Bucket:
    """The nodes of one chain start, first segment and class of sizes; those of the class below are guests.

    hits() yields the places (i, j) and distances of all pairs, but of two guests, that pass the filter.
    """

    def __init__(self, ring, rest, size, guest):
        order = np.lexsort((ring, guest))
        self.order, self.ring, self.rest, self.size = order, ring[order], rest[order], size[order].astype(np.int64)
        self.own = int((~guest).sum())

    def _pairs(self, a0, a1, b0, b1, level, spent):
        """Pairs of two ranges that agree in their first segments but for so many bits, split while they are many."""
        if a0 >= a1 or b0 >= b1:
            return
        if level == SEGMENTS or (a1 - a0) * (b1 - b0) <= AT_ONCE:
            step = max(1, AT_ONCE // (b1 - b0))
            for i in range(a0, a1, step):
                to = min(a1, i + step)
                from_ = max(b0, i + 1) if (a0, a1) == (b0, b1) else b0
                differ = self.ring[i:to, None] ^ self.ring[None, from_:b1]
                x, y = np.nonzero(np.bitwise_count(differ) <= RADIUS)
                d = differ[x, y]
                x, y = x + i, y + from_
                small, large = np.minimum(self.size[x], self.size[y]), np.maximum(self.size[x], self.size[y])
                keep = (x < y) & (small >= large * (LEAST - 1e-9))
                x, y, d = x[keep], y[keep], d[keep]
                far = np.bitwise_count(d).astype(np.int64) + np.bitwise_count(self.rest[x] ^ self.rest[y])
                keep = (far <= WHOLE) & chained(d)
                if keep.any():
                    yield x[keep], y[keep], far[keep]
            return
        at = np.uint64(64 - WIDTH * (level + 1))
        values = np.arange(1 << WIDTH)
        split = lambda lo, hi: lo + np.searchsorted(self.ring[lo:hi] >> at & np.uint64((1 << WIDTH) - 1), np.arange((1 << WIDTH) + 1))
        a, b, same = split(a0, a1), split(b0, b1), (a0, a1) == (b0, b1)
        for x in values.tolist():
            for y in values[x if same else 0 :].tolist():
                now = spent + (x ^ y).bit_count()
                if now <= BUDGETS[level]:
                    yield from self._pairs(int(a[x]), int(a[x + 1]), int(b[y]), int(b[y + 1]), level + 1, now)

    def hits(self):
        yield from self._pairs(0, self.own, 0, self.own, 1, 0)
        yield from self._pairs(0, self.own, self.own, len(self.ring), 1, 0)


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after places i and j are joined: each the smallest place of its class."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def _candidates(bucket: Bucket) -> tuple[np.ndarray, np.ndarray, bool]:
    """All candidate pairs of a bucket where they are few; of a crowd each node and the first that candidates join it to."""
    n, count = len(bucket.ring), 0
    x, y, label = [], [], np.arange(n)
    for i, j, _ in bucket.hits():
        count += len(i)
        if count <= FEW * n:
            x.append(i)
            y.append(j)
        label = merged(label, i, j)
    if count <= FEW * n:
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *x]), np.concatenate([none, *y]), True
    own = np.flatnonzero(label != np.arange(n))
    return own, label[own], False


def candidates(nodes: DataFrame) -> DataFrame:
    """(a, b, whole): pairs of nodes (fp, n, ring, rest) that pass the filter, each once or more.

    A node goes under the first segment of each chain start and its class of sizes, and as a guest to the next
    class, since sets of that similarity differ in size by no more than a class. A crowd gives no pairs but what
    joins its nodes, and whole is false there.
    """
    size = F.floor(F.ln(F.greatest(F.col("n"), F.lit(1))) / F.lit(_RATIO) + F.lit(1e-9)).cast("int")
    start = F.explode(F.array(*[
        F.struct(F.lit(s).alias("t"), F.shiftrightunsigned("ring", 64 - WIDTH * (s + 1)).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int").alias("k"), F.lit(g).alias("guest"), (size + g).alias("size"))
        for s in range(SEGMENTS) for g in (0, 1)
    ]))
    rows = nodes.where("n > 0").select(start.alias("e"), "fp", "n", "ring", "rest")
    rows = rows.select(((F.col("e.size").cast("long") * SEGMENTS + F.col("e.t")) * (1 << WIDTH) + F.col("e.k")).alias("key"), "e.t", "e.guest", "fp", "n", "ring", "rest")

    def pairs(held):
        key, t, guest, fp, n, ring, rest = held
        cuts = np.flatnonzero(np.diff(key)) + 1
        for lo, hi in zip(np.concatenate(([0], cuts)).tolist(), np.concatenate((cuts, [len(key)])).tolist()):
            if hi - lo < 2 or guest[lo:hi].all():
                continue
            bucket = Bucket(turned(ring[lo:hi].view(np.uint64), int(t[lo])), rest[lo:hi].view(np.uint64), n[lo:hi], guest[lo:hi] > 0)
            x, y, whole = _candidates(bucket)
            if len(x):
                ids = fp[lo:hi][bucket.order]
                yield ids[x], ids[y], whole

    def run(batches):
        held = None

        def send(part):
            for a, b, whole in pairs(part):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(a), whole))], ["a", "b", "whole"])

        for batch in batches:
            now = [np.asarray(c) for c in batch.columns]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            if not len(held[0]):
                continue
            last = int(np.searchsorted(held[0], held[0][-1]))
            if last:
                yield from send([c[:last] for c in held])
                held = [c[last:] for c in held]
        if held is not None and len(held[0]):
            yield from send(held)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint, whole boolean")


def crowd_links(crowds: DataFrame, grams: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) that join the nodes of each crowd (node, component) whose sets are alike: all pairs are counted.

    A crowd is dealt into blocks; each pair of blocks meets in one group of bounded size, where products of
    0-1 matrices count common shingles. A group gives no more edges than nodes. The work is quadratic in
    the different texts of one crowd, rows grow by the number of its blocks.
    """
    blocks = F.ceil(F.col("nodes") / CROWD_BLOCK).cast("int")
    sizes = crowds.groupBy("component").agg(F.count("*").alias("nodes")).select("component", blocks.alias("blocks"))
    dealt = crowds.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = dealt.join(grams.withColumnRenamed("fp", "node"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("component", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "grams")

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, own = group.column("node").to_numpy(), group.column("own").to_numpy()
        lists = group.column("grams").chunk(0)
        sizes = np.diff(np.asarray(lists.offsets))
        values = np.asarray(lists.values)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
        owner = np.repeat(np.arange(len(ids)), sizes)
        _, at, often = np.unique(values, return_inverse=True, return_counts=True)
        kept = often[at] > 1  # what one set has alone is common to none
        at, owner = np.unique(at[kept], return_inverse=True)[1], owner[kept]
        order = np.argsort(at, kind="stable")
        at, owner = at[order], owner[order]
        left = np.flatnonzero(own == group.column("x")[0].as_py())
        right = np.flatnonzero(own == group.column("y")[0].as_py())
        common = np.zeros((len(left), len(right)), np.float32)
        for lo in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
            a, b = np.searchsorted(at, (lo, lo + COLUMNS))
            held = np.zeros((len(ids), COLUMNS), np.float32)
            held[owner[a:b], at[a:b] - lo] = 1
            common += held[left] @ held[right].T
        alike = common >= (sizes[left][:, None] + sizes[right][None, :] - common) * (least - 1e-9)
        i, j = np.nonzero(alike)
        label = merged(np.arange(len(ids)), left[i], right[j])
        some = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"a": ids[label[some]], "b": ids[some]})

    return met.groupBy("component", "x", "y").applyInArrow(compare, "a bigint, b bigint")


def _only(docs: DataFrame, doc_id: str, ids: DataFrame) -> DataFrame:
    """The rows of docs whose id may be among ids (a bitmap of fixed size, so a few others too), or is null."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP * 64))
    at = ids.select(bit(F.col("id")).alias("bit")).select(F.shiftright("bit", 6).alias("w__"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int")).alias("bits"))
    bitmap = cut(at.groupBy("w__").agg(F.bit_or("bits").alias("bits__")))
    mine = docs.withColumn("bit__", bit(F.col(doc_id)))
    hit = F.call_function("shiftright", F.col("bits__"), (F.col("bit__") % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    found = mine.where(F.col(doc_id).isNotNull()).join(F.broadcast(bitmap), F.shiftright("bit__", 6) == F.col("w__")).where(hit)
    return found.select(*docs.columns).unionByName(docs.where(F.col(doc_id).isNull()))


def near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """(doc_id, fp, component_id, class_fp) for every row, as simhash.near_duplicates() has them; fp is a hash of the text's shingles.

    Candidate pairs whose shingles have a Jaccard similarity of at least so much, counted on the whole sets, link.
    Texts with the same shingles are one node, so copies make no pairs; the nodes of a crowd are counted in blocks (see
    crowd_links()). least must not be below LEAST, which the radius is made for.
    """
    if least < LEAST:
        raise ValueError(f"the radius reaches similarities of {LEAST} or more")
    found = cut(sets(docs, text, doc_id, words, prints=True))
    distinct = cut(found.groupBy("fp").agg(F.min("doc_id").alias("rep"), *[F.any_value(c).alias(c) for c in ("n", "ring", "rest")]))
    pairs = cut(candidates(distinct).groupBy("a", "b").agg(F.min("whole").alias("whole")))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    wanted = nodes.join(distinct.select("fp", "rep"), "fp").where("rep is not null").select(F.col("rep").alias("id"))
    grams = sets(_only(docs.select(doc_id, text), doc_id, wanted), text, doc_id, words, grams=True)
    grams = cut(grams.groupBy("fp").agg(F.any_value("grams").alias("grams")))

    def alike(pairs):
        both = pairs.select("a", "b").join(grams.select(F.col("fp").alias("a"), F.col("grams").alias("x")), "a").join(grams.select(F.col("fp").alias("b"), F.col("grams").alias("y")), "b")
        both = both.withColumn("s", F.size(F.array_intersect("x", "y")))
        return both.where(F.col("s") >= (F.size("x") + F.size("y") - F.col("s")) * (least - 1e-9)).select("a", "b")

    edges = alike(pairs.where("whole"))
    crowds = pairs.where("not whole").select("a", "b")
    if crowds.limit(1).count():
        edges = edges.unionByName(crowd_links(connected_components(crowds), grams, least))
    parts = connected_components(edges)
    return classes_of(found.select("doc_id", "fp"), distinct.select("fp", "rep"), parts)


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """The rows of docs that simhash.keep_one() keeps: one document of each class of near copies."""
    classes = cut(near_copies(docs, text, doc_id, words, least))
    return keep_one(docs, classes, lambda d: sets(d, text, doc_id, words, whole_rows=True), doc_id)
