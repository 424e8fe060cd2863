"""SimHash near-duplicates: bitwise majority fingerprints, a pigeonring filter, linked classes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import connected_components, cut, small_batches

BITS = 64
#: Segments of the ring and their width.
SEGMENTS = 8
WIDTH = BITS // SEGMENTS
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
#: Runs of one key up to this length are compared for all keys at once; longer ones key by key.
SHORT_RUN = 8
#: Runs of one key beyond this length are split by further bits before they are compared.
LONG_RUN = 4096

_UPPER = bytes(range(65, 91))
_FOLD = bytes.maketrans(_UPPER, _UPPER.lower())
# the six characters of ASCII white space; bytes.split() takes exactly these


def word_bounds(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A text's words, A-Z lower-cased and joined by single spaces, and where each starts and ends; a word is a run
    without ASCII white space."""
    found = (text or "").encode("utf-8", "replace").translate(_FOLD).split()
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    return b" ".join(found), np.concatenate(([0], ends[:-1] + 1))[: len(found)], ends


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The fingerprint of a whole text as an unsigned number.

    A-Z are lower-cased; words are runs without ASCII white space; shingles of so many words, joined
    by a space and counted with repeats, are hashed with XXH64 over UTF-8. Fewer words than that make
    one shingle of the whole sequence. A bit is 1 if over half the hashes have it. Null, empty and
    blank texts have fingerprint 0. Memory beyond the text is bounded: bits are counted by chunks.
    """
    joined, starts, ends = word_bounds(text)
    if not len(starts):
        return 0
    most = max(1, len(starts) - words + 1)
    starts, ends = starts[:most], ends[-most:]
    counts, digest = np.zeros(BITS, np.int64), xxhash.xxh64_digest
    for at in range(0, len(starts), CHUNK):
        part = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist())
        hashes = np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in part]), np.uint8).reshape(-1, 8)
        counts += np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, seed: int = 42, whole_rows: bool = False) -> DataFrame:
    """(doc_id, fp) for every row; fp holds the 64 bits as a signed long. See fingerprint().

    With whole_rows a struct named row holds the columns of docs beside them.
    """
    small_batches(docs.sparkSession)
    row = [F.struct(*docs.columns).alias("row")] if whole_rows else []
    work = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), *row)
    schema = StructType([work.schema["doc_id"], StructField("fp", LongType()), *([work.schema["row"]] if whole_rows else [])])

    def run(batches):
        for b in batches:
            found = [fingerprint(t.as_py(), words, seed) for t in b.column(1)]
            columns = [b.column(0), pa.array(np.array(found, np.uint64).view(np.int64)), *b.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", *["row"] * whole_rows])

    return work.mapInArrow(run, schema)


def budgets(most: int) -> list[int]:
    """Differences allowed in the first 1, 2, ... segments of a chain when the ring holds at most so many."""
    return [most * length // SEGMENTS for length in range(1, SEGMENTS + 1)]


def _segments(x: np.ndarray) -> np.ndarray:
    """Bits set in each segment, by rows of x."""
    return np.stack([np.bitwise_count(x >> np.uint64(WIDTH * s) & np.uint64((1 << WIDTH) - 1)) for s in range(SEGMENTS)], axis=1)


def chain(differ: np.ndarray, start: int, most: int) -> np.ndarray:
    """Whether the chain of segments from start keeps to its budget at every length (pigeonring, strong form)."""
    sums = np.cumsum(np.roll(_segments(differ), -start, axis=1), axis=1)
    return (sums <= np.array(budgets(most))).all(axis=1)


def probe_keys(most: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """The exact keys that a chain start implies: (start, bit ranges).

    From a start the budget allows no difference for some segments, then one for a few more: one half
    of those is then free of differences. So each start gives two keys, the free segments with either
    half, that are equal for every pair whose chain starts there. With no allowed difference at all
    the whole fingerprint is the key.
    """
    allowed = budgets(most)
    free, one = sum(b == 0 for b in allowed), sum(b <= 1 for b in allowed)
    if not free:
        raise ValueError(f"at most {SEGMENTS - 1} differing bits can be searched")
    out = []
    for start in range(SEGMENTS):
        first, then = start * WIDTH, (one - free) * WIDTH
        if not then:
            out.append((start, ((first, free * WIDTH),)))
        else:
            half = then // 2
            out.append((start, ((first, free * WIDTH + half),)))
            out.append((start, ((first, free * WIDTH), (first + free * WIDTH + half, then - half))))
    return out


def _key(fp, ranges):
    """The bits of the ranges of a fingerprint, as a column: ranges wrap around the ring."""
    out = F.lit(0).cast("long")
    for at, n in ranges:
        at %= BITS
        turned = fp if not at else F.shiftrightunsigned(fp, at).bitwiseOR(F.shiftleft(fp, BITS - at))
        out = F.shiftleft(out, n).bitwiseOR(turned.bitwiseAND(F.lit((1 << n) - 1)))
    return out


def _links(fps: np.ndarray, start: int, most: int) -> np.ndarray:
    """For each of the distinct fingerprints of one key the place of the first of its class within the key.

    A long run is first split by the bits (a pigeonhole over most + 1 parts, so no link is lost). Only
    a class for each fingerprint comes back, never the pairs.
    """
    n = len(fps)
    label = np.arange(n)

    def compare(where):
        own = fps[where]
        for i in range(len(own) - 1):
            differ = own[i + 1 :] ^ own[i]
            near = np.flatnonzero(np.bitwise_count(differ) <= most)
            if len(near):
                near = near[chain(differ[near], start, most)] + i + 1
                classes = np.unique(label[where[np.append(near, i)]])
                if len(classes) > 1:
                    label[np.isin(label, classes)] = classes[0]

    if n <= LONG_RUN:
        compare(np.arange(n))
    else:
        width = BITS // (most + 1)
        for part in range(most + 1):
            value = fps >> np.uint64(part * width) & np.uint64((1 << width) - 1)
            order = np.argsort(value, kind="stable")
            for run in np.split(order, np.flatnonzero(np.diff(value[order])) + 1):
                compare(np.sort(run))
    return label


def link_classes(fps: DataFrame, most: int = 3) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that differ in at most so many bits, enough to join each class.

    fps holds one row (fp, node) for each distinct fingerprint; a and b are nodes. Every fingerprint
    goes under the keys of probe_keys(); rows of a key stand together in a sorted partition and are
    streamed. Two fingerprints under one key are linked if the chain of consecutive segments from
    that key's start keeps to its budgets and the full distance is small enough. A fingerprint yields
    fewer edges per key than SHORT_RUN, and one in longer runs: to the first of its class there.
    """
    keys = probe_keys(most)
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), _key(F.col("fp"), r).alias("k")) for i, (_, r) in enumerate(keys)]))
    rows = fps.select("fp", "node", table.alias("e")).select(F.col("e.t").cast("int").alias("t"), F.col("e.k").alias("k"), "fp", "node")
    starts = np.array([s for s, _ in keys])
    kind = fps.schema["node"].dataType.simpleString()

    def run(batches):
        held = None

        def done(part):
            t, k, fp, node = part
            if len(t) < 2:
                return
            cuts = np.flatnonzero((np.diff(t) != 0) | (np.diff(k) != 0)) + 1
            begin, end = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(t)]))
            size = end - begin
            out_a, out_b = [], []
            short = np.repeat(size <= SHORT_RUN, size)
            number = np.repeat(np.arange(len(size)), size)
            for d in range(1, SHORT_RUN):  # most keys have few fingerprints: compared all at once
                at = np.flatnonzero((number[d:] == number[:-d]) & short[d:]) if d < len(fp) else []
                if not len(at):
                    break
                differ = fp[at] ^ fp[at + d]
                near = np.flatnonzero(np.bitwise_count(differ) <= most)
                for s in np.unique(starts[t[at[near]]]):
                    own = near[starts[t[at[near]]] == s]
                    own = at[own[chain(differ[own], int(s), most)]]
                    out_a.append(own + d)
                    out_b.append(own)
            for a, b in zip(begin[size > SHORT_RUN].tolist(), end[size > SHORT_RUN].tolist()):
                top = _links(fp[a:b], int(starts[t[a]]), most)
                own = np.flatnonzero(top != np.arange(b - a))
                out_a.append(own + a)
                out_b.append(top[own] + a)
            if out_a:
                yield node.take(pa.array(np.concatenate(out_a))), node.take(pa.array(np.concatenate(out_b)))

        def edges(part):
            for a, b in done(part):
                if len(a):
                    yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])

        for batch in batches:
            t, k = (np.asarray(batch.column(i)) for i in (0, 1))
            fp, node = np.asarray(batch.column(2)).view(np.uint64), batch.column(3)
            if held is not None:
                t, k, fp = (np.concatenate((x, y)) for x, y in zip(held, (t, k, fp)))
                node = pa.concat_arrays([held[3], node])
            if not len(t):
                continue
            last = np.flatnonzero((t != t[-1]) | (k != k[-1]))
            last = last[-1] + 1 if len(last) else 0
            yield from edges((t[:last], k[:last], fp[:last], node.slice(0, last)))
            held = (t[last:], k[last:], fp[last:], node.slice(last))
        if held is not None:
            yield from edges(held)

    dealt = rows.repartition("t", "k").sortWithinPartitions("t", "k", "fp")
    return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, seed: int = 42, most: int = 3) -> DataFrame:
    """(doc_id, fp, component_id, class_fp) for every row of docs.

    Documents link if their fingerprints differ in at most so many bits; component_id is the smallest
    doc_id that links reach, itself included. Equal fingerprints are one node, so groups of copies
    never make pairs. Rows with a null doc_id take part, but name no class unless all its ids are
    null (then component_id is null; class_fp, the smallest fingerprint of the class, tells it). Repeated rows are copies. An empty table gives no rows.
    """
    found = cut(fingerprints(docs, text, doc_id, words, seed))
    distinct = cut(found.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    # a node is the fingerprint itself, so that classes hold even where ids are null
    edges = link_classes(distinct.select("fp", F.col("fp").alias("node")), most)
    return classes_of(found, distinct, connected_components(edges))


def classes_of(found: DataFrame, distinct: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id, class_fp) of rows (doc_id, fp), distinct (fp, rep) and components of their fp."""
    members = parts.join(distinct.withColumnRenamed("fp", "node"), "node", "left")
    least = members.groupBy("component").agg(F.min("rep").alias("least"))
    linked = cut(parts.join(least, "component").select(F.col("node").alias("fp"), "least", "component"))
    own = F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("least"))
    rep = distinct.join(linked, "fp", "left").select("fp", own.alias("component_id"), F.coalesce("component", "fp").alias("class_fp"))
    return found.join(rep, "fp").select("doc_id", "fp", "component_id", "class_fp")


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs whose id is the smallest of its class: one document of each group stays.

    Where several rows share that id (repeated rows) one of them stays: that of the least hash of all
    its columns. Of a class whose ids are all null one row stays likewise.
    """
    classes = cut(near_duplicates(docs, text, doc_id, **options))
    marked = lambda d: fingerprints(d, text, doc_id, whole_rows=True, **{k: v for k, v in options.items() if k != "most"})
    return keep_one(docs, classes, marked, doc_id)


def keep_one(docs: DataFrame, classes: DataFrame, marked, doc_id: str) -> DataFrame:
    """The rows of docs that stay for their classes; marked(rows) gives (fp, row) of rows. See deduplicate()."""
    keep = cut(classes.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("rows_of_id")))
    single, several = keep.where("rows_of_id = 1"), keep.where("rows_of_id > 1")
    # documents meet the ids by a shuffle at every size: ids that stay have no bound for a broadcast
    stay = docs.join(single.select(F.col("doc_id").alias(doc_id)).hint("merge"), doc_id, "left_semi").select(*docs.columns)
    first = F.min_by("row", F.xxhash64("row")).alias("row")
    nameless = classes.where("doc_id is null and component_id is null").select("fp", "class_fp").distinct()
    if nameless.limit(1).count():
        rows = marked(docs.where(F.col(doc_id).isNull()))
        stay = stay.unionByName(rows.join(nameless, "fp").groupBy("class_fp").agg(first).select("row.*"))
    if several.limit(1).count():
        again = docs.select(F.struct(*docs.columns).alias("row")).join(
            several.select(F.col("doc_id").alias("id")).hint("merge"), F.col(f"row.`{doc_id}`") == F.col("id")
        )
        stay = stay.unionByName(again.groupBy("id").agg(first).select("row.*"))
    return stay
