"""Exact top-k search by inner product: Fagin's threshold algorithm over sorted lists, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

#: Vectors of a candidate block, whose sorted lists one task holds, and queries that meet it at once.
BLOCK = 16_384
QUERY_BLOCK = 128


class Lists:
    """The sorted lists of a block: for each dimension the places of its vectors by falling value.

    ids ascend, so that of equal scores the smaller place has the smaller id. Scores are exact: sums
    of whole numbers below 2^24 in 32-bit floats, below 2^53 in 64-bit ones.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.order = np.argsort(-self.rows, axis=0, kind="stable")
        self.top = float(np.abs(self.rows).max(initial=0))

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None):
        """For each query the places and scores of its k best vectors, other than those with its own id.

        With a floor for each query only scores of at least that much count: a kth score known from other vectors.

        Sorted access goes down all lists together, from the top where the query's component is
        positive and from the bottom where it is negative. Vectors met for the first time are scored
        (random access). What no list has shown yet scores at most the sum of the components times
        the values where the lists stand; a query stops when that bound is below its kth score, so
        that not even a tie is left out.
        """
        n, d = self.rows.shape
        exact = np.float32 if self.top * float(np.abs(queries).max(initial=0)) * max(d, 1) < 1 << 24 else np.float64
        rows, queries = self.rows.astype(exact), queries.astype(exact)
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        best = np.full((len(queries), k), -np.inf)
        place = np.full((len(queries), k), -1, np.int64)
        floor = np.full(len(queries), -np.inf) if floor is None else floor
        left, seen, depth, step = np.arange(len(queries)), np.zeros(n, bool), 0, max(16, 2 * k)
        while len(left) and depth < n:
            to = min(n, depth + step)
            # vectors without components stand in no list: all are met at once
            met = np.unique(np.concatenate((self.order[depth:to].ravel(), self.order[n - to : n - depth].ravel()))) if d else np.arange(n)
            met = met[~seen[met]]
            seen[met] = True
            if len(met):
                scores = (queries[left] @ rows[met].T).astype(np.float64)
                scores[(self.ids[met][None, :] == own[left][:, None]) | (scores < floor[left][:, None])] = -np.inf
                both = np.concatenate((best[left], scores), axis=1)
                where = np.concatenate((place[left], np.broadcast_to(met, scores.shape)), axis=1)
                if both.shape[1] > 4 * k:
                    # all that reach the kth best score stay in play, so ties are settled by place
                    kth = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k]
                    most = int((both >= kth[:, None]).sum(axis=1).max())
                    if most < both.shape[1]:
                        keep = np.argpartition(-both, most - 1, axis=1)[:, :most]
                        both, where = np.take_along_axis(both, keep, 1), np.take_along_axis(where, keep, 1)
                order = np.lexsort((where, -both), axis=1)[:, :k]
                best[left], place[left] = np.take_along_axis(both, order, 1), np.take_along_axis(where, order, 1)
            depth = to
            if depth < n:
                high = self.rows[self.order[depth - 1], np.arange(d)]
                low = self.rows[self.order[n - depth], np.arange(d)]
                bound = up[left].astype(np.float64) @ high + down[left].astype(np.float64) @ low
                left = left[~(bound < np.maximum(best[left, k - 1], floor[left]))]
            step *= 2
        return place, best


def quantise(vector, scale: float = 64.0):
    """floor(scale * x) of each component, as doubles."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("double"))


def usable(vector):
    """Whether a vector takes part: not null, no null and no non-finite component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.exists(vector, bad)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product with each query, its own id excepted.

    Components must be whole numbers (see quantise()). Ties go to the smaller vec_id; fewer
    candidates than k give them all. Vectors that are not usable() or have a null id take no part;
    only vectors of the query's length are its candidates, those without components among themselves. Rows that
    repeat an id are candidates each; a query id that stands several times gives one set of answers, by its smallest vector.
    Every query meets every block of BLOCK candidates once. The first block goes alone: a query's kth score there
    is its floor in all others, so those send only what may still be among the k best; results are merged by query.
    """
    spark = rows.sparkSession
    small_batches(spark, 4096)
    pick = lambda df: df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    rows, queries = cut(pick(rows)), cut(pick(queries).groupBy("id").agg(F.min("v").alias("v")))
    blocks = max(1, -(-rows.count() // BLOCK))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = _search(rows.where(block == 0), queries.withColumn("floor", F.lit(float("-inf"))), k, 0, 1)
    if blocks > 1:
        first = cut(first)
        kth = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
        floors = queries.join(kth, queries["id"] == kth["query_id"], "left").select("id", "v", F.coalesce(F.col("least").cast("double"), F.lit(float("-inf"))).alias("floor"))
        first = first.unionByName(_search(rows.where(block > 0), cut(floors), k, 1, blocks))
    found = first.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, queries: DataFrame, k: int, first: int, blocks: int) -> DataFrame:
    """(query_id, vec_id, score): each block's k best rows for each query, of its floor or more; blocks count from first."""
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    cand = rows.select(block.alias("block"), F.lit(0).alias("query"), "id", "v", F.lit(0.0).alias("floor"))
    asked = queries.select(F.explode(F.sequence(F.lit(first), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("query"), "id", "v", "floor")
    dealt = cand.unionByName(asked).repartitionByRange(blocks, "block").sortWithinPartitions("block", "query", F.size("v"))

    def run(batches):
        now, ids, vectors, lists, waiting = None, [], [], {}, []

        def answers():
            by_size: dict[int, list] = {}
            for q, v, f in waiting:
                by_size.setdefault(len(v), []).append((q, v, f))
            for d, asked in by_size.items():
                if d not in lists:
                    continue
                own = np.array([q for q, _, _ in asked], np.int64)
                floor = np.array([f for _, _, f in asked])
                place, score = lists[d].search(own, np.array([v for _, v, _ in asked]).reshape(len(asked), d), k, floor)
                q, r = np.nonzero(score > -np.inf)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[q]), pa.array(lists[d].ids[place[q, r]]), pa.array(score[q, r].astype(np.int64))], ["query_id", "vec_id", "score"]
                )

        for b in batches:
            offsets = np.asarray(b.column(3).offsets)
            values = np.asarray(b.column(3).values)
            for i, (block, query, vid, floor) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 1, 2, 4)))):
                v = values[offsets[i] : offsets[i + 1]]
                if block != now:
                    yield from answers()
                    now, ids, vectors, lists, waiting = block, [], [], {}, []
                if not query:
                    ids.append(vid)
                    vectors.append(v)
                    continue
                if ids:
                    sizes = np.array([len(x) for x in vectors])
                    for d in np.unique(sizes):
                        own = np.flatnonzero(sizes == d)
                        lists[int(d)] = Lists(np.array(ids, np.int64)[own], np.stack([vectors[j] for j in own]).reshape(len(own), d))
                    ids, vectors = [], []
                waiting.append((vid, v, floor))
                if len(waiting) == QUERY_BLOCK:
                    yield from answers()
                    waiting = []
        yield from answers()

    return dealt.mapInArrow(run, "query_id long, vec_id long, score long")
