"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, voted."""

from __future__ import annotations

import re
import sys
import zlib
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, small_batches

#: The classifier's bound: labelled rows of each class it is fitted on.
EXAMPLES_PER_CLASS = 1000
#: Neighbours that vote, examples of an index block (their places fit a byte).
NEIGHBOURS, BLOCK = 16, 128
#: Cosines this close, relative to each other, count as equal: postings are 32-bit floats.
TIE = 1e-5
#: Places at which a term's evidence counts half.
DOUBT = 3
#: Terms of at least this part of the examples have whole rows instead of postings.
FULL = 1 / 8
#: Characters of those beginnings of words that are terms too.
BEGINNINGS = (4, 5)
#: Words of more characters are looked up one by one; texts of more are read in pieces of about as many.
LONG, PIECE = 64, 1 << 16

_WORDS, _GAP = re.compile(r"\w+"), re.compile(r"\W")
_NO_PLACES, _NO_SCORES = np.zeros(0, np.int64), np.zeros(0)


def terms_of(word: str) -> list[str]:
    """The word itself and its beginnings of BEGINNINGS characters, marked by a leading ^."""
    return [word, *("^" + word[:n] for n in BEGINNINGS if len(word) >= n)]


class _Hashed:
    """Distinct 64-bit keys in buckets of their highest bits, and the place of a key among them."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys)
        keys = keys[self.order]
        bits = max(8 * len(keys), 2).bit_length()
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys >> self.shift, np.arange(2**bits, dtype=np.uint64)).astype(np.int32)
        self.steps = int(np.diff(self.first, append=len(keys)).max())
        self.keys = np.append(keys, np.zeros(self.steps + 1, np.uint64))  # a search may walk beyond the last
        self.order = np.append(self.order, np.full(self.steps + 1, -1))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key in the order given first; -1 if it is none of them."""
        at = self.first[keys >> self.shift]
        for _ in range(self.steps):
            at = at + (self.keys[at] != keys)
        return np.where(self.keys[at] == keys, self.order[at], -1)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _word_characters() -> np.ndarray:
    """For every code point whether it belongs to a word, as _WORDS has it."""
    out = np.zeros(sys.maxunicode + 1, bool)
    for m in _WORDS.finditer("".join(map(chr, range(len(out))))):
        out[m.start() : m.end()] = True
    return out


class Reader:
    """Counts the terms of whole texts by their numbers; terms that no example has are left out, their weight is 0.

    Words are found and looked up by their code points, all of a text at once: a hash names the one known word that it
    may be, whose characters are then compared, so no other word counts as it. Each word has a row of numbers, its own and
    those of its beginnings; words that no example has take the row of their longest known beginning.
    """

    def __init__(self, numbers: dict[str, int]):
        words = [t for t in numbers if t[0] != "^"]
        starts = {n: [t[1:] for t in numbers if t[0] == "^" and len(t) == n + 1] for n in sorted(BEGINNINGS, reverse=True)}
        rows = [[numbers[w], *(numbers.get("^" + w[:n], -1) if len(w) >= n else -1 for n in BEGINNINGS)] for w in words]
        for n, found in starts.items():
            rows += [[-1, *(numbers.get("^" + t[:m], -1) if m <= n else -1 for m in BEGINNINGS)] for t in found]
        self.known = np.array([*rows, [-1] * (1 + len(BEGINNINGS))], np.int32)  # the last row: no term at all
        self.is_word = _word_characters()
        self.long = {w: r for r, w in enumerate(words) if len(w) > LONG}
        short = [r for r, w in enumerate(words) if len(w) <= LONG]
        self.row = np.array(short, np.int64)
        self.size = np.array([len(words[r]) for r in short], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.characters = _code_points("".join(words[r] for r in short))
        self.starts, at = [], len(words)
        for n, found in starts.items():
            self.starts.append((n, at, _code_points("".join(found)).reshape(-1, n)))
            at += len(found)
        # words of at most LONG characters: some base tells all that are known apart
        base = 0x9E3779B97F4A7C15
        while True:
            self.power = np.cumprod(np.full(LONG, base, np.uint64))
            keys = [self._hash(self.characters, self.size), *(self._hash(c.ravel(), np.full(len(c), c.shape[1])) for _, _, c in self.starts)]
            if all(len(np.unique(k)) == len(k) for k in keys):
                break
            base = (base * 0xD1342543DE82EF95 + 2) % 2**64
        self.tables = [_Hashed(k) for k in keys]

    def _hash(self, characters: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A hash of each word of size characters; the words stand one after another."""
        if not len(size):
            return np.zeros(0, np.uint64)
        begin = np.cumsum(size) - size
        place = np.minimum(np.arange(len(characters)) - np.repeat(begin, size), LONG - 1)
        return np.add.reduceat((characters + np.uint64(1)) * self.power[place], begin)

    def _rows(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Where each word of a lower-cased text begins, and its row."""
        points = _code_points(text)
        inside = np.zeros(len(points) + 2, bool)
        inside[1:-1] = self.is_word[points]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        begin, size = edges[::2], edges[1::2] - edges[::2]
        which = self.tables[0].find(self._hash(points[inside[1:-1]], size))
        at = np.flatnonzero(which >= 0)
        at = at[self.size[which[at]] == size[at]]
        # characters of the words found against those of the known words
        found, length = which[at], size[at]
        ends = np.cumsum(length)
        step = np.arange(ends[-1] if len(ends) else 0)
        same = points[step + np.repeat(begin[at] - ends + length, length)] == self.characters[step + np.repeat(self.begin[found] - ends + length, length)]
        if not same.all():
            right = np.logical_and.reduceat(same, ends - length)
            at, found = at[right], found[right]
        none = len(self.known) - 1
        out = np.full(len(size), none, np.int32)
        out[at] = self.row[found]
        if self.long:
            for i in np.flatnonzero(size > LONG).tolist():
                out[i] = self.long.get(text[begin[i] : begin[i] + size[i]], none)
        left = np.flatnonzero(out == none)
        for (n, first, known), table in zip(self.starts, self.tables[1:]):
            left = left[out[left] == none]
            at = left[size[left] >= n]
            points_of = points[begin[at][:, None] + np.arange(n)]
            which = table.find(self._hash(points_of.ravel(), np.full(len(at), n)))
            right = np.flatnonzero(which >= 0)
            right = right[(points_of[right] == known[which[right]]).all(1)]
            out[at[right]] = first + which[right]
        return begin, out

    def _terms(self, texts: list[str]):
        """terms_of() of lower-cased texts that are read together; beyond PIECE characters piece by piece, cut between words."""
        whole, at, begin, rows = "\n".join(texts), 0, [_NO_PLACES], [_NO_PLACES]
        while at < len(whole):
            gap = _GAP.search(whole, at + PIECE)
            end = gap.start() if gap else len(whole)
            places, found = self._rows(whole[at:end])
            begin.append(places + at)
            rows.append(found)
            at = end
        begin, rows = np.concatenate(begin), np.concatenate(rows)
        after = np.cumsum([len(t) + 1 for t in texts])
        first = 0
        for last in np.searchsorted(begin, after).tolist():
            found = self.known[rows[first:last]].ravel()
            yield found[found >= 0]
            first = last

    def terms_of(self, texts):
        """For each text the numbers of its terms, each as often as it stands there; short texts are read together."""
        group, size = [], 0
        for t in texts:
            t = (t or "").lower()
            if group and size + len(t) > PIECE:
                yield from self._terms(group)
                group, size = [], 0
            group.append(t)
            size += len(t) + 1
        if group:
            yield from self._terms(group)

    def counts_of(self, texts):
        """For each text the numbers of its terms, rising, and how often each stands; none for null and empty texts."""
        for found in self.terms_of(texts):
            found.sort()
            first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))) if len(found) else _NO_PLACES
            yield found[first].astype(np.int64), np.diff(np.append(first, len(found)))

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """counts_of() one text."""
        return next(self.counts_of([text]))


@dataclass
class Index:
    """A block-max inverted index of the examples over all their terms, and what their votes count.

    For each term and block with postings, where[term, block] is the number of their run: its postings are
    place and value from start on, peak is its largest value; run 0 is empty. The values of a term that stands in
    many examples are a row of full, by block and place, instead. Examples stand by label and strongest term, so
    that blocks are alike inside and their maxima low elsewhere.
    """

    numbers: dict[str, int] = field(default_factory=dict)
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ids: list = field(default_factory=list)
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    where: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int32))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2, np.int64))
    place: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint8))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    peak: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))
    row: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    full: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, BLOCK), np.float32))
    class_weight: np.ndarray = field(default_factory=lambda: np.ones(2))
    prior: float = 0.0
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms of weight above 0 and their normalised weights, (1 + ln count) times the term's weight."""
        w = (1 + np.log(counts)) * self.weight[terms]
        keep = w > 0
        terms, w = terms[keep], w[keep]
        return terms, w / np.linalg.norm(w) if len(w) else w

    def nearest(self, terms: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The examples of the k highest cosines above 0, all that tie with the kth included, and the cosines.

        Blocks are taken by falling upper bound, the sum of the query's weights times the block's maxima;
        when a bound is below the kth cosine no later block can add or tie, and the search ends.
        """
        if not len(terms) or not len(self.ids):
            return _NO_PLACES, _NO_SCORES
        runs = self.where[terms]
        bounds = w @ self.peak[runs]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        row = self.row[terms]
        many, w32 = row >= 0, w.astype(np.float32)
        row, wide, runs, few = row[many], w32[many], runs[~many], w[~many]
        places, scores, at, step = _NO_PLACES, _NO_SCORES, 0, 4
        while at < len(order):
            if len(scores) >= k:
                least = scores[k - 1] * (1 - TIE)
                order = order[: np.searchsorted(-bounds[order], -least, side="right")]
            blocks = order[at : at + step]
            if not len(blocks):
                break
            s = (wide @ self.full[row[:, None], blocks].reshape(len(row), -1)).astype(np.float64) if len(row) else np.zeros(len(blocks) * BLOCK)
            which, column = np.nonzero(runs[:, blocks])
            run = runs[which, blocks[column]]
            begin = self.start[run]
            size = self.start[run + 1] - begin
            post = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
            s += np.bincount(self.place[post] + np.repeat(column * BLOCK, size), self.value[post] * np.repeat(few[which], size), minlength=len(s))
            p = np.flatnonzero(s > (scores[k - 1] * (1 - TIE) if len(scores) >= k else 0))
            places, scores = np.concatenate((places, blocks[p // BLOCK] * BLOCK + p % BLOCK)), np.concatenate((scores, s[p]))
            best = np.argsort(-scores, kind="stable")
            if len(best) > k:
                best = best[scores[best] >= scores[best[k - 1]] * (1 - TIE)]
            places, scores = places[best], scores[best]
            at += step
            step *= 2
        return places, scores

    def vote(self, places: np.ndarray, scores: np.ndarray) -> float:
        """The toxic part of the neighbours' votes, each by its cosine and its class's weight, drawn to the prior."""
        y = self.labels[places]
        v = scores * self.class_weight[y]
        return float(((v * y).sum() + 0.05 * self.prior) / (v.sum() + 0.05))

    def calibrated(self, vote: float) -> float:
        return vote if self.knots is None else float(np.interp(vote, *self.knots))


def build(numbers: dict[str, int], weight: np.ndarray, examples: list[tuple], rates: dict[int, float]) -> Index:
    """The index of examples (id, label, terms, counts); rates: rows of each class that one example of it stands for."""
    out = Index(numbers, weight)
    vectors = [(i, y, *out.vector(t, n)) for i, y, t, n in examples]
    vectors.sort(key=lambda v: (v[1], int(v[2][np.argmax(v[3])]) if len(v[2]) else -1, str(v[0])))
    out.ids, out.labels = [v[0] for v in vectors], np.array([v[1] for v in vectors], np.int64)
    blocks = -(-len(vectors) // BLOCK)
    sizes = [len(v[2]) for v in vectors]
    owner = np.repeat(np.arange(len(vectors)), sizes)
    key = owner // BLOCK * len(weight) + np.concatenate([v[2] for v in vectors])
    order = np.argsort(key, kind="stable")
    key, first = np.unique(key[order], return_index=True)
    place, value = (owner[order] % BLOCK).astype(np.uint8), np.concatenate([v[3] for v in vectors])[order].astype(np.float32)
    start = np.append(first, len(owner))
    out.where = np.zeros((len(weight), blocks), np.int32)
    term, block = key % max(len(weight), 1), key // max(len(weight), 1)
    out.where[term, block] = np.arange(1, len(key) + 1)
    # run 0 holds nothing: its start and end are both 0
    out.peak = np.concatenate(([0], np.maximum.reduceat(value, first) if len(first) else [])).astype(np.float32)
    often = np.bincount(term, np.diff(start), minlength=len(weight))
    whole = np.flatnonzero(often >= max(8, FULL * len(vectors)))
    out.row = np.full(len(weight), -1, np.int32)
    out.row[whole] = np.arange(len(whole))
    out.full = np.zeros((len(whole), blocks, BLOCK), np.float32)
    run = np.repeat(np.arange(len(key)), np.diff(start))
    held = out.row[term[run]] >= 0
    out.full[out.row[term[run[held]]], block[run[held]], place[held]] = value[held]
    out.place, out.value = place[~held], value[~held]
    out.start = np.concatenate(([0, 0], np.cumsum(np.bincount(run[~held], minlength=len(key)))))
    out.class_weight = np.array([rates.get(0, 1.0), rates.get(1, 1.0)])
    mass = out.class_weight[out.labels]
    out.prior = float((mass * out.labels).sum() / mass.sum())
    # each example is scored by the others; the votes' observed toxic rates, made monotone, calibrate
    votes = []
    for n, (_, _, t, w) in enumerate(vectors):
        places, scores = out.nearest(t, w, NEIGHBOURS + 1)
        votes.append(out.vote(places[places != n], scores[places != n]))
    out.knots = _isotonic(np.array(votes), out.labels, mass)
    return out


def _isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares rising fit of y by x (pool adjacent violators), from (0, 0) to (1, 1)."""
    pools: list[list[float]] = []  # sum of weight, of weight times x, of weight times y
    _, same = np.unique(np.round(x, 9), return_inverse=True)  # equal votes are one point
    for w, wx, wy in zip(*(np.bincount(same, v) for v in (weight, weight * x, weight * y))):
        pools.append([w, wx, wy])
        while len(pools) > 1 and pools[-2][2] / pools[-2][0] >= pools[-1][2] / pools[-1][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    own = [(p[1] / p[0], p[2] / p[0]) for p in pools]
    return np.array([0.0, *[a for a, _ in own], 1.0]), np.array([0.0, *[b for _, b in own], 1.0])


def held_out(doc_id):
    """Whether a row's label is kept from learning: crc32 of its id as text, modulo 4, is 2. Null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def evidence_of(n0: np.ndarray, n1: np.ndarray, clean: int, toxic: int) -> np.ndarray:
    """How uneven a term's places are split between the classes: the exponent of the Chernoff bound, were it chance,
    drawn to 0 where the places are few."""
    base, n = (toxic + 0.5) / (clean + toxic + 1), n0 + n1
    part = lambda k, q: k * np.log(np.maximum(k, 1) / np.maximum(n, 1) / q)
    return np.maximum(part(n1, base) + part(n0, 1 - base), 0) * n / (n + DOUBT)


def document_frequencies(docs: DataFrame, numbers: dict[str, int], text: str = "text") -> np.ndarray:
    """In how many rows of docs each numbered term stands: every row counts; a task sends one sum a term."""
    shared, size = docs.sparkSession.sparkContext.broadcast(Reader(numbers)), len(numbers)

    def run(batches):
        reader, rows = shared.value, np.zeros(size, np.int64)
        for b in batches:
            for terms in reader.terms_of(t.as_py() for t in b.column(0)):
                rows[terms] += 1  # once a row, however often a number stands there
        found = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(rows[found])], ["term", "rows"])

    out = np.zeros(len(numbers), np.int64)
    sums = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "term long, rows long").groupBy("term").agg(F.sum("rows").alias("rows"))
    got = sums.toArrow()
    out[got.column("term").to_numpy()] = got.column("rows").to_numpy()
    return out


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", per_class: int = EXAMPLES_PER_CLASS) -> Index:
    """The index of a bounded sample of the labelled rows that are not held out.

    Up to per_class rows of each label, least hash of the id first, so any run takes the same ones. Every
    term of theirs is indexed. Its weight is its inverse document frequency over all rows of docs, times how
    uneven its places are split between the labels of the sample: words that tell nothing of the class weigh
    next to nothing, a word of few places weighs less for that, none is left out. A place counts once for each surrounding of a term's first place in a text, so
    that copies of a text are no evidence. Other labels than 0 and 1 and null ids are no examples; a
    document with both labels counts as toxic, one with several texts by its least. Without examples the
    index is empty and every score is 0. The driver gets the sample's terms and counts, never a text.
    """
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where(
        "id is not null and y in (0, 1)"
    ).where(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    rows = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    part = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
    chosen = [tuple(r) for y in (0, 1) for r in part(y).collect()]
    if not chosen:
        return Index()
    spark = docs.sparkSession
    small_batches(spark)
    kind = known.schema["id"].dataType.simpleString()
    sample = spark.createDataFrame(chosen, f"id {kind}, y int")
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(sample), "id")
    texts = cut(texts.groupBy("id", "y").agg(F.min("text").alias("text")))
    got = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not got:
        return Index()

    def spread(batches):
        for b in batches:
            seen = set()
            for y, t in zip(b.column(0).to_pylist(), b.column(1)):
                found = _WORDS.findall((t.as_py() or "").lower())
                first: dict[str, int] = {}
                for i, w in enumerate(found):
                    first.setdefault(w, i)
                around = {}
                for w, i in first.items():
                    place = zlib.crc32("\n".join(found[max(0, i - 2) : i + 3]).encode())
                    for term in terms_of(w):
                        around.setdefault(term, place)
                seen.update((term, y, place) for term, place in around.items())
            columns = list(zip(*seen)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], ["term", "y", "place"])

    seen = texts.select("y", "text").mapInArrow(spread, "term string, y int, place long").distinct()
    seen = seen.groupBy("term").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")).orderBy("term").toArrow()
    numbers = {t: i for i, t in enumerate(seen.column("term").to_pylist())}
    n0, n1 = (seen.column(c).to_numpy().astype(np.float64) for c in ("n0", "n1"))
    found = document_frequencies(docs, numbers, text)
    total = docs.count()
    weight = (np.log((1 + total) / (1 + found)) + 1) * evidence_of(n0, n1, got.get(0, 0), got.get(1, 0))
    shared = spark.sparkContext.broadcast(Reader(numbers))

    def count(batches):
        for b in batches:
            own = list(shared.value.counts_of(t.as_py() for t in b.column(2)))
            arrays = [pa.array([o[c] for o in own], pa.list_(pa.int32())) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], ["id", "y", "t", "n"])

    examples = texts.select("id", "y", "text").mapInArrow(count, f"id {kind}, y int, t array<int>, n array<int>").toArrow()
    ids, ys, ts, ns = (examples.column(c).combine_chunks() for c in ("id", "y", "t", "n"))
    rows_of = zip(ids.to_pylist(), ys.to_pylist(), *([np.asarray(x.values, np.int64) for x in a] for a in (ts, ns)))
    return build(numbers, weight, list(rows_of), {y: rows[y] / got[y] for y in got})


def score(docs: DataFrame, index: Index, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.3, whole_rows: bool = False) -> DataFrame:
    """For every row: doc_id, score in [0, 1], predicted (1 from the threshold on) and evidence.

    evidence lists the nearest examples, nearest first, as (doc_id, similarity, toxic); all that tie
    with the last vote, but are not listed. A text that shares no term with an example, null and empty texts
    included, has no evidence and the calibrated score of the prior. Repeated rows score alike. With whole_rows a struct named row holds the columns of docs.
    """
    small_batches(docs.sparkSession)
    row = [F.struct(*docs.columns).alias("row")] if whole_rows else []
    work = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), *row)
    found = StructType.fromDDL("score double, predicted int, evidence array<struct<doc_id:string,similarity:double,toxic:int>>")
    schema = StructType([work.schema["doc_id"], *found.fields, *([work.schema["row"]] if whole_rows else [])])
    evidence = pa.list_(pa.struct([("doc_id", pa.string()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
    shared = docs.sparkSession.sparkContext.broadcast((replace(index, numbers={}), Reader(index.numbers)))

    def run(batches):
        own, reader = shared.value
        for b in batches:
            scores, why = [], []
            for counted in reader.counts_of(t.as_py() for t in b.column(1)):
                places, near = own.nearest(*own.vector(*counted), NEIGHBOURS)
                scores.append(own.calibrated(own.vote(places, near)))
                why.append([{"doc_id": str(own.ids[p]), "similarity": s, "toxic": int(own.labels[p])} for p, s in zip(places[:NEIGHBOURS].tolist(), near[:NEIGHBOURS].tolist())])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(why, evidence), *([b.column(2)] if whole_rows else [])],
                ["doc_id", "score", "predicted", "evidence", *["row"] * whole_rows],
            )

    return work.mapInArrow(run, schema)


def reject(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, in its columns, whose text scores below the threshold."""
    return score(docs, fit(docs, labels, text, doc_id), text, doc_id, threshold, whole_rows=True).where("predicted = 0").select("row.*")
