"""Mixing, SimHash, syncmers, licences, byte-level BPE and toxicity against brute force."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import byte_bpe, common, licenses, mixing, queries, simhash, syncmers, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(rows):
    return sorted(rows, key=repr)


# ---------------------------------------------------------------- 3 mixing


def water(sizes, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        got = {s: rest * w[s] / sum(w[f] for f in free) for s in free}
        over = [s for s in free if got[s] > most * sizes[s]]
        if not over:
            return {**{s: most * sizes[s] for s in full}, **got}
        full.update(over)


def test_mixing(spark, sf, odd, none):
    for docs in (common.table(spark, sf, "documents"), odd):
        rows = mixing.plan(docs).collect()
        sizes = {}
        for d in docs.select("doc_id", "text", "source").collect():
            sizes[d.source] = sizes.get(d.source, 0) + len(WORD.findall(d.text or ""))
        want = water(sizes)
        assert len(rows) == docs.count() and key(rows) == key(mixing.plan(docs.repartition(3)).collect())
        targets = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
        assert targets == pytest.approx(want)
        assert all(r.copies <= 2 and r.source_size in sizes.values() for r in rows)
        mixed = mixing.mix(docs)
        assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0
    found = mixing.plan(common.table(spark, "/root/testdata/sf0.1", "documents")).groupBy("target").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.sum("size").alias("n"))
    assert sum(r.t for r in found.collect()) == pytest.approx(1.5 * sum(r.n for r in found.collect()), rel=0.05)


def test_rows_without_ids_draw_apart(spark):
    """Each source comes near its target, also where ids are null, repeated, or whole rows repeat."""
    rng = np.random.default_rng(2)
    text = lambda: " ".join(["w"] * int(rng.integers(5, 40)) + [str(rng.integers(1 << 40))])
    rows = [(None, text(), "a") for _ in range(600)] + [(i, text(), "b") for i in range(600)] + [(i % 3, text(), "c") for i in range(600)] + [(7, "same row again", "d")] * 3000
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = mixing.plan(docs).groupBy("source_size", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()
    assert len(found) == 4 and all(0.9 < r.taken / r.target < 1.1 for r in found)
    again = mixing.plan(docs.repartition(5))
    assert key(mixing.plan(docs).collect()) == key(again.collect())


# ---------------------------------------------------------------- 4 SimHash


def slow_fingerprint(text):
    found = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not found:
        return 0
    grams = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(fps, most=3):
    """Smallest member of each class of (node, fingerprint) pairs by all pairs."""
    parent = {n: n for n, _ in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(fps):
        for b, y in fps[:i]:
            if (x ^ y).bit_count() <= most:
                a1, b1 = root(a), root(b)
                parent[max(a1, b1)] = min(a1, b1)
    return {n: root(n) for n in parent}


def test_simhash(spark, sf, odd, none):
    for docs in (common.table(spark, sf, "documents"), odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        texts = {r.doc_id: r.text for r in docs.collect()}
        fps = [(i, slow_fingerprint(t)) for i, t in sorted(texts.items())]
        want = slow_components(fps)
        got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
        assert {i: r.fp & (1 << 64) - 1 for i, r in got.items()} == dict(fps)
        assert {i: r.component_id for i, r in got.items()} == want
        kept = simhash.deduplicate(docs)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert simhash.near_duplicates(odd).count() == odd.count() and simhash.near_duplicates(none).count() == 0
    kept = simhash.deduplicate(odd).collect()
    assert [r.doc_id for r in kept if r.doc_id in (1, 2)] == [1] and [r.text for r in kept if r.doc_id is None] == ["no id at all"]
    twice = odd.union(odd.where("doc_id = 1 or doc_id is null"))
    assert sorted(map(repr, simhash.deduplicate(twice).collect())) == sorted(map(repr, kept))
    assert simhash.deduplicate(none).count() == 0


def test_links_of_dense_groups(spark):
    """Random near groups of any shape: the keys, the chains and long runs lose no link."""
    rng = random.Random(3)
    values = {0, (1 << 64) - 1}
    for _ in range(6):
        values |= {x := rng.getrandbits(64)}
        for _ in range(80):
            for b in rng.sample(range(64), rng.randrange(1, 4)):
                x ^= 1 << b
            values.add(x)
    base = rng.getrandbits(64)
    values |= {base ^ 1 << a ^ 1 << b for a in range(60) for b in range(a)}  # one key of many fingerprints
    fps = [(int(np.uint64(v).view(np.int64)), v) for v in sorted(values)]
    want = slow_components(fps)
    edges = simhash.link_classes(spark.createDataFrame([(n, n) for n, _ in fps], "fp bigint, node bigint"))
    assert edges.count() < 20 * len(fps)
    found = {r.node: r.component for r in common.connected_components(edges).collect()}
    assert {n: found.get(n, n) for n, _ in fps} == want


def test_long_runs_split(monkeypatch):
    monkeypatch.setattr(simhash, "LONG_RUN", 64)
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 12, 300).astype(np.uint64))
    label = simhash._links(fps, 3, 3)
    want = slow_components([(i, int(f)) for i, f in enumerate(fps)])
    assert [int(x) for x in label] == [want[i] for i in range(len(fps))]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 1)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# ---------------------------------------------------------------- 5 syncmers


def slow_anchors(text):
    """(position, words) of the closed syncmers, by the hash that the operator uses for inner substrings."""
    return [w for w in re.split(r"[ \t-\r]+", text) if w]


def test_syncmers(spark, sf, odd, none, monkeypatch):
    monkeypatch.setattr(syncmers, "RUN_ROWS", 23)
    docs = common.table(spark, sf, "documents")
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in syncmers.edited_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for i, (d, text) in enumerate(rows):
        n, after = len(text) // 3, rows[(i + 1) % len(rows)][1]
        edited = text[: len(text) - n] + after[:n]
        assert got[d].n_chars == len(text) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[d].near_next <= 1 and (got[d].near_edited == 1) == (got[d].fingerprint == got[d].edited_fingerprint)
    alone = {r.doc_id: r.fingerprint for r in syncmers.fingerprints(docs).collect()}
    assert alone == {d: r.fingerprint for d, r in got.items()}
    by_text = {}
    for d, t in rows:
        assert by_text.setdefault(t, alone[d]) == alone[d]
    assert np.mean([r.near_edited for r in got.values()]) > 0.3 > 0.05 > np.mean([r.near_next for r in got.values()])
    assert syncmers.edited_fingerprints(odd).count() == odd.count()
    assert syncmers.edited_fingerprints(none).count() == 0
    one = syncmers.edited_fingerprints(docs.limit(1)).first()
    assert one.near_next == 1


def test_anchors_are_closed_syncmers(spark):
    """An anchor's choice needs its own words alone, and anchors of a shared passage differ by one offset."""
    words = [f"w{random.Random(i).randrange(50)}" for i in range(300)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(["x", "y", "z"] + words)), (3, "a b c"), (4, None)], "doc_id bigint, text string")
    got = syncmers.anchors(docs).collect()
    a, b = ({(r.position, r.hash) for r in got if r.doc_id == d} for d in (1, 2))
    assert {(p + 3, h) for p, h in a} <= b and not any(r.doc_id > 2 for r in got)
    # brute force over the words, with Spark's own hash of words and pairs
    h = [r.h for r in spark.createDataFrame(list(enumerate(words)), "i int, w string").selectExpr("i", "xxhash64(w) h").orderBy("i").collect()]
    g = [r.g for r in spark.createDataFrame([(i, h[i], h[i + 1]) for i in range(len(h) - 1)], "i int, a bigint, b bigint").selectExpr("i", "xxhash64(a, b) g").orderBy("i").collect()]
    want = {i for i in range(len(words) - 4) if min(g[i : i + 4]) in (g[i], g[i + 3])}
    assert {p for p, _ in a} == want
    assert all(any(i + j in want for j in range(4)) for i in range(len(words) - 8))  # no long gap without an anchor


# ---------------------------------------------------------------- 7 licences


def slow_places(words, phrase):
    return [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]


def test_licence_phrases_and_spans():
    scanner, rng = licenses.Scanner(), random.Random(5)
    pool = sorted({w for t, _ in scanner.templates for w in t} | {"x", "y"})
    for _ in range(300):
        words = []
        while len(words) < 60:
            t = rng.choice(scanner.templates)[0]
            a = rng.randrange(len(t))
            words += rng.choice([t[a : a + rng.randrange(1, 9)], [rng.choice(pool)], rng.choice(scanner.phrases)[0]])
        got = scanner.scan(words)
        want = sorted((i, n) for n, (p, _) in enumerate(scanner.phrases) for i in slow_places(words, p))
        assert sorted(got["places"]) == want
        for first, end, number, coverage in got["spans"]:
            t = scanner.templates[number][0]
            assert 0 < coverage <= 1 and end <= len(words)
            assert any(words[first : first + 3] == t[i : i + 3] for i in range(len(t)))
        # every run of three template words is in some span of that template
        for number, (t, _) in enumerate(scanner.templates):
            grams = {tuple(t[i : i + 3]) for i in range(len(t) - 2)}
            for i in range(len(words) - 2):
                if tuple(words[i : i + 3]) in grams:
                    assert any(a <= i and i + 3 <= e for a, e, n, _ in got["spans"] if n == number), (i, number)


def test_licence_scan(spark, sf, odd, none):
    docs = common.table(spark, sf, "documents")
    rows = {r.doc_id: r for r in queries.op7_license_scan(spark, sf).collect()}
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for d in docs.collect():
        words = word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d.text or ""))
        places = sorted((i, label) for p, label in licenses.PHRASES for i in slow_places(words, p.split()))
        r = rows[d.doc_id]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    got = {r.doc_id: r for r in licenses.scan(odd).where("doc_id is not null").collect()}
    assert got[8].labels == ["mit"] and got[8].score == 1 and got[3].n_words == 0 and got[6].n_words == 80_000
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(none).count() == 0
    text = "x Permission is hereby granted free of charge to any person obtaining a copy of this software and its documentation files"
    spans = licenses.Scanner().scan(licenses.words(text))["spans"]
    assert spans[0][0] == 1 and max(s[3] for s in spans) > 0.25


def test_licence_matches_and_chains():
    """Matches are those of a plain search, and stray words between, even the template's own, do not end a chain."""
    scanner, rng = licenses.Scanner(), random.Random(6)
    for _ in range(60):
        words = []
        while len(words) < 50:
            t = rng.choice(scanner.templates)[0]
            a = rng.randrange(len(t))
            words += rng.choice([t[a : a + rng.randrange(1, 9)], ["x"]])
        want = set()
        for number, (t, _) in enumerate(scanner.templates):
            for i in range(len(words)):
                for at in range(len(t)):
                    if i and at and words[i - 1] == t[at - 1]:
                        continue
                    k = 0
                    while i + k < len(words) and at + k < len(t) and words[i + k] == t[at + k]:
                        k += 1
                    if k >= scanner.least:
                        want.add((i, number, at, k))
        got, seen = [], scanner._chain
        scanner._chain = lambda m: got.extend(m) or seen(m)
        scanner.scan(words)
        scanner._chain = seen
        assert len(got) == len(set(got)) and set(got) == want
    for number, (t, label) in enumerate(scanner.templates):
        if len(t) > 16:
            for stray in (["x", "y", "z"], t[:3], t[-3:], ["all", "rights", "reserved"]):
                found = scanner.scan([*t[:8], *stray, *t[8:]])["spans"]
                assert max(c for _, _, n, c in found if n == number) > 0.85, (label, stray)
    assert all(n == 1 or max(c for *_, k, c in scanner.scan(t)["spans"] if k == i) == 1 for i, (t, n) in enumerate(scanner.templates))


# ---------------------------------------------------------------- 8 byte-level BPE


def test_byte_bpe(spark, sf, odd, none):
    import tiktoken

    path, pattern = queries.vocabulary_path(), queries.vocabulary_pattern()
    tokens = byte_bpe.read_ranks(path)
    want = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    codec, rng = byte_bpe.Codec(tokens, pattern, cache=500), random.Random(2)
    texts = ["", "a" * 5000, " \n\n  x\t", "<unk></s><|endoftext|>", "▁ ▁▁ 一丁", "😀👨‍👩‍👧 é é", "\x00\x7f"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x2000), rng.randrange(0x4E00, 0x9FFF), rng.randrange(0x1F300, 0x1F700)])) for _ in range(60)) for _ in range(200)]
    for t in texts:
        assert codec.encode(t) == want.encode_ordinary(t) and codec.decode(codec.encode(t)) == t.encode()
    for docs in (common.table(spark, sf, "documents"), odd):
        got = byte_bpe.encode(docs, path, pattern, with_digests=True).collect()
        source = sorted((repr(r.doc_id), r.text or "") for r in docs.collect())
        assert sorted((repr(r.doc_id), want.decode(r.ids)) for r in got) == source
        for r in got:
            raw = np.array(r.ids, "<u4").tobytes()
            assert (r.n_tokens, r.ids_sha256) == (len(r.ids), hashlib.sha256(raw).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256(want.decode(r.ids).encode()).hexdigest()
        back = byte_bpe.decode(byte_bpe.encode(docs, path, pattern), path).collect()
        assert sorted((repr(r.doc_id), r.text) for r in back) == source
    assert byte_bpe.encode(none, path, pattern).count() == 0


# ---------------------------------------------------------------- 6 toxicity


def test_block_max_search_is_exact():
    """Whole TF-IDF vectors of random texts: the index finds what all cosines say, ties with the last included."""
    rng = np.random.default_rng(4)
    word = lambda: f"w{int(rng.zipf(1.3)) % 400}"
    texts = [" ".join(word() for _ in range(rng.integers(0, 40))) for _ in range(700)]
    texts += texts[:30]  # copies tie
    numbers = {t: i for i, t in enumerate(sorted({t for x in texts for w in x.split() for t in toxicity.terms_of(w)}))}
    reader, weight = toxicity.Reader(numbers), rng.random(len(numbers)) + 0.01
    index = toxicity.build(numbers, weight, [(i, int(rng.random() < 0.3), *reader.counts(t)) for i, t in enumerate(texts)], {0: 3.0, 1: 1.0})

    def dense(text):
        out = np.zeros(len(numbers))
        for w in text.split():
            for t in toxicity.terms_of(w):
                if t in numbers:
                    out[numbers[t]] += 1
        out = np.where(out > 0, 1 + np.log(np.maximum(out, 1)), 0) * weight
        return out / (np.linalg.norm(out) or 1)

    every = np.stack([dense(texts[i]) for i in index.ids])
    assert (index.row >= 0).any() and (index.row < 0).any()
    for n in range(150):
        text = texts[n] if n % 3 == 0 else " ".join(word() for _ in range(rng.integers(0, 30)))
        cosine = every @ dense(text)
        places, scores = index.nearest(*index.vector(*reader.counts(text)), 16)
        kth = sorted(cosine, reverse=True)[15]
        sure, maybe = {j for j, c in enumerate(cosine) if c > 1e-9 and c >= kth + 1e-4}, {j for j, c in enumerate(cosine) if c > 0 and c >= kth - 1e-4}
        assert sure <= set(places.tolist()) <= maybe and len(places) >= min(16, (cosine > 1e-9).sum())
        assert np.allclose(scores, cosine[places], atol=1e-5) and (np.diff(scores) <= 1e-12).all()
    assert index.calibrated(0.0) <= index.calibrated(0.5) <= index.calibrated(1.0)


def test_reader_counts_as_splitting_does():
    """Words of any script, length and hash, in texts read together and in pieces, against plain splitting."""
    rng = random.Random(6)
    known = ["mit", "w1", "straße", "наука", "数学の本", "𝒳abc𝒳", "i̇stan", "a_b", "x" * 64, "y" * 65, "z" * 300, "herereat", "ab", "9½"]
    numbers = {t: i for i, t in enumerate(sorted({t for w in known for t in toxicity.terms_of(w)} | {"^lone", "^lonel"}))}
    words = [*known, "MIT", "İSTAN", "mi", "heresy", "herereats", "x" * 65, "y" * 64, "y" * 66, "z" * 299 + "ж", "lone", "lonely", "науки", "ΑΣ", "", "e\u0301t", "\U0001f600"]
    texts = [None, "", " ", "\n", *known, "-".join(known)]
    texts += ["".join(rng.choice(words) + rng.choice(" \n.,\u00a0\u3000—") for _ in range(rng.randrange(60))) for _ in range(300)]
    texts.append(" ".join(rng.choice(words[:12]) for _ in range(60000)))

    def plain(text):
        out = {}
        for w in re.findall(r"\w+", (text or "").lower()):
            for t in toxicity.terms_of(w):
                if t in numbers:
                    out[numbers[t]] = out.get(numbers[t], 0) + 1
        return sorted(out.items())

    reader = toxicity.Reader(numbers)
    got = list(reader.counts_of(texts))
    assert len(texts[-1]) > 2 * toxicity.PIECE and len(got) == len(texts)
    for text, (terms, counts) in zip(texts, got):
        assert list(zip(terms.tolist(), counts.tolist())) == plain(text)
    assert all(len(t) == 0 for t, _ in toxicity.Reader({}).counts_of(texts))
    # words with the hash of a known one, of its length too, are not taken for it
    reader._hash = lambda characters, size: np.full(len(size), reader.tables[0].keys[0])
    assert len(next(reader.counts_of([" ".join("q" * n for n in range(1, 66))]))[0]) == 0


def test_reading_costs_little_more_than_splitting():
    """Words are looked up together: reading takes less than twice as long as splitting and counting words alone."""
    rng = random.Random(7)
    syllables = ["tion", "er", "ou", "ment", "the", "re", "ing", "an", "qu", "ci", "ón", "st"]
    vocabulary = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(60000)]
    numbers = {t: i for i, t in enumerate(sorted({t for w in vocabulary[:50000] for t in toxicity.terms_of(w)}))}
    texts = [" ".join(rng.choice(vocabulary) for _ in range(400)) for _ in range(500)]
    reader = toxicity.Reader(numbers)

    def seconds(f):
        took = []
        for _ in range(3):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    plain = seconds(lambda: [Counter(re.findall(r"\w+", t.lower())) for t in texts])
    took = seconds(lambda: list(reader.counts_of(texts)))
    assert took < 2 * plain, (took, plain)


def test_document_frequencies_count_every_row(spark, odd):
    numbers = {t: i for i, t in enumerate(("same", "^same", "mit", "w1", "absent"))}
    assert toxicity.document_frequencies(odd.repartition(3), numbers).tolist() == [3, 3, 2, 1, 0]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = common.table(spark, sf, "labels")
    rows = queries.op6_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    hits = sum(r.predicted and r.toxic for r in rows)
    assert hits / sum(r.toxic for r in rows) > 0.9 and hits / sum(r.predicted for r in rows) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    # labels of held-out rows change nothing
    sf = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    changed = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, changed)
    assert a.ids == b.ids and a.numbers == b.numbers and (a.weight == b.weight).all() and (a.labels == b.labels).all()


def test_copies_of_toxic_examples_are_found(spark):
    """Every text that shares a term with an example is searched: a copy of a toxic example finds it at cosine 1."""
    sf = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    index = toxicity.fit(docs, labels)
    toxic = {i for i, y in zip(index.ids, index.labels) if y}
    rows = toxicity.score(docs.where(F.col("doc_id").isin(sorted(toxic))), index).collect()
    assert all(abs(r.evidence[0].similarity - 1) < 1e-4 for r in rows)
    assert sum(r.predicted for r in rows) / len(rows) > 0.9


def test_toxicity_edges(spark, sf, odd, none):
    labels = common.table(spark, sf, "labels")
    index = toxicity.fit(common.table(spark, sf, "documents"), labels)
    got = toxicity.score(odd, index).collect()
    assert len(got) == odd.count() and len({r.score for r in got if r.doc_id in (3, 4, 5)}) == 1
    kept = toxicity.reject(odd, labels)
    assert kept.columns == odd.columns
    assert toxicity.score(none, index).count() == 0 and toxicity.reject(none, labels).count() == 0
    empty = toxicity.fit(odd, spark.createDataFrame([(None, None)], "doc_id bigint, toxic int"))
    assert [r.score for r in toxicity.score(odd.limit(2), empty).collect()] == [0.0, 0.0]
    one_class = toxicity.fit(odd, spark.createDataFrame([(1, 0), (6, 0), (7, 0)], "doc_id bigint, toxic int"))
    assert all(r.score < 0.3 for r in toxicity.score(odd, one_class).collect())
