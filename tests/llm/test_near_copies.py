"""Near copies against brute force over all pairs."""

import numpy as np

from lectern.llm import common, near_copies


def similarities(texts):
    """(a, b, similarity) of all pairs of ids with the same or alike shingles of five words."""
    split = {i: (t or "").lower().split() for i, t in texts.items()}
    own = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in split.items()}
    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = own[a], own[b]
            if x == y:
                yield b, a, 1.0
            elif len(x) * 0.8 <= len(y) <= len(x) * 1.25 and len(x & y) >= 0.8 * len(x | y) > 0:
                yield b, a, len(x & y) / len(x | y)


def classes(ids, pairs):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b, *_ in pairs:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def planted(spark, sf):
    """Documents with groups of edited copies: similarity 0.7 to 0.97, and two groups larger than a bucket tries at once."""
    rng = np.random.default_rng(3)
    rows, n = [(r.doc_id, r.text) for r in common.table(spark, sf, "documents").select("doc_id", "text").collect()], 1_000_000
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 50_000, 300)]
        for c in range(90 if k < 2 else 3):
            own = list(words)
            for at in rng.choice(300, c % (7 if k else 12), False):
                own[at] = f"c{n}-{at}"
            rows.append((n, " ".join(own)))
            n += 1
    return rows


def test_near_copies_are_dropped(spark, sf, none, monkeypatch):
    import corpus_pipeline as p

    monkeypatch.setattr(near_copies, "CROWD_BLOCK", 40)
    monkeypatch.setattr(near_copies, "COLUMNS", 100)

    rows = planted(spark, sf)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    pairs = list(similarities(dict(rows)))
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    # nothing joins but by a link; of the links all but those whose fingerprints are too far apart are found
    want = classes(dict(rows), pairs)
    assert all(want[i] == want[c] for i, c in got.items())
    found = sum(got[a] == got[b] for a, b, _ in pairs) / len(pairs)
    assert found > 0.99 and len(set(got.values())) <= len(set(want.values())) * 1.02
    assert sorted(r.doc_id for r in p.drop_near_copies(spark, docs, sf).collect()) == sorted(set(got.values()))
    assert near_copies.deduplicate(none).count() == 0


def test_filter_finds_every_pair_within_the_radius():
    """A bucket yields each pair whose chain from its start keeps to the budgets, large ones split by further segments too."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    ring = np.repeat(base, 60)
    for i in range(len(ring)):
        for bit in rng.choice(64, rng.integers(0, 12), False):
            ring[i] ^= np.uint64(1 << int(bit))
    n = len(ring)
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if (int(ring[i]) ^ int(ring[j])).bit_count() <= near_copies.RADIUS}
    for at_once in (near_copies.AT_ONCE, 64):
        got, near_copies.AT_ONCE, before = set(), at_once, near_copies.AT_ONCE
        for start in range(near_copies.SEGMENTS):
            rings = near_copies.turned(ring, start)
            first = rings >> np.uint64(64 - near_copies.WIDTH)
            for value in np.unique(first):
                own = np.flatnonzero(first == value)
                bucket = near_copies.Bucket(rings[own], np.zeros(len(own), np.uint64), np.full(len(own), 100), np.zeros(len(own), bool))
                places = own[bucket.order]
                for x, y, _ in bucket.hits():
                    got |= {(min(a, b), max(a, b)) for a, b in zip(places[x].tolist(), places[y].tolist())}
        near_copies.AT_ONCE = before
        assert got == want
