"""The likeness of texts against all of their anchors and the shifts between their places."""

from collections import Counter

import numpy as np

from lectern.llm import syncmers


def slow_likeness(a, b):
    """a, b: hash -> first place."""
    shift = Counter(b[h] - a[h] for h in a if h in b)
    common = sum(shift.values())
    hit = common if common == 1 else sum(n for n in shift.values() if n > 1)
    return hit / (len(a) + len(b) - hit)


def test_likeness_matches_by_positions(spark):
    rng = np.random.default_rng(5)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 9000, 1500))
    passage, short = text()[:300], " ".join(text().split()[:9])
    rows = [(i, f"{text()} {passage} {text()} {short if i % 2 else passage}") for i in range(6)]
    got = {r.doc_id: r for r in syncmers.edited_fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    down, made = rows[::-1], {}
    for n, (i, t) in enumerate(down):
        k, after = len(t) // 3, down[(n + 1) % len(down)]
        made[i] = (after[0], t[: len(t) - k] + after[1][:k])
    both = spark.createDataFrame(rows + [(i + 100, e) for i, (_, e) in made.items()], "doc_id bigint, text string")
    own = {}
    for r in sorted(syncmers.anchors(both).collect(), key=lambda r: r.position):
        own.setdefault(r.doc_id, {}).setdefault(r.hash, r.position)
    for i, (after, _) in made.items():
        for value, x, y in ((got[i].near_edited, own[i], own[i + 100]), (got[i].near_next, own[i], own[after])):
            assert x.keys() & y.keys() and abs(value - slow_likeness(x, y)) < 1e-12
        # the fingerprint holds every anchor with its place
        held = [(int(got[i].fingerprint[k : k + 8], 16), int(got[i].fingerprint[k + 8 : k + 16], 16)) for k in range(0, len(got[i].fingerprint), 16)]
        assert sorted((h - (1 << 31)) % (1 << 32) for h in own[i]) == sorted(h for h, _ in held) and sorted(own[i].values()) == sorted(p for _, p in held)


def test_shared_words_out_of_place_count_little(spark):
    """The same sentences in another order keep their anchors; a bag of equal anchors at scattered shifts would not."""
    rows = [(1, "one two three four five six seven eight nine ten"), (2, "one two three four five six seven eight nine ten"), (3, "x")]
    got = {r.doc_id: r for r in syncmers.edited_fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[2].near_next == 1.0 and got[1].near_next == 0.0 and got[1].fingerprint == got[2].fingerprint
