"""The template tree against a plain recursive one, and branches that must stay apart."""

import math
import random

from lectern.llm import url_filter


def judged(spark, rows, urls):
    labels = spark.createDataFrame(rows, "host string, path string, blocked int")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    return {r.page_id: r for r in url_filter.judge(pages, rules=(), labels=labels).collect()}


def test_unlabelled_branches_merge_no_opposites(spark):
    rows = [("h.x", f"/fr/{i}", 0) for i in range(50)] + [("h.x", f"/de/{i}", 1) for i in range(50)]
    got = judged(spark, rows, [f"http://h.x/{b}/7" for b in ("fr", "en", "es", "de")])
    assert [got[i].template for i in range(4)] == ["/fr/{n}", "/{?}/{n}", "/{?}/{n}", "/de/{n}"]
    assert [got[i].verdict for i in range(4)] == ["allow", "allow", "allow", "block"]
    got = judged(spark, rows[:50], ["http://h.x/fr/7", "http://h.x/en/7"])
    assert got[0].template == got[1].template == "/*/{n}"


def test_many_branches_leave_out_what_is_apart(spark):
    names = ["n" + chr(97 + i % 26) + chr(97 + i // 26) for i in range(60)]
    rows = [("h.x", f"/{n}/{i}", int(n == names[5])) for n in names for i in range(20)]
    got = judged(spark, rows, [f"http://h.x/{n}/99" for n in (names[5], names[6], "zz")])
    assert [got[i].verdict for i in range(3)] == ["block", "allow", "allow"]
    assert got[0].template == f"/{names[5]}/{{n}}" and got[1].template == "/*/{n}"


def test_deep_paths_and_labels_of_their_own(spark):
    """Templates differ at any depth; one without labels is not rejected on its host's rate."""
    rows = [("h.x", f"/a/b/c/d/e/{s}/{i}", int(s == "bad")) for s in ("good", "bad") for i in range(40)]
    rows += [("k.x", f"/de/{i}", 1) for i in range(60)] + [("k.x", f"/fr/{i}", 0) for i in range(30)]
    got = judged(spark, rows, ["http://h.x/a/b/c/d/e/bad/7", "http://h.x/a/b/c/d/e/good/7", "http://k.x/about/us/team", "http://k.x/de/7"])
    assert [got[i].verdict for i in range(4)] == ["block", "allow", "allow", "block"]
    assert got[0].template == "/a/b/c/d/e/bad/{n}"


def slow_classes(branches):
    """seg -> class of branches seg -> (labelled, blocked)."""
    out = {s: "" for s, (n, _) in branches.items() if n}
    while True:
        sums, moved = {}, {}
        for s, c in out.items():
            n, b = sums.get(c, (0, 0))
            sums[c] = n + branches[s][0], b + branches[s][1]
        for s, c in out.items():
            n, b = branches[s]
            m, a = sums[c][0] - n, sums[c][1] - b
            if m <= 0:
                continue
            pooled = (a + b) / (n + m)
            z = (b / n - a / m) / max(math.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m)), 1e-9)
            if abs(z) > url_filter.MERGE_Z:
                moved[s] = c + ("+" if z > 0 else "-")
        if not moved:
            break
        out |= moved
    kinds = sorted(set(out.values()))
    return out | {s: "?" if len(kinds) > 1 else (kinds or [""])[0] for s, (n, _) in branches.items() if not n}


def slow_tree(paths, made=(), level=0):
    """path -> template of one host's paths: path -> (labelled, blocked)."""
    if len(paths) == 1:
        return {p: made + p[level:] for p in paths}
    out = {p: made for p in paths if len(p) <= level}
    branches = {}
    for p, (n, b) in paths.items():
        if len(p) > level:
            m, a = branches.get(p[level], (0, 0))
            branches[p[level]] = m + n, a + b
    named = slow_classes(branches)
    nodes = {}
    for p, v in paths.items():
        if len(p) > level:
            c = named[p[level]]
            alone = sum(x == c for x in named.values()) == 1
            nodes.setdefault(p[level] if alone else "*" if not c else "{" + c + "}", {})[p] = v
    for step, below in nodes.items():
        out |= slow_tree(below, (*made, step), level + 1)
    return out


def test_tree_is_the_plain_recursive_one(spark):
    rng = random.Random(8)
    paths = {}
    for _ in range(900):
        host = rng.choice(["h.x", "h.x", "k.x"])
        p = tuple(rng.choice(["a", "b", "c", "d", "e", "f"][: 6 - i % 3]) for i in range(rng.randrange(6)))
        n = rng.choice([0, 0, 1, 5, 30])
        bad = 0.9 if p[:1] == ("a",) else 0.5 if p[1:2] == ("b",) else 0.05
        paths.setdefault(host, {})[p] = n, sum(rng.random() < bad for _ in range(n))
    rows = [(h, list(p), 1, n, b) for h, own in paths.items() for p, (n, b) in own.items()]
    table = spark.createDataFrame(rows, "host string, shape array<string>, n bigint, labelled bigint, blocked bigint")
    got = {(r.host, tuple(r.shape)): r for r in url_filter.templates(table).collect()}
    want = {(h, p): "/" + "/".join(t) for h, own in paths.items() for p, t in slow_tree(own).items()}
    assert {k: r.template for k, r in got.items()} == want and len(set(want.values())) > 20
    every = [(h, want[h, tuple(p)], n, b) for h, p, _, n, b in rows]
    base = sum(b for *_, b in every) / sum(n for _, _, n, _ in every)
    for (h, _), r in got.items():
        n, b = (sum(x[i] for x in every if x[:2] == (h, r.template)) for i in (2, 3))
        hn, hb = (sum(x[i] for x in every if x[0] == h) for i in (2, 3))
        purity = (b + 8 * (hb + 8 * base) / (hn + 8)) / (n + 8)
        assert (r.labelled, r.blocked) == (n, b) and abs(r.purity - purity) < 1e-9 and r.rejected == (purity >= 0.5 and 2 * b >= n > 0)
