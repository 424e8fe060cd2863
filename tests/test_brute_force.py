"""Queries that SQL cannot express, against plain Python over the collected rows."""

import difflib
import re
import unicodedata

from pyspark.sql import functions as F

from lectern.functions.text import norm_title, norm_title_column
from lectern.operators import document, link, records, search, transform
from lectern.plans import catalogue
from lectern.plans.carriers import table, text_records

SF = "/root/testdata/sf0.001"


def norm(title):
    plain = re.sub(r"[{}\\\"'`^~]", "", re.sub(r"\\[a-zA-Z]+\s*", "", title or ""))
    return " ".join(re.findall("[a-z0-9]+", unicodedata.normalize("NFKD", plain).lower()))


def test_norm_title(spark):
    want = {r.id: norm(r.title) for r in text_records(spark, SF).select("id", "title").collect()}
    assert {r.id: r.norm for r in catalogue.norm_title(spark, SF).collect()} == want


def test_norm_title_of_any_character(spark):
    texts = [f"a{chr(c)}B" for c in range(1, 0x2200)] + ["", None, "\\emph {X}y", "\\ss\x1c z", "e\u0301a", "ﬁn Ⅷ"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("t", norm_title_column(F.col("t")).alias("n")).collect()
    assert [r.n for r in got if r.n != norm_title(r.t)] == []
    assert all(r.n == norm(r.t) for r in got)


def test_published_versions(spark):
    rows = text_records(spark, SF).collect()
    preprint = lambda r: r.venue == "CoRR" or "informal" in (r.publtype or "")
    last = lambda n: re.sub("[^a-z]", "", n.split()[-1].lower())
    want = set()
    for a in filter(preprint, rows):
        for b in rows:
            if b.id != a.id and not preprint(b) and b.type not in ("proceedings", "data") and norm(a.title) == norm(b.title) and len([w for w in re.findall(r"\w+", a.title) if len(w) > 2]):
                shared = sum(last(n) in {last(m) for m in a.authors} for n in b.authors) / max(len(a.authors), len(b.authors))
                if shared > 0.4:
                    want.add((a.id, b.id))
    assert {(r.id, r.version) for r in catalogue.published_versions(spark, SF).collect()} == want


def test_match_best(spark):
    rows = catalogue.match_best(spark, SF).collect()
    pubs = {r.key: r for r in text_records(spark, SF).collect()}
    versions = {}
    for v in catalogue.published_versions(spark, SF).collect():
        versions.setdefault(v.id, []).append(v.version)
    want = set()
    for e in catalogue._entries(spark, SF).collect():
        found = pubs.get(f"text/{e.entry}")  # an entry names its record's key; its title has no record
        if found is None or found.type == "data":
            continue
        score = 100 + (10 if found.year == 2000 + e.entry % 25 else 0) - (30 if found.type == "proceedings" else 0)
        preprint = found.venue == "CoRR" or "informal" in (found.publtype or "")
        last = max(versions.get(found.id, [])) if preprint and found.id in versions else None
        how = "source key" if last is None else f"published version of {found.key}"
        if score >= 70:
            want.add((e.entry, found.key if last is None else f"text/{last}", how, float(score)))
    assert {(r.entry, r.key, r.how, r.score) for r in rows} == want


def test_similar_titles(spark):
    parts = {r.p_partkey: r for r in table(spark, SF, "part").collect()}
    first = {}
    for k in sorted(parts):
        first.setdefault((parts[k].p_brand, parts[k].p_size), parts[k].p_name)
    for r in catalogue.similar_titles(spark, SF).collect():
        p = parts[r.p_partkey]
        assert abs(r.ratio - difflib.SequenceMatcher(None, p.p_name, first[p.p_brand, p.p_size]).ratio()) < 1e-6


def test_similar_titles_are_linked(spark):
    names = ["Sorting in parallel on grids", "On grids: sorting in parallel", "Sorting in parallel on the grids", "Sorting on trees", "Sorting in parallel on grids"]
    pubs = catalogue._whole(spark.createDataFrame([(i, f"k{i}", "article", n, ["A B"], "J", 2000) for i, n in enumerate(names)], "id long, key string, type string, title string, authors array<string>, venue string, year int"))
    entry = "@article{x, title = {Sorting in Parallel on Grids}}"
    facts = spark.createDataFrame([(1, entry)], "entry int, raw string").select("entry", link.entry_facts_column("raw").alias("f"))
    got = {(r.id, r.how, r.base) for r in link.found_pairs(pubs, search.build_index(pubs, ("title",)), facts).collect()}
    asked, want = norm("Sorting in Parallel on Grids"), set()
    for i, n in enumerate(names):
        alike = difflib.SequenceMatcher(None, norm(n), asked).ratio()
        if norm(n) == asked:
            want.add((i, "title", 60))
        elif set(asked.split()) <= set(norm(n).split()) and alike > 0.9:
            want.add((i, "similar title", 40))
    assert got == want and len(want) == 3


def test_word_diffs(spark):
    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    turns = {}
    for r in table(spark, SF, "conversations").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    want = {}
    for conv, rows in turns.items():
        before = ""
        for turn, _, text in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "")):
            a, b = re.split(r"(\s+)", before or ""), re.split(r"(\s+)", text or "")
            same = common(a, b) if len(a) * len(b) <= 250_000 else None
            want[conv, turn] = [1, 1] if same is None else [len(a) - same, len(b) - same]
            before = text
    assert {(r.conv_id, r.turn): list(r.changed) for r in catalogue.word_diffs(spark, SF).collect()} == want


def _entry(r, options):
    rec = r.asDict(recursive=True)
    return transform.record_entry(rec, None, options)


def test_render_records(spark):
    made = {r.id: _entry(r, transform.Options()) for r in text_records(spark, SF).collect()}
    got = catalogue.render_records(spark, SF).collect()
    assert len(got) == len(made)
    place = {}
    for i in sorted(made):
        doc = i % 64
        place[doc] = place.get(doc, 0) + 1
        found = [r for r in got if r.doc == doc and r.pos == place[doc]]
        assert [(r.key, r.type, r.text, r.duplicate) for r in found] == [(made[i].key, made[i].type, transform.text_of(made[i]), None)]


def test_option_preview(spark):
    plain = transform.Options.of(series_abbrev=False, booktitle="keep", full_years=False, url_doi="keep", drop_source_meta=False, latex=False, protect_caps=False)
    want = set()
    for r in text_records(spark, SF).withColumn("title", F.col("key")).collect():
        left, right = ({n: " ".join(v.split()) for n, v in _entry(r, o).fields} for o in (plain, transform.Options()))
        order = [*right, *[n for n in left if n not in right]]
        want |= {(r.id, n, left.get(n), right.get(n), i + 1) for i, n in enumerate(order) if left.get(n) != right.get(n)}
    assert {(r.entry, r.name, r.left, r.right, r.at) for r in catalogue.option_preview(spark, SF).collect()} == want


def test_categories_overlap(spark):
    df = spark.createDataFrame([(1, "proceedings", "informal", "X"), (2, "article", None, "CoRR"), (3, "article", "Informal", "X"), (4, None, None, None)], "id int, type string, publtype string, venue string")
    found = lambda *names: [r.id for r in df.where(records.in_categories(list(names))).collect()]
    assert found("informal") == [1, 3] and found("editorship") == [1] and found("journal") == [2] and found("informal", "journal", "x") == [1, 2, 3]
    assert records.in_categories(["x"]) is None
    assert [r.d for r in df.select(records.display_category().alias("d")).collect()] == ["informal", "informal", "journal", "journal"]


def test_unique_keys(spark):
    rows = [(1, i, "k", False) for i in range(28)] + [(1, 28, "kb", True), (2, 0, None, False), (2, 1, "k", True), (2, 2, "k", False)]
    got = document.unique_keys(spark.createDataFrame(rows, "doc int, pos int, key string, fixed boolean")).orderBy("doc", "pos").collect()
    assert [r.unique for r in got][:3] == ["k", "kc", "kd"] and [r.unique for r in got][24:28] == ["kz", "k_", "k_", "k_"]
    assert [r.unique for r in got if r.doc == 2] == [None, "k", "kb"]


def test_set_keys(spark):
    items = spark.createDataFrame([(1, 0, "raw", None, None, "@misc{a, title = {x}}", None, None), (1, 1, "record", "r", "b", None, None, None)], document.ITEMS_DDL)
    wanted = spark.createDataFrame([(1, 0, "c"), (1, 1, "a")], "doc bigint, pos int, new_key string")
    got = document.set_keys(items, wanted).orderBy("pos").collect()
    assert got[0].raw == "@misc{c, title = {x}}" and got[1].key == "b"  # a is another item's key
