"""Published versions by the beginnings of titles, linkage that reads no more than it must, and parts with keys below zero and beyond 32 bits."""

import duckdb
import pytest

from lectern.functions.bibtex import parse
from lectern.operators import link
from lectern.plans import catalogue

from .test_linkage_tables import same

MARKS, LONG = "- " * 300, "many words of one text " * 40
TEXTS = [
    "same ending", MARKS + "same ending", "same" + MARKS + "ending", MARKS, LONG, LONG + "x", LONG.replace(" ", "\t\n  "), "", "  ",
    "\\emph {" * 60 + "deep" + "}" * 60, "deep", "deep", "{" * 299 + "\\emph deep", "Tür" * 150, "Tu r" * 150, "é" * 299 + "x" * 99, "é" * 299 + "y" * 99,
]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Texts that begin alike, or not until long after their marks, each with preprints and others."""
    place, con = str(tmp_path_factory.mktemp("starts")), duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, 'en', 'src', ?)", [(n * len(TEXTS) + i, t, len(t)) for n in range(8) for i, t in enumerate(TEXTS)])
    con.execute("create table labels (doc_id bigint, quality integer, toxic integer)")
    con.execute("create table part as select * replace (p_partkey + shift as p_partkey) from read_parquet('/root/testdata/sf0.001/part.parquet'), (values (0), (-1000), (20000), (1000000000), (1000000000000)) s(shift) where p_partkey < 40")
    for t in ("documents", "labels", "part"):
        con.execute(f"copy {t} to '{place}/{t}.parquet' (format parquet)")
    return place, con


@pytest.mark.parametrize("name", ["published_versions", "versions_by_names", "match_ways"])
def test_same_as_sql(spark, tables, name):
    same(spark, tables, name)


def _records(spark, titles):
    rows = [(i, f"k{i}", "article", t, ["A B"], "CoRR" if i % 2 else "J", 2000) for i, t in enumerate(titles)]
    return catalogue._whole(spark.createDataFrame(rows, "id long, key string, type string, title string, authors array<string>, venue string, year int"))


def test_only_titles_that_begin_alike_are_normalised_whole(spark, monkeypatch):
    whole, normalised = [], link._normalised
    monkeypatch.setattr(link, "_normalised", lambda pubs, *columns: whole.append([r.id for r in pubs.select("id").collect()]) or normalised(pubs, *columns))
    pubs = _records(spark, [LONG, LONG, "other " + LONG, "third " + LONG, LONG + "x"])
    assert {(r.id, r.version) for r in link.published_versions(pubs, pubs).collect()} == {(1, 0)}
    assert sorted(sum(whole, [])) == [0, 1, 4]


def test_no_version_is_looked_for_without_a_preprint(spark, tables, monkeypatch):
    monkeypatch.setattr(link, "published_versions", None)
    same(spark, tables, "match_candidates")


def test_pairs_are_grouped_by_numbers(spark, tables):
    """A text among the grouped values would have all pairs sorted."""
    df = catalogue.match_ways(spark, tables[0])
    assert "max_by" not in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("longest", ["Ring", "ring " * 60, "ring " * 300])
def test_equal_titles_of_any_length(spark, longest):
    pubs = _records(spark, ["Ring", "ring " * 60, "Ring " * 300, "\\emph " + "ring " * 300, "r i n g", "thing"])
    facts = link.entry_table(spark.createDataFrame([(1, "@misc{a, title = {ring}}"), (2, f"@misc{{b, title = {{{longest}}}}}")], "entry int, raw string"))
    found = {(r.entry, r.id) for r in link.found_pairs(pubs, None, facts).where("how = 'title'").collect()}
    assert found == {(1, 0)} | {"Ring": {(2, 0)}, "ring " * 60: {(2, 1)}, "ring " * 300: {(2, 2), (2, 3)}}[longest]


@pytest.mark.parametrize("raw, want", [
    ("@a{k, t = {x, y = \"z\" # (}, u = {b{c}d}, v = {\\}e}}", [("t", "x, y = \"z\" # ("), ("u", "b{c}d"), ("v", "\\}e")]),
    ("@a{k, t = {x} # {y}, u = {}}", [("t", "{x} # {y}"), ("u", "")]),
])
def test_groups_are_read_at_once(raw, want):
    assert [(i.kind, i.fields, i.raw) for i in parse(raw)] == [("entry", want, raw)]
