"""Linkage over tables of its own: keys of six digits, titles of short words, equal titles in other spellings, against the SQL."""

import duckdb
import pytest

from lectern.plans import catalogue

from .test_catalogue import plain

TEXTS = ["a bc de", "A bc, de", "l'art of it", "lart of it", "Deep \\emph {blue} seas", "deep blue seas", "x", "x", "", "", "---", "Ein Tür", "ein Tu r", "Same words here", "same words here"]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Documents with ids so that each text stands with preprints and others; parts with keys about 100,000."""
    place, con = str(tmp_path_factory.mktemp("tables")), duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, 'en', 'src', ?)", [(n * len(TEXTS) + i, t, len(t)) for n in range(8) for i, t in enumerate(TEXTS)])
    con.execute("create table labels (doc_id bigint, quality integer, toxic integer)")
    con.execute("create table part as select * replace (p_partkey + shift as p_partkey) from read_parquet('/root/testdata/sf0.001/part.parquet'), (values (0), (9990), (99990), (1000000)) s(shift) where p_partkey < 30")
    for t in ("documents", "labels", "part"):
        con.execute(f"copy {t} to '{place}/{t}.parquet' (format parquet)")
    return place, con


def same(spark, tables, name):
    place, con = tables
    df = catalogue.QUERIES[name](spark, place)
    result = con.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in result.description]
    want = sorted((tuple(map(plain, r)) for r in result.fetchall()), key=repr)
    assert want and sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr) == want


def test_published_versions_of_short_words(spark, tables):
    same(spark, tables, "published_versions")


def test_versions_meet_by_titles(spark, tables):
    """Equal titles meet by digests: no index of words is built of whole texts."""
    same(spark, tables, "versions_by_names")
    df = catalogue.versions_by_names(spark, tables[0])
    assert "posexplode" not in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["match_ways", "match_promoted", "match_candidates"])
def test_keys_of_six_digits(spark, tables, name):
    same(spark, tables, name)


@pytest.mark.parametrize("name", ["match_candidates", "match_best"])
def test_long_titles_are_not_indexed(spark, tables, name):
    """Titles longer than any similar one are left before they are split into words; entries are read once."""
    df = catalogue.QUERIES[name](spark, tables[0])
    assert "posexplode" not in df._jdf.queryExecution().optimizedPlan().toString()
