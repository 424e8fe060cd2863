"""URL filters, chat examples, exact search and fixity against brute force; the pipeline's stages."""

import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import chat, common, oracles, queries, topk, url_filter, warc

# ---------------------------------------------------------------- 1 URL filters


def slow_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
    path = rest[n:]
    return host, path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]


def slow_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = ["http://A.Example.ORG/es/1", "https://example.org/en/12?x#y", "https://xexample.org/es/", "http://org/", "http://com/fr/a", "x://a.com/de/", "x://a.com/de",
        "http://a.org?x/y", "nope", "", None, "http://", "http://h/1/2/3/4/5/6/7", "http://h/a?b://c", "http://É.org/", "http://a.org:80/", "//a.org/", "http://a.org\n/x"]


def test_urls(spark, sf):
    pages = common.table(spark, sf, "pages")
    odd = spark.createDataFrame([(i, u) for i, u in enumerate(URLS + URLS[:3])] + [(None, None)], "page_id bigint, url string")
    for df in (pages, odd.withColumn("host", F.lit(1)).withColumn("n", F.lit(2))):
        got = url_filter.judge(df).collect()
        want = sorted([repr((r.page_id, *slow_split(r.url), slow_rule(*slow_split(r.url))[0])) for r in df.collect()])
        assert sorted(repr((r.page_id, r.host, r.path, r.rule)) for r in got) == want
        for r in got:
            assert r.verdict == (slow_rule(r.host, r.path)[1] or r.verdict) and (r.verdict == "allow" or slow_rule(r.host, r.path)[1] or r.purity >= url_filter.REJECT_FROM)
    assert url_filter.judge(odd.limit(0)).count() == 0


def test_templates(spark):
    """Numbers and many names become wildcards, alike branches merge, and blocked templates are told apart."""
    rows = [("h.x", f"/good/{i}", 0) for i in range(40)] + [("h.x", f"/fine/{i}", 0) for i in range(40)]
    rows += [("h.x", f"/bad/{i}", 1) for i in range(40)] + [("h.x", f"/tag/name{chr(97 + i % 26)}{chr(97 + i // 26)}", 0) for i in range(100)]
    labels = spark.createDataFrame(rows, "host string, path string, blocked int")
    urls = ["http://h.x/good/999", "http://h.x/bad/999", "http://h.x/fine/7", "http://h.x/tag/nameaa", "http://h.x/tag/other", "http://new.y/bad/1", "http://h.x/bad/1/2/3/4/5/6"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: r for r in url_filter.judge(pages, labels=labels).collect()}
    assert got[0].template == got[2].template and got[1].template == "/bad/{n}"
    assert (got[0].verdict, got[1].verdict) == ("allow", "block") and got[1].purity > 0.5
    assert got[3].template == got[4].template and got[3].verdict == "allow" and got[5].verdict == got[6].verdict == "allow"


# ---------------------------------------------------------------- 2 chat


PIECES = st.lists(st.sampled_from(["<", "s>", "</s>", "\\", "[INST]", "[/INST]", "[", "INST]", "<<SYS>>", "<|im_end|>", "|", "é", "\n", "x"]), max_size=14).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=5))
def test_escaping(turns):
    for role, text in turns:
        assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROL)
    whole = "".join("".join(chat.mark(r, t)) for r, t in turns)
    assert chat.read_turns(whole) == turns


def test_chat_examples(spark, sf):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", None), (1, 3, "assistant", "</s>[INST]"), (1, 4, "user", "tail"),
            (2, 0, None, "x"), (3, 0, "assistant", ""), (None, 1, "user", "q"), (None, None, "assistant", "r"), (1, 3, "assistant", "</s>[INST]")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit("clash"))
    got = chat.expand(df).orderBy("conv_id", "example").collect()
    one = [r for r in got if r.conv_id == 1]
    assert [chat.unescape(r.formatted[r.loss_start : r.loss_end]) for r in one] == ["b", "</s>[INST]", "</s>[INST]", ""]
    assert chat.read_turns(one[1].formatted) == [("user", "a"), ("assistant", "b"), ("user", ""), ("assistant", "</s>[INST]")]
    assert len(chat.read_turns(one[3].formatted)) == 6 and one[1].formatted.startswith(one[0].formatted)
    assert [r.loss_end - r.loss_start for r in got if r.conv_id in (2, 3)] == [0, 0]
    assert chat.read_turns([r for r in got if r.conv_id is None][-1].formatted) == [("assistant", "r"), ("user", "q")]
    assert chat.expand(df.limit(0)).count() == 0
    assert queries.op2_chat_examples(spark, sf).where("conv_id = -7").first().loss_chars == 21


# ---------------------------------------------------------------- 9 exact search


@pytest.mark.parametrize("block", [7, 64, 100_000])
def test_top_k(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(block)
    rows = [(i, [float(x) for x in rng.integers(-4, 5, 6)]) for i in range(-60, 140)]
    rows += [(500 + i, [1.0] * 6) for i in range(30)]  # ties and one vector many times
    rows += [(700, None), (None, [1.0] * 6), (701, [1.0, None] + [0.0] * 4), (702, [float("nan")] * 6), (703, [float("inf")] * 6), (704, []), (720, [2.0, 3.0]), (721, [1.0, 1.0]), (740, [9e6] * 6), (800, []), (0, [3.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("block", F.lit(0))
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 20 = 0"), k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in good:
        if q % 20 == 0 and v == min(w for i, w in good if i == q):  # a repeated query id asks with its smallest vector
            scores = sorted((-int(sum(a * b for a, b in zip(v, w))), i) for i, w in good if i != q and len(w) == len(v))[:20]
            assert got.get(q, []) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def test_quantise(spark):
    df = spark.createDataFrame([([0.5, -0.01, 0.0156],)], "v array<float>")
    assert df.select(topk.quantise(F.col("v"))).first()[0] == [32.0, -1.0, 0.0]


# ---------------------------------------------------------------- 10 fixity


def test_fixity(spark):
    rng = random.Random(1)
    rows = [(i // 40, i, bytes(rng.randrange(256) for _ in range(rng.randrange(5, 90)))) for i in range(200)]
    rows += [(2, 7, b"x"), (2, 7, b"x"), (9, None, b""), (9, None, None)]
    ddl = "file bigint, record_id bigint, content binary"
    a = spark.createDataFrame(rows, ddl).withColumn("digest", F.lit("clash"))
    clean = warc.audit(a, a, 200, 3)
    assert clean.count() == len(rows) and clean.where("status <> 'ok' or checked").count() == 0
    changed = [(f, i, c) for f, i, c in rows if i != 50]
    changed = [(f, i, b"!" + c[1:] if i == 13 else c + b"!" if i == 99 else c) for f, i, c in changed] + [(4, 1000, b"new")]
    got = warc.audit(a, spark.createDataFrame(changed, ddl), 200, 3)
    bad = {(r.record_id, r.status) for r in got.where("status in ('corrupt', 'missing', 'extra')").collect()}
    assert bad == {(50, "missing"), (13, "corrupt"), (99, "corrupt"), (1000, "extra")}
    assert 0 < got.where("checked").count() < len(rows)  # branches that agree are not descended
    assert got.where("status = 'moved' and file not in (1, 2)").count() == 0
    assert {r.status for r in warc.audit(a, a.limit(0), 200, 3).collect()} == {"missing"}
    assert warc.audit(a.limit(0), a.limit(0)).count() == 0


# ---------------------------------------------------------------- SQL and the pipeline


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf)
    result = con.execute(oracles.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(result.fetchall(), key=repr)


def test_pipeline(spark, sf, odd, none):
    import corpus_pipeline as p

    docs = common.table(spark, sf, "documents")
    assert [n for n, _ in p.STAGES] and p.run(spark, sf).columns == ["doc_id", "n_tokens", "ids"]
    for start in (docs, odd, none):
        now = start
        for name, stage in p.STAGES[:-1]:
            out = common.cut(stage(spark, now, sf))
            assert out.columns == start.columns
            if name != "mixing sources":
                assert out.count() <= now.count() and out.exceptAll(now).count() == 0
            now = out
        assert p.STAGES[-1][1](spark, now, sf).count() == now.count()
    # clean, distinct documents stay
    kept = {r.doc_id for r in p.drop_near_copies(spark, p.drop_toxic(spark, docs, sf), sf).select("doc_id").collect()}
    assert len(kept) > 0.6 * docs.select("text").distinct().count()
