import numpy as np
import pytest

import graphloom.llm.topk_search as tk
from graphloom.llm import queries
from graphloom.llm.url_filter import filter_urls


def brute_topk(rows, k=10):
    vs = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for qi, q in vs:
        if qi % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, c)), ci) for ci, c in vs if ci != qi)[:k]
            out += [(qi, r + 1, ci, -x) for r, (x, ci) in enumerate(s)]
    return sorted(out)


def test_topk_query(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(tuple(r) for r in queries.op10_topk_search(spark, sf).collect()) == brute_topk(rows)


@pytest.mark.parametrize("block", [3, 2048])
def test_topk_ties_nulls_and_lengths(spark, monkeypatch, block):
    monkeypatch.setattr(tk, "QUERY_BLOCK", block)
    rng = np.random.RandomState(0)
    rows = [(i, [float(x) for x in rng.randint(-2, 3, 6)]) for i in range(900)]
    rows += [(1000, None), (1100, [1.0, None]), (1200, [float("nan")] * 6), (1300, [float("inf")] * 6), (1400, []), (1500, [1.0, -1.0]), (1600, [0.0] * 6), (7, [1.0] * 6)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    assert sorted(tuple(r) for r in tk.exact_topk(df).collect()) == brute_topk(rows)


def test_topk_small_tables(spark):
    df = spark.createDataFrame([(100, [1.0, 2.0]), (1, [1.0, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in tk.exact_topk(df).collect()] == [(100, 1, 1, 1024 * 1024 + 2048 * 512)]
    assert tk.exact_topk(df.limit(0)).collect() == []
    with pytest.raises(Exception, match="2\\^26"):
        tk.exact_topk(spark.createDataFrame([(100, [1e30])], "vec_id long, embedding array<double>")).collect()


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def judge(url):
    if url is None or "://" not in url:
        host, path = "", ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut], rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fit, default=(0, None, "allow"))
    return host, path, rule, verdict


def test_url_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y#z", "https://example.com/en/", "https://example.com/en", "https://notexample.com/en/",
        "https://a.example.com/en/1", "https://a.www.example.com/en/1", "ftp://x.net/es/?q", "ftp://x.net#/es/", "http://x.net/fr/" + "y" * 50_000, "http://ÄÖ.net/es/", "http://a?b://c.net/es/", "x\ny://q.net/es/", "http://..net/es/",
    ]
    rows = list(enumerate(urls + urls[:3]))
    df = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(df, rules).collect()}
    assert got == {i: judge(u) for i, u in rows}
    assert filter_urls(df.limit(0), rules).count() == 0
    none = filter_urls(df, rules.limit(0), default="block").collect()
    assert len(none) == len(rows) and {(r["rule"], r["verdict"]) for r in none} == {(None, "block")}


def test_many_rules_are_joined_without_a_broadcast(spark, monkeypatch):
    import graphloom.llm.url_filter as uf

    monkeypatch.setattr(uf, "ROW_RULES", 0)
    urls = ["https://a.example.com/en/1", "http://x.net/es/", None, "", "http://com/", "http://com/", "http://com/", "nowhere"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    for most in (1, 100):
        monkeypatch.setattr(uf, "BROADCAST_RULES", most)
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(df, rules).collect()}
        assert got == {i: judge(u) for i, u in enumerate(urls)}
