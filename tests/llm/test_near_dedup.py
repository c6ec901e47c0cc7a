import re
from collections import Counter, defaultdict

import pytest

import graphloom.llm.near_dedup as nd
from graphloom.llm import queries
from graphloom.llm.components import connected_components

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
    if len(w) >= 5:
        return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    return frozenset([tuple(w)]) if w else frozenset()


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in sets.items():
        common = Counter(j for x in s for j in where[x] if j < i)
        for j, k in common.items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def made_documents():
    import random

    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    docs = [(0, " ".join(base)), (1, " ".join(base).upper()), (2, "one two"), (3, "ONE  two"), (4, ""), (5, None), (6, " \t\n"), (7, "one"), (8, "one two three four five")]
    text = list(base)
    for i in range(40):  # a chain: neighbours are close, the ends are not
        text[rng.randrange(120)] = rng.choice(words)
        docs.append((10 + i, " ".join(text)))
    shared = " ".join(rng.choice(words) for _ in range(30))
    docs += [(100 + i, shared + " " + " ".join(rng.choice(words) for _ in range(40))) for i in range(30)]
    docs.append((200, "long " * 50_000))
    return docs


def test_query_against_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert result(queries.op2_near_dedup(spark, sf)) == brute(docs)


def test_chain_and_edges(spark):
    docs = made_documents()
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, component_id string, kept string")
    assert result(nd.near_duplicates(df)) == brute(docs)


def test_complete_search_alone_finds_every_link(spark, monkeypatch):
    """Without the stars, and with cells and groups of a few rows, the second search finds all."""
    docs = made_documents()
    allowed = nd._allowed
    monkeypatch.setattr(nd, "_allowed", lambda flips: allowed(-1))
    monkeypatch.setattr(nd, "CELL", 4)
    monkeypatch.setattr(nd, "SMALL", 3)
    assert result(nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


@pytest.mark.parametrize("crowd", [5, 2048])
def test_crowds_are_compared_on_full_sets(spark, monkeypatch, crowd):
    docs = made_documents()
    allowed = nd._allowed
    monkeypatch.setattr(nd, "_allowed", lambda flips: allowed(-1))
    monkeypatch.setattr(nd, "SMALL", 2)
    monkeypatch.setattr(nd, "CROWDED", 0)
    monkeypatch.setattr(nd, "CROWD", crowd)
    assert result(nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "x")], "doc_id long, text string")
    rows = sorted(((r["doc_id"] or -1), r["component_id"], r["kept"]) for r in nd.near_duplicates(df).collect())
    assert rows == [(-1, None, False), (1, 1, True), (1, 1, True), (2, 2, True)]
    assert nd.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (5, 4), (9, 9)], [(i, i + 1) for i in range(60)], []])
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}
    for a, b in edges:
        if a != b:
            up.setdefault(a, a), up.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            if a != b:
                m = min(up[a], up[b])
                up[a] = up[b] = m
    assert got == up
