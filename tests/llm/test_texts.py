import numpy as np
import pytest

import graphloom.llm.decontaminate as dc
from graphloom.llm import queries
from graphloom.llm.html_extract import extract_main_text, main_text
from graphloom.llm.rule_quality import FEATURES, compile_rules, fit_rules, holds, score_quality, with_statistics
from graphloom.llm.toxicity import grams, score_toxicity


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])


@pytest.mark.parametrize("query,target,least", [("op9_quality", "quality", 0.97), ("op5_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, query, target, least):
    sf = "/root/testdata/sf0.1"
    rows = queries.QUERIES[query](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(rows) > 500 and rows["score"].between(0, 1).all()
    assert auc(rows[target].to_numpy(), rows["score"].to_numpy()) > least


LABELS = "doc_id long, quality int, toxic int"


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, 3.0), (2, "", 3.0), (2, "", 3.0), (3, "x" * 300_000, 3.0), (None, "a\nb", 3.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None, None), (3, 1, 0)], LABELS)
    for f in (score_quality, score_toxicity):
        for lab in (labels, labels.limit(0)):
            rows = f(docs, lab).collect()
            assert len(rows) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
            assert f(docs.limit(0), lab).count() == 0


def test_rules_compile_to_what_they_say(spark, sf):
    rng = np.random.RandomState(0)
    x = rng.rand(400, len(FEATURES))
    y = ((x[:, 3] > 0.5) & (x[:, 5] < 0.7)).astype(float)
    rules, b = fit_rules(x, y)
    p = 1 / (1 + np.exp(-(b + sum(w * holds(r, x) for r, w in rules))))
    assert ((p > 0.5) == (y == 1)).mean() > 0.97
    docs = with_statistics(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = docs.select("__stats.*", compile_rules(rules, b).alias("p")).toPandas()
    stats = rows[list(FEATURES)].to_numpy()
    assert np.isfinite(stats).all()
    assert np.allclose(rows["p"], 1 / (1 + np.exp(-(b + sum(w * holds(r, stats) for r, w in rules)))))


def test_grams_are_those_of_each_text_alone():
    texts = ["Hello\tworld", "", "hello world", "héé", "ab"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    t, f = grams(np.frombuffer(b"".join(raw), np.uint8), offsets)
    each = [set(grams(np.frombuffer(r, np.uint8), np.array([0, len(r)]))[1]) if r else set() for r in raw]
    assert [set(f[t == i]) for i in range(5)] == each
    assert each[0] == each[2] and not each[1] and not each[4]


def test_toxicity_scores_against_brute_force(spark, sf):
    import graphloom.llm.toxicity as tx

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    hashes, weights, b = tx.fit_toxicity(docs, labels)
    known = dict(zip(hashes.tolist(), weights.tolist()))
    code = [int(x) for x in tx._CODE]

    def slot(g):
        h = code[g[0]]
        for x in g[1:]:
            h = (h * 0x01000193 + code[x]) & 0xFFFFFFFF
        x = ((h ^ (len(g) * 0x9E3779B1 & 0xFFFFFFFF)) * 0x85EBCA6B) & 0xFFFFFFFF
        return (((x ^ (x >> 15)) * 0xC2B2AE35) & 0xFFFFFFFF) >> (32 - tx.BITS)

    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    got = {r["doc_id"]: r["score"] for r in queries.op5_toxicity(spark, sf).collect()}
    for d in sorted(texts)[:40]:
        t = texts[d]
        want = b + sum(known.get(s, 0.0) for s in {slot(t[i : i + n]) for n in tx.SIZES for i in range(len(t) - n + 1)})
        assert got[d] == pytest.approx(1 / (1 + np.exp(-want)), abs=1e-6)


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body>
<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></ul></nav>
<div class="cookie-notice">We use cookies, many of them, in all the places you could think of.</div>
<div id="content"><article><h1>Title &amp; more</h1><p>First   paragraph, with <b>bold</b> text, and commas,
over lines.<p>Second one is unclosed, long enough to be scored as a paragraph.<div class="ad-slot">Buy now, buy here, buy it all today, and more!</div>
<section><h2>Part</h2><p>Short.</p></section><script>var x = "<p>no</p>";</script><ul><li>item one<li>item two</ul></article>
<section class="comments"><p>A reader says, at length, that all of this is wrong, and so on and so forth.</p></section></div>
<aside>Sidebar text that is long enough, with commas, to look like something.</aside>
<form><input><p>Subscribe to our letter, please, it is good, and free of charge.</p></form><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE).split("\n") == [
        "Title & more", "First paragraph, with bold text, and commas, over lines.", "Second one is unclosed, long enough to be scored as a paragraph.",
        "Part", "Short.", "item one", "item two",
    ]
    div = "<body><div class=menu><a href=x>a</a></div><div><div><p>" + "Some words, and more of them. " * 5 + "</p><p>tail</p></div><div class='sidebar'><p>side, bar, text, long enough to count</p></div></div></body>"
    assert main_text(div).split("\n") == ["Some words, and more of them. " * 4 + "Some words, and more of them.", "tail"]
    assert main_text(None) == main_text("") == main_text("<p></p>") == ""
    assert main_text("just text &lt;b&gt;") == "just text <b>"
    assert main_text("<article><p>cut off &amp") == "cut off &"
    assert len(main_text("<p>" + "<b>" * 20_000 + "deep" + "x, " * 100_000)) > 200_000


P = "A paragraph of the article, long enough to be scored, with commas, and more."
Q = "Another paragraph, which is just as long as the first, and has commas, too."
C = "A reader says, at length, that all of this is wrong, and so on, and so forth. " * 6
LABELLED = {
    "related work is content": (f"<article><p>{P}</p><p class='related-work'>{Q}</p></article>", [P, Q]),
    "a share price is content": (f"<article><p>{P}</p><div id='share-price'>{Q}</div></article>", [P, Q]),
    "an advert within an article": (f"<article><p>{P}</p><div class='ad'>Buy now, buy it here, and buy it all today!</div><p>{Q}</p></article>", [P, Q]),
    "an advert with a layout word": (f"<article><p>{P}</p><div class='ad-box 3'>Buy now, buy it here, and buy it all today!</div></article>", [P]),
    "a layout class around everything": (f"<div class='content has-sidebar'><div><p>{P}</p><p>{Q}</p></div></div>", [P, Q]),
    "a fixed header's page": (f"<div id='page' class='header-fixed'><article><p>{P}</p></article></div>", [P]),
    "a navigation layout": (f"<div class='layout with-nav'><div><p>{P}</p><p>{Q}</p></div></div>", [P, Q]),
    "an article's header": (f"<article><div class='article-header'><h1>Title</h1></div><p>{P}</p></article>", ["Title", P]),
    "a header element in an article": (f"<header>Site</header><article><header><h1>Title</h1></header><p>{P}</p></article>", ["Title", P]),
    "a site header": (f"<div class='site-header'>The site, its name, its motto, and a long line of text.</div><article><p>{P}</p></article>", [P]),
    "two articles in main": (f"<main><h1>Title</h1><p>{Q}</p><article><p>{P}</p></article><article><p>{P}</p><p>{Q}</p></article></main>", ["Title", Q, P, P, Q]),
    "comments longer than the article": (f"<article><p>{P}</p><p>{Q}</p></article><section id='comments'><p>{C}</p><p>{C}</p></section>", [P, Q]),
    "comments that are articles": (f"<main><article><p>{P}</p><p>{Q}</p></article><section class='comment-list'><article class='comment'><p>{C}</p></article></section></main>", [P, Q]),
    "no article element": (f"<div id='nav'><a href=x>a</a></div><div><div><h2>Part</h2><p>{P}</p><p>{Q}</p></div></div><div class='footer'>{Q}</div>", ["Part", P, Q]),
    "related links": (f"<article><p>{P}</p><div class='related-stories'><a href=x>One story, and one more</a> <a href=y>Two</a></div></article>", [P]),
    "a notice": (f"<article><div class='cookie-notice'>We use cookies, many of them, in all places.</div><p>{P}</p></article>", [P]),
    "only furniture names": (f"<div class='sidebar'><p>{P}</p><p>{Q}</p></div>", [P, Q]),
    "hidden text": (f"<article><p>{P}</p><p hidden>{Q}</p><p style='display: none'>{Q}</p><div aria-hidden=true>{Q}</div></article>", [P]),
    "roles": (f"<div role=banner>{Q}</div><article><p>{P}</p><div role=search>{Q}</div></article>", [P]),
    "forms, asides and scripts": (f"<article><p>{P}</p><form><p>{Q}</p></form><aside>{Q}</aside><script>x</script><style>y</style></article>", [P]),
    "lists and tables": (f"<article><p>{P}</p><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table></article>", [P, "one", "two", "a", "b", "c"]),
    "references and white space": (f"<article><p>{P}</p><p>a &amp;\n\t b&nbsp;c</p></article>", [P, "a & b c"]),
    "siblings of the best container": (f"<div><div><p>{P}</p><p>{Q}</p></div><h2>Next</h2><p>Short one</p><p><a href=x>links only</a></p></div>", [P, Q, "Next", "Short one"]),
}


@pytest.mark.parametrize("name", LABELLED)
def test_labelled_pages(name):
    page, blocks = LABELLED[name]
    assert main_text(f"<html><body>{page}</body></html>").split("\n") == blocks


def test_depth_and_stray_tags_take_linear_time():
    import time

    def took(page):
        t = time.perf_counter()
        main_text(page)
        return time.perf_counter() - t

    for make in (lambda n: "<div>" * n + "x" * 40, lambda n: "<span>" * n + "<div></div>" * n, lambda n: "<span>" * n + "</b>" * n, lambda n: "<div>text, long enough to be scored" * n, lambda n: "<dl><dd><dl>" + "<span>" * n + "<dt></dt>" * n):
        small = min(took(make(8_000)) for _ in range(2))
        assert took(make(64_000)) < 24 * small + 1


def test_extraction_query(spark, sf):
    rows = queries.op7_html_extraction(spark, sf).collect()
    pages = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()}
    assert len(rows) == len(pages) and all(r["n_chars"] == len(r["text"]) and "<" not in r["text"] for r in rows)
    assert all(r["text"] == main_text(pages[r["page_id"]]) for r in rows)
    df = spark.createDataFrame([(1, None, None, "t"), (1, None, None, "t")], "page_id long, url string, html string, text string")
    assert [tuple(r) for r in extract_main_text(df).collect()] == [(1, None, "")] * 2
    assert extract_main_text(df.limit(0)).count() == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_bit_parallel_lcs():
    rng = np.random.RandomState(1)
    for _ in range(200):
        a, b = rng.randint(0, 6, rng.randint(1, 90)).tolist(), rng.randint(0, 6, rng.randint(0, 90)).tolist()
        masks = {}
        for k, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << k
        assert dc._lcs(masks, len(a), b) == lcs(a, b)


def made(seed=0):
    rng = np.random.RandomState(seed)
    vocab = [f"word{i}" for i in range(3000)]
    zipf = 1 / np.arange(1, 3001)
    draw = lambda n: list(rng.choice(vocab, n, p=zipf / zipf.sum()))
    items = [(i, draw(int(rng.randint(6, 160)))) for i in range(60)]
    docs, truth = [], set()
    for d in range(400):
        words = draw(int(rng.randint(5, 400)))
        if d % 8 == 0:
            i, w = items[rng.randint(60)]
            w = list(w)
            if d % 16 == 0 and len(w) >= 20:  # a paraphrase: a fifth of the words replaced
                for k in rng.choice(len(w), len(w) // 5, replace=False):
                    w[k] = "other"
            at = rng.randint(len(words) + 1)
            words[at:at] = w
            truth.add((d, i))
        docs.append((d, " ".join(words).upper() if d % 5 == 0 else ", ".join(words)))
    return docs, [(i, " ".join(w)) for i, w in items], truth


def test_leaks_and_paraphrases_are_found(spark):
    docs, items, truth = made()
    got = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert truth <= got
    # whatever else is reported has the words in order
    for d, i in got - truth:
        a, b = dict(items)[i].lower().split(), dict(docs)[d].lower().replace(",", "").split()
        assert lcs(a, b) >= 0.6 * len(a)


@pytest.mark.parametrize("share", [0, 0.2, 0.3, 0.4])
def test_recall_against_all_pairs(spark, share):
    """All pairs with a long enough common subsequence in a stretch of twice the item's length; replaced words are the benchmark's own."""
    rng = np.random.RandomState(7)
    vocab, zipf = [f"word{i}" for i in range(20_000)], 1 / np.arange(1, 20_001)
    draw = lambda n: list(rng.choice(vocab, n, p=zipf / zipf.sum()))
    items = [(i, draw(int(rng.randint(8, 160)))) for i in range(150)]
    other = [x for _, w in items for x in w]
    docs = []
    for d in range(150):
        new = list(items[d][1])
        for k in rng.choice(len(new), int(len(new) * share), replace=False):
            new[k] = other[rng.randint(len(other))]
        words = draw(int(rng.randint(30, 400)))
        at = rng.randint(len(words) + 1)
        docs.append((d, words[:at] + new + words[at:]))
    want, allowed = set(), set()
    for i, w in items:
        n, masks = len(w), {}
        for k, x in enumerate(w):
            masks[x] = masks.get(x, 0) | 1 << k
        for d, t in docs:
            if dc._lcs(masks, n, t) >= 0.6 * n:
                allowed.add((d, i))
                if any(dc._lcs(masks, n, t[s : s + 2 * n]) >= 0.6 * n for s in range(0, len(t), max(1, n // 4))):
                    want.add((d, i))
    assert len(want) >= 140
    table = spark.createDataFrame([(i, " ".join(w), " ".join(w)) for i, w in items], "item_id long, text string, answer string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string"), table).collect()}
    assert len(want & got) >= 0.9 * len(want) and got <= allowed


def test_items_of_very_many_words(spark):
    words = [f"w{i}" for i in range(66_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:30_000])), (3, "w65999 " * 100), (4, "nothing of it")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[-50:]))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["overlap"] for r in dc.find_leaks(docs, items).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 1.0}


def test_leak_query_and_clashing_columns(spark, sf):
    want = {tuple(r) for r in queries.op8_decontamination(spark, sf).select("doc_id", "item_id").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "1 AS item_id", "2 AS terms", "3 AS overlap", "4 AS __leak0")
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr("*", "1 AS doc_id", "2 AS overlap")
    assert {tuple(r) for r in dc.find_leaks(docs, benchmark).select("doc_id", "item_id").collect()} == want
    # every item that a text holds word for word is found
    import re

    flat = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    texts = {r["doc_id"]: flat(r["text"]) for r in docs.collect()}
    assert {(d, r["item_id"]) for r in benchmark.collect() for d, t in texts.items() if flat(r["text"]) in t} <= want
    kept = {r[0] for r in dc.drop_leaks(docs, benchmark).select("doc_id").collect()}
    assert kept == set(texts) - {d for d, _ in want}


def test_leak_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "alpha beta gamma"), (3, "alpha beta gamma"), (None, "alpha beta gamma"), (4, "x " * 100_000 + "Alpha, beta; GAMMA")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma", "gamma"), (1, "alpha beta gamma", None), (2, None, None), (3, "...", None), (4, "alpha beta delta", None)], "item_id long, text string, answer string")
    got = sorted(((r["doc_id"] or 0), r["item_id"]) for r in dc.find_leaks(docs, items).collect())
    assert got == [(0, 1), (3, 1), (4, 1)]
    assert dc.find_leaks(docs, items.limit(0)).count() == 0 and dc.find_leaks(docs.limit(0), items).count() == 0
    assert sorted(r["doc_id"] for r in dc.drop_leaks(docs, items).collect()) == [1, 2]


def test_benchmark_blocks(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_WORDS", 1500)
    docs, items, truth = made(1)
    got = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert truth <= got


@pytest.mark.parametrize("share", [0.3, 0.4])
def test_paraphrases_among_many_items_are_found(spark, share):
    rng = np.random.RandomState(5)
    vocab, zipf = [f"word{i}" for i in range(20_000)], 1 / np.arange(1, 20_001)
    draw = lambda n: list(rng.choice(vocab, n, p=zipf / zipf.sum()))
    items = [(i, draw(int(rng.randint(16, 64)))) for i in range(1200)]
    other = [x for _, w in items for x in w]
    docs, truth = [], set()
    for d in range(800):
        words = draw(int(rng.randint(30, 300)))
        if d % 2 == 0:
            i, old = items[rng.randint(len(items))]
            new = list(old)
            for k in rng.choice(len(new), int(len(new) * share), replace=False):
                new[k] = other[rng.randint(len(other))]
            at = rng.randint(len(words) + 1)
            words[at:at] = new
            truth.add((d, i))
        docs.append((d, " ".join(words)))
    # every word counts as the answer, so that only the search can lose a pair
    table = spark.createDataFrame([(i, " ".join(w), " ".join(w)) for i, w in items], "item_id long, text string, answer string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), table).collect()}
    assert truth <= got


@pytest.mark.parametrize("n", [8, 64, 65, 80, 95, 96, 130, 159, 300])
def test_passages_hold_every_word_of_an_item(n):
    words = np.arange(n, dtype=np.uint64)
    items = dc._Items([1], [words], [None], words, np.ones(n), np.eye(n))
    held = sum((z > 0).sum(1) for _, z, _ in items.classes.values())
    assert held.tolist() == [1] * n
