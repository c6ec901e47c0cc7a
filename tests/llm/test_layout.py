import random
import zlib

import pytest

import graphloom.llm.sharding as sh
from graphloom.llm import queries
from graphloom.llm.packing import encoder, pack, pack_documents, plan_best_fit, vocabulary


def test_minimax_is_the_smallest_capacity():
    rng = random.Random(1)
    for _ in range(50):
        sizes = [rng.randint(1, 50) for _ in range(rng.randint(1, 30))]
        k = rng.randint(1, 6)
        c, _ = sh.minimax(sizes, k)
        assert sh.greedy(sizes, c, k) is not None and sh.greedy(sizes, c - 1, k) is None
        b = [0, *sh.even_cuts(sizes, c, k), len(sizes)]
        assert b == sorted(b) and max(sum(sizes[x:y]) for x, y in zip(b, b[1:])) <= c


@pytest.mark.parametrize("cells,listed,heavy", [(1 << 14, 1 << 16, False), (512, 100, False), (512, 100, True)])
def test_cuts_found_in_cells_are_optimal(spark, monkeypatch, cells, listed, heavy):
    monkeypatch.setattr(sh, "CELLS", cells)
    monkeypatch.setattr(sh, "LISTED", listed)
    rng = random.Random(2)
    rows = sorted((rng.getrandbits(63), rng.randint(1, 3000)) for _ in range(2500))
    if heavy:
        rows[800] = (rows[800][0], 1_500_000)
    keys = sh.cut_keys(spark.createDataFrame(rows, "key long, size long"), 16)
    sizes = [r[1] for r in rows]
    b = [0, *(sum(r[0] < k for r in rows) for k in keys), len(rows)]
    assert max(sum(sizes[x:y]) for x, y in zip(b, b[1:])) == sh.minimax(sizes, 16)[0]


def check_shards(rows, docs):
    assert sorted(r["doc_id"] for r in rows) == sorted(d for d, _ in docs)
    texts = {}
    for r in rows:
        t = dict(docs)[r["doc_id"]]
        raw = (t or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and 0 <= r["shard"] < 16
        texts.setdefault(t or "", set()).add(r["shard"])
    assert all(len(s) == 1 for s in texts.values())
    for s in range(16):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_sharding_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op4_sharding(spark, sf).collect()
    check_shards(rows, docs)
    load = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(16)]
    assert max(load) <= sum(load) / 16 + max(r["size"] for r in rows)


def test_sharding_edges(spark):
    docs = [(i, t) for i, t in enumerate([None, "", "a", "a", "é日", "x" * 300_000] + ["copy"] * 200)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, shard int, size int")
    rows = sh.shard_documents(df).collect()
    check_shards(rows, docs)
    assert sh.shard_documents(df.limit(0)).count() == 0


def test_best_fit_plan():
    rng = random.Random(3)
    for _ in range(60):
        cap = rng.choice([7, 20, 64])
        counts = {rng.randint(1, cap): rng.randint(1, 40) for _ in range(rng.randint(1, 12))}
        runs, bins = plan_best_fit(counts, cap)
        fill = {}
        ranks = {}
        for length, rank, n, first, offset in runs:
            ranks.setdefault(length, []).extend(range(rank, rank + n))
            for b in range(first, first + n):
                fill.setdefault(b, []).append((offset, length))
        assert {k: len(v) for k, v in ranks.items()} == counts and all(sorted(v) == list(range(len(v))) for v in ranks.values())
        for parts in fill.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= cap
        # the same as best fit decreasing, one item at a time
        room = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fit = [r for r in room if r >= length]
                if fit:
                    room.remove(min(fit))
                    room.append(min(fit) - length)
                else:
                    room.append(cap - length)
        assert bins == len(room) == len(fill)


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    encode = encoder(vocabulary())
    rng = random.Random(5)
    texts = ["", " ", "Hello  world\n\n\tx", "<|endoftext|>", "in<|endoftext|>side", "<|endoftext|><|endoftext|>", "<|endoftext|> x <|endoftext|>", "<|endoftext", "é日本\u2003𝒳 don't I'LL", "a" * 3000, "1234567 89,-!!"]
    texts += ["".join(rng.choice("ab C\n\t .,'!1é日ß\u00a0") for _ in range(200)) for _ in range(50)]
    for x in texts:
        assert list(encode(x)) == t.encode(x, add_special_tokens=False).ids


def test_added_tokens_are_those_of_the_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    texts = ["x <|endoftext|> y", "<|endoftext|>", "<|endoftext|><|endoftext|>\n a", "a<|endoftext |>", "plain"]
    got = {r["doc_id"]: r["ids"] for r in pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True).collect()}
    assert got == {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in enumerate(texts)}



def test_packing_query_and_round_trip(spark, sf):
    docs = {r[0]: r[1] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    encode = encoder(vocabulary())
    want = {d: [*map(int, encode(t)), 0] for d, t in docs.items()}
    rows = pack_documents(spark.read.parquet(f"{sf}/documents.parquet"), with_ids=True).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["piece"]):
        assert r["start"] == len(got.setdefault(r["doc_id"], [])) and r["length"] == len(r["ids"]) <= 2048 and (r["piece"] == 0 or r["length"] == 2048)
        got[r["doc_id"]] += r["ids"]
    assert got == want
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert len(seqs) <= -(-sum(r["length"] for r in rows) // 2048) * 1.02 + 1
    digests = {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in queries.op6_packing(spark, sf).collect()}
    import numpy as np

    assert digests == {(r["doc_id"], r["piece"]): zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows}


def test_packing_edges(spark):
    df = spark.createDataFrame([(1, None, 5), (1, None, 5), (2, "", 5), (None, "a", 5), (3, "word " * 9000, 5)], "doc_id long, text string, length int")
    rows = pack_documents(df).collect()
    assert sorted((r["doc_id"] or 0, r["piece"], r["length"]) for r in rows)[:4] == [(0, 0, 2), (1, 0, 1), (1, 0, 1), (2, 0, 1)]
    assert sum(r["length"] for r in rows if r["doc_id"] == 3) > 9000
    assert pack_documents(df.limit(0)).count() == 0
    one = spark.createDataFrame([(i, 0, 7) for i in range(1000)], "doc_id long, piece int, length long")  # a single hot length
    placed = pack(one, 20).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in placed}) == 1000 and len({r["sequence_id"] for r in placed}) == 500
    clash = pack(one.selectExpr("*", "'x' AS sequence_id", "'y' AS offset", "'z' AS __rank"), 20)
    assert clash.columns == ["doc_id", "piece", "length", "sequence_id", "offset"] and len({(r["sequence_id"], r["offset"]) for r in clash.collect()}) == 1000
