"""Benchmark leaks in documents, found by latent semantic retrieval.

1. Passages of all documents, as TF-IDF vectors over the benchmark's words, give
   by one pass of a randomised SVD (a Nystrom sketch of the Gram matrix: tasks
   send sums of a words x SKETCH matrix) a latent space. The benchmark's own
   passages weigh as much as the corpus's, so that the space can tell them apart.
2. Windows of each document, in four lengths and about a quarter of their length
   apart, are compared by cosine with the benchmark passages of their length.
3. Around a candidate window, the longest common subsequence of words must
   cover ``LCS`` of the item, and ``ANSWER`` of the item's answer (the column of
   that name, or else the item's most telling words) must be in it. So
   reordered, inserted or replaced words are tolerated, common words are not enough.

Words are runs of letters and digits in lower case. The benchmark is a
stated query set: it is taken in blocks of ``BLOCK_WORDS`` words, which bounds
what the driver holds and broadcasts; each block is searched in all rows.

Defined results: null and empty texts match nothing, and so do items without
words; items shorter than ``SHORT`` words must occur whole, and so long as they
are, items of any number of words and distinct words are searched; repeated rows,
items and matches within a text give one row for each pair of distinct ids; ties
go to the first window; an empty benchmark or table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import durable, hashed_words, text_chunks

#: Share of an item's words, in order, that a document must have.
LCS = 0.6
#: Share of the answer's words among them.
ANSWER = 0.5
#: Cosine from which a window is a candidate: LCS times what the window farthest from a passage holds of it (7/8 from
#: 16 words on), less the scatter of RANK coordinates; lower still for passages shorter than their window, which holds other words too, or longer, which it holds in part.
COSINE = 0.45
RANK, SKETCH = 64, 80
#: Words of a passage in the statistics; window lengths; words of a block of a window.
PASSAGE, WINDOWS, UNIT = 32, (8, 16, 32, 64), 4
SHORT = 8
#: Words of the benchmark handled at a time, answers included.
BLOCK_WORDS = 200_000
#: Words that an item counts for at least, which bounds the items of a block; classes of an item's filter of words.
ITEM_WORDS, FILTER = 32, 2048
#: Words of items multiplied at a time on the driver.
OWN_WORDS = 50_000
#: Words whose sums travel together, 4 x ROWS x SKETCH bytes.
ROWS = 16
#: Words of a block that are frequent enough to be summed as a dense matrix.
DENSE = 512
#: Texts up to which documents are dropped by a broadcast join (16 bytes each), and by a shuffle beyond.
BROADCAST_IDS = 2_000_000

_GAPS = np.array([not (chr(i).isalnum() or i >= 128) for i in range(256)])


def _words(texts: list[str | None]) -> list[np.ndarray]:
    import pyarrow as pa

    out = []
    for _, data, offsets in text_chunks(pa.array(texts, pa.string())):
        w, bounds = hashed_words(data, offsets, _GAPS)
        out += [w[s:e] for s, e in zip(bounds[:-1], bounds[1:])]
    return out


def _terms(vocabulary: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Index of each word in the sorted vocabulary, or its size for words outside."""
    at = np.searchsorted(vocabulary, words)
    at[at == len(vocabulary)] = 0
    return np.where(vocabulary[at] == words, at, len(vocabulary))


class _Lookup:
    """:func:`_terms` by a table over the words' leading bits; words of shared slots are searched."""

    BITS = 20

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        slot = (vocabulary >> np.uint64(64 - self.BITS)).astype(np.int64)
        self.table = np.full(1 << self.BITS, -1, np.int32)
        self.table[slot] = np.arange(len(vocabulary))
        used, n = np.unique(slot, return_counts=True)
        self.table[used[n > 1]] = -2

    def __call__(self, words: np.ndarray) -> np.ndarray:
        v = len(self.vocabulary)
        at = self.table[(words >> np.uint64(64 - self.BITS)).astype(np.int64)]
        out = np.where(self.vocabulary[np.maximum(at, 0)] == words, np.maximum(at, 0), v)
        shared = np.flatnonzero(at == -2)
        out[shared] = _terms(self.vocabulary, words[shared])
        return out


def _encoded(vocabulary):
    """Each text's words as indexes into the vocabulary, four bytes each."""

    def run(batches):
        import pyarrow as pa

        look = _Lookup(vocabulary.value)
        for b in batches:
            for row, data, offsets in text_chunks(b.column("text")):
                words, bounds = hashed_words(data, offsets, _GAPS)
                terms = look(words).astype(np.uint32)
                n = len(offsets) - 1
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds * 4), pa.py_buffer(terms)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(row, n), column], names=["doc_id", "terms"])

    return run


def _term_chunks(column, limit: int = 1 << 19):
    for row, data, offsets in text_chunks(column, limit):
        yield row, data[int(offsets[0]) : int(offsets[-1])].copy().view(np.uint32).astype(np.int64), (offsets - offsets[0]) // 4


def _layout(terms: np.ndarray, bounds: np.ndarray, length: int, v: int, pad: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows x length terms, rows of each text, first row of each text): texts cut into runs, filled up with ``v``."""
    size = np.diff(bounds)
    runs = -(-size // length)
    base = np.cumsum(runs + pad) - (runs + pad)
    grid = np.full((int((runs + pad).sum()), length), v, np.int64)
    grid.ravel()[np.arange(len(terms)) + np.repeat(base * length - bounds[:-1], size)] = terms
    return grid, runs, base


def _frequencies(v: int):
    def run(batches):
        import pyarrow as pa

        df = np.zeros(v + 1, np.int64)
        for b in batches:
            for _, terms, bounds in _term_chunks(b.column("terms")):
                grid, _, _ = _layout(terms, bounds, PASSAGE, v)
                if not len(grid):
                    continue
                grid.sort(axis=1)
                new = np.ones(grid.shape, bool)
                new[:, 1:] = grid[:, 1:] != grid[:, :-1]
                n = np.bincount(grid[new], minlength=v + 1)
                n[v] = len(grid)
                df += n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "n"])

    return run


def _gram(idf: np.ndarray, omega: np.ndarray):
    v = len(idf)
    weighted = np.vstack([idf[:, None] * omega, np.zeros((1, omega.shape[1]))]).astype(np.float32)
    frequent = np.argsort(idf, kind="stable")[:DENSE]
    dense = np.full(v + 1, -1)
    dense[frequent] = np.arange(len(frequent))

    def run(batches):
        import pyarrow as pa

        total = np.zeros((-(-(v + 1) // ROWS) * ROWS, SKETCH))
        for b in batches:
            for _, terms, bounds in _term_chunks(b.column("terms")):
                grid, _, _ = _layout(terms, bounds, PASSAGE, v)
                if not len(grid):
                    continue
                y = weighted[grid[:, 0]]  # A * omega
                for k in range(1, PASSAGE):
                    y += weighted[grid[:, k]]
                # A^T * (A * omega): frequent words as a matrix product, others one by one
                d = dense[grid]
                r, c = np.nonzero(d >= 0)
                a = np.bincount(r * len(frequent) + d[r, c], minlength=len(grid) * len(frequent)).reshape(len(grid), len(frequent)).astype(np.float32)
                total[frequent] += a.T @ y
                r, c = np.nonzero((d < 0) & (grid < v))
                t = grid[r, c]
                order = np.argsort(t, kind="stable")
                ts = t[order]
                edge = np.flatnonzero(np.concatenate(([True], ts[1:] != ts[:-1]))) if len(ts) else np.empty(0, np.int64)
                if len(edge):
                    total[ts[edge]] += np.add.reduceat(y[r[order]], edge, axis=0)
        total[:v] *= idf[:, None]
        rows = total.astype(np.float32).reshape(-1, ROWS * SKETCH)
        at = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([rows[i].tobytes() for i in at], pa.binary())], names=["part", "sums"])

    return run


def _summed(batches):
    import pyarrow as pa

    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, x in zip(b.column("part").to_pylist(), b.column("sums")):
            x = np.frombuffer(x.as_buffer(), np.float32).astype(np.float64)
            total[k] = total[k] + x if k in total else x
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "sums"])


def latent_space(coded: DataFrame, vocabulary: np.ndarray, items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(idf, map from words to RANK whitened latent coordinates, idf included)."""
    v = len(vocabulary)
    df = np.zeros(v + 1)
    for t, n in coded.select("terms").mapInArrow(_frequencies(v), "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        df[t] = n
    idf = np.log((df[v] + 1) / (df[:v] + 1)) + 1e-3
    omega = np.linalg.qr(np.random.RandomState(17).normal(size=(v, min(v, SKETCH))))[0]
    omega = np.pad(omega, ((0, 0), (0, SKETCH - omega.shape[1])))
    parts = coded.select("terms").mapInArrow(_gram(idf, omega), "part long, sums binary").repartition("part").mapInArrow(_summed, "part long, sums binary").collect()
    b = np.zeros((-(-(v + 1) // ROWS) * ROWS, SKETCH))
    for k, x in parts:
        b[k * ROWS : (k + 1) * ROWS] = np.frombuffer(x, np.float64).reshape(ROWS, SKETCH)
    b = b[:v]
    spread = np.trace(omega.T @ b) * v / min(v, SKETCH)  # about the corpus's share of the trace
    gram, norm = _own_gram([_terms(vocabulary, w) for w in items], idf, omega)
    b += (spread or 1.0) / norm * gram
    # Gram ~ b (omega^T b)^-1 b^T: its eigenvectors are the right singular vectors
    c = omega.T @ b
    val, vec = np.linalg.eigh((c + c.T) / 2)
    good = val > max(val.max(), 0) * 1e-9 if len(val) else np.zeros(0, bool)
    if not good.any():
        return idf, (idf[:, None] * np.eye(v, RANK))
    u, s, _ = np.linalg.svd(b @ (vec[:, good] / np.sqrt(val[good])), full_matrices=False)
    u, s = u[:, :RANK], s[:RANK]
    return idf, idf[:, None] * u / np.maximum(s, s[0] * 1e-6)


def _own_gram(items: list[np.ndarray], idf: np.ndarray, omega: np.ndarray) -> tuple[np.ndarray, float]:
    """(X^T X omega, |X|^2) for the items' TF-IDF rows X, of which only the words that occur are held."""
    v = len(idf)
    out, norm = np.zeros(omega.shape), 0.0
    at = 0
    while at < len(items):
        end, words = at, 0
        while end < len(items) and (words < OWN_WORDS or end == at):
            words += len(items[end])
            end += 1
        key, n = np.unique(np.concatenate([t + k * v for k, t in enumerate(items[at:end])]), return_counts=True)
        row, term = key // v, key % v
        x = n * idf[term]
        norm += float(x @ x)
        edge = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        y = np.repeat(np.add.reduceat(x[:, None] * omega[term], edge, axis=0), np.diff([*edge, len(row)]), axis=0)
        order = np.argsort(term, kind="stable")
        ts = term[order]
        edge = np.flatnonzero(np.concatenate(([True], ts[1:] != ts[:-1])))
        out[ts[edge]] += np.add.reduceat((x[:, None] * y)[order], edge, axis=0)
        at = end
    return out, norm


def _lcs(masks: dict[int, int], length: int, region: list[int]) -> int:
    """Length of the longest common subsequence, with one bit for each word of the item."""
    full = (1 << length) - 1
    row = full
    for t in region:
        m = masks.get(t)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return length - row.bit_count()


class _Items:
    """The benchmark block as the search needs it."""

    def __init__(self, ids, words, answers, vocabulary, idf, turn):
        self.ids, self.vocabulary = ids, vocabulary
        self.turn = np.vstack([turn, np.zeros((1, turn.shape[1]))]).astype(np.float32)
        self.terms = [_terms(vocabulary, w) for w in words]
        self.sizes = np.array([len(t) for t in self.terms])
        # which of FILTER classes of words an item has; words outside the vocabulary are in a class that none has
        self.may = np.zeros((len(words), FILTER + 1), bool)
        for i, t in enumerate(self.terms):
            self.may[i, t % FILTER] = True
        self.masks, self.answer = [], []
        classes: dict[int, tuple[list, list, list]] = {w: ([], [], []) for w in WINDOWS}
        for i, t in enumerate(self.terms):
            masks: dict[int, int] = {}
            for k, x in enumerate(t.tolist()):
                masks[x] = masks.get(x, 0) | 1 << k
            self.masks.append(masks)
            if answers[i] is not None and len(answers[i]):
                self.answer.append(frozenset(_terms(vocabulary, answers[i]).tolist()))
            else:  # the most telling quarter of its words
                distinct = np.unique(t)
                self.answer.append(frozenset(distinct[np.argsort(-idf[distinct], kind="stable")[: max(1, len(distinct) // 4)]].tolist()))
            # even pieces hold every word once: some piece keeps the share of its words that the item keeps
            step = max(WINDOWS)
            for part in np.array_split(t, -(-len(t) // step)):
                w = next((w for w in WINDOWS if len(part) <= 1.25 * w), step)
                z = self.turn[part].sum(0)
                classes[w][0].append(i)
                classes[w][1].append(z / (np.linalg.norm(z) + 1e-12))
                classes[w][2].append(COSINE * min(w / len(part), len(part) / w) ** 0.5)
        self.classes = {w: (np.array(i), np.array(z, np.float32).T, np.array(c, np.float32)) for w, (i, z, c) in classes.items() if i}


def _enough(items: _Items, classes, bounds, text, item, start, w) -> np.ndarray:
    """Whether the text around each window may have words of the item in sufficient number, in whatever order."""
    n = items.sizes[item]
    before = np.minimum(n, 2 * max(WINDOWS))
    lo = np.maximum(bounds[text], bounds[text] + start - before)
    hi = np.minimum(bounds[text + 1], bounds[text] + start + w + before)
    at = lo[:, None] + np.arange(int((hi - lo).max()))
    shared = items.may[item[:, None], classes[np.minimum(at, len(classes) - 1)]] & (at < hi[:, None])
    return (shared.sum(1) >= np.where(n < SHORT, n, LCS * n)) | (n > before)


def _search(shared):
    pad = max(WINDOWS) // UNIT

    def run(batches):
        import pyarrow as pa

        items: _Items = shared.value
        v = len(items.vocabulary)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for row0, terms, bounds in _term_chunks(b.column("terms")):
                if not len(terms):
                    continue
                # sums over units of a few words; empty units after each text keep windows within it
                grid, units, base = _layout(terms, bounds, UNIT, v, pad)
                s = items.turn[grid[:, 0]]
                for k in range(1, UNIT):
                    s += items.turn[grid[:, k]]
                total = len(grid)
                text_of = np.repeat(np.arange(len(units)), units)
                inside = np.arange(len(text_of)) - np.repeat(np.cumsum(units) - units, units)
                slot = np.repeat(base, units) + inside
                width, hits = UNIT, []
                for w in WINDOWS:
                    while width < w:
                        h = width // UNIT
                        s[: total - h] += s[h:].copy()
                        width *= 2
                    if w not in items.classes:
                        continue
                    which, z, cut = items.classes[w]
                    at = np.flatnonzero(inside % (w // 4 // UNIT or 1) == 0)
                    for k in range(0, len(at), 8192):
                        rows = at[k : k + 8192]
                        x = s[slot[rows]]
                        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
                        cos = x @ z
                        r, c = np.nonzero(cos > norm[:, None] * cut)
                        hits.append((text_of[rows[r]], which[c], inside[rows[r]] * UNIT, cos[r, c] / np.maximum(norm[r], 1e-12), np.full(len(r), w)))
                if not hits:
                    continue
                t, i, start, cos, w = (np.concatenate(x) for x in zip(*hits))
                maybe = np.ones(len(t), bool)
                classes = np.where(terms < v, terms % FILTER, FILTER)
                for k in range(0, len(t), 8192):
                    maybe[k : k + 8192] = _enough(items, classes, bounds, *(x[k : k + 8192] for x in (t, i, start, w)))
                t, i, start, cos, w = (x[maybe] for x in (t, i, start, cos, w))
                order = np.lexsort((start, -cos, i, t))
                done, tried = None, set()
                ids = b.column("doc_id")
                for k in order.tolist():
                    pair = int(t[k]), int(i[k])
                    if pair == done:
                        continue
                    item = items.terms[pair[1]]
                    n = len(item)
                    lo = bounds[pair[0]] + max(0, int(start[k]) - n)
                    hi = min(bounds[pair[0] + 1], bounds[pair[0]] + int(start[k]) + int(w[k]) + n)
                    if (pair, lo, hi) in tried:  # windows of a long item often have one surrounding
                        continue
                    tried.add((pair, lo, hi))
                    region = terms[lo:hi].tolist()
                    have = set(region)
                    masks = items.masks[pair[1]]
                    need = n if n < SHORT else LCS * n
                    if sum(m.bit_count() for x, m in masks.items() if x in have) < need:
                        continue
                    answer = items.answer[pair[1]]
                    if len(answer & have) < ANSWER * len(answer):
                        continue
                    got = _lcs(masks, n, region)
                    if got >= need:
                        done = pair
                        for col, x in zip(out, (ids[row0 + pair[0]].as_py(), int(items.ids[pair[1]]), got / n, float(cos[k]), int(start[k]))):
                            col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], b.schema.field("doc_id").type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.float64()), pa.array(out[4], pa.int64())], names=["doc_id", "item_id", "overlap", "cosine", "near_word"])

    return run


def _blocks(benchmark: DataFrame):
    """Distinct items with words, in order, in blocks of at most BLOCK_WORDS words (one item at least)."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.select(F.col("item_id").cast("long"), F.lower(F.col("text").cast("string")).alias("text"), F.lower(answer).alias("answer")).where("item_id IS NOT NULL AND text IS NOT NULL")
    block, size = [], 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        w = _words([r[1]])[0]
        if not len(w):
            continue
        answer = _words([r[2]])[0] if r[2] else None
        n = max(ITEM_WORDS, len(w) + (0 if answer is None else len(answer)))
        if size + n > BLOCK_WORDS and block:
            yield block
            block, size = [], 0
        block.append((r[0], w, answer))
        size += n
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, overlap, cosine, near_word) for every document and item that match."""
    return _matches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark)


def _matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The same for documents known by a ``doc_id`` of any type."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.lower(F.col("text").cast("string")).alias("text"))
    schema = f"doc_id {kind}, item_id long, overlap double, cosine double, near_word long"
    found = None
    for block in _blocks(benchmark):
        vocabulary = np.unique(np.concatenate([x for _, w, a in block for x in (w, a) if x is not None]))
        coded = durable(docs.mapInArrow(_encoded(spark.sparkContext.broadcast(vocabulary)), f"doc_id {kind}, terms binary"))
        idf, turn = latent_space(coded, vocabulary, [x[1] for x in block])
        items = _Items(np.array([x[0] for x in block]), [x[1] for x in block], [x[2] for x in block], vocabulary, idf, turn)
        part = coded.mapInArrow(_search(spark.sparkContext.broadcast(items)), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema)
    best = F.max(F.struct("overlap", "cosine", (-F.col("near_word")).alias("back"))).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.overlap", "b.cosine", (-F.col("b.back")).alias("near_word"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item. A row is known by its text's digest, so ids may be null or repeated."""
    digest = F.unhex(F.md5(F.col("text").cast("string")))
    leaks = durable(_matches(docs.select(digest.alias("doc_id"), "text").where("text IS NOT NULL"), benchmark).select(F.col("doc_id").alias("__leak")).distinct())
    if leaks.count() <= BROADCAST_IDS:
        leaks = F.broadcast(leaks)
    return docs.join(leaks, digest == F.col("__leak"), "left_anti")
