"""Toxicity by character n-grams, a linear classifier on naive Bayes features.

A text's features are the distinct n-grams of its bytes (A-Z as a-z, white
space as one kind), hashed. Each feature's value is its naive Bayes log-count
ratio between the classes, and a logistic model over the most telling ones is
fitted to the labels (naive Bayes features, linear weights).

Fitting takes at most ``FIT_ROWS`` labelled rows, those whose id hashes lowest;
the rest of the corpus is only scored, over whole texts. Counts leave a task as
one row for each hash it saw, and the driver gets ``FEATURES`` of them.

Defined results: null and empty texts have no features and get the score of the
intercept; null labels are ignored; without labels of both classes every score
is the share of label 1 (0.5 if there are none); repeated rows score alike;
ties among features go to the smaller hash; input columns named like an output
column are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import held_out, text_chunks
from .rule_quality import training_rows

#: Labelled rows that a fit uses at most.
FIT_ROWS = 8192
BITS = 20
SIZES = (3, 4, 5, 6)
#: Features that the linear model weighs. A model over all 2^BITS slots was tried and was worse: see the README.
FEATURES = 2048
#: A feature must occur in so many labelled texts.
LEAST = 3
_CODE = np.random.RandomState(11).randint(1, 1 << 31, 256, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_CODE[65:91] = _CODE[97:123]
_CODE[[9, 10, 11, 12, 13]] = _CODE[32]


def grams(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, distinct and sorted, of texts laid end to end.

    ``wanted`` maps a hash to a feature or -1; without it the hash is the feature.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    ends = np.repeat(offsets[1:] - lo, np.diff(offsets)).astype(np.int64)
    code = _CODE[data[lo:hi]]
    found_at, found = [], []
    h = code
    for n in range(2, max(SIZES) + 1):
        if len(code) < n:
            break
        h = h[: len(code) - n + 1] * np.uint32(0x01000193) + code[n - 1 :]
        if n not in SIZES:
            continue
        x = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        x = (x ^ (x >> np.uint32(15))) >> np.uint32(32 - BITS) if BITS == 32 else ((x ^ (x >> np.uint32(15))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)
        if wanted is not None:
            f = wanted[x]
            at = np.flatnonzero(f >= 0)
            f = f[at].astype(np.int64)
        else:
            at, f = np.arange(len(x)), x.astype(np.int64)
        ok = at + n <= ends[at]  # an n-gram lies within one text
        found_at.append(at[ok])
        found.append(f[ok])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    text = np.searchsorted(offsets - lo, np.concatenate(found_at), side="right") - 1
    key = np.unique((text << BITS) | np.concatenate(found))
    return key >> BITS, key & ((1 << BITS) - 1)


def _counts(batches):
    import pyarrow as pa

    total = np.zeros((2, 1 << BITS), np.int32)
    seen = False
    for b in batches:
        label = b.column("label").to_numpy(zero_copy_only=False)
        for row, data, offsets in text_chunks(b.column("text")):
            t, f = grams(data, offsets)
            for c in (0, 1):
                total[c] += np.bincount(f[label[row + t] == c], minlength=1 << BITS).astype(np.int32)
            seen = True
    if seen:
        hit = np.flatnonzero(total.sum(0) >= 1)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[0, hit].astype(np.int64)), pa.array(total[1, hit].astype(np.int64))], names=["h", "n0", "n1"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, target: str = "toxic", limit: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """(hashes, weights, intercept) of the fitted model."""
    # the sample is small: a few tasks count it, so a hash leaves few tasks
    rows = training_rows(docs, labels, target, limit).select("label", "text").repartition(8)
    from ._shared import durable

    rows = durable(rows)
    sizes = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        p = min(max(n1 / (n0 + n1) if n0 + n1 else 0.5, 1e-4), 1 - 1e-4)
        return np.empty(0, np.int64), np.empty(0), float(np.log(p / (1 - p)))
    ratio = F.log((F.col("n1") + 1) / (n1 + 2)) - F.log((F.col("n0") + 1) / (n0 + 2))
    # telling: a strong ratio on many texts
    tell = F.abs(ratio) * F.sqrt(F.col("n1") * (n0 / n1) + F.col("n0"))
    counted = rows.coalesce(8).mapInArrow(_counts, "h long, n0 long, n1 long").groupBy("h").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    top = counted.where(F.col("n0") + F.col("n1") >= LEAST).select("h", ratio.alias("r"), tell.alias("tell")).orderBy(F.desc("tell"), "h").limit(FEATURES).collect()
    hashes = np.array([r[0] for r in top], np.int64)
    r = np.array([r[1] for r in top])
    table = np.full(1 << BITS, -1, np.int16)
    table[hashes] = np.arange(len(hashes))
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def present(batches):
        import pyarrow as pa

        for b in batches:
            label = b.column("label").to_numpy(zero_copy_only=False)
            for row, data, offsets in text_chunks(b.column("text")):
                t, f = grams(data, offsets, shared.value)
                edges = np.searchsorted(t, np.arange(len(offsets)))
                yield pa.RecordBatch.from_arrays([pa.array(label[row : row + len(offsets) - 1].astype(np.int32)), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(f.astype(np.int32)))], names=["label", "f"])

    got = sorted((list(x[1]), x[0]) for x in rows.mapInArrow(present, "label int, f array<int>").collect())
    a = np.zeros((len(got), len(hashes)), np.float32)
    for i, (f, _) in enumerate(got):
        a[i, f] = 1
    y = np.array([g[1] for g in got], np.float32)
    a *= r.astype(np.float32)
    w, b = _logistic(a, y)
    return hashes, w * r, b


def _logistic(a: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, float]:
    """Accelerated gradient on the mean log loss + ridge / 2 * |w|^2."""
    n = len(y)
    v = np.ones(a.shape[1], np.float32)
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v) + 1e-12
    lip = 0.25 * (float(np.linalg.norm(a @ v)) ** 2 / n * 1.1 + 1) + ridge
    w, b, z, zb, t = np.zeros(a.shape[1]), 0.0, np.zeros(a.shape[1]), 0.0, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(a @ z.astype(np.float32) + zb, -30, 30))) - y
        nw, nb = z - (a.T @ r / n + ridge * z) / lip, zb - r.mean() / lip
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb, t = nw + (t - 1) / s * (nw - w), nb + (t - 1) / s * (nb - b), s
        w, b = nw, nb
    return w, float(b)


def score_toxicity(docs: DataFrame, labels: DataFrame, target: str = "toxic", cut: float = 0.5, limit: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; score is the probability of label 1."""
    hashes, weights, intercept = fit_toxicity(docs, labels, target, limit)
    table = np.full(1 << BITS, -1, np.int16)
    table[hashes] = np.arange(len(hashes))
    shared = docs.sparkSession.sparkContext.broadcast((table, weights, intercept))

    def score(batches):
        import pyarrow as pa

        table, weights, intercept = shared.value
        for b in batches:
            out = np.zeros(len(b))
            for row, data, offsets in text_chunks(b.column("text")):
                t, f = grams(data, offsets, table)
                out[row : row + len(offsets) - 1] = np.bincount(t, weights[f] if len(f) else None, len(offsets) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(out + intercept, -500, 500))))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
