"""Exact top-k inner-product search over integer vectors.

Candidates are laid out by descending length. Vectors are rotated by the
eigenvectors of the candidates' Gram matrix (the right singular vectors), so a
few leading coordinates carry most of an inner product; for the rest,
Cauchy-Schwarz bounds what it can add. A candidate is dropped for a query only
if that bound, widened by the rounding error, lies below the query's k-th best
score so far; survivors are scored exactly with integers. Tasks start from the
k-th best score among the longest vectors, and stop at the first block whose
lengths alone rule out every query.

Queries are taken in blocks of ``QUERY_BLOCK``, so what is broadcast has a fixed
size; every block meets every candidate block. Each task returns at most k rows
for each query, merged by partial top-k aggregation.

Defined results: vectors that are null or hold a null, NaN or infinite
component take no part, neither as query nor as candidate; vectors of unequal
length are compared over the common prefix (as if padded with zeros); a vector
never meets rows with its own id; scores tie towards the smaller id; fewer than
k candidates give fewer rows; rows repeated with an id are separate candidates.
Components must stay under 2^26 in size once scaled, or the job fails.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import checkpointed

#: Queries that one broadcast holds: 2048 x 64 x 8 bytes is 1 MB.
QUERY_BLOCK = 2048
#: Longest candidates that give every query its first bound.
SEEDS = 4096
#: Candidates that a task scores at a time.
ROWS = 2048


def _usable(rows: DataFrame, vec: str) -> DataFrame:
    v = F.col(vec)
    return rows.where(v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False)))


def _matrix(arrays, width: int) -> np.ndarray:
    """Rows of an Arrow list column as exact floats, padded with zeros."""
    flat = arrays.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(arrays.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    if len(flat):
        out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Eigenvectors of the sum of x x^T, by descending eigenvalue; a task sends one width x width matrix."""

    def gram(batches):
        import pyarrow as pa

        g = np.zeros((width, width))
        for b in batches:
            m = _matrix(b.column("v"), width)
            g += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(width), width)), pa.array(np.tile(np.arange(width), width)), pa.array(g.ravel())], names=["i", "j", "g"])

    g = np.zeros((width, width))
    for i, j, x in vectors.select("v").mapInArrow(gram, "i long, j long, g double").groupBy("i", "j").agg(F.sum("g")).collect():
        g[i, j] = x
    return np.linalg.eigh((g + g.T) / 2)[1][:, ::-1].copy()


def exact_topk(vectors: DataFrame, k: int = 10, scale: int = 1024, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates among all other rows.

    Queries are the rows whose id is a multiple of ``every``.
    """
    spark = vectors.sparkSession
    scaled = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale))
    base = _usable(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias(vec_col)).where("vec_id IS NOT NULL"), vec_col)
    base = base.select("vec_id", scaled.alias("v")).withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the id spreads equal lengths over tasks
    laid = checkpointed(base.repartitionByRange(n, F.col("norm2").desc(), "vec_id").sortWithinPartitions(F.col("norm2").desc(), "vec_id"))
    width, largest, count = laid.agg(F.max(F.size("v")), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))), F.count(F.lit(1))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not count or not width:
        width = max(width or 0, 1)
    largest = largest or 0
    if largest >= 1 << 26 or largest * largest * width >= 1 << 62:
        raise ValueError(f"scaled components reach {largest}; an exact 64-bit score needs less than 2^26")
    whole = largest * largest * width < 1 << 53  # then float64 products are exact
    turn = rotation(laid, width)
    energy = np.zeros(width)
    seeds = laid.orderBy(F.col("norm2").desc(), "vec_id").limit(SEEDS).select("vec_id", "v").collect()
    seed_ids = np.array([r[0] for r in seeds], np.int64)
    seed_m = np.zeros((len(seeds), width))
    for i, r in enumerate(seeds):
        seed_m[i, : len(r[1])] = r[1]
    energy = ((seed_m @ turn) ** 2).sum(0)
    lead = int(np.searchsorted(np.cumsum(energy), 0.7 * energy.sum()) + 1) if energy.sum() else 1
    lead = max(1, min(width, lead))

    def exact(q, c):
        return np.rint(q @ c.T).astype(np.int64) if whole else q.astype(np.int64) @ c.T.astype(np.int64)

    asked = laid.where(F.col("vec_id") % every == 0).select("vec_id", "v").orderBy("vec_id")
    total = asked.count()
    parts = []
    local = asked.toLocalIterator()  # one partition of queries at a time
    for start in range(0, total, QUERY_BLOCK):
        rows = [r for _, r in zip(range(min(QUERY_BLOCK, total - start)), local)]
        q_ids = np.array([r[0] for r in rows], np.int64)
        q = np.zeros((len(rows), width))
        for i, r in enumerate(rows):
            q[i, : len(r[1])] = r[1]
        floor = np.full(len(rows), np.iinfo(np.int64).min, np.int64)
        if len(seed_ids) > k:
            s = exact(q, seed_m)
            for i in range(len(rows)):
                own = s[i][seed_ids != q_ids[i]]
                if len(own) >= k:
                    floor[i] = np.partition(own, len(own) - k)[len(own) - k]
        parts.append(laid.mapInArrow(_searcher(spark.sparkContext.broadcast((q_ids, q, floor)), turn, lead, width, k, exact), "query_id long, vec_id long, score long"))
    if not parts:
        return spark.createDataFrame([], schema)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    # each task kept its own k best, so a query gathers k rows from each task at most
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("pos", "b")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.down")).alias("score")
    )


def _searcher(shared, turn: np.ndarray, lead: int, width: int, k: int, exact):
    def search(batches):
        import pyarrow as pa

        q_ids, q, floor = shared.value
        floor = floor.copy()
        turned = q @ turn
        q_len = np.sqrt((q * q).sum(1))
        q_rest = np.sqrt((turned[:, lead:] ** 2).sum(1))
        head_q = turned[:, :lead]
        best_s = [np.empty(0, np.int64) for _ in q_ids]
        best_i = [np.empty(0, np.int64) for _ in q_ids]
        done = False
        for b in batches:
            for at in range(0, len(b), ROWS):
                if done:
                    break
                part = b.slice(at, ROWS)
                ids = part.column("vec_id").to_numpy(zero_copy_only=False)
                lens = np.sqrt(part.column("norm2").to_numpy(zero_copy_only=False))
                slack = 1e-9 * (q_len * lens[0] + 1) + 1e-6
                live = np.flatnonzero(q_len * lens[0] + slack >= floor)
                if not len(live):
                    done = True  # lengths only fall from here on
                    break
                c = _matrix(part.column("v"), width)
                t = c @ turn
                rest = np.sqrt((t[:, lead:] ** 2).sum(1))
                bound = head_q[live] @ t[:, :lead].T + q_rest[live][:, None] * rest[None, :] + slack[live][:, None]
                keep = bound >= floor[live][:, None]
                keep &= q_ids[live][:, None] != ids[None, :]
                rows = np.flatnonzero(keep.any(1))
                cols = np.flatnonzero(keep.any(0))
                if not len(cols):
                    continue
                scores = exact(q[live[rows]], c[cols])
                for r, s in zip(rows, scores):
                    i = live[r]
                    ok = keep[r, cols]
                    ss, ii = np.concatenate([best_s[i], s[ok]]), np.concatenate([best_i[i], ids[cols][ok]])
                    o = _best(ss, ii, k)
                    best_s[i], best_i[i] = ss[o], ii[o]
                    if len(o) == k:
                        floor[i] = max(floor[i], best_s[i][-1])
        sizes = [len(s) for s in best_s]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, sizes)), pa.array(np.concatenate(best_i)), pa.array(np.concatenate(best_s))], names=["query_id", "vec_id", "score"])

    return search
