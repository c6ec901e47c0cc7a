"""Contiguous minimax sharding of documents whose equal texts stay together.

Groups of equal texts are ordered by the hash of their text. The largest shard
is made as small as any contiguous cut allows: the smallest feasible capacity
is found by binary search, a greedy pass over the ordered group sizes checks
each guess, and the cuts are then placed as evenly as that capacity allows.

The driver never sees a row for each group. It holds sums over cells of the
hash range, at most ``CELLS`` at a level, and descends only into the cells where
a cut can fall, so a cut is placed exactly with a few thousand numbers
at any input size.

Defined results: a null text has size 1 and the CRC of empty bytes and groups
with other null and empty texts; repeated rows each get a slot; an empty table
gives an empty result; clashing input columns are ignored because only the id
and the text are read. A single group larger than an even share fills a shard
of its own (a group is never divided); its rows are still handled by many tasks.
"""

from __future__ import annotations

import bisect
import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import durable, number_rows

#: Cells of the hash range that one level of the search sums up.
CELLS = 1 << 14
#: Groups near the cuts that are listed one by one; while there are more, they are summed in finer cells.
LISTED = 1 << 16


def greedy(sizes: list[int], capacity: int, shards: int) -> list[int] | None:
    """Where each next shard begins (shards - 1 indexes), or None if ``capacity`` is too small."""
    total = [0]
    for s in sizes:
        total.append(total[-1] + s)
    cuts, at = [], 0
    for _ in range(shards):
        at = bisect.bisect_right(total, total[at] + capacity) - 1
        cuts.append(at)
    return cuts[:-1] if at == len(sizes) else None


def even_cuts(sizes: list[int], capacity: int, shards: int) -> list[int]:
    """Cuts as near to even shares as a feasible ``capacity`` allows."""
    total = [0]
    for s in sizes:
        total.append(total[-1] + s)
    latest, at = [], len(sizes)
    for _ in range(shards - 1):  # the shards to the right must still suffice
        at = bisect.bisect_left(total, total[at] - capacity)
        latest.append(at)
    cuts, at = [], 0
    for k, least in enumerate(reversed(latest), 1):
        ideal = k * total[-1] / shards
        i = bisect.bisect_left(total, ideal)
        if i and ideal - total[i - 1] < total[min(i, len(sizes))] - ideal:
            i -= 1
        at = max(at, min(max(i, least), bisect.bisect_right(total, total[at] + capacity) - 1))
        cuts.append(at)
    return cuts


def minimax(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest capacity for which ``shards`` contiguous runs suffice, and the cuts."""
    low, high = max([-(-sum(sizes) // shards), *sizes], default=0), max(sum(sizes), 0)
    while low < high:
        mid = (low + high) // 2
        if greedy(sizes, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low, greedy(sizes, low, shards) or [len(sizes)] * (shards - 1)


def _cells(groups: DataFrame, spans: list[tuple[int, int]], most: int | None = None) -> list[tuple[int, int, int, int]]:
    """(first key, last key, size, groups) for each non-empty cell of the given key spans."""
    out = []
    widths = [-(-(hi - lo + 1) // max(1, (most or CELLS) // len(spans))) for lo, hi in spans]
    span = F.lit(None).cast("int")
    cell = F.lit(None).cast("long")
    for i, ((lo, hi), w) in enumerate(zip(spans, widths)):
        inside = F.col("key").between(F.lit(lo), F.lit(hi))
        span = F.when(inside, F.lit(i)).otherwise(span)
        # keys lie within 63 bits, so the difference cannot overflow
        cell = F.when(inside, F.expr(f"(key - {lo}L) div {w}L")).otherwise(cell)
    rows = groups.select(span.alias("span"), cell.alias("cell"), "size").where("span IS NOT NULL").groupBy("span", "cell").agg(F.sum("size"), F.count(F.lit(1))).collect()
    for s, c, size, n in rows:
        lo, hi = spans[s]
        out.append((lo + c * widths[s], min(hi, lo + (c + 1) * widths[s] - 1), size, n))
    return sorted(out)


def _bounds(cells: list[tuple[int, int, int, int]], low: int, high: int, shards: int) -> list[tuple[int, int]]:
    """For each cut, the least and greatest position it can have for a capacity from low to high.

    Boundaries of cells are a subset of those of groups, so a greedy pass over
    whole cells never runs ahead of the true one; a pass that may stop anywhere
    inside a cell of several groups never falls behind it.
    """
    total = [0]
    for c in cells:
        total.append(total[-1] + c[2])
    least, most, out = 0, 0, []
    for _ in range(shards - 1):
        least = total[bisect.bisect_right(total, least + low) - 1]
        most = min(total[-1], most + high)
        i = bisect.bisect_right(total, most) - 1
        if i < len(cells) and cells[i][3] == 1:
            most = total[i]
        out.append((least, most))
    return out


def cut_keys(groups: DataFrame, shards: int) -> list[int]:
    """First key of shards 1, 2, ... for ``groups`` (key: distinct, 0 to 2^63 - 1; size > 0)."""
    cells = _cells(groups, [(0, (1 << 63) - 1)])
    most, before = CELLS, None
    while cells:
        # a cell that is much of a share may hold one heavy group, which must be known to stand alone
        share = sum(c[2] for c in cells) / shards
        heavy = [c for c in cells if c[3] > 1 and c[2] * 4 > share]
        if heavy and len(cells) > 1:
            cells = sorted([c for c in cells if c[3] == 1 or c[2] * 4 <= share] + _cells(groups, [c[:2] for c in heavy]))
            continue
        sizes = [c[2] for c in cells]
        high, _ = minimax(sizes, shards)
        low = max([-(-sum(sizes) // shards), *(c[2] for c in cells if c[3] == 1)])
        total = [0]
        for s in sizes:
            total.append(total[-1] + s)
        hit = set()
        for a, b in _bounds(cells, low, high, shards):
            i, j = bisect.bisect_right(total, a) - 1, bisect.bisect_left(total, b)
            hit.update(k for k in range(i, j) if k < len(cells))
        runs: list[list[int]] = []
        for k in sorted(hit):
            if runs and k == runs[-1][1] + 1:
                runs[-1][1] = k
            else:
                runs.append([k, k])
        runs = [r for r in runs if any(cells[k][3] > 1 for k in range(r[0], r[1] + 1))]
        if not runs:
            break
        inside = {k for a, b in runs for k in range(a, b + 1)}
        spans = [(cells[a][0], cells[b][1]) for a, b in runs]
        near = sum(cells[k][3] for k in inside)
        if before is not None and near > 0.7 * before:
            most *= 2  # the cells were too coarse to come closer
        before = near
        if near <= LISTED:
            here = functools.reduce(lambda x, y: x | y, (F.col("key").between(F.lit(lo), F.lit(hi)) for lo, hi in spans))
            finer = [(r[0], r[0], r[1], 1) for r in groups.where(here).select("key", "size").collect()]
        else:
            finer = _cells(groups, spans, most)
        cells = sorted([c for k, c in enumerate(cells) if k not in inside] + finer)
    sizes = [c[2] for c in cells]
    cuts = even_cuts(sizes, minimax(sizes, shards)[0], shards)
    return [cells[i][0] if i < len(cells) else (1 << 63) - 1 for i in cuts]


def shard_documents(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, key, shard, slot) for every row of ``docs``."""
    raw = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    rows = durable(docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(raw), 1).alias("key"),
    ))
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"))
    cuts = cut_keys(durable(groups), shards)
    # a shard is a function of the key alone, so no row moves to learn it
    placed = rows.withColumn("shard", sum((F.when(F.col("key") >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)).cast("int"))
    return number_rows(placed, "shard", ["key", "doc_id"], "slot")
