"""Helpers shared by the operators: tables, durable cut points, text hashing."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where driver and tasks are one process (master ``local`` or
    ``local[n]``) an unset folder is replaced by a private one; on a cluster
    each executor would write to a disk of its own, so the job fails instead.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="graphloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def durable(df: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder.

    Later stages read the table instead of recomputing ``df``, also when
    executors are lost, and non-deterministic plans become fixed rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/graphloom/{uuid.uuid4().hex}"
    for made in _MADE:
        made.append(path)
    df.write.parquet(path, compression="zstd" if not keep_bytes else "none")
    return spark.read.schema(df.schema).parquet(path)


_MADE: list[list[str]] = []


@contextlib.contextmanager
def tables_made() -> Iterator[list[str]]:
    """The paths that :func:`durable` writes within the block, for :func:`drop_tables`."""
    made: list[str] = []
    _MADE.append(made)
    try:
        yield made
    finally:
        _MADE[:] = [m for m in _MADE if m is not made]


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables that no later plan reads."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which keeps partitions and their order."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Groups that may be too large for a task; fewer groups than this hold more than 1 / BUSY of all rows each.
BUSY = 1 << 14


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner equi-join of rows with one row for each group, without gathering a large group in one task.

    ``size`` is a column of ``groups``: the rows that a group has, or more.
    Sizes sum up to ``total`` at most, so fewer than ``BUSY`` groups exceed
    total / BUSY; these are broadcast and meet their rows where they lie. The
    other groups are shuffled, total / BUSY rows at most each; rows already met
    go along under scattered keys, so that every row moves once. The first key
    is a long, a string or binary; ``groups`` has no columns of ``rows`` but the keys.
    """
    bound = total // BUSY
    more = [c for c in groups.columns if c not in keys]
    large = groups.where(F.col(size) > bound).select(*(F.col(c).alias(f"__large_{c}") for c in groups.columns))
    other = groups.where(F.col(size) <= bound).select(*(F.col(c).alias(f"__other_{c}") for c in groups.columns))
    same = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"__large_{k}") for k in keys))
    met = F.col(f"__large_{size}").isNotNull()
    # a met row keeps its first partner, so whatever its scattered key meets can't change or repeat it
    kinds = dict(rows.dtypes)
    apart = F.xxhash64(F.spark_partition_id(), *(F.col(c) for c in rows.columns if not re.search(r"\b(map<|variant)", kinds[c])))
    apart = apart if kinds[keys[0]] == "bigint" else apart.cast("string").cast(kinds[keys[0]])
    marked = rows.join(F.broadcast(large), same, "left").withColumn("__at", F.when(met, apart).otherwise(F.col(keys[0])))
    same = reduce(lambda a, b: a & b, (F.col("__at" if k == keys[0] else k) == F.col(f"__other_{k}") for k in keys))
    found = marked.join(other, same, "left").where(met | F.col(f"__other_{size}").isNotNull())
    return found.select(*rows.columns, *(F.when(met, F.col(f"__large_{c}")).otherwise(F.col(f"__other_{c}")).alias(c) for c in more))


def held_out(doc_id="doc_id"):
    """Rows that no model may learn from: crc32 of the id's text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def number_rows(df: DataFrame, group: str, order: list[str], out: str, partitions: int | None = None) -> DataFrame:
    """Rank from 0 within ``group`` by ``order`` without gathering a group in one task.

    Rows are range-partitioned on group and order, so a hot group spreads over
    many tasks; each task numbers what it holds and adds the sizes of the runs
    before it. The runs are one row for each partition and group in it (about
    partitions + groups rows, never a row of data), which the driver turns into
    offsets.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = checkpointed(df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order).withColumn("__part", F.spark_partition_id()))
    runs = laid.groupBy("__part", group).agg(F.count(F.lit(1)).alias("__n")).collect()
    at: dict[int, int] = {}
    offsets: dict[tuple[int, int], int] = {}
    for part, key, size in sorted((r[0], r[1], r[2]) for r in runs):
        offsets[part, key] = at.get(key, 0)
        at[key] = at.get(key, 0) + size
    kept = spark.sparkContext.broadcast(offsets)

    def ranked(batches):
        import pyarrow as pa

        seen: dict[tuple[int, int], int] = {}
        for b in batches:
            part = b.column("__part").to_numpy(zero_copy_only=False)
            keys = b.column(group).to_numpy(zero_copy_only=False)
            rank = np.empty(len(keys), np.int64)
            edges = np.flatnonzero((keys[1:] != keys[:-1]) | (part[1:] != part[:-1])) + 1
            for s, e in zip([0, *edges], [*edges, len(keys)]):
                if s == e:
                    continue
                k = int(part[s]), int(keys[s])
                first = seen.get(k, kept.value[k])
                rank[s:e] = np.arange(first, first + e - s)
                seen[k] = first + e - s
            cols = [c for c in b.schema.names if c != "__part"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(rank)], names=[*cols, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.schema if f.name != "__part")
    return laid.mapInArrow(ranked, f"{schema}, `{out}` long")


# --- words as 64-bit numbers ------------------------------------------------

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_LUT = np.random.RandomState(7).randint(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_LUT[65:91] = _LUT[97:123]  # A-Z are read as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            up = np.full(n, _P, np.uint64)
            up[0] = 1
            down = np.full(n, _PINV, np.uint64)
            down[0] = 1
            _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hashed_words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash every word of several texts at once.

    ``data`` holds the texts' UTF-8 bytes end to end, ``offsets`` their n + 1
    bounds; words are runs of bytes outside ``space``, read with A-Z as a-z.
    Returns the words' hashes and, for each text, where its words begin (n + 1
    bounds into the hashes). Equal words get equal numbers in every task.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    data, offsets = data[lo:hi], (offsets - lo).astype(np.int64)
    n = hi - lo
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    ws = space[data]
    before = np.empty(n, bool)
    before[1:] = ws[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(~ws & before)
    after = np.empty(n, bool)
    after[:-1] = ws[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(~ws & after) + 1
    up, down = _powers(n)
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_LUT[data] * up[:n], out=total[1:])
        words = mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return words, np.searchsorted(starts, offsets).astype(np.int64)


def text_chunks(column, limit: int = 1 << 20):
    """Cut an Arrow string column into runs of about ``limit`` bytes, whole texts each.

    Yields (first row, bytes, offsets); nulls are empty texts. A text longer
    than the limit is a run of its own. Binary columns are cut alike.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    if len(column) == 0:
        return
    if not pa.types.is_binary(column.type):
        column = column.cast(pa.large_string())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        end = min(end, len(column))
        yield row, data, offsets[row : end + 1]
        row = end
