"""Best-fit packing of tokenized documents into fixed-length training sequences.

The plan is made over lengths, not documents: the driver gets the histogram of
piece lengths (at most one number for each length up to the sequence length),
runs best-fit decreasing over counts, and gets runs of equal slots. Pieces are
then ranked within their length without gathering a length in one task, and the
rank picks the slot.

Defined results: a null or empty text is one piece, the end token; only
documents longer than a sequence are cut, into full pieces after a first one
that may be shorter; repeated rows are packed as separate documents; an empty
table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import durable, number_rows

CAPACITY = 2048
END = 0
#: Fixed value: the pre-tokenizer pattern that belongs to the 50k byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODERS: dict[str, object] = {}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str):
    """A function text -> ids as the plain call of the tokenizer file gives them, made once in a process.

    A ``.tiktoken`` file beside a byte-level ``.json`` file of the same name
    holds the same vocabulary as ranks; with the added tokens that the ``.json``
    file lists it gives the same ids several times as fast.
    """
    import os

    if path not in _ENCODERS:
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            import json

            import tiktoken

            with open(path, encoding="utf-8") as f:
                special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens=special).encode_to_numpy
            _ENCODERS[path] = lambda text: encode(text, allowed_special=set(special), disallowed_special=())
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            _ENCODERS[path] = lambda text: np.array(t.encode(text, add_special_tokens=False).ids, np.uint32)
    return _ENCODERS[path]


def plan_best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over a histogram.

    Returns runs (length, first rank, bins, first bin, offset), where the items
    of that length ranked from ``first rank`` on go one each to ``bins``
    consecutive bins at ``offset``; and the number of bins.
    """
    # open bins as runs (room, first bin, bins), smallest room first
    free: list[tuple[int, int, int]] = []
    runs, bins = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect_left(free, (length, -1, -1))
            if i < len(free):
                room, first, n = free.pop(i)
            else:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            each = room // length
            # best fit fills a bin as far as it goes before the next one
            full = min(n, left // each)
            if full:
                for j in range(each):
                    runs.append((length, rank + j * full, full, first, capacity - room + j * length))
                rank, left = rank + each * full, left - each * full
                if room - each * length:
                    insort(free, (room - each * length, first, full))
            if full < n:
                if left and left < each:
                    for j in range(left):
                        runs.append((length, rank + j, 1, first + full, capacity - room + j * length))
                    insort(free, (room - left * length, first + full, 1))
                    rank, left, full = rank + left, 0, full + 1
                if full < n:
                    insort(free, (room, first + full, n - full))
    return runs, bins


def tokenize(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) for every piece of every document."""

    def pieces(batches):
        import pyarrow as pa

        encode = encoder(path)
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                out: list[list] = [[], [], [], [], [], []]
                for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.append(np.asarray(encode(t or ""), "<u4"), np.uint32(END)).astype("<u4")
                    first = (len(ids) - 1) % capacity + 1
                    for p, e in enumerate(range(first, len(ids) + 1, capacity)):
                        s = 0 if p == 0 else e - capacity
                        for col, x in zip(out, (d, p, s, e - s, zlib.crc32(ids[s:e].tobytes()), ids[s:e] if with_ids else None)):
                            col.append(x)
                cols = [pa.array(out[0], b.schema.field(0).type), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:5])]
                if with_ids:
                    cols.append(pa.array([x.astype(np.int32) for x in out[5]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (any columns, of which ``doc_id``, ``piece`` and ``length`` are read).

    Columns that are named like the added ones (or ``__rank``, ``__part``) are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset", "__rank", "__part")
    spark = pieces.sparkSession
    histogram = pieces.groupBy("length").count().collect()  # one row for each length up to the capacity
    runs, _ = plan_best_fit({r[0]: r[1] for r in histogram}, capacity)
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 5)
    # position of a rank among all ranks, to look up both keys at once
    sizes = np.zeros(capacity + 2, np.int64)
    for r in histogram:
        sizes[r[0] + 1] = r[1]
    base = np.cumsum(sizes)
    shared = spark.sparkContext.broadcast((table, base, base[table[:, 0]] + table[:, 1] if len(table) else np.empty(0, np.int64)))
    ranked = number_rows(pieces, "length", ["doc_id", "piece"], "__rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def place(batches):
        import pyarrow as pa

        plan, base, at = shared.value
        for b in batches:
            spot = base[b.column("length").to_numpy(zero_copy_only=False)] + b.column("__rank").to_numpy(zero_copy_only=False)
            i = np.searchsorted(at, spot, side="right") - 1
            names = [c for c in b.schema.names if c != "__rank"]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), pa.array(plan[i, 3] + spot - at[i]), pa.array(plan[i, 4])], names=[*names, "sequence_id", "offset"]
            )

    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack all rows of ``docs``; ``with_ids`` adds the pieces' token ids."""
    return pack(durable(tokenize(docs, path or vocabulary(), capacity, with_ids)), capacity)
