"""Near-duplicate documents by MinHash bands, checked with odd sketches, confirmed on full sets.

1. Each text becomes the set of its distinct shingles (64-bit hashes), 128
   MinHash samples of it, 32 band keys of four samples each, and an odd sketch:
   the samples folded into a bitmap by flipping one bit each, so that the
   population count of two bitmaps' XOR estimates their similarity.
2. Texts with equal sets are one class, known by its smallest id.
3. In each band bucket every class is paired with the bucket's smallest class (a
   star: rows grow with the bucket, not with its square). Pairs whose sketches
   allow the wanted similarity are confirmed on their full sets, and components
   are formed.
4. Buckets that still hold several components are searched completely:
   sketches of members in different components are compared with each other
   (bucket by bucket, large buckets in cells of bounded size), and what may be
   similar is confirmed too. Where almost everything may be similar to
   everything (a large group of near copies), pairs are not written out: the
   members meet in cells of bounded size with their full sets, and a cell gives
   a link for each two components that it joins. Then components are final.

Only step 1 and the confirmation read texts. Two sets at exactly the wanted
similarity of 0.75 share no bucket with probability 5e-6; the sketch cut lies
4.5 standard deviations below it.

Defined results: texts without words, and null texts, have an empty set and are
linked with nothing; with fewer words than a shingle the whole sequence is one
shingle; repeated rows are equal sets; rows with one id and different texts are
one document, linked with whatever any of its texts is linked with (each row
keeps the size of its own set); a null id gets no component and is not kept;
other input columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import durable, hashed_words, join_groups, mix64, text_chunks
from .components import connected_components

WORDS = 5
BANDS, SAMPLES_PER_BAND = 32, 4
SAMPLES = BANDS * SAMPLES_PER_BAND
#: Bits of an odd sketch.
SKETCH = 512
#: Similarity as a fraction: intersection * DEN >= union * NUM.
NUM, DEN = 75, 100
#: Standard deviations that an estimate may lie below the wanted similarity.
SIGMAS = 4.5
#: Rows of a bucket that one task compares at a time; larger buckets are cut into cells.
CELL = 8192
#: Groups up to this size are compared together with others.
SMALL = 64
#: A group with more candidate pairs than so many for each member is compared on full sets in place.
CROWDED = 8
#: Members on either side of such a comparison.
CROWD = 2048
#: Ids up to which the wanted texts are found by a broadcast (8 bytes each), and by a shuffle beyond.
BROADCAST_IDS = 2_000_000

_rng = np.random.RandomState(3)
_A = _rng.randint(1, 1 << 31, SAMPLES, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.randint(0, 1 << 31, SAMPLES, dtype=np.int64).astype(np.uint32)


def most_flips(num: int = NUM, den: int = DEN) -> int:
    """XOR population count up to which two sketches may belong to sets of similarity num / den."""
    j = num / den
    low = j - SIGMAS * (j * (1 - j) / SAMPLES) ** 0.5
    # n/2 * (1 - (1 - 2/n)^d) bits differ on average after d flips
    mean = SKETCH / 2 * (1 - (1 - 2 / SKETCH) ** (2 * SAMPLES * (1 - low)))
    return int(mean + 2 * mean**0.5) + 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, bounds = hashed_words(data, offsets)
    out = []
    if len(words) >= WORDS:
        with np.errstate(over="ignore"):
            h = words[: len(words) - WORDS + 1].copy()
            for k in range(1, WORDS):
                h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - WORDS + 1 + k]
        h = mix64(h)
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = e - s
        if n >= WORDS:
            x = np.sort(h[s : e - WORDS + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif n:
            with np.errstate(over="ignore"):
                x = np.uint64(n)
                for w in words[s:e]:
                    x = x * np.uint64(0xC2B2AE3D27D4EB4F) + w
            out.append(mix64(np.array([x])))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, odd sketches) of non-empty sets."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    mins = np.empty((SAMPLES, len(sets)), np.uint32)
    buf = np.empty_like(x)
    for i in range(SAMPLES):
        np.multiply(x, _A[i], out=buf)
        buf += _B[i]
        mins[i] = np.minimum.reduceat(buf, starts)
    m = mins.T.astype(np.uint64)
    with np.errstate(over="ignore"):
        keys = np.zeros((len(sets), BANDS), np.uint64)
        for k in range(SAMPLES_PER_BAND):
            keys = keys * np.uint64(0x9E3779B97F4A7C15) + m[:, k::SAMPLES_PER_BAND] + np.uint64(1)
        keys = mix64(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        spot = mix64(m + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH)
    bits = np.zeros((len(sets), SKETCH // 64), np.uint64)
    rows = np.arange(len(sets))
    for i in range(SAMPLES):
        s = spot[:, i]
        bits[rows, s >> np.uint64(6)] ^= np.uint64(1) << (s & np.uint64(63))
    return keys.view(np.int64), bits


def _sign(batches):
    import pyarrow as pa

    for b in batches:
        for row, data, offsets in text_chunks(b.column("text")):
            n = len(offsets) - 1
            sets = shingle_sets(data, offsets)
            full = [i for i, s in enumerate(sets) if len(s)]
            digest = np.zeros((n, 2), np.int64)
            keys: list = [None] * n
            sketch: list = [None] * n
            if full:
                k, bits = signatures([sets[i] for i in full])
                for j, i in enumerate(full):
                    digest[i] = np.frombuffer(hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), np.int64)
                    keys[i], sketch[i] = k[j], bits[j].tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(row, n), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                names=["doc_id", "n_shingles", "d0", "d1", "keys", "sketch"],
            )


def _sets(batches):
    import pyarrow as pa

    for b in batches:
        for row, data, offsets in text_chunks(b.column("text")):
            sets = shingle_sets(data, offsets)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(row, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "members"])


def _confirmed(num: int, den: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            keep = np.zeros(len(b), bool)
            for i, (x, y) in enumerate(zip(b.column("x"), b.column("y"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                if len(small) * den < num * len(large):
                    continue
                at = np.searchsorted(large, small)
                common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep[i] = common * den >= num * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep))], names=["a", "b"])

    return run


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, members): full sets of the documents named in ``ids`` (id); only their texts become sets and move."""
    ids = durable(ids)
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = docs.join(wanted, F.col("doc_id") == F.col("id"), "left_semi").mapInArrow(_sets, "doc_id long, members binary")
    # an id has one set for each different text
    return durable(sets.withColumn("digest", F.md5("members")).dropDuplicates(["doc_id", "digest"]).drop("digest"), keep_bytes=True)


def confirm(docs: DataFrame, pairs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    pairs = durable(pairs)
    sets = _sets_of(docs, pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("members").alias("y")), "b")
    return durable(both.select("a", "b", "x", "y").mapInArrow(_confirmed(num, den), "a long, b long").distinct())


def _across(num: int, den: int, flips: int):
    """Within each cell, pairs of members in different components that their sketches allow."""

    def cell(left, right, same: bool):
        order = np.argsort(right[3], kind="stable")
        rid, rcomp, rbits, rsize = (x[order] for x in right)
        out_a, out_b = [], []
        step = max(1, (1 << 21) // (max(1, len(rid)) * (SKETCH // 64)))
        for s in range(0, len(left[0]), step):
            lid, lcomp, lbits, lsize = (x[s : s + step] for x in left)
            lo = np.searchsorted(rsize, lsize.min() * num // den)
            hi = np.searchsorted(rsize, lsize.max() * den // num + 1, side="right")
            if lo >= hi:
                continue
            far = np.zeros((len(lid), hi - lo), np.uint16)
            for w in range(SKETCH // 64):
                far += np.bitwise_count(lbits[:, w, None] ^ rbits[None, lo:hi, w])
            i, j = np.nonzero((far <= flips) & (lcomp[:, None] != rcomp[None, lo:hi]))
            x, y = lid[i], rid[lo + j]
            ok = (x > y) if same else np.ones(len(x), bool)
            out_a.append(np.maximum(x, y)[ok])
            out_b.append(np.minimum(x, y)[ok])
        return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.empty(0, np.int64),) * 2

    def compare(rows, bounds):
        """All groups between ``bounds``: small ones side by side, others one at a time."""
        ids, comp, bits, size, block, lo, hi = rows
        sizes = np.diff(bounds)
        out_a, out_b, crowds = [], [], []
        for g in np.flatnonzero(sizes > SMALL):
            part = slice(bounds[g], bounds[g + 1])
            x = tuple(v[part] for v in (ids, comp, bits, size))
            first, last = lo[bounds[g]], hi[bounds[g]]
            left = tuple(v[block[part] == first] for v in x)
            right = left if first == last else tuple(v[block[part] == last] for v in x)
            a, b = cell(left, right, first == last)
            if len(a) > CROWDED * sizes[g]:
                # not its pairs but its members go on, tied to one of them
                rest = np.unique(np.concatenate((a, b)))
                crowds.append(np.stack([rest[1:], np.full(len(rest) - 1, rest[0])], 1))
                continue
            out_a.append(a)
            out_b.append(b)
        group = np.repeat(np.arange(len(sizes)), sizes)
        group[sizes[group] > SMALL] = -1
        at = np.flatnonzero(group >= 0)
        for d in range(1, SMALL):
            at = at[at + d < len(group)]
            at = at[group[at] == group[at + d]]
            if not len(at):
                break
            i, j = at, at + d
            ok = (comp[i] != comp[j]) & ((lo[i] == hi[i]) | (block[i] != block[j])) & (np.minimum(size[i], size[j]) * den >= np.maximum(size[i], size[j]) * num)
            i, j = i[ok], j[ok]
            ok = np.bitwise_count(bits[i] ^ bits[j]).sum(1) <= flips
            out_a.append(np.maximum(ids[i], ids[j])[ok])
            out_b.append(np.minimum(ids[i], ids[j])[ok])
        pairs = np.unique(np.stack([np.concatenate([np.empty(0, np.int64), *x]) for x in (out_a, out_b)], 1), axis=0)
        return pairs, np.concatenate([np.empty((0, 2), np.int64), *crowds])

    def run(batches):
        import pyarrow as pa

        def done(table, last: bool):
            """Compare the complete groups of ``table``; returns pairs and what is left for the next batch."""
            table = table.combine_chunks()
            k, lo, hi = (table.column(c).to_numpy() for c in ("key", "lo", "hi"))
            edges = np.flatnonzero((k[1:] != k[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            bounds = np.concatenate(([0], edges, [len(k)] if last else [])).astype(np.int64)
            n = int(bounds[-1])
            bits = np.frombuffer(b"".join(x.as_py() for x in table.column("sketch").slice(0, n)), np.uint64).reshape(-1, SKETCH // 64)
            rows = [table.column(c).to_numpy()[:n] for c in ("id", "component", "n_shingles", "block")]
            pairs, crowds = compare((rows[0], rows[1], bits, rows[2], rows[3], lo[:n], hi[:n]), bounds)
            both = np.concatenate((pairs, crowds))
            crowded = np.arange(len(both)) >= len(pairs)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(crowded)], names=["a", "b", "crowded"]), table.slice(n)

        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            rest = t if rest is None else pa.concat_tables([rest, t])
            if len(rest):
                out, rest = done(rest, False)
                yield out
        if rest is not None and len(rest):
            yield done(rest, True)[0]

    return run


def _in_crowd(num: int, den: int):
    """Links between components within each cell, by exact intersections of full sets; a link for each union at most."""

    def links(ids, comp, block, lo, hi, members):
        flat = np.concatenate(members)
        sizes = np.array([len(m) for m in members])
        starts = np.cumsum(sizes) - sizes
        _, flat = np.unique(flat, return_inverse=True)
        mark = np.zeros(flat.max() + 1, np.int8)
        up: dict[int, int] = {}

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        roots = np.array([root(c) for c in comp])
        out = []
        # within one block every row meets the rows after it, else every row of the one block those of the other
        first = np.flatnonzero(block == lo)
        for i in first:
            away = roots != roots[i]
            away &= (np.arange(len(ids)) > i) if lo == hi else (block == hi)
            away &= np.minimum(sizes, sizes[i]) * den >= np.maximum(sizes, sizes[i]) * num
            if not away.any():
                continue
            own = flat[starts[i] : starts[i] + sizes[i]]
            mark[own] = 1
            common = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[own] = 0
            for j in np.flatnonzero(away & (common * den >= num * (sizes + sizes[i] - common))):
                a, b = root(comp[i]), root(comp[j])
                if a != b:
                    up[max(a, b)] = min(a, b)
                    roots[roots == max(a, b)] = min(a, b)
                    out.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
        return out

    def run(batches):
        import pyarrow as pa

        rest = None
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def done(table, last: bool):
            table = table.combine_chunks()
            k, lo, hi = (table.column(c).to_numpy() for c in ("crowd", "lo", "hi"))
            edges = np.flatnonzero((k[1:] != k[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            bounds = [0, *edges.tolist(), *([len(k)] if last else [])]
            out = []
            for s, e in zip(bounds, bounds[1:]):
                part = table.slice(s, e - s)
                members = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("members")]
                ids, comp, block = (part.column(c).to_numpy() for c in ("id", "component", "block"))
                out += links(ids, comp.tolist(), block, lo[s], hi[s], members)
            pairs = np.array(out, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema), table.slice(bounds[-1])

        for b in batches:
            t = pa.Table.from_batches([b])
            rest = t if rest is None else pa.concat_tables([rest, t])
            if len(rest):
                out, rest = done(rest, False)
                yield out
        if rest is not None and len(rest):
            yield done(rest, True)[0]

    return run


def _cells(rows: DataFrame, key: str, n: str, size: int) -> DataFrame:
    """Rows of a key in cells (lo, hi) of at most two blocks of about ``size`` rows; every two rows of a key share a cell."""
    blocks = F.ceil(F.col(n) / size).cast("int")
    return (
        rows.withColumns({"block": F.pmod(F.xxhash64("id"), blocks).cast("int"), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
        .withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other", n)
        .repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")
    )


def _crowd_links(docs: DataFrame, crowded: DataFrame, comps: DataFrame, num: int, den: int) -> DataFrame:
    """Confirmed links within crowds: members tied together, compared on their full sets in cells of bounded size."""
    crowds = durable(connected_components(crowded).select(F.col("node").alias("id"), F.col("component").alias("crowd")))
    sets = _sets_of(docs, crowds.select("id").distinct())
    sizes = crowds.groupBy("crowd").agg(F.count(F.lit(1)).alias("n"))
    rows = crowds.join(sizes, "crowd").join(comps.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    rows = rows.join(sets.select(F.col("doc_id").alias("id"), "members"), "id").select("crowd", "id", "component", "members", "n")
    return durable(_cells(rows, "crowd", "n", CROWD).mapInArrow(_in_crowd(num, den), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = durable(docs.mapInArrow(_sign, "doc_id long, n_shingles long, d0 long, d1 long, keys array<long>, sketch binary"))
    # equal sets are one class; counted before they move, so a large group of copies is a few rows
    grouped = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d0", "d1", "n_shingles")
    classes = durable(grouped.agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies")))
    bands = classes.select(F.explode("keys").alias("key"), "id")
    buckets = bands.groupBy("key").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = durable(join_groups(bands, buckets, ["key"], "n", BANDS * classes.count()))
    sketches = classes.select("id", "sketch", "n_shingles")
    flips = most_flips(num, den)
    stars = members.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct()
    near = (
        stars.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sa"), F.col("n_shingles").alias("na")), "a")
        .join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sb"), F.col("n_shingles").alias("nb")), "b")
        .where((F.least("na", "nb") * den >= F.greatest("na", "nb") * num))
        .select("a", "b", "sa", "sb").mapInArrow(_allowed(flips), "a long, b long")
    )
    links = confirm(docs, near, num, den).unionByName(_texts_of_one_id(signed, classes))
    comps = durable(connected_components(links))
    # what the stars left apart: buckets with several components
    placed = members.join(comps.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("n")).where("c0 <> c1")
    spread = join_groups(placed, mixed.select("key", "n"), ["key"], "n", members.count()).join(sketches, "id").select("key", "id", "component", "sketch", "n_shingles", "n")
    across = durable(_cells(spread, "key", "n", CELL).mapInArrow(_across(num, den, flips), "a long, b long, crowded boolean").distinct())
    more = confirm(docs, across.where("NOT crowded").select("a", "b"), num, den)
    crowded = across.where("crowded").select("a", "b")
    if not crowded.isEmpty():
        more = more.unionByName(_crowd_links(docs, crowded, comps, num, den))
    final = durable(connected_components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))
    named = classes.select("d0", "d1", "n_shingles", "id", "copies").join(final.select(F.col("node").alias("id"), "component"), "id", "left").select("d0", "d1", "n_shingles", "copies", F.coalesce("component", "id").alias("component"))
    rows = signed.select("doc_id", "n_shingles", "d0", "d1")
    full = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    joined = join_groups(rows.where(full), named, ["d0", "d1", "n_shingles"], "copies", signed.count()).select("doc_id", "n_shingles", "component")
    own = final.select(F.col("node").alias("__id"), F.col("component").alias("__component"))
    bare = rows.where(~full & F.col("doc_id").isNotNull()).select("doc_id", "n_shingles").join(own, F.col("doc_id") == F.col("__id"), "left")
    joined = joined.unionByName(bare.select("doc_id", "n_shingles", F.coalesce("__component", "doc_id").alias("component")))
    joined = joined.unionByName(rows.where("doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component")))
    return joined.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False)).alias("kept"))


def _texts_of_one_id(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between an id and the classes of its texts, for ids with several different texts."""
    rows = signed.where("doc_id IS NOT NULL").select("doc_id", "d0", "d1", "n_shingles")
    many = rows.groupBy("doc_id").agg(F.min(F.struct("d0", "d1", "n_shingles")).alias("x"), F.max(F.struct("d0", "d1", "n_shingles")).alias("y")).where("x <> y").select("doc_id")
    rows = rows.join(many, "doc_id", "left_semi").distinct()
    return durable(rows.join(classes.select("d0", "d1", "n_shingles", "id"), ["d0", "d1", "n_shingles"]).where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b")))


def _allowed(flips: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not len(b):
                continue
            x, y = (np.frombuffer(b"".join(v.as_py() for v in b.column(c)), np.uint64).reshape(len(b), -1) for c in ("sa", "sb"))
            keep = pa.array(np.bitwise_count(x ^ y).sum(1) <= flips)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    return run
