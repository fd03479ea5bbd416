"""Near-duplicate vectors: Euclidean p-stable hashing in several tables, exact cosine checks within buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, mix, small_or_shuffled
from .graph import components

#: Floor((a.v + b) / WIDTH) for HASHES Gaussian projections a name a bucket, in TABLES tables. Unit vectors of cosine 0.9 (distance
#: 0.447) share a hash with probability 0.82 and a bucket of some table with 0.98; of cosine 0.97 with more than 0.9999.
TABLES, HASHES, WIDTH = 40, 12, 2.0
#: Rows of a bucket that are compared as one block; larger buckets are cut into blocks, and pairs of blocks into tasks.
BLOCK = 1024


class Hasher:
    """The same projections for the same dimension everywhere."""

    def __init__(self, dim: int):
        rng = np.random.default_rng(20_240 + dim)
        self.a = rng.standard_normal((dim, TABLES * HASHES))
        self.b = rng.uniform(0, WIDTH, TABLES * HASHES)
        self.odd = rng.integers(1, 1 << 62, HASHES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """[row, table] as uint64."""
        code = np.floor((unit @ self.a + self.b) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(unit), TABLES, HASHES)
        h = np.arange(TABLES, dtype=np.uint64) + np.uint64(self.a.shape[0] << 20)
        return mix((code * self.odd).sum(axis=2, dtype=np.uint64) + mix(h))


_HASHERS: dict[int, Hasher] = {}


def _hasher(dim: int) -> Hasher:
    if dim not in _HASHERS:
        _HASHERS[dim] = Hasher(dim)
    return _HASHERS[dim]


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _by_dim(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    size = np.asarray(column.value_lengths())
    flat, start = np.asarray(column.flatten(), np.float64), np.r_[0, np.cumsum(size)]
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        yield rows, _unit(flat[(start[rows][:, None] + np.arange(dim))])


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for rows, unit in _by_dim(b.column(1)):
            for at in range(0, len(rows), 512):
                part = rows[at : at + 512]
                h = _hasher(unit.shape[1]).buckets(unit[at : at + 512]).view(np.int64)
                ids = np.asarray(b.column(0))[part]
                yield pa.RecordBatch.from_pydict({"class": np.repeat(ids, TABLES), "t": np.tile(np.arange(TABLES, dtype=np.int32), len(part)), "bucket": h.ravel()})


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of equal (bucket, i, j) of a sorted stream; several small groups come together, never part of one."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = np.column_stack([np.asarray(b.column(k)) for k in range(3)])
        cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1))
        last = [held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in range(3)] if held else None
        if held and list(key[0]) != last:
            yield pa.Table.from_batches(held)
            held = []
        if len(cut):
            yield pa.Table.from_batches([*held, b.slice(0, cut[-1] + 1)])
            held = [b.slice(cut[-1] + 1)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            table = table.combine_chunks()
            key = np.column_stack([np.asarray(table.column(k)) for k in range(3)])
            side, t, ids, copies = (np.asarray(table.column(c)) for c in ("side", "t", "class", "copies"))
            column = table.column("v")
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1), True])
            links: dict[int, int] = {}
            near: list[tuple[int, int]] = []
            for s, e in zip(edge[:-1], edge[1:]):
                if e - s < 2:
                    continue
                for rows, unit in _by_dim(column.slice(s, e - s)):  # only by a collision of hashes do dimensions meet
                    _block(unit, side[s + rows], key[s, 1] == key[s, 2], int(t[s]), ids[s + rows], copies[s + rows], threshold, links, near)
            if links:
                a, b = zip(*near) if near else ((), ())
                k, v = zip(*links.items())
                yield pa.RecordBatch.from_pydict({"a": np.array([*k, *a], np.int64), "b": np.array([*k, *b], np.int64), "n": np.array([*v, *([0] * len(a))], np.int64)})

    return run


def _block(unit, side, own, t, ids, copies, threshold, links, near) -> None:
    """Counts each link in the first table where both ends meet; joins the ends of links by a forest, not by all pairs.

    own: whether a block meets itself; else its rows are on two sides, of which one may be empty.
    """
    one, two = (np.arange(len(ids)),) * 2 if own else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    cos = unit[one] @ unit[two].T
    i, j = np.nonzero(cos >= threshold - 1e-9)
    i, j = one[i], two[j]
    ok = i < j if own else ids[i] != ids[j]
    i, j = i[ok], j[ok]
    exact = (unit[i] * unit[j]).sum(axis=1) >= threshold
    i, j = i[exact], j[exact]
    if not len(i):
        return
    if t:
        used = np.unique(np.r_[i, j])
        h = _hasher(unit.shape[1]).buckets(unit[used])[:, :t]
        first = ~(h[np.searchsorted(used, i)] == h[np.searchsorted(used, j)]).any(axis=1)
        i, j = i[first], j[first]
    for x, y in ((i, j), (j, i)):
        who, at = np.unique(x, return_inverse=True)
        for k, n in zip(ids[who].tolist(), np.bincount(at, weights=copies[y]).astype(np.int64).tolist()):
            links[k] = links.get(k, 0) + n
    parent = np.arange(len(ids))
    while True:  # least label over links, then shortcuts
        low = parent.copy()
        np.minimum.at(low, i, parent[j])
        np.minimum.at(low, j, parent[i])
        low = low[low]
        if (low == parent).all():
            break
        parent = low
    moved = np.flatnonzero(parent != np.arange(len(ids)))
    near += zip(ids[moved].tolist(), ids[parent[moved]].tolist())


def near_vectors(vectors: DataFrame, threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors(vec_id long, embedding array of numbers).

    Rows whose vectors have a cosine of at least threshold (double precision) are linked where some table puts them into one
    bucket; n_links counts the other rows linked directly, component_id is the smallest vec_id that links reach.

    Equal vectors collapse to one class with a count. A bucket's classes are compared in blocks, and large buckets are cut
    into pairs of blocks, each a task's group of bounded size; what leaves a group is a count a class and a forest of its
    links, never its pairs. A link counts in the first table where its ends meet, so no pairs are gathered to be made distinct.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different length
    don't either. Null vec_id: 0 links, null component, kept. Repeated ids are rows of their own. Other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    good = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    digest = F.when(good & F.col("vec_id").isNotNull(), F.unhex(F.sha2(F.to_binary(F.array_join(F.transform("v", lambda x: (x + 0.0).cast("string")), ","), F.lit("utf-8")), 256)))
    rows = rows.withColumn("d", digest)
    classes = rows.where("d is not null").groupBy("d").agg(F.min("vec_id").alias("class"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = materialise(classes, "vectors")
    hashed = classes.select("class", "v").mapInArrow(_hash, "class long, t int, bucket long")
    hashed = materialise(hashed, "buckets")
    sizes = hashed.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    n_sizes = sizes.count()
    met = hashed.join(small_or_shuffled(sizes, n_sizes), "bucket").withColumn("g", F.ceil(F.col("m") / block).cast("int"))
    met = met.withColumn("i", F.when(F.col("g") > 1, F.pmod(F.xxhash64("class", "t"), F.col("g")).cast("int")).otherwise(0))
    # Block i meets itself and every other block once: as side 0 where its number is the smaller, else as side 1.
    pair = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda k: F.struct(F.least("i", k).alias("x"), F.greatest("i", k).alias("y"), F.when(F.col("i") > k, 1).otherwise(0).alias("side")))
    met = met.select("class", "t", "bucket", F.explode(pair).alias("p")).select("bucket", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("p.side").alias("side"), "t", "class")
    full = met.join(classes.select("class", "copies", "v"), "class").select("bucket", "x", "y", "side", "t", "class", "copies", "v")
    spread = full.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    found = materialise(spread.mapInArrow(_compare(threshold), "a long, b long, n long"), "links")
    discard(hashed)
    label = components(found.where("a <> b").select("a", "b"))
    n = found.groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    own = classes.select("d", "class", "copies").join(n, "class", "left").join(label, F.col("class") == F.col("id"), "left")
    own = own.select("d", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class").alias("component_id"))
    out = rows.select("vec_id", "d").join(small_or_shuffled(own, classes.count()), "d", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
