"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: An edge list of at most this many rows (16 bytes each) is finished by union-find in one task; longer ones by star rounds.
LOCAL_EDGES = 200_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    ids = np.fromiter(parent, np.int64, len(parent))
    yield pa.RecordBatch.from_pydict({"id": ids, "component": np.fromiter(map(root, list(parent)), np.int64, len(ids))})


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step (Kiveris et al., 2014). edges: a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Nodes of edges(a long, b long) with their component's smallest node: (id, component).

    Loops and repeated or reversed edges don't matter, null ends are dropped, no edges give an empty table. Each round is
    written to the shared folder; the number of rounds grows with the logarithm of a component's size. Only a count and a
    checksum reach the driver. Once at most LOCAL_EDGES edges are left, one task ends the work.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    if e.count() <= LOCAL_EDGES:  # edges are usually a stored table, so this is a cheap scan
        return materialise(e.repartition(1).mapInArrow(_union_find, "id long, component long"), "components")
    e, seen = materialise(e.distinct(), "edges"), None
    while True:
        row = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if row[0] <= LOCAL_EDGES:
            out = materialise(e.repartition(1).mapInArrow(_union_find, "id long, component long"), "components")
            discard(e)
            return out
        if tuple(row) == seen:
            break
        seen, last = tuple(row), e
        e = materialise(_round(e), "edges")
        discard(last)
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
