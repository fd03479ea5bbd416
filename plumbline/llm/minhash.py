"""Near-duplicate documents: fast similarity sketches, banding and exact verification of word-shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, lean, materialise, mix, seeds, small_or_shuffled
from .graph import components
from .words import packs, words

SHINGLE = 5
#: 30 bands of 5 coordinates find a pair of similarity 0.8 but for one in 10^5, and of 0.85 but for one in 10^7.
BANDS, ROWS = 30, 5
T = BANDS * ROWS
_SEED = seeds(2 * T, 0xF55)
_STEP = seeds(SHINGLE, 0x5417)
_LOW = np.uint64(32)
#: A bucket of m uncompared members has at most about 2 * HUBS * m pairs in its first round, and twice as many in each further one.
HUBS = 16
#: Bits of each coordinate that are kept for an estimate of a pair's similarity, packed into words of 64.
PLANES, WORDS = 4, (T + 63) // 64
#: Cells of the odd sketch (a power of two).
CELLS = 1024


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles."""
    for _, buf, offsets in packs(texts):
        h, start, _ = words(buf.lower())
        at = np.searchsorted(start, offsets)
        n = len(h) - SHINGLE + 1
        window = np.zeros(max(n, 0), np.uint64)
        for k in range(SHINGLE if n > 0 else 0):
            window += h[k : k + n] * _STEP[k]
        window = mix(window)
        for s, e in zip(at[:-1], at[1:]):
            if e - s >= SHINGLE:
                yield np.unique(window[s : e - SHINGLE + 1])
            elif e > s:
                yield mix((h[s:e] * _STEP[: e - s]).sum(keepdims=True) + np.uint64(e - s))
            else:
                yield np.zeros(0, np.uint64)


def sketch(u: np.ndarray) -> np.ndarray:
    """Fast similarity sketching (Dahlgaard, Knudsen, Thorup, 2017) of a non-empty set of 64-bit hashes.

    In rounds 0..T-1 each element falls into one hashed bin; in round T+i all fall into bin i, which fills every coordinate.
    A bin keeps the least (round, value).
    """
    out, empty = np.zeros(T, np.uint64), np.ones(T, bool)
    step = max(1, 1024 // len(u))
    i = 0
    while i < 2 * T and empty.any():
        if i < T:
            r = np.arange(i, min(T, i + step))
            h = mix(u[None, :] ^ _SEED[r][:, None])
            h.sort(axis=1)
            b = (((h >> _LOW) * np.uint64(T)) >> _LOW).astype(np.int64)
            key = (b + T * np.arange(len(r))[:, None]).ravel()
            head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            at, val = key[head], h.ravel()[head]
            bins, first = np.unique(at % T, return_index=True)  # the earliest round comes first
            ok = empty[bins]
            bins, first = bins[ok], first[ok]
            out[bins] = mix(val[first] + _SEED[r[at[first] // T]])
            empty[bins] = False
            i += len(r)
        else:
            if empty[i - T]:
                out[i - T] = mix(mix(u ^ _SEED[i]).min(keepdims=True) + _SEED[i])[0]
                empty[i - T] = False
            i += 1
    return out


def bands(sketched: np.ndarray) -> np.ndarray:
    s = sketched.reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = mix(h + s[:, k])
    return h.view(np.int64)


def planes(sketched: np.ndarray) -> np.ndarray:
    """The lowest bits of the coordinates: PLANES rows of WORDS words."""
    bits = np.zeros((PLANES, WORDS * 64), np.uint8)
    bits[:, :T] = (sketched[None, :] >> np.arange(PLANES, dtype=np.uint64)[:, None]) & np.uint64(1)
    return np.packbits(bits, axis=1).view(np.int64).ravel()


def parities(u: np.ndarray) -> np.ndarray:
    """The odd sketch of a set (Mitzenmacher, Pagh, Pham, 2014): of each cell, whether an odd number of hashes falls into it.

    Two sets differ in at least as many hashes as their parities do in bits, so what this rules out is ruled out for certain.
    """
    odd = np.bincount((u & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _least_agreeing(percent: int) -> int:
    """Coordinates whose kept bits agree in a pair at the threshold, less five standard deviations (about one pair in 10^6 has fewer)."""
    agree = percent / 100 + (1 - percent / 100) / 2**PLANES
    return int(T * agree - 5 * (T * agree * (1 - agree)) ** 0.5)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with lean():
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                n, one, two, band, mark = [], [], [], [], []
                for u in shingle_sets(part.column(1).to_pylist()):
                    n.append(len(u))
                    one.append(int(mix(u).sum(dtype=np.uint64).astype(np.int64)))
                    two.append(int(mix(u + _SEED[0]).sum(dtype=np.uint64).astype(np.int64)))
                    found = sketch(u) if len(u) else None
                    band.append(None if found is None else bands(found))
                    mark.append(None if found is None else np.concatenate([planes(found), parities(u)]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (band, mark))],
                    ["doc_id", "n_shingles", "d1", "d2", "bands", "marks"],
                )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with lean():
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                sets = [u.view(np.int64) for u in shingle_sets(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "s"])


def _marked(classes: DataFrame, side: str) -> DataFrame:
    return classes.select(F.col("rep").alias(side), F.col("n_shingles").alias("n" + side), F.col("marks").alias("m" + side))


def _promising(percent: int) -> Column:
    """Whether sizes and sketches of a and b (na, ma; nb, mb) allow a link. Only the sketch of PLANES can be wrong, see there."""
    x = [F.col("ma")[k].bitwiseXOR(F.col("mb")[k]) for k in range(PLANES * WORDS + CELLS // 64)]
    differ = sum((F.bit_count(reduce(lambda u, v: u.bitwiseOR(v), x[w : PLANES * WORDS : WORDS])) for w in range(WORDS)), F.lit(0))
    odd = sum((F.bit_count(v) for v in x[PLANES * WORDS :]), F.lit(0))
    sizes = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return sizes & (odd * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)) & (differ <= T - _least_agreeing(percent))


def _shingled(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """The full shingle sets of those docs that have these ids(doc_id): (id, s)."""
    some = docs.select("doc_id", "text").join(small_or_shuffled(ids, ids.count()), "doc_id", "left_semi")
    return materialise(some.mapInArrow(_sets, "id long, s array<long>").dropDuplicates(["id"]), "sets")


def _matching(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs(a, b) of class representatives whose full shingle sets are similar enough."""
    x = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    y = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    found = pairs.join(x, "a").join(y, "b").withColumn("i", both).where(f"100 * i >= {percent} * (size(sa) + size(sb) - i)")
    return materialise(found.select("a", "b"), "links")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id long, text string).

    Words are runs of non-blanks after lower-casing A-Z, a set has the distinct 5-word shingles (with fewer words the whole
    sequence). Documents whose sets have 100 * intersection >= percent * union are linked; component_id is the smallest
    doc_id that links reach, kept says that it is the row's own.

    Equal sets collapse to one class by a 128-bit digest before anything is compared, so copies cost one row each. Classes
    meet in buckets of equal bands; in each bucket the smallest is compared with the others, then, in rounds, further hubs
    with those that aren't yet in their component, until no bucket has an uncompared pair of two components. Pairs that
    sizes and sketches don't rule out are confirmed on full sets.

    Null or blank texts: empty set, own component, kept. Rows with a null doc_id: component null, kept. Rows that repeat a
    doc_id with the same text get the same result. Other columns are ignored.
    """
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    all_rows = materialise(rows.mapInArrow(_sketches, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, marks array<long>"), "sketches")
    usable = all_rows.where("n_shingles > 0 and doc_id is not null")
    classes = materialise(usable.groupBy("d1", "d2", "n_shingles", "bands", "marks").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    links = _links(classes, rows.where("doc_id is not null"), percent)
    label = components(links)
    discard(links)
    known = classes.select("d1", "d2", F.col("n_shingles").alias("n"), "rep").join(label, F.col("rep") == F.col("id"), "left")
    known = known.select("d1", "d2", "n", "rep", F.coalesce("component", "rep").alias("component_id"))
    n_known = classes.where("copies > 1").count() + label.count()
    # Only classes with copies or links can differ from a row's own id.
    loose = known.join(classes.where("copies > 1").select("rep").distinct(), "rep", "left_semi").unionByName(known.where("rep <> component_id")).distinct().drop("rep")
    loose = small_or_shuffled(loose, n_known)
    out = all_rows.join(loose, (all_rows.d1 == loose.d1) & (all_rows.d2 == loose.d2) & (all_rows.n_shingles == loose.n) & (all_rows.n_shingles > 0), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _links(classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    banded = classes.select("rep", F.explode("bands").alias("key"))
    hubs = banded.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("m")).where("m > 1")
    member = materialise(banded.join(hubs, "key").select("key", "rep", "hub", "m"), "buckets")
    pairs = member.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = pairs.join(_marked(classes, "a"), "a").join(_marked(classes, "b"), "b").where(_promising(percent)).select("a", "b")
    pairs = materialise(pairs, "pairs")
    sets = _shingled(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), docs)
    links = _matching(pairs, sets, percent)
    discard(sets, pairs)
    buckets = member
    # A hub has met all of its bucket and leaves it; a bucket is settled once what is left of it lies in one component.
    member, turn = member.where("m > 2 and rep <> hub").select("key", "rep"), 0
    left = None
    while True:
        label, before = components(links), left
        left = _open(member, label, classes, turn)
        discard(*([before] if before else []))
        if left.isEmpty():
            discard(left, buckets, label)
            return links
        hub = left.where("is_hub").select("key", F.col("rep").alias("a"), F.col("c").alias("ca"), F.col("n_shingles").alias("na"), F.col("marks").alias("ma"))
        rest = left.select("key", F.col("rep").alias("b"), F.col("c").alias("cb"), F.col("n_shingles").alias("nb"), F.col("marks").alias("mb"), F.col("is_hub").alias("hb"))
        pairs = hub.join(rest, "key").where(F.expr("ca <> cb and (not hb or a < b)") & _promising(percent))
        pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        if not pairs.isEmpty():
            sets = _shingled(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), docs)
            # Of the links so far only which component a class is in is carried on: a row a class, however many links there are.
            new, old = _matching(pairs, sets, percent), links
            links = materialise(label.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(new), "links")
            discard(sets, new, old)
        discard(pairs, label)
        member, turn = left.where("not is_hub").select("key", "rep"), turn + 1


def _open(member: DataFrame, label: DataFrame, classes: DataFrame, turn: int) -> DataFrame:
    """The members of unsettled buckets with their component c, and whether they are hubs of this turn: (key, rep, c, is_hub, n_shingles, marks).

    Half of the hubs come from a bucket's largest component, which they are spared, so they are the more numerous the fewer
    are outside of it; the other half from outside. A hash of the id chooses them, so buckets that share members share hubs
    and no bucket has to be sorted in one task.
    """
    all_of = member.join(label, F.col("rep") == F.col("id"), "left").select("key", "rep", F.coalesce("component", "rep").alias("c"))
    sizes = all_of.groupBy("key", "c").agg(F.count("*").alias("size"))
    split = sizes.groupBy("key").agg(F.sum("size").alias("m"), F.max(F.struct("size", "c")).alias("top"), F.count("*").alias("n")).where("n > 1")
    split = materialise(split.select("key", "m", F.col("top.c").alias("top"), F.col("top.size").alias("g")), "split")
    share = F.when(F.col("c") == F.col("top"), F.col("m") / (F.col("g") * (F.col("m") - F.col("g")))).otherwise(1 / (F.col("m") - F.col("g")))
    chance = F.pmod(F.xxhash64("rep", F.lit(turn)), F.lit(1 << 32)) / float(1 << 32)
    found = all_of.join(small_or_shuffled(split, split.count()), "key").select("key", "rep", "c", (chance < share * (HUBS << turn)).alias("is_hub"))
    out = materialise(found.join(classes.select("rep", "n_shingles", "marks"), "rep"), "open")
    discard(split)
    return out


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs without those that are linked to one with a smaller doc_id; columns and other rows as they were.

    Null or blank texts and null doc_ids stay. Rows that repeat a kept doc_id stay as well, as ids are taken for unique.
    """
    found = materialise(near_duplicates(docs, percent), "near")
    gone = found.where("not kept").select("doc_id").distinct()
    return docs.join(small_or_shuffled(gone, gone.count()), "doc_id", "left_anti").select(*docs.columns)
