"""Index structures as queries over sorted, grouped or bit-packed tables."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import add, lower_bound, prefix


def multimap(df: DataFrame, key: str, value: str) -> DataFrame:
    """key -> values; for keys of bounded multiplicity."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("values"))


# Bitmaps: bucket and bitmap columns; positions are row ids from 0, shifted by one as the functions count from 1.


def _bit(row: str) -> tuple[Column, Column]:
    return F.bitmap_bucket_number(F.col(row) + 1).alias("bucket"), F.bitmap_bit_position(F.col(row) + 1).alias("bit")


def bitmap_index(df: DataFrame, key: str, row: str) -> DataFrame:
    """Equality encoding: for each key and bucket of rows the bitmap of the rows that have the key."""
    return df.select(F.col(key).alias("key"), *_bit(row)).groupBy("key", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def bitmap_or(index: DataFrame) -> DataFrame:
    """Union of the bitmaps of an index's keys, by bucket."""
    return index.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_and(one: DataFrame, two: DataFrame) -> DataFrame:
    both = one.unionByName(two).groupBy("bucket").agg(F.count("*").alias("c"), F.bitmap_and_agg("bits").alias("bits"))
    return both.where("c = 2").select("bucket", "bits")


def bitmap_and_not(one: DataFrame, two: DataFrame) -> DataFrame:
    """The rows of one that two lacks: of each bucket one xor (one and two), as bits of the inverted words of two."""
    flip = F.unhex(F.translate(F.hex("bits"), "0123456789ABCDEF", "FEDCBA9876543210"))
    inverted = two.select("bucket", flip.alias("bits"))
    both = one.join(inverted.withColumnRenamed("bits", "other"), "bucket", "left")
    some = both.where("other is not null")
    met = some.select("bucket", "bits").unionByName(some.select("bucket", F.col("other").alias("bits"))).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
    return met.unionByName(both.where("other is null").select("bucket", "bits"))


def bitmap_cardinality(bitmap: DataFrame, name: str = "n") -> DataFrame:
    return bitmap.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("long").alias(name))


def range_encoded(index: DataFrame) -> DataFrame:
    """Range encoding: for each key the rows with this or a smaller key."""
    w = Window.partitionBy("bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return index.select("key", "bucket", F.bitmap_or_agg("bits").over(w).alias("bits"))


def at_most(index: DataFrame, key) -> DataFrame:
    """Rows with a key of at most `key`: in each bucket of a range-encoded index the bitmap of the next smaller key that is there."""
    return index.where(F.col("key") <= key).groupBy("bucket").agg(F.max_by("bits", "key").alias("bits"))


# Word-aligned hybrid compression


def wah_words(df: DataFrame, key: str, row: str, n: int, length: int = 32) -> DataFrame:
    """key, word_no, kind ('fill' or 'literal'), ones (long, fills of ones), run or bits: the compressed bit sequence of each key.

    Chunks have length - 1 bits; runs of equal all-zero or all-one chunks are one fill word of at most 2^(length - 2) - 1
    chunks, other chunks are literals. The last chunk may be short and is a literal unless its bits are equal, as if it
    were full. Only chunks with a set bit come from the data; the zero fills between them follow from the gaps, so the work
    grows with the set bits, not with keys times rows.
    """
    c, most = length - 1, 2 ** (length - 2) - 1
    chunks = -(-n // c)
    last = n - (chunks - 1) * c
    one = df.select(F.col(key).alias("key"), F.floor(F.col(row) / c).cast("long").alias("chunk"), F.pmod(F.col(row), F.lit(c)).cast("int").alias("bit")).distinct()
    some = one.groupBy("key", "chunk").agg(F.count("*").alias("set"), F.sum(F.expr("shiftleft(1L, bit)")).alias("bits"))
    full = F.col("set") == F.when(F.col("chunk") == chunks - 1, last).otherwise(c)
    w = Window.partitionBy("key").orderBy("chunk")
    some = some.withColumn("full", full).withColumn("island", F.col("chunk") - F.row_number().over(Window.partitionBy("key", "full").orderBy("chunk")))
    ones = some.where("full").groupBy("key", "island").agg(F.min("chunk").alias("chunk"), F.count("*").alias("run"))
    runs = ones.select("key", "chunk", "run", F.lit("one").alias("kind"), F.lit(None).cast("long").alias("bits")).unionByName(
        some.where("not full").select("key", "chunk", F.lit(1).cast("long").alias("run"), F.lit("literal").alias("kind"), "bits"))
    runs = runs.withColumns({"from": F.coalesce(F.lag(F.col("chunk") + F.col("run")).over(w), F.lit(0)), "next": F.lead("chunk").over(w)})
    before = F.col("chunk") - F.col("from")
    after = F.when(F.col("next").isNull(), chunks - F.col("chunk") - F.col("run")).otherwise(0)
    gap = lambda at, run: F.struct(at.alias("chunk"), run.alias("run"), F.lit("zero").alias("kind"), F.lit(None).cast("long").alias("bits"))
    own = F.struct("chunk", "run", "kind", "bits")
    parts = F.explode(F.filter(F.array(gap(F.col("chunk") - before, before), own, gap(F.col("chunk") + F.col("run"), after)), lambda x: x["run"] > 0)).alias("x")
    words = runs.select("key", parts).select("key", "x.*")
    split = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("run") - 1) / most).cast("long"))).alias("part")
    words = words.select("key", "chunk", "kind", "bits", "run", split)
    return words.select("key", (F.col("chunk") + F.col("part") * most).alias("chunk"), "kind", F.least(F.col("run") - F.col("part") * most, F.lit(most)).alias("run"), "bits")


_WORD = "array<struct<chunk: bigint, run: bigint, kind: string, bits: bigint>>"


def _mask(width: int) -> int:
    return (1 << width) - 1


def _as_words(runs: DataFrame, n: int, length: int) -> DataFrame:
    """Canonical words of runs (key, chunk, run, value) that cover all chunks: neighbouring fills of one kind become one, in pieces of at most 2^(length - 2) - 1 chunks.

    value: a chunk's bits; runs of several chunks hold zeros or ones only.
    """
    c, most = length - 1, 2 ** (length - 2) - 1
    last = -(-n // c) - 1
    full = F.when((F.col("chunk") == last) & (F.col("run") == 1), _mask(n - last * c)).otherwise(_mask(c))
    kind = F.when(F.col("value") == 0, "zero").when(F.col("value") == full, "one").otherwise("literal")
    by = Window.partitionBy("key").orderBy("chunk")
    runs = runs.withColumn("kind", kind)
    runs = runs.withColumn("new", ((F.col("kind") == "literal") | ~F.col("kind").eqNullSafe(F.lag("kind").over(by))).cast("int")).withColumn("island", F.sum("new").over(by))
    whole = runs.groupBy("key", "island", "kind").agg(F.min("chunk").alias("chunk"), F.sum("run").alias("run"), F.first("value").alias("value"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("run") - 1) / most).cast("long"))).alias("part")
    bits = F.when(F.col("kind") == "literal", F.col("value"))
    return whole.select("key", "chunk", "kind", "run", bits.alias("bits"), part).select("key", (F.col("chunk") + F.col("part") * most).alias("chunk"), "kind", F.least(F.col("run") - F.col("part") * most, F.lit(most)).cast("long").alias("run"), "bits")


def _values(words: DataFrame, n: int, length: int) -> DataFrame:
    """key, chunk, run, value of words, so that fills and literals are bits alike."""
    c = length - 1
    last = -(-n // c) - 1
    ones = F.when((F.col("chunk") == last) & (F.col("run") == 1), _mask(n - last * c)).otherwise(_mask(c)).cast("long")
    return words.select("key", "chunk", "run", F.when(F.col("kind") == "zero", F.lit(0).cast("long")).when(F.col("kind") == "one", ones).otherwise(F.col("bits")).alias("value"))


def wah_combine(one: DataFrame, two: DataFrame, op: str, n: int, length: int = 32) -> DataFrame:
    """The words of `one op two` (op: and, or, xor) for each key of both, worked out on the words: a run is cut only where the other side's words begin.

    A key that one side lacks is left out. The work grows with the words, not with the bits.
    """
    merge = {"and": Column.bitwiseAND, "or": Column.bitwiseOR, "xor": Column.bitwiseXOR}[op]
    keys = one.select("key").distinct().join(two.select("key").distinct(), "key")
    a, b = (_values(w.join(keys, "key", "left_semi"), n, length).select("key", "chunk", F.struct("chunk", "run", "value").alias(s)) for w, s in ((one, "a"), (two, "b")))
    cuts = a.join(b, ["key", "chunk"], "full")
    by = Window.partitionBy("key").orderBy("chunk")
    held = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = cuts.withColumns({"a": F.last("a", ignorenulls=True).over(held), "b": F.last("b", ignorenulls=True).over(held), "next": F.lead("chunk").over(by)})
    c = length - 1
    chunks = -(-n // c)
    run = F.coalesce("next", F.lit(chunks)) - F.col("chunk")
    # The last chunk may be short: a fill that reaches it has ones there only up to its end.
    width = F.when((F.col("chunk") == chunks - 1) & (run == 1), _mask(n - (chunks - 1) * c)).otherwise(_mask(c)).cast("long")
    value = merge(F.col("a.value"), F.col("b.value")).bitwiseAND(width)
    return _as_words(cuts.select("key", "chunk", run.alias("run"), value.alias("value")), n, length)


def wah_not(words: DataFrame, n: int, length: int = 32) -> DataFrame:
    """The words of the complement of each key."""
    c = length - 1
    last = -(-n // c) - 1
    width = F.when(F.col("chunk") == last, _mask(n - last * c)).otherwise(_mask(c)).cast("long")
    kind = F.when(F.col("kind") == "zero", "one").when(F.col("kind") == "one", "zero").otherwise("literal")
    return words.select("key", "chunk", kind.alias("kind"), "run", F.bitwise_not("bits").bitwiseAND(width).alias("bits"))


def wah_positions(words: DataFrame, n: int, length: int = 32) -> DataFrame:
    """key, pos: the set bits of each key; zero fills cost nothing."""
    c = length - 1
    some = _values(words.where("kind <> 'zero'"), n, length)
    each = some.select("key", "value", F.explode(F.sequence(F.col("chunk"), F.col("chunk") + F.col("run") - 1)).alias("chunk"))
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(c - 1)), lambda i: F.getbit("value", i) == 1)).alias("bit")
    return each.select("key", "chunk", bit).select("key", (F.col("chunk") * c + F.col("bit")).alias("pos")).where(F.col("pos") < n)


def wah_ends(words: DataFrame, n: int, length: int = 32) -> DataFrame:
    """key, n_set, first, last: number of set bits, the lowest and the highest (most significant) of each key that has any."""
    c = length - 1
    some = _values(words.where("kind <> 'zero'"), n, length)
    final = F.col("chunk") + F.col("run") - 1
    ones = F.when(F.col("run") == 1, F.bit_count("value").cast("long")).otherwise(F.least(F.col("run") * c, F.lit(n) - F.col("chunk") * c))
    low = F.col("chunk") * c + F.bit_count(F.col("value").bitwiseAND(-F.col("value")) - 1)
    high = F.when(F.col("run") == 1, F.col("chunk") * c + F.length(F.bin("value")) - 1).otherwise(F.least((final + 1) * c, F.lit(n)) - 1)
    return some.groupBy("key").agg(F.sum(ones).alias("n_set"), F.min(low).cast("long").alias("first"), F.max(high).cast("long").alias("last"))


# Bloom filters

#: Bits of the largest filter (8 MB to broadcast); beyond the keys that it is good for, rows are not filtered.
MOST_BITS = 1 << 26


def bloom_bits(n: int, per_key: int = 10) -> int:
    """Bits of a filter for n keys: a power of two, at most MOST_BITS."""
    return min(MOST_BITS, 1 << max(10, (per_key * n - 1).bit_length()))


def bloom_shape(n: int, bits: int) -> int:
    """Number of hash functions for n keys."""
    return max(1, math.ceil(math.log(2) * bits / max(1, n)))


def _bloom_bits(key: Column, bits: int, k: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(k)])


def bloom_filter(df: DataFrame, key: str, bits: int, k: int) -> DataFrame:
    """One row with `words`, the filter's bits in longs. Tasks add up words, not keys; the row's size is bounded by `bits`."""
    each = df.select(F.explode(_bloom_bits(F.col(key), bits, k)).alias("b")).select((F.col("b") / 64).cast("long").alias("w"), F.expr("shiftleft(1L, cast(b % 64 as int))").alias("bit"))
    words = df.sparkSession.range(0, -(-bits // 64)).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("bit")).unionByName(each).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "bits"))), lambda x: x["bits"]).alias("words"))


def maybe_in(df: DataFrame, key: str, bloom: DataFrame, bits: int, k: int) -> DataFrame:
    """The rows whose key may be in the filter: all that are, and some that aren't."""
    on = "forall(__b, b -> getbit(get(words, cast(b div 64 as int)), cast(b % 64 as int)) = 1)"
    return df.withColumn("__b", _bloom_bits(F.col(key), bits, k)).join(F.broadcast(bloom)).where(on).select(*df.columns)


# Ordered indexes


def upsert(log: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """The last value put for each key."""
    return log.groupBy(key).agg(F.max_by(value, seq).alias(value))


class Index:
    """A multi-valued index of a table by a key: tables in, tables out. Reads are filters that reach the scan; nothing is gathered by key."""

    def __init__(self, entries: DataFrame, key: str):
        self.entries, self.key = entries, key

    def put(self, more: DataFrame) -> Index:
        return Index(self.entries.unionByName(more), self.key)

    def remove(self, keys: DataFrame) -> Index:
        """Without the entries whose key is in keys, a table with the key's column."""
        return Index(self.entries.join(keys.select(self.key).distinct(), self.key, "left_anti").select(*self.entries.columns), self.key)

    def get(self, key) -> DataFrame:
        return self.entries.where(F.col(self.key) == key)

    def get_all(self, where: Column | None = None) -> DataFrame:
        """All entries, or those that satisfy a clause on any column."""
        return self.entries if where is None else self.entries.where(where)

    def range(self, low, high) -> DataFrame:
        return self.entries.where(F.col(self.key).between(low, high))


class Leaves:
    """An ordered index on disk: files of rows with keys in disjoint ranges, each sorted, so that a read opens those files only whose range fits.

    Puts are written beside and dealt into the leaves by compact(). A key's value is that of its largest `seq`.
    """

    def __init__(self, spark, path: str, key: str, schema):
        self.spark, self.path, self.key, self.schema = spark, path, key, schema

    @classmethod
    def build(cls, df: DataFrame, key: str, path: str, leaves: int | None = None) -> Leaves:
        dealt = df.repartitionByRange(*([leaves] if leaves else []), F.col(key)).sortWithinPartitions(key)
        dealt.write.parquet(path)
        return cls(df.sparkSession, path, key, df.schema)

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def get(self, key) -> DataFrame:
        return self.table().where(F.col(self.key) == key)

    def range(self, low, high) -> DataFrame:
        return self.table().where(F.col(self.key).between(low, high))

    def put(self, more: DataFrame, seq: str, path: str) -> Leaves:
        """A new index at path with more rows; of equal keys the row of the largest seq stays."""
        both = self.table().unionByName(more.select(*self.table().columns))
        newest = both.groupBy(self.key).agg(F.max_by(F.struct(*both.columns), seq).alias("x")).select("x.*")
        return Leaves.build(newest, self.key, path)

    def nodes(self) -> DataFrame:
        """leaf, n, low, high: what an inner level holds of each leaf."""
        return self.table().groupBy(F.input_file_name().alias("leaf")).agg(F.count("*").alias("n"), F.min(self.key).alias("low"), F.max(self.key).alias("high"))

    def invariants(self) -> DataFrame:
        """sorted, disjoint, n: whether each leaf is in order of the key, whether no leaf's range meets another's, and the number of rows. Leaves are few: a row a file."""
        at = self.table().select(F.input_file_name().alias("leaf"), F.monotonically_increasing_id().alias("__at"), F.col(self.key).alias("__k"))
        before = F.lag("__k").over(Window.partitionBy("leaf").orderBy("__at"))
        inner = at.select((F.col("__k") < before).alias("back")).agg((F.count_if("back") == 0).alias("sorted"), F.count("*").alias("n"))
        apart = self.nodes().select("low", F.lag("high").over(Window.orderBy("low")).alias("end")).agg((F.count_if(F.col("low") < F.col("end")) == 0).alias("disjoint"))
        return inner.join(apart).select("sorted", "disjoint", "n")


def _below(key: str, bounds: Iterable) -> Column:
    """How many of the bounds are smaller than the key; null for a null key. A search tree, so that a row is compared with few of many bounds."""
    b = sorted(bounds, key=lambda x: (x != x, x))  # NaN is the largest

    def tree(low: int, high: int) -> Column:
        m = (low + high) // 2
        return F.lit(low).cast("long") if low == high else F.when(F.col(key) > b[m], tree(m + 1, high)).otherwise(tree(low, m))

    return F.when(F.col(key).isNotNull(), tree(0, len(b)))


def equi_depth(df: DataFrame, key: str, bounds: list[float]) -> DataFrame:
    """partition, n: rows between learned bounds (ascending); the first partition is 0, that of null keys is null."""
    return df.groupBy(_below(key, bounds).alias("partition")).agg(F.count("*").alias("n"))


def depth_bounds(df: DataFrame, key: str, parts: int, accuracy: int = 10_000) -> list:
    """Boundaries of partitions of equal depth: of n keys, nulls left out, the one at rank ceil(k n / parts) for each k below parts.

    They are exact at any accuracy. Cuts from a sketch enclose each rank, all keys between cuts are counted, and those between the
    cuts around a rank (about n / accuracy for each, more if the sketch is off) are ranked. Counts between cuts and parts - 1 keys reach the driver.
    """
    keys = df.select(F.col(key).alias("__k")).where("__k is not null")
    near = [min(max(k / parts + e / accuracy, 0.0), 1.0) for k in range(1, parts) for e in (-2, 2)]
    cuts = near and set(keys.agg(F.percentile_approx("__k", near, accuracy)).first()[0] or [])
    if not cuts:
        return []
    counts = dict(map(tuple, equi_depth(keys, "__k", cuts).collect()))
    n, before, kept, slots, places = sum(counts.values()), 0, 0, [], []
    ranks = [-(-k * n // parts) for k in range(1, parts)]
    for slot, c in sorted(counts.items()):
        if here := [r - before + kept for r in ranks if before < r <= before + c]:
            slots.append(slot)
            places += here
            kept += c
        before += c
    some = keys.where(_below("__k", cuts).isin(slots)).groupBy("__k").agg(F.count("*").alias("__c"))
    upto = prefix(some, [F.col("__k")], {"__n": (F.sum("__c"), F.sum("__c"))}, {"__n": (F.sum, add)})
    return list(upto.agg(*[F.min(F.when(F.col("__n") >= r, F.col("__k"))).alias(f"b{k}") for k, r in enumerate(places)]).first())


class RadixTrie:
    """A trie of fixed depth over digits of a key: `levels` columns of digits base fan-out, the highest first, so that a prefix is a conjunction of equalities.

    mapping gives the number whose digits are taken, for instance a hash or a string's code; keys at or beyond fan-out to the power of
    levels don't fit and are an error when they are read.
    """

    def __init__(self, fan_out: int, levels: int, mapping=lambda c: c):
        if fan_out < 2 or levels < 1:
            raise ValueError("a trie needs two children a node and one level at least")
        self.fan_out, self.levels, self.mapping = fan_out, levels, mapping

    def digits(self, key: Column) -> list[Column]:
        x = self.mapping(key).cast("long")
        fits = F.when((x >= 0) & (x < self.fan_out**self.levels), x).otherwise(F.raise_error(F.concat(F.lit("key doesn't fit the trie: "), x.cast("string"))).cast("long"))
        return [(F.floor(fits / self.fan_out ** (self.levels - 1 - k)) % self.fan_out).cast("long") for k in range(self.levels)]

    def route(self, df: DataFrame, key: str) -> DataFrame:
        """df with d1, d2, ...: the child that is taken at each level. Null keys have null digits."""
        return df.withColumns({f"d{k + 1}": F.when(F.col(key).isNotNull(), d) for k, d in enumerate(self.digits(F.col(key)))})

    def get(self, routed: DataFrame, key: str, value) -> DataFrame:
        """All rows of a key: its path, then the key itself, as several may share a path where the mapping isn't one to one."""
        path = self.digits(F.lit(value))
        on = F.col(key) == value
        for k, d in enumerate(path):
            on &= F.col(f"d{k + 1}") == d
        return routed.where(on)

    def nodes(self, routed: DataFrame) -> DataFrame:
        """level, prefix, n: the nodes of all levels with the keys below them, prefix as the number of its digits. One pass; counts are added up before the shuffle."""
        digits = [F.col(f"d{k + 1}") for k in range(self.levels)]
        prefix, nodes = F.lit(0).cast("long"), []
        for k, d in enumerate(digits):
            prefix = prefix * self.fan_out + d
            nodes.append(F.struct(F.lit(k + 1).alias("level"), prefix.alias("prefix")))
        return routed.select(F.explode(F.array(*nodes)).alias("x")).select("x.*").groupBy("level", "prefix").agg(F.count("*").alias("n"))


def fitting_levels(df: DataFrame, key: str, fan_out: int) -> int:
    """Levels of a trie that holds the largest key; one number reaches the driver."""
    top, levels = df.agg(F.max(key)).first()[0] or 0, 1
    while fan_out**levels <= top:
        levels += 1
    return levels


# Learned index: splines from the smallest to the largest key of a model


def spline(df: DataFrame, key: str, pos: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min(key).alias("k0"), F.max(key).alias("k1"), F.min(pos).alias("p0"), F.max(pos).alias("p1"))


def predicted(key: str) -> Column:
    """Position that a spline predicts; its first position where all its keys are equal."""
    slope = (F.col("p1") - F.col("p0")) / F.when(F.col("k1") == F.col("k0"), None).otherwise(F.col("k1") - F.col("k0"))
    return F.col("p0") + F.coalesce((F.col(key) - F.col("k0")) * slope, F.lit(0.0))


def learned_positions(df: DataFrame, key: str, models: int = 1) -> DataFrame:
    """df with pos, model, pred and err of a recursive index of a root and `models` leaves."""
    at = lower_bound(df, key)
    n = at.agg(F.count("*").alias("n"))
    root = spline(at, key, "pos")
    one = at.join(F.broadcast(root)).join(F.broadcast(n)).withColumn("first", predicted(key)).drop("k0", "k1", "p0", "p1")
    leaf = F.least(F.lit(models - 1), F.greatest(F.lit(0), F.floor(F.col("first") / F.col("n") * models))).cast("int")
    one = one.withColumn("model", leaf).drop("first", "n")
    if models == 1:
        out = one.join(F.broadcast(root))
    else:
        out = one.join(F.broadcast(spline(one, key, "pos", "model")), "model")
    return out.withColumn("pred", predicted(key)).withColumn("err", F.abs(F.col("pred") - F.col("pos"))).drop("k0", "k1", "p0", "p1")


def layer_sizes(layers: int, models: int) -> list[int]:
    """Models of each layer of a recursive index: 1, 3, 5, ... at least, and of the rest layer i gets i for each 1 of layer 1, the last layers first.

    Fewer models than the least give the least.
    """
    sizes = [2 * i + 1 for i in range(layers)]
    spare = max(0, models - sum(sizes))
    if layers == 1:
        return [1 + spare]
    rounds, spare = divmod(spare, layers * (layers - 1) // 2)
    for i in range(layers - 1, 0, -1):
        rest = min(i, spare)
        sizes[i], spare = sizes[i] + rounds * i + rest, spare - rest
    return sizes


def search_steps(err: Column, n: Column) -> dict[str, Column]:
    """Keys that a search looks at, at most, to find a position that a prediction misses by err among n: one by one, by halving everything, by doubling steps from the prediction."""
    steps = F.ceil(F.log2(F.ceil(err) + 1))
    return {"linear": F.ceil(err).cast("long") + 1, "binary": F.ceil(F.log2(n + F.lit(1))).cast("long"), "exponential": (2 * steps + 1).cast("long")}


def lower_bounds(df: DataFrame, key: str, values: list[float]) -> DataFrame:
    """value, pos: the number of keys below each value, for all values in one pass."""
    row = df.agg(*[F.count_if(F.col(key) < v).alias(f"v{i}") for i, v in enumerate(values)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(float(v)).alias("value"), F.col(f"v{i}").alias("pos")) for i, v in enumerate(values)])).alias("x")).select("x.*")


def gate_platform(id_: Column, levels: int, gates: int) -> Column:
    """The leaf that a train reaches whose number's bits, lowest first, set the gates of a binary tree; `gates` flips them by level."""
    bit = [F.shiftright(id_, k).bitwiseAND(F.lit(1)).bitwiseXOR(F.lit((gates >> k) & 1)) for k in range(levels)]
    return sum((F.shiftleft(b, levels - 1 - k) for k, b in enumerate(bit)), F.lit(0))
