"""Token ids in a content-addressed store: chunks cut by a rolling hash, stored once; recipes and Merkle manifests rebuild documents.

Files of a store, all Parquet:
  chunks/    hash binary (sha-256 of ids), n int, ids binary (little-endian unsigned 16 or 32-bit): one row a distinct chunk
  recipes/   rank long, doc_id long, start long, n_tokens long, hashes array<binary>, ns array<int>, root binary: in ascending doc_id
  manifest/  level int, node long, root binary: the Merkle tree over the documents' roots, FAN documents or nodes a node
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialise, mix, new_path, small_or_shuffled
from .pieces import CACHE_BYTES, Words, flat, gather, plain, work

#: A chunk ends where the hash of the last SPAN ids has MASK's bits clear, after LEAST ids at least and MOST at most.
SPAN, MASK, LEAST, MOST = 16, (1 << 9) - 1, 128, 4096
FAN = 4096
#: Hashes that a task recalls of the chunks that it has sent (some 16 MB).
SENT = 100_000
_ZSTD = {"compression": "zstd"}
_GEAR = np.uint64(0x9E3779B97F4A7C15)


def cuts(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of the chunks of documents whose ids follow each other, up to ends each. A cut depends on the SPAN ids before it and the chunk's begin only.

    SPAN ids reach into the document before only where no cut may be yet, as a chunk has LEAST ids.
    """
    h = mix(ids.astype(np.uint64) + np.uint64(1))
    step, power = 1, int(_GEAR)
    while step < SPAN:
        more = h.copy()
        more[step:] += h[:-step] * np.uint64(power)
        h, step, power = more, step * 2, power * power % (1 << 64)
    found = np.flatnonzero((mix(h) & np.uint64(MASK)) == 0) + 1
    out, begin, places = [], 0, iter(found.tolist())
    c = next(places, None)
    for end in ends.tolist():
        while True:
            here = end if c is None or c >= end else c
            while here - begin > MOST:
                begin += MOST
                out.append(begin)
            if here - begin >= LEAST or here == end > begin:
                begin = here
                out.append(begin)
            if c is None or c > end:
                break
            c = next(places, None)
            if here == end:
                break
    return np.array(out, np.int64)


def root_of(hashes: list[bytes]) -> bytes:
    """Merkle root: pairs are hashed together level by level; a last odd one moves up."""
    level = [hashlib.sha256(b"\0" + h).digest() for h in hashes]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else hashlib.sha256(b"").digest()


def _alphabet() -> dict[int, int]:
    """The byte-level alphabet: visible characters of Latin-1 stand for their bytes, further ones for the rest; line feeds part pieces here."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted({*range(256)} - {*seen})
    return {x: x for x in seen} | {b: 256 + k for k, b in enumerate(rest) if b != 10}


_ALPHABET = _alphabet()


class Encoder:
    """The tokenizers library behind a cache of words.

    Where the file splits by the usual pattern, plain words that the cache lacks are parted here and their pieces go to the
    library's model, as its matching of the pattern costs more than its merging; other words go to the library together, parted by
    line feeds. Texts of other files go to the library as they are.
    """

    def __init__(self, path: str, room: int = 2 * CACHE_BYTES):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        usual = form["pre_tokenizer"] or {}
        usual = usual.get("type") == "ByteLevel" and usual.get("use_regex", True) and not usual.get("add_prefix_space") and form["model"]["type"] == "BPE"
        usual = usual and not form["normalizer"] and not form["model"].get("dropout") and all(t["special"] for t in form["added_tokens"])
        self.library.encode_special_tokens = True
        self.type = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.feed = 0
        if usual:
            self.model = Tokenizer.from_file(path).model
            self.model._resize_cache(0)  # the cache of words is here
            (self.feed,) = self.library.encode("\n", add_special_tokens=False).ids
        self.words = Words(self._words, self._whole, self.feed, self.type, usual, room)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.type)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.type) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: pa.Array, easy: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data, edge = flat(words)
        cut = np.unique(np.concatenate([edge, mark[easy]]))
        pieces = pa.Array.from_buffers(pa.large_string(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(data)])
        hard = np.searchsorted(cut, edge[:-1][~easy])  # words that aren't plain
        some = np.ones(len(cut) - 1, bool)
        some[hard] = False
        coded = pieces.filter(pa.array(some)).dictionary_encode()
        ids, upto = self._pieces(coded.dictionary)
        odd, more = self._odd([pieces[i].as_py() for i in hard.tolist()])
        start, size = np.zeros(len(cut) - 1, np.int64), np.zeros(len(cut) - 1, np.int64)
        index = coded.indices.to_numpy()
        start[some], size[some] = upto[:-1][index], np.diff(upto)[index]
        start[hard], size[hard] = len(ids) + more[:-1], np.diff(more)
        ids, at = gather(np.concatenate([ids, odd]), start, size)
        return ids, at[np.searchsorted(cut, edge)]

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of pieces, by the library's model alone."""
        text = b"\n".join(pieces.cast(pa.large_binary()).to_numpy(zero_copy_only=False)).decode("latin-1").translate(_ALPHABET)
        found = [[t.id for t in self.model.tokenize(x)] for x in text.split("\n")] if len(pieces) else []
        return np.fromiter(chain.from_iterable(found), self.type), np.r_[0, np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))]

    def _odd(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of words that the library parts itself."""
        ids, ends, done = [np.zeros(0, self.type)], [np.zeros(1, np.int64)], 0
        for at in range(0, len(words), 5000):
            own = self._ids("\n".join(words[at : at + 5000]) + "\n")
            feeds = np.flatnonzero(own == self.feed)
            ends.append(feeds - np.arange(len(feeds)) + done)
            ids.append(own[own != self.feed])
            done += len(ids[-1])
        return np.concatenate(ids), np.concatenate(ends)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each text (large_string, no nulls) and the end id, one text after the other, and where each text ends."""
        ids, at = self.words.ids(texts)
        ends = at[1:] + np.arange(1, len(at))
        own = np.ones(len(ids) + len(texts), bool)
        own[ends - 1] = False
        out = np.full(len(own), end_id, self.type)
        out[own] = ids
        return out, ends


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a process."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


#: What a task of write_store gives: recipes (hash null) and chunks (hashes null).
_STAGED = "doc_id long, hashes array<binary>, ns array<int>, root binary, hash binary, n int, ids binary"
_FIELDS = [pa.field("doc_id", pa.int64()), pa.field("hashes", pa.list_(pa.binary())), pa.field("ns", pa.list_(pa.int32())), pa.field("root", pa.binary()), pa.field("hash", pa.binary()), pa.field("n", pa.int32()), pa.field("ids", pa.binary())]


def _rows(**columns: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in _FIELDS], schema=pa.schema(_FIELDS))


def _staged(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        sent: set[bytes] = set()
        w = enc.type.itemsize
        for b in batches:
            done = 0
            for texts in work(b.column(1)):
                docs = b.column(0).slice(done, len(texts))
                done += len(texts)
                ids, ends = enc.encode(texts, end_id)
                cut = cuts(ids, ends)
                raw, at = ids.tobytes(), [0, *(cut * w).tolist()]
                parts = [raw[x:y] for x, y in zip(at, at[1:])]
                names = [hashlib.sha256(p).digest() for p in parts]
                ns = np.diff(np.r_[0, cut]).astype(np.int32)
                own = np.r_[0, np.searchsorted(cut, ends) + 1].astype(np.int32)  # chunks up to each document
                roots = [root_of(names[x:y]) for x, y in zip(own.tolist(), own[1:].tolist())]
                hashes = pa.array(names, pa.binary())
                yield _rows(doc_id=docs, hashes=pa.ListArray.from_arrays(own, hashes), ns=pa.ListArray.from_arrays(own, pa.array(ns)), root=pa.array(roots, pa.binary()))
                new = []
                for i, h in enumerate(names):
                    if h not in sent:  # once a task, as far as a bounded set recalls
                        if len(sent) < SENT:
                            sent.add(h)
                        new.append(i)
                if new:
                    yield _rows(hash=hashes.take(pa.array(new)), n=pa.array(ns[new]), ids=pa.array([parts[i] for i in new], pa.binary()))

    return run


def write_store(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 0) -> str:
    """Encodes each row of docs(doc_id long, text string) with the tokenizers library, adds end_id, and writes a store at path.

    Documents are in ascending doc_id order (null first, then equal ids by content); start counts the ids of all documents
    before. Null and empty texts have the end id alone; an empty table gives empty files. Other columns are ignored. Equal
    chunks are stored once however many documents hold them; within a task they aren't even shuffled. Returns the path.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "store")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    staged = materialise(bounded_batches(rows).mapInArrow(_staged(tokenizer, end_id), _STAGED).withColumn("task", F.spark_partition_id()), "staged", **_ZSTD)
    _write_chunks(staged, f"{path}/chunks")
    ranked = _write_recipes(staged.where("hashes is not null").select("doc_id", "hashes", "ns", "root"), f"{path}/recipes")
    discard(staged)
    _write_manifest(ranked, f"{path}/manifest")
    return path


def _write_chunks(staged: DataFrame, path: str) -> None:
    """Of the tasks that have a chunk, the first keeps it. Only hashes are shuffled to find the others."""
    chunks = staged.where("hash is not null")
    twice = chunks.groupBy("hash").agg(F.min("task").alias("task"), F.count("*").alias("c")).where("c > 1").select("hash", F.col("task").alias("first"))
    twice = materialise(twice, "twice")
    out = chunks.join(small_or_shuffled(twice, twice.count()), "hash", "left").where("first is null or first = task")
    # A task's memory of chunks is bounded, so a chunk may be in one task twice.
    own = materialise(chunks.groupBy("hash", "task").agg(F.count("*").alias("c")).where("c > 1").select("hash"), "own")
    if own.isEmpty():
        out.select("hash", "n", "ids").write.options(**_ZSTD).parquet(path)
    else:
        out.select("hash", "n", "ids").dropDuplicates(["hash"]).write.options(**_ZSTD).parquet(path)
    discard(twice, own)


def _write_recipes(refs: DataFrame, path: str) -> DataFrame:
    total = F.aggregate("ns", F.lit(0).cast("long"), lambda a, x: a + x)
    sorted_ = refs.withColumn("n_tokens", total).repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("root")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root")
    sorted_ = materialise(sorted_.withColumn("part", F.spark_partition_id()), "sorted", **_ZSTD)
    sums = sorted_.groupBy("part").agg(F.count("*").alias("c"), F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row a partition
    before, done = [], [0, 0]
    for r in sums:
        before.append((r["part"], *done))
        done = [done[0] + r["c"], done[1] + r["n"]]
    offsets = F.broadcast(refs.sparkSession.createDataFrame(before, "part int, c0 long, n0 long"))
    w = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "root")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    small = sorted_.select("part", "doc_id", "root", "n_tokens", "hashes", "ns").withColumns({"r": F.row_number().over(w), "s": F.sum("n_tokens").over(upto)})
    out = small.join(offsets, "part").select((F.col("c0") + F.col("r") - 1).alias("rank"), "doc_id", (F.col("n0") + F.col("s") - F.col("n_tokens")).alias("start"), "n_tokens", "hashes", "ns", "root")
    out.write.options(**_ZSTD).parquet(path)
    discard(sorted_)
    return refs.sparkSession.read.schema(out.schema).parquet(path)


def _parents(nodes: DataFrame) -> DataFrame:
    """node, root of the level above node, root."""
    up = nodes.groupBy(F.floor(F.col("node") / FAN).cast("long").alias("up")).agg(F.array_sort(F.collect_list(F.struct("node", "root"))).alias("x"))
    return up.select(F.col("up").alias("node"), F.unhex(F.sha2(F.expr("concat_ws('', transform(x, y -> hex(y.root)))").cast("binary"), 256)).alias("root"))


def _write_manifest(recipes: DataFrame, path: str) -> None:
    level, nodes = 0, recipes.select(F.col("rank").alias("node"), "root")
    while True:
        up = _parents(nodes).select(F.lit(level).alias("level"), "node", "root")
        up.write.mode("append").options(**_ZSTD).parquet(path)
        nodes = recipes.sparkSession.read.schema(up.schema).parquet(path).where(F.col("level") == level).select("node", "root")
        if nodes.where("node > 0").isEmpty():
            return
        level += 1


def _sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes as they are, if their roots and token counts are those of their chunks."""
    for b in batches:
        rank, n_tokens, hashes, ns, root = (b.column(k).to_pylist() for k in ("rank", "n_tokens", "hashes", "ns", "root"))
        for r, n, h, k, own in zip(rank, n_tokens, hashes, ns, root):
            if not h or root_of(h) != own or len(k) != len(h) or sum(k) != n:
                raise ValueError(f"recipe {r} is damaged")
        yield b


def _kind(n_bytes: int, n: int) -> str:
    """The type of n ids in so many bytes, so that a store needn't be told its vocabulary."""
    return "<u2" if n_bytes == 2 * n else "<u4"


class Store:
    """Reads a store and verifies it: chunks against their hashes and recipes, recipes against their roots, roots against the manifest.

    The manifest and the starts are checked when a reader is called, the rest as rows are read. What is missing or differs is an error.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.chunks = spark.read.schema("hash binary, n int, ids binary").parquet(f"{path}/chunks")
        self.recipes = spark.read.schema("rank long, doc_id long, start long, n_tokens long, hashes array<binary>, ns array<int>, root binary").parquet(f"{path}/recipes")
        self.manifest = spark.read.schema("level int, node long, root binary").parquet(f"{path}/manifest")

    def _check_manifest(self) -> None:
        level, nodes = 0, self.recipes.select(F.col("rank").alias("node"), "root")
        while True:
            stored = self.manifest.where(F.col("level") == level).select("node", "root")
            both = _parents(nodes).join(stored.withColumnRenamed("root", "stored"), "node", "full")
            seen = both.agg(F.count_if(~F.col("root").eqNullSafe(F.col("stored"))).alias("wrong"), F.max("node").alias("last")).first()
            if seen.wrong:
                raise ValueError(f"{seen.wrong} nodes of level {level} of the manifest differ from the recipes")
            if not seen.last:
                break
            level, nodes = level + 1, stored
        if not self.manifest.where(F.col("level") > level).isEmpty():
            raise ValueError("the manifest has levels that the recipes don't")
        before = self.recipes.select((F.col("rank") + 1).alias("rank"), (F.col("start") + F.col("n_tokens")).alias("end"))
        end = F.coalesce("end", F.when(F.col("rank") == 0, 0))
        wrong = self.recipes.select("rank", "start").join(before, "rank", "left").where(~F.col("start").eqNullSafe(end)).count()
        if wrong:
            raise ValueError(f"{wrong} recipes don't start where the one before ends")

    def _pieces(self) -> DataFrame:
        self._check_manifest()
        recipes = self.recipes.mapInArrow(_sound, self.recipes.schema)
        r = recipes.select("rank", "doc_id", "start", "n_tokens", F.posexplode("hashes").alias("pos", "hash"), "ns")
        after = F.aggregate(F.slice("ns", F.col("pos") + 2, F.size("ns")), F.lit(0).cast("long"), lambda a, x: a + x)
        return r.select("rank", "doc_id", "start", F.col("n_tokens").alias("want"), "pos", "hash", F.get("ns", F.col("pos")).cast("long").alias("own"), after.alias("after"))

    @staticmethod
    def _whole(each: DataFrame, *aggregates: Column) -> DataFrame:
        """Pieces with the n of their chunks, added up by document; an error where a chunk is missing or the numbers of tokens differ."""
        bad = F.min(F.when(~F.col("n").eqNullSafe(F.col("own")), F.hex("hash"))).alias("bad")
        out = each.groupBy("rank", "doc_id", "start", "want").agg(F.sum("n").alias("n_tokens"), bad, *aggregates)
        error = F.raise_error(F.concat(F.lit("document of rank "), F.col("rank").cast("string"), F.lit(" is damaged: missing or wrong chunk "), F.coalesce("bad", F.lit("or a repeated one"))))
        return out.where(F.when(F.col("bad").isNotNull() | (F.col("n_tokens") != F.col("want")), error.cast("boolean")).otherwise(True)).drop("want", "bad")

    def checksums(self) -> DataFrame:
        """rank, doc_id, start, n_tokens, ids_crc32, from the files: each chunk is read once, its CRC moved to its place in a document.

        crc(a + b) = crc(a) * x^(8 * bytes of b) + crc(b) over GF(2), so a document's CRC is the sum of its chunks' moved CRCs,
        and no ids are shuffled.
        """

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                crc = []
                for h, n, raw in zip(*(b.column(k).to_pylist() for k in ("hash", "n", "ids"))):
                    if len(raw) not in (2 * n, 4 * n) or hashlib.sha256(raw).digest() != h:
                        raise ValueError(f"chunk {h.hex()} is damaged")
                    crc.append(zlib.crc32(np.frombuffer(raw, _kind(len(raw), n)).astype("<u4").tobytes()))
                yield pa.RecordBatch.from_pydict({"hash": b.column("hash"), "crc": np.array(crc, np.int64), "n": b.column("n").cast(pa.int64())})

        @F.pandas_udf("long")
        def moved(crc: pd.Series, after: pd.Series) -> pd.Series:
            return pd.Series(times(crc.to_numpy().astype(np.uint32), shift(4 * after.to_numpy().astype(np.int64))).astype(np.int64))

        crc = bounded_batches(self.chunks).select("hash", "n", "ids").mapInArrow(read, "hash binary, crc long, n long")
        each = self._pieces().join(crc, "hash", "left").withColumn("term", moved(F.coalesce("crc", F.lit(0).cast("long")), "after"))
        return self._whole(each, F.bit_xor("term").alias("ids_crc32"))

    def documents(self) -> DataFrame:
        """rank, doc_id, start, ids array<int>: the documents, rebuilt from their recipes."""

        @F.pandas_udf("array<int>")
        def ids(raw: pd.Series, n: pd.Series) -> pd.Series:
            return pd.Series([np.frombuffer(x, _kind(len(x), k)).astype(np.int32) for x, k in zip(raw, n)], dtype=object)

        sound = (F.sha2("ids", 256) == F.lower(F.hex("hash"))) & F.octet_length("ids").isin(F.col("n") * 2, F.col("n") * 4)
        chunks = self.chunks.select("hash", "ids", F.when(sound, F.col("n").cast("long")).alias("n"))  # a damaged chunk is as good as missing
        each = self._whole(self._pieces().join(chunks, "hash", "left"), F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("x"))
        return each.withColumn("raw", F.expr("unhex(concat_ws('', transform(x, y -> hex(y.ids))))")).select("rank", "doc_id", "start", ids("raw", "n_tokens").alias("ids"))


_POLY = np.uint32(0xEDB88320)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo CRC-32's, bit-reversed, elementwise."""
    a, b = np.broadcast_arrays(np.asarray(a, np.uint32), np.asarray(b, np.uint32))
    p, b = np.zeros(a.shape, np.uint32), b.copy()
    for k in range(31, -1, -1):
        p ^= np.where((a >> np.uint32(k)) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), (b >> np.uint32(1)) ^ _POLY, b >> np.uint32(1))
    return p


def shift(n_bytes: np.ndarray) -> np.ndarray:
    """x^(8 n) modulo CRC-32's polynomial, elementwise."""
    distinct, back = np.unique(n_bytes, return_inverse=True)
    out = np.full(len(distinct), 1 << 31, np.uint32)
    square = np.array([1 << 30], np.uint32)  # x
    for _ in range(3):
        square = times(square, square)
    left = distinct.copy()
    while left.any():
        out = np.where(left & 1, times(out, square), out)
        square, left = times(square, square), left >> 1
    return out[back]
