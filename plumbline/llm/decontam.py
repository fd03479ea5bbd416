"""Benchmark decontamination: one Aho-Corasick automaton over windows of benchmark words, one scan of each text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Table
from .common import bounded_batches, lean
from .pieces import flat, gather, work
from .words import words

WINDOW = 10
#: Words of a benchmark that an automaton may have. It is read by the driver and broadcast; each word takes up to WINDOW states of some 45 bytes.
MAX_WORDS = 4_000_000
#: Words that a row of a scan advances by; a batch's rows are scanned side by side.
STEP = 128

_TO_SPACE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_RESULT = {"n_words": "long", "n_hit": "long", "items": "array<string>", "spans": "array<struct<start: int, end: int>>"}


def normal(text: bytes) -> bytes:
    """Lower-cased A-Z; what isn't in a word [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ becomes a space, so offsets stay."""
    return text.lower().translate(_TO_SPACE)


class Automaton:
    """Aho-Corasick over word ids, in arrays. State 0 is the root; a state's child for a word is found by state * n + word.

    A window is `size` consecutive words of an item; an item of fewer words, but not none, is one window. Words are told by
    64-bit hashes, which are distinct for the benchmark's; scan() compares the bytes of what it hits.
    """

    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW):
        self.size, self.text = size, {}
        parts, owner = [], []
        for k, (_, text) in enumerate(items):
            buf = normal(text.encode("utf-8", "surrogatepass"))
            h, start, end = words(buf)
            for x, s, e in zip(h.tolist(), start.tolist(), end.tolist()):
                if self.text.setdefault(x, buf[s:e]) != buf[s:e]:
                    raise ValueError("two words of the benchmark have one hash")
            parts.append(h)
            owner.append(np.full(len(h), k, np.int64))
        flow, owner = (np.concatenate([np.zeros(0, t), *p]) for p, t in ((parts, np.uint64), (owner, np.int64)))
        known = np.unique(flow)
        self.n = len(known) + 1
        self.hashes = [None, *known.tolist()]
        self.vocabulary = Table((known >> np.uint64(1)).astype(np.int64), np.arange(1, self.n, dtype=np.int32)) if len(np.unique(known >> np.uint64(1))) == len(known) else None
        if self.vocabulary is None:
            raise ValueError("two words of the benchmark have one hash")
        word = np.searchsorted(known, flow).astype(np.int64) + 1
        self._build(items, word, owner)

    def _build(self, items: list[tuple[str, str]], word: np.ndarray, owner: np.ndarray) -> None:
        length = np.bincount(owner, minlength=len(items)) if len(items) else np.zeros(0, np.int64)
        first = np.cumsum(length) - length
        place = np.arange(len(word)) - first[owner]
        start = np.flatnonzero((place == 0) | (place + self.size <= length[owner]))
        deep = np.minimum(self.size, length[owner[start]])
        node, top = np.zeros(len(start), np.int64), 1
        keys, parents, depth = [], [np.zeros(1, np.int64)], [np.zeros(1, np.int8)]
        for d in range(self.size):
            on = np.flatnonzero(deep > d)
            new, back = np.unique(node[on] * self.n + word[start[on] + d], return_inverse=True)
            node[on] = top + back
            keys.append(new)
            parents.append(new // self.n)
            depth.append(np.full(len(new), d + 1, np.int8))
            top += len(new)
        edge = np.concatenate([np.zeros(0, np.int64), *keys])
        self.child = Table(edge, np.arange(1, top, dtype=np.int32))
        self.depth, parent = np.concatenate(depth), np.concatenate(parents)
        self.fail = np.zeros(top, np.int32)
        at = 1
        for d, new in enumerate(keys):  # by depth: states above have their links already
            own = np.arange(at, at + len(new))
            at += len(new)
            if d:
                self.fail[own] = self.follow(self.fail[parent[own]].astype(np.int64), new % self.n)
        ends, found = np.unique(node, return_inverse=True) if len(node) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        final = np.zeros(top, bool)
        final[ends] = True
        #: The longest window that ends in a state, and the next shorter one.
        self.ends, self.shorter = np.zeros(top, np.int32), np.zeros(top, np.int32)
        at = 1
        for new in keys:
            own = np.arange(at, at + len(new))
            at += len(new)
            self.shorter[own] = self.ends[self.fail[own]]
            self.ends[own] = np.where(final[own], own, self.shorter[own])
        pairs = np.unique(np.column_stack([ends[found], owner[start]]), axis=0) if len(node) else np.zeros((0, 2), np.int64)
        self.items = [i for i, _ in items]
        self.owned, self.owner = pairs[:, 0], pairs[:, 1].astype(np.int32)

    def follow(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The next states: that of the longest suffix which goes on with the word."""
        out, on = np.zeros(len(state), np.int64), np.flatnonzero(word > 0)
        state = state[on]
        while len(on):
            to = self.child.get(state * self.n + word[on])
            out[on] = np.maximum(to, 0)
            more = (to < 0) & (state > 0)
            on, state = on[more], self.fail[state[more]].astype(np.int64)
        return out

    def occurrences(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of its last word, state) of each window in a flow of word ids; 0 is no word of the benchmark. Windows may come twice."""
        rows = max(1, -(-len(word) // STEP))
        flow = np.zeros(rows * STEP + self.size, np.int64)
        flow[: len(word)] = word
        at = np.arange(rows) * STEP
        state, where, what = np.zeros(rows, np.int64), [], []
        for k in range(STEP + self.size - 1):  # a row goes on into the next for the windows that begin in it
            state = self.follow(state, flow[at + k])
            hit = np.flatnonzero(self.ends[state])
            if len(hit):
                where.append(at[hit] + k)
                what.append(self.ends[state[hit]].astype(np.int64))
        where, what = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (where, what))
        more, also = where, what
        while len(more := more[(also := self.shorter[also].astype(np.int64)) > 0]):
            also = also[also > 0]
            where, what = np.r_[where, more], np.r_[what, also]
        return where, what

    def scan(self, texts: pa.Array) -> pa.StructArray:
        """n_words, n_hit, items and spans (code points of the original) of texts (large_string, no nulls)."""
        data, cut = flat(pc.binary_join_element_wise(texts, _EMPTY, _SPACE))  # each text and a space
        buf = normal(data.tobytes())
        h, start, end = words(buf)
        first = np.searchsorted(start, cut)
        n = np.diff(first)
        doc = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(h)) + doc  # with a word of no kind between texts
        word = self.vocabulary.get((h >> np.uint64(1)).astype(np.int64)).astype(np.int64)
        word = np.maximum(word, 0)
        while True:
            flow = np.zeros(len(h) + len(n) + 1, np.int64)
            flow[place] = word
            where, what = self.occurrences(flow)
            delta = np.zeros(len(flow) + 1, np.int64)
            np.add.at(delta, where - self.depth[what] + 1, 1)
            np.add.at(delta, where + 1, -1)
            hit = np.flatnonzero(np.cumsum(delta)[place] > 0)
            same = np.array([self.text[self.hashes[word[i]]] == buf[start[i] : end[i]] for i in hit.tolist()], bool)
            if same.all():
                break
            word[hit[~same]] = 0  # another word of the same hash
        n_hit = np.bincount(doc[hit], minlength=len(n))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(n_hit, pa.int64()), self._items(len(n), np.searchsorted(place, where), what, doc), _spans(data, cut, start, end, doc, hit)], list(_RESULT))

    def _items(self, n: int, where: np.ndarray, what: np.ndarray, doc: np.ndarray) -> pa.Array:
        """The distinct items of each text's windows, as strings in order."""
        pairs = np.unique(np.column_stack([doc[where], what]), axis=0) if len(where) else np.zeros((0, 2), np.int64)
        lo, hi = np.searchsorted(self.owned, pairs[:, 1]), np.searchsorted(self.owned, pairs[:, 1], "right")
        own, upto = gather(self.owner, lo, hi - lo)
        found: dict[int, set[str]] = {}
        for d, k in zip(np.repeat(pairs[:, 0], np.diff(upto)).tolist(), own.tolist()):
            found.setdefault(d, set()).add(self.items[k])
        return pa.array([sorted(found[i]) if i in found else [] for i in range(n)], pa.list_(pa.string()))


_EMPTY, _SPACE = (pa.scalar(x, pa.large_string()) for x in ("", " "))


def _spans(data: np.ndarray, cut: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, hit: np.ndarray) -> pa.Array:
    """The stretches of hit words of each text, as offsets of code points in it."""
    head = np.flatnonzero(np.r_[True, (np.diff(hit) > 1) | (np.diff(doc[hit]) > 0)]) if len(hit) else np.zeros(0, np.int64)
    tail = np.r_[head[1:] - 1, len(hit) - 1] if len(head) else head
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)] if len(hit) else np.zeros(len(data) + 1, np.int64)
    own = doc[hit[head]]
    sides = [pa.array((points[x] - points[cut[own]]).astype(np.int32)) for x in (start[hit[head]], end[hit[tail]])]
    counts = np.bincount(own, minlength=len(cut) - 1)
    return pa.ListArray.from_arrays(np.r_[0, np.cumsum(counts)].astype(np.int32), pa.StructArray.from_arrays(sides, ["start", "end"]))


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs with n_words, n_hit, items array<string> (in order) and spans array<struct<start, end>> (code points of the original).

    A window is `size` consecutive words of an item of benchmark(item_id, text); a word inside any occurrence of a window is
    hit. Null texts and texts without words: 0 words, nothing hit. Items without words or id are left out; items that share
    an id count as one. An empty benchmark hits nothing. Rows with null ids and repeated rows are rows like others. Other
    columns stay; existing columns of these names are replaced. A benchmark of more than MAX_WORDS words is an error: scan for
    parts of it.
    """
    own = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    if (own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > 2 * MAX_WORDS:  # words take two bytes at least, with their space
        held = own.agg(F.sum(F.size(F.regexp_extract_all(F.lower("text"), F.lit("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), F.lit(0))))).first()[0]
        if held > MAX_WORDS:
            raise ValueError(f"the benchmark has {held} words, more than {MAX_WORDS}; scan for parts of it")
    automaton = Automaton([tuple(r) for r in own.orderBy("item_id", "text").collect()], size)
    sent = docs.sparkSession.sparkContext.broadcast(automaton)

    @F.arrow_udf(", ".join(f"{k} {v}" for k, v in _RESULT.items()))
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with lean():
            for texts in batches:
                parts = [sent.value.scan(part) for part in work(texts)]
                yield pa.concat_arrays(parts) if parts else sent.value.scan(pa.array([], pa.large_string()))

    out = bounded_batches(docs).withColumn("__found", found(F.col("text").cast("string")))
    return out.withColumns({c: F.col(f"__found.{c}") for c in _RESULT}).drop("__found")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs without those in which a window of the benchmark occurs; columns as they were, clashing names too. Null texts stay."""
    others = [c for c in docs.columns if c != "text"]
    found = scan(docs.select("text", F.struct(F.lit(0), *others).alias("__row")), benchmark, size)
    return found.where("n_hit = 0").select("text", *[F.col("__row")[c].alias(c) for c in others]).select(*docs.columns)
