"""Byte-level BPE by prefix dynamic programming, and decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, bounded_batches, lean, trim
from .pieces import USUAL, Words, flat, gather, plain, work

#: Entries of the cache of token pairs, and slots of the one that arrays of pairs use.
PAIRS, SLOTS = 50_000, 1 << 19
#: Pieces of more bytes are encoded one by one.
SHORT = 64
#: Ids whose digits and bytes are worked out at a time, where a batch has more (a very long text).
MANY = 2_000_000
#: Bytes of text that digests() works on at a time, where texts are not longer themselves; temporary arrays take some 70 times as many.
SLICE = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Table:
    """A fixed map from distinct int64 keys >= 0 to int32 values, asked by whole arrays: open addressing in numpy."""

    _ODD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (3 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free, first = np.unique(slot, return_index=True)
            first = first[self.keys[free] == -1]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, slot = keys[rest], values[rest], slot[rest] + 1 & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self._ODD) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values, -1 for those it lacks."""
        out = np.full(len(keys), -1, np.int32)
        slot, own, on = self._slot(keys), keys, np.arange(len(keys))
        while len(own):
            there = self.keys[slot]
            hit = there == own
            out[on[hit]] = self.values[slot[hit]]
            more = np.flatnonzero(~hit & (there != -1))
            slot, own, on = slot[more] + 1 & self.last, own[more], on[more]
        return out


class BPE:
    """Encodes pieces of bytes by ranks: the token pair of least rank merges first.

    For each prefix of a piece there is exactly one token that its encoding can end in; it is the one whose bytes end the
    prefix and that may follow the last token of the prefix before it. Two tokens may follow each other if merging their joint
    bytes gives just these two.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pairs: dict[int, bool] = {}  # by left << 32 | right
        self._arrays: Arrays | None = None

    def merge(self, data: bytes) -> list[int]:
        """The encoding by repeated merging; quadratic, for short data only."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            least, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (least is None or r < least):
                    least, at = r, i
            if least is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def follows(self, left: int, right: int) -> bool:
        """Whether right may follow left; left < 0: whether right's own bytes merge to it."""
        ok = self.pairs.get(left << 32 | right)
        if ok is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            want = [right] if left < 0 else [left, right]
            ok = self.pairs[left << 32 | right] = self.merge(b"".join(map(self.tokens.__getitem__, want))) == want
        return ok

    def last_tokens(self, data: bytes, last: list[int]) -> list[int]:
        """Extends last (the last token of each non-empty prefix so far) to all of data, in place."""
        rank, known = self.ranks.get, self.pairs.get
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(max(0, end - self.longest), end):
                t = rank(data[start:end])
                if t is None:
                    continue
                before = last[start - 1] if start else -1
                ok = known(before << 32 | t)
                if self.follows(before, t) if ok is None else ok:
                    last.append(t)
                    break
            else:
                raise ValueError("the ranks lack a byte")
        return last

    def walk(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[last[end - 1]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece; a piece that is a token is that token."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.walk(self.last_tokens(piece, []))

    def encode_all(self, data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces data[edge[i] : edge[i + 1]] one after the other, and the offsets of each piece's; equal pieces are encoded once."""
        if self._arrays is None:
            self._arrays = Arrays(self)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(edge) - 1, [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        own, at = flat(pieces.dictionary)
        ids, upto = self._arrays.encode(own, at)
        index = pieces.indices.to_numpy()
        return gather(ids, upto[index], np.diff(upto)[index])

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Arrays:
    """The same dynamic programming for many short pieces at a time, a byte of all pieces after the other."""

    def __init__(self, bpe: BPE):
        self.bpe = bpe
        n = max(bpe.tokens) + 1
        self.n = n
        self.size = np.zeros(n + 1, np.int64)
        for t, k in bpe.tokens.items():
            self.size[t] = len(k)
        # The tokens' bytes as a tree: node 0 is the root, and a node's child for a byte is at node << 8 | byte.
        node: dict[bytes, int] = {b"": 0}
        keys, token = [], [-1]
        for k in sorted(bpe.ranks):
            for end in range(1, len(k) + 1):
                if k[:end] not in node:
                    node[k[:end]] = len(token)
                    keys.append(node[k[: end - 1]] << 8 | k[end - 1])
                    token.append(bpe.ranks.get(k[:end], -1))
        self.child, self.token = Table(np.array(keys, np.int64), np.arange(1, len(token), dtype=np.int32)), np.array(token, np.int32)
        # What pairs of tokens merge to, and the two parts that each token is made of last.
        left, right, made = [], [], []
        part = np.full((n + 1, 2), -1, np.int64)
        self.alone = np.zeros(n + 1, bool)
        orderly = True
        for k, t in bpe.ranks.items():
            for cut in range(1, len(k)):
                a = bpe.ranks.get(k[:cut])
                b = bpe.ranks.get(k[cut:]) if a is not None else None
                if b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(t)
            split = self._split(k)
            if split is None:
                self.alone[t] = len(k) == 1
                orderly &= len(k) > 1 or t < 256
            else:
                self.alone[t] = True
                part[t] = split
                orderly &= t > max(split)
        self.part = part
        self.made = Table(np.array(left, np.int64) * n + np.array(right, np.int64), np.array(made, np.int32))
        self.memo = np.zeros(SLOTS, np.int64)
        self.orderly = bool(orderly)

    def _split(self, data: bytes) -> tuple[int, int] | None:
        """The two tokens that data is in before its last merge, or None if its bytes don't merge to one token."""
        ranks, parts = self.bpe.ranks, [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            found = [r for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                return None
            both = self.bpe.tokens[min(found)]
            at = next(i for i in range(len(parts) - 1) if parts[i] + parts[i + 1] == both)
            parts[at : at + 2] = [both]
        return (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None

    def _parted(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the border between left and right stands while their bytes merge.

        Seen backwards: at the border stand parts u and v, which are undone in turn, the one made later first. They would merge
        with each other if that had come before the merge which was undone last.
        """
        ok, on = np.ones(len(left), bool), np.arange(len(left))
        u, v, before = left.astype(np.int64), right.astype(np.int64), np.full(len(left), 1 << 40)
        while len(on):
            joint = self.made.get(u * self.n + v)
            crossed = (joint >= 0) & (joint < before)
            ok[on[crossed]] = False
            later = u > v  # of the same token twice, the left one is made first
            a, b = self.part[u, 1], self.part[v, 0]
            go = ~crossed & (np.where(later, a, b) >= 0)
            before = np.where(later, u, v + 1)[go]
            u, v, on = np.where(later, a, u)[go], np.where(later, v, b)[go], on[go]
        return ok

    def follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each right may follow its left; left = n stands for nothing. What was asked lately is remembered."""
        key = left.astype(np.int64) * self.n + right
        slot = ((key.astype(np.uint64) * Table._ODD) >> np.uint64(64 - (SLOTS.bit_length() - 1))).astype(np.int64)
        there = self.memo[slot]
        ok = (there & 1).astype(bool)
        new = np.flatnonzero(there >> 1 != key + 1)
        if len(new):
            some, back = np.unique(key[new], return_inverse=True)
            a, b = np.divmod(some, self.n)
            first = a == self.n
            found = self.alone[b] & (first | self.alone[a])
            ask = np.flatnonzero(found & ~first)
            if self.orderly:
                found[ask] = self._parted(a[ask], b[ask])
            else:
                found[ask] = [self.bpe.follows(x, y) for x, y in zip(a[ask].tolist(), b[ask].tolist())]
            ok[new] = found[back]
            self.memo[slot[new]] = key[new] + 1 << 1 | ok[new]
        return ok

    def encode(self, data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of distinct pieces, see BPE.encode_all. Pieces that are tokens are these tokens."""
        size = np.diff(edge)
        whole = np.full(len(size), -1, np.int64)
        order = np.argsort(-size, kind="stable")
        order = order[(size[order] <= SHORT) & (size[order] > 0)]
        n, k = size[order], len(order)
        deep = int(n[0]) if k else 0
        active = np.searchsorted(-n, -np.arange(deep), "left")  # pieces longer than p
        last = np.full((deep + 1, k), self.n, np.int32)
        row, start, node = (np.zeros(0, np.int64) for _ in range(3))
        for p in range(deep):
            m = active[p]
            on = row < m
            row = np.concatenate([row[on], np.arange(m)])
            start, node = np.concatenate([start[on], np.full(m, p)]), np.concatenate([node[on], np.zeros(m, np.int64)])
            byte = data[edge[order[:m]] + p]
            node = self.child.get(node << 8 | byte[row]).astype(np.int64)
            on = node >= 0
            row, start, node = row[on], start[on], node[on]
            token = self.token[node]
            may = np.flatnonzero(token >= 0)
            r, s, t = row[may], start[may], token[may]
            ok = self.follow(last[s, r], t)
            last[p + 1, r[ok]] = t[ok]
            ends = (s == 0) & (n[r] == p + 1)
            whole[order[r[ends]]] = t[ends]
            if (last[p + 1, :m] == self.n).any():
                raise ValueError("the ranks lack a byte")
        count, at, on, steps = np.zeros(k, np.int64), n.copy(), np.arange(k), []
        token = whole[order]
        done = token >= 0
        at[done] = 0
        count[done] = 1
        on = on[~done]
        while len(on):
            t = last[at[on], on]
            steps.append((on, t))
            at[on] -= self.size[t]
            count[on] += 1
            on = on[at[on] > 0]
        long = {int(i): np.array(self.bpe.encode(data[edge[i] : edge[i + 1]].tobytes()), np.int32) for i in np.flatnonzero(size > SHORT)}
        each = np.zeros(len(size), np.int64)
        each[order] = count
        for i, x in long.items():
            each[i] = len(x)
        upto = np.r_[0, np.cumsum(each)]
        out = np.zeros(upto[-1], np.int32)
        out[upto[:-1][order[done]]] = token[done]
        for back, (on, t) in enumerate(steps):
            out[upto[1:][order[on]] - 1 - back] = t
        for i, x in long.items():
            out[upto[i] : upto[i + 1]] = x
        return out, upto


class Prefixes:
    """A piece under edit: appends and edits recompute only the prefixes that can change."""

    def __init__(self, bpe: BPE, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, data, bpe.last_tokens(data, [])

    def append(self, more: bytes) -> None:
        self.data += more
        self.bpe.last_tokens(self.data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts new in place of data[start:end]; returns how many prefixes were computed.

        A prefix's last token depends on the longest-token bytes and last tokens before it, so once that many agree with the
        old ones behind the edit, all later ones are the old ones.
        """
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[:start]
        agree = 0
        while len(self.last) < len(self.data):
            self.bpe.last_tokens(self.data[: len(self.last) + 1], self.last)
            n = len(self.last)
            before = n - shift
            agree = agree + 1 if n > start + len(new) and before > end and old[before - 1] == self.last[-1] else 0
            if agree >= self.bpe.longest:
                self.last += old[before:]
                return n - start
        return len(self.last) - start

    def ids(self) -> list[int]:
        return self.bpe.walk(self.last)


class Codec:
    """Texts to ids and back, a batch at a time."""

    def __init__(self, ranks_path: str, pattern: str):
        self.bpe = BPE(load_ranks(ranks_path))
        self.pattern = regex.compile(pattern)
        top = max(self.bpe.tokens) + 1
        self.kind = np.dtype(np.uint16 if top <= 1 << 16 else np.uint32)
        told = [b"%d," % i for i in range(top)]
        self.decimal = np.array(told, f"S{max(map(len, told))}").view(np.uint8).reshape(top, -1)  # padded by zeros
        own = [self.bpe.tokens.get(i, b"") for i in range(top)]
        self.bytes, self.at = np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)])
        self.words = Words(self._words, self._whole, int(self._ids([b"\n"])[0]), self.kind, pattern == USUAL)

    def _ids(self, pieces: list[bytes]) -> np.ndarray:
        return self.bpe.encode_all(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([0, *map(len, pieces)]))[0].astype(self.kind)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        """Texts that are matched as they are; the pieces of all are encoded together."""
        pieces, counts = [], [0]
        for t in texts:
            pieces += [m[0].encode("utf-8", "surrogatepass") for m in self.pattern.finditer(t)]
            counts.append(len(pieces))
        ids, upto = self.bpe.encode_all(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([0, *map(len, pieces)]))
        at = upto[counts].tolist()
        ids = ids.astype(self.kind)
        return [ids[a:b] for a, b in zip(at, at[1:])]

    def _words(self, words: pa.Array, easy: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that are plain are parted without matching."""
        data, edge = flat(words)
        cuts = [edge, mark[easy]]
        for i in np.flatnonzero(~easy).tolist():
            cuts.append(edge[i] + np.cumsum([len(m[0].encode()) for m in self.pattern.finditer(words[i].as_py())]))
        cut = np.unique(np.concatenate(cuts))
        ids, upto = self.bpe.encode_all(data, cut)
        return ids.astype(self.kind), upto[np.searchsorted(cut, edge)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids one after the other, and the offsets of each id's."""
        return gather(self.bytes, self.at[ids], self.at[ids.astype(np.int64) + 1] - self.at[ids])

    def digests(self, texts: pa.Array) -> tuple[list[int], list[str], list[str]]:
        """n_tokens, ids_sha256 and decoded_sha256 of each text."""
        count, told, decoded = [], [], []
        for part in work(texts, SLICE):
            ids, at = self.words.ids(part)
            count += np.diff(at).tolist()
            if len(ids) > MANY:
                for a, b in zip(at.tolist(), at[1:].tolist()):
                    one, two = self._digest(ids[a:b])
                    told.append(one)
                    decoded.append(two)
                continue
            raw, upto = self.decode(ids)
            text = self.decimal[ids]
            length = np.r_[0, np.cumsum((text != 0).sum(1))][at].tolist()
            text, raw = memoryview(text[text != 0]), memoryview(raw)
            told += [hashlib.sha256(text[a : max(a, b - 1)]).hexdigest() for a, b in zip(length, length[1:])]
            cut = upto[at].tolist()
            decoded += [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cut, cut[1:])]
        return count, told, decoded

    def _digest(self, ids: np.ndarray) -> tuple[str, str]:
        """The two digests of a very long text, MANY ids at a time."""
        one, two = hashlib.sha256(), hashlib.sha256()
        for k in range(0, len(ids), MANY):
            text = self.decimal[ids[k : k + MANY]]
            text = text[text != 0]
            one.update(text if k + MANY < len(ids) else text[:-1])
            two.update(self.decode(ids[k : k + MANY])[0])
        return one.hexdigest(), two.hexdigest()

    def ids(self, texts: pa.Array) -> pa.Array:
        """list<int32> of each text."""
        parts = [self.words.ids(part) for part in work(texts)]
        ids = np.concatenate([p[0].astype(np.int32) for p in parts]) if parts else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(np.r_[0, np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))].astype(np.int32) if parts else np.zeros(1, np.int32), ids)


_CODECS: dict[tuple[str, str], Codec] = CACHES.setdefault("bpe", {})


def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec a process; executors read the vocabulary file from its installed place."""
    if (ranks_path, pattern) not in _CODECS:
        _CODECS.clear()
        _CODECS[ranks_path, pattern] = Codec(ranks_path, pattern)
    return _CODECS[ranks_path, pattern]


_DIGESTS = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def digests(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with n_tokens long, ids_sha256 and decoded_sha256: encodes each whole text, decodes the ids, and hashes both.

    Each match of pattern is encoded separately and no special tokens exist. Null and empty texts: 0 tokens, hashes of nothing.
    Rows with a null id and repeated rows are rows like others; an empty table stays empty. Other columns stay; existing ones of
    these names are replaced.
    """

    @F.arrow_udf(", ".join(f"{k} {v}" for k, v in _DIGESTS.items()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with lean("bpe"):
            c = codec(ranks_path, pattern)
            for texts in batches:
                n, told, decoded = c.digests(texts)
                trim()
                yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(told, pa.string()), pa.array(decoded, pa.string())], list(_DIGESTS))

    out = bounded_batches(docs).withColumn("__bpe", run(F.col(text).cast("string")))
    return out.withColumns({c: F.col(f"__bpe.{c}") for c in _DIGESTS}).drop("__bpe")


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the ids array<int> of each whole text; empty for null and empty texts."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(ranks_path, pattern)
        for texts in batches:
            yield c.ids(texts)

    return bounded_batches(docs).withColumn(ids, run(F.col(text).cast("string")))


def decode(docs: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with the text whose ids are given; null for null ids, and U+FFFD where the bytes aren't UTF-8. Ids that the ranks lack are an error."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(ranks_path, pattern)
        for b in batches:
            yield pa.array([None if x is None else c.bpe.decode(x).decode("utf-8", "replace") for x in b.to_pylist()], pa.string())

    return bounded_batches(docs).withColumn(text, run(F.col(ids)))
