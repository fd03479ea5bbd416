"""A batch of texts as token ids: its distinct words are encoded once, through a cache of bounded bytes, and put together by index."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: the usual pattern, which never has a match across the begin of a word, unless blanks meet there.
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of Python objects that a cache of words may hold, by estimate; what an entry takes besides its word and its ids.
CACHE_BYTES, ENTRY_BYTES = 48 << 20, 190
#: Bytes of text that are worked on at a time, where texts are not longer themselves.
WORK_BYTES = 2 << 20

#: Characters of a text from which on it is encoded in parts, and where these may begin: at a blank between letters.
LONG = 4 << 20
_BLANK_BETWEEN = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def plain(data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words data[edge[i] : edge[i + 1]] (UTF-8): whether each is a leading blank or none, letters of ASCII or Latin-1, and then
    punctuation of ASCII or none; and where its punctuation begins. The usual pattern parts such a word there and nowhere else.
    """
    pair = np.zeros(len(data), bool)  # both bytes of a Latin-1 letter
    if len(data) > 1:
        lead = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0xBF) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        pair[:-1] |= lead
        pair[1:] |= lead
    letter, mark = _LETTER[data] | pair, _MARK[data]
    begin, end = edge[:-1], edge[1:]
    n_letter, n_mark = (np.r_[0, np.cumsum(x, dtype=np.int64)] for x in (letter, mark))
    back = np.r_[0, np.cumsum(np.r_[False, mark[:-1] & letter[1:]], dtype=np.int64)] if len(data) else np.zeros(1, np.int64)
    blank = (data[np.minimum(begin, max(len(data) - 1, 0))] == 0x20) & (begin < end) if len(data) else np.zeros(len(begin), bool)
    letters, marks = n_letter[end] - n_letter[begin], n_mark[end] - n_mark[begin]
    returns = back[end] - back[np.minimum(begin + 1, end)]
    first = letter[np.minimum(begin + blank, max(len(data) - 1, 0))] & (letters > 0) if len(data) else np.zeros(len(begin), bool)
    return first & (letters + marks + blank == end - begin) & (returns == 0), end - marks


def flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string or large_binary array without nulls, and the offsets of its values in them."""
    at = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
    data = np.frombuffer(values.buffers()[2], np.uint8)[at[0] : at[-1]] if len(values) and values.buffers()[2] else np.zeros(0, np.uint8)
    return data, at - at[0]


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches data[start : start + size] one after the other, and their offsets."""
    upto = np.r_[0, np.cumsum(size, dtype=np.int64)]
    return data[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])], upto


def work(texts: pa.Array, size: int = WORK_BYTES) -> Iterator[pa.Array]:
    """Slices of texts of about size bytes each, as large_string without nulls."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = flat(texts)[1]
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + size)))
        yield texts.slice(i, j - i)
        i = j


def parts(text: str, size: int) -> Iterator[str]:
    """text, cut at single blanks into parts of about size characters; a part begins with its blank."""
    at = 0
    while len(text) - at > size and (m := _BLANK_BETWEEN.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


class Words:
    """Encodes batches of texts by way of their words.

    A text is cut before its blanks and its line feeds; a stretch is what stands between. Where no blanks meet (two spaces, blank
    lines, tabs, blanks at an end), no match of the usual pattern runs across the begin of a stretch, so stretches are encoded
    apart. Texts where blanks do meet, or all texts where the pattern isn't the usual one, go to `whole` as they are.

    `encode` gets distinct new words (large_string), each with its leading blank if it has one, and what plain() says of them; it
    gives their ids one word after the other and the offsets of each word's. `whole` gives the ids of each of some texts; feed is the
    line feed's id. The cache takes new words while there is room, and starts anew once it misses too often.
    """

    def __init__(self, encode: Callable[[pa.Array, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], whole: Callable[[list[str]], list[np.ndarray]], feed: int, kind: np.dtype, usual: bool = True, room: int = CACHE_BYTES):
        self.encode, self.whole, self.feed, self.kind, self.usual, self.room = encode, whole, feed, np.dtype(kind), usual, room
        self.cache: dict[str, bytes] = {}
        self.held = self.seen = self.missed = 0

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts (large_string, no nulls) one after the other, and the offsets of each text's."""
        if not self.usual:
            return self._joined(self.whole(texts.to_pylist()))
        if len(texts) == 1 and len(text := texts[0].as_py()) > LONG and len(some := list(parts(text, LONG))) > 1:
            # A letter before the blank, whose one id goes again, makes a part like a text of its own.
            ids = [self.ids(pa.array(["a" * bool(k) + x], pa.large_string()))[0][bool(k) :] for k, x in enumerate(some)]
            return self._joined([np.concatenate(ids)])
        lists = pc.split_pattern(pc.binary_join_element_wise(_FEED, pc.replace_substring(texts, "\n", " \n"), _EMPTY), " ")
        coded, at = lists.values.dictionary_encode(), lists.offsets.to_numpy()
        index = coded.indices.to_numpy()
        known, start, size = self._known(coded.dictionary, len(index))
        ids, upto = gather(known, start[index], size[index])
        begin, end = upto[at[:-1]] + 1, upto[at[1:]]  # the line feed before a text's first word isn't its own
        odd = np.logical_or.reduceat(size[index] == 0, at[:-1]) if len(texts) else np.zeros(0, bool)
        if not odd.any():
            own = np.ones(len(ids), bool)
            own[begin - 1] = False
            return ids[own], np.r_[0, np.cumsum(end - begin)]
        places = np.flatnonzero(odd)
        other = dict(zip(places.tolist(), self.whole(texts.take(pa.array(places)).to_pylist())))
        return self._joined([other[i] if i in other else ids[b:e] for i, (b, e) in enumerate(zip(begin.tolist(), end.tolist()))])

    def _joined(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.zeros(0, self.kind), *parts]).astype(self.kind), np.r_[0, np.cumsum([len(p) for p in parts], dtype=np.int64)]

    def _known(self, keys: pa.Array, seen: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them and how many each key has: of a word after a blank, or of a line feed and the word after it; none where blanks meet."""
        names, w = keys.to_numpy(zero_copy_only=False).tolist(), self.kind.itemsize
        got = list(map(self.cache.get, names))
        lacking = np.flatnonzero(np.fromiter((g is None for g in got), bool, len(got)))
        old = [g for g in got if g is not None]
        start, size = np.zeros(len(got), np.int64), np.zeros(len(got), np.int64)
        there = np.ones(len(got), bool)
        there[lacking] = False
        size[there] = np.fromiter(map(len, old), np.int64, len(old)) // w
        start[there] = np.cumsum(size[there]) - size[there]
        ids = np.frombuffer(b"".join(old), self.kind)
        if not len(lacking):
            return ids, start, size
        words = pc.replace_substring(pc.binary_join_element_wise(_BLANK, keys.take(pa.array(lacking)), _EMPTY), " \n", "")
        easy, mark = plain(*flat(words))
        bad = [i for i in np.flatnonzero(~easy).tolist() if len((t := words[i].as_py()).split()) != 1 or t.split()[0] != t[t[:1] == " " :]]
        if bad:
            keep = np.ones(len(words), bool)
            keep[bad] = False
            words, lacking = words.filter(pa.array(keep)), lacking[keep]
            easy, mark = plain(*flat(words))
        new, upto = self.encode(words, easy, mark)
        line = np.array([names[i][0] == "\n" for i in lacking.tolist()], bool)
        new, upto = np.insert(new, upto[:-1][line], self.feed).astype(self.kind), upto + np.r_[0, np.cumsum(line)]
        start[lacking], size[lacking] = len(ids) + upto[:-1], np.diff(upto)
        self._keep([names[i] for i in lacking.tolist()], new.tobytes(), upto * w, seen)
        return np.concatenate([ids, new]), start, size

    def _keep(self, names: list[str], raw: bytes, at: np.ndarray, seen: int) -> None:
        self.seen, self.missed = self.seen + seen, self.missed + len(names)
        if self.held >= self.room and self.seen > 2_000_000:
            if self.missed > 0.3 * self.seen:
                self.cache.clear()
                self.held = 0
            self.seen = self.missed = 0
        takes = np.cumsum(np.fromiter(map(len, names), np.int64, len(names)) + ENTRY_BYTES + np.diff(at))
        n = int(np.searchsorted(takes, self.room - self.held))
        at = at[: n + 1].tolist()
        self.cache.update(zip(names[:n], [raw[a:b] for a, b in zip(at, at[1:])]))
        self.held = self.room if n < len(names) else self.held + int(takes[-1] if n else 0)


_FEED, _BLANK, _EMPTY = (pa.scalar(x, pa.large_string()) for x in ("\n", " ", ""))
