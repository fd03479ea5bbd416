"""Words and word hashes of many texts at a time, in numpy over UTF-8 bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from .common import mix

#: Bytes that are worked on at a time; numpy's temporary arrays take about 40 times as many.
BLOCK = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_NEXT = re.compile(rb"[\x20\x09-\x0d]")
_P = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd constant and of its inverse modulo 2**64."""
    size = 1 << max((2 * BLOCK).bit_length(), int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        one = np.full(size, _P, np.uint64)
        inv = np.full(size, pow(_P, -1, 1 << 64), np.uint64)
        one[0] = inv[0] = 1
        _POWERS[size] = np.cumprod(one, dtype=np.uint64), np.cumprod(inv, dtype=np.uint64)
    return _POWERS[size]


def _block(raw: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.r_[True, space, True].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    power, inverse = _powers(len(raw) + 1)
    total = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], dtype=np.uint64)]
    h = (total[end] - total[start]) * inverse[start]
    return mix(h ^ ((end - start).astype(np.uint64) << np.uint64(40))), start + at, end + at


def words(buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word [^\\x20\\x09-\\x0D]+ of buf, worked on in blocks of about BLOCK bytes."""
    parts, at = [], 0
    while at < len(buf):
        cut = len(buf)
        if len(buf) - at > 2 * BLOCK and (m := _NEXT.search(buf, at + BLOCK)):
            cut = m.start()
        parts.append(_block(np.frombuffer(buf, np.uint8, cut - at, at), at))
        at = cut
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts))  # type: ignore[return-value]


def packs(texts: list[str | None]) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Groups of texts of about BLOCK bytes: index of the first, their bytes joined by line feeds, the offsets where each starts and one past the end."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1]) + 1
        if size >= BLOCK or i == len(texts) - 1:
            yield first, b"\n".join(held), np.cumsum([0, *(len(x) + 1 for x in held)])
            first, held, size = i + 1, [], 0
