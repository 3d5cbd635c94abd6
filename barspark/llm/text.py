"""Whole texts of Arrow batches as byte arrays, and vectorised rolling hashes over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20  # bytes of text that are worked on together; a longer document is a chunk of its own

_MULT = 0xD6E8FEB86659FD93
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_cache: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _cache.get(name)
    if have is None or len(have) < n:
        p = np.full(max(n, CHUNK + 64), base, np.uint64)
        p[0] = 1
        have = _cache[name] = np.cumprod(p, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def prefix(values: np.ndarray) -> np.ndarray:
    """Sums of value * multiplier**index before each place; input of ``spans``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers("up", _MULT, len(values)), out=out[1:])
    return out


def spans(sums: np.ndarray, start, end) -> np.ndarray:
    """64-bit hashes of the sequences [start, end) of what ``prefix`` was given."""
    down = _powers("down", pow(_MULT, -1, 2**64), len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def longer(values: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """What ``spans`` mixes, of sequences with one more value in front."""
    return values + sums * np.uint64(_MULT)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTES[data]


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        a, span = np.minimum(a[:-span], a[span:]), span * 2
    return np.minimum(a[: len(a) - width + span], a[width - span :]) if width > span else a


def winnowed(h: np.ndarray, width: int) -> np.ndarray:
    """True where a hash is the minimum (each of equal ones) of some ``width`` neighbours; all minima if there are fewer."""
    if not len(h):
        return np.zeros(0, bool)
    if len(h) <= width:
        return h == h.min()
    least = sliding_min(h, width)
    pad = np.full(width - 1, ~np.uint64(0), np.uint64)
    return ~sliding_min(~np.concatenate([~pad, least, ~pad]), width) == h


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts after each other and where each begins (and the last ends); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(ends):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[ends[0] : ends[-1]], ends - ends[0]


def chunks(starts: np.ndarray, size: int = CHUNK):
    """Ranges of documents of about ``size`` bytes together."""
    i, n = 0, len(starts) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + size, "right")) - 1)
        yield i, j
        i = j


def byte_set(drop) -> np.ndarray:
    """A table that is true for every byte but those in ``drop``."""
    out = np.ones(256, bool)
    out[list(drop)] = False
    return out


SPACES = [0x20, *range(0x09, 0x0E)]
NOT_SPACE = byte_set(SPACES)
LETTERS = byte_set([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def words(data: np.ndarray, starts: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every run of ``kept`` bytes inside a document, and the first word's number of each document (and the count)."""
    inside = kept[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    begin = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return begin, end, np.searchsorted(begin, starts)


def ramp(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the lengths, after each other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def covered(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """True for every place of ``n`` that lies in one of the ranges."""
    steps = np.bincount(begin, minlength=n + 1)[: n + 1] - np.bincount(end, minlength=n + 1)[: n + 1]
    return np.cumsum(steps[:n]) > 0
