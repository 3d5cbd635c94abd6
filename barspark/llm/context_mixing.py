"""LM scoring by online logistic context mixing.

The model predicts a text's bits: its words in lower case (A-Z only), one space between two, one end mark. Six predictors look up the bits seen after
the last 1 to 5 bytes (across words), and after the word so far, in hashed tables of counts. Most places of a corpus have contexts that recur, and each
distinct one of a batch is predicted once (see ``Cut``). What the text says about its language is said once: 4 bits name the text's class (a hash of its most frequent
short word), on which contexts depend. A mixer adds their log-odds with weights that a gate chooses (how many contexts were seen
before, and how often the one of three bytes), and an adaptive table refines the sum by the bits so far of the byte. The tables count all training
documents; mixer and refinement learn online from all of them too, block by block (see ``blocks``), each bit predicted without its own count, and are
averaged over the blocks. Every text is scored with the same finished model, so a score depends neither on order nor on partitions. ``score`` is log10
of the text's probability; ``bits_per_byte`` its total in bits over the bytes.

Counting tasks send their tables in compressed slices, which are summed slice by slice in a stream; the finished tables have a fixed size (``SLOTS`` for
each order) and are broadcast. Word counts for the base go through blocks and buckets (see ``blocks``): 64-bit hashes of words with their 64-bit counts. A
block learns and names its words in one pass, and is scored in another.

A null or empty text is one end mark. A null doc_id counts as the text "" for the fold. Repeated rows are scored one by one, and each is learned from.
An empty table gives an empty result; without training documents the predictors have seen nothing and N is 0.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable
from copy import copy
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Blocks, by_bucket, runs
from .files import sampled, staged, table
from .registry import query
from .substrings import parts
from .text import LOWER, NOT_SPACE, byte_values, chunks, covered, longer, mix, prefix, ramp, spans, words

LAST = 5  # bytes of the longest byte context
ORDERS = LAST + 1  # and the word so far
BITS = 21
SLOTS = 1 << BITS
SLICE = 1 << 16
HELD_BITS = 23  # costs of bytes with contexts, and of ends of words, that a worker keeps
HELD = 1 << HELD_BITS
FOLDS, HELD_OUT = 7, 2
END = b"\xff"
BLOCK_BYTES = 16 << 20  # what a block repeats, it learns and is told once
PADDING = b" " * LAST
GATES = (ORDERS + 1) * 5
STEPS = 33
_TURN = np.uint64(0x9E3779B97F4A7C15)


def fold(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


CLASS_BITS = 4


def plain(text: bytes) -> tuple[bytes, int]:
    """The bytes to predict and the text's class."""
    own = text.lower().split()
    short = Counter([w for w in own if len(w) < 5])
    most = max(short.values(), default=0)
    kind = crc32(min((w for w, n in short.items() if n == most), default=b"")) % (1 << CLASS_BITS)
    return b" ".join(own) + END, kind


def grams(plain_texts: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every byte of the plain texts the byte with the five before it (48 bits; the text's class in the highest 4) and a hash of the word so far; and the
    texts' sizes."""
    texts, kinds = [t for t, _ in plain_texts], np.array([k for _, k in plain_texts], np.uint64)
    sizes = np.array([len(t) for t in texts], np.int64)
    buffer = np.frombuffer(PADDING + PADDING.join(texts) + b"\0\0", np.uint8)
    # All places of the buffer from the first text on are worked out side by side; the padding between texts goes at the end.
    n = len(buffer) - 2 - LAST
    context = np.ndarray((n,), ">u8", buffer, strides=(1,)).astype(np.uint64) >> np.uint64(16)
    at = np.arange(LAST, LAST + n, dtype=np.int32)
    begin = np.maximum.accumulate(np.where(buffer[LAST - 1 : LAST - 1 + n] == 0x20, at, np.int32(0)))
    word = spans(prefix(byte_values(buffer)), begin, at)
    ends = np.cumsum(sizes + LAST) - LAST
    own = ~covered(n, ends[:-1], ends[:-1] + LAST)
    return context[own] | np.repeat(kinds, sizes) << np.uint64(60), word[own], sizes


def names(keys: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One number for a byte and all its contexts."""
    return mix(keys * _TURN ^ word)


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that stand for all equal ones, and for each place the number of its stand-in. (Some equal places stand for themselves.)"""
    bits = min(21, len(key).bit_length() + 1)
    cell = (key >> np.uint64(64 - bits)).view(np.int64)
    at = np.arange(len(key), dtype=np.int32)
    holder = np.empty(1 << bits, np.int32)
    holder[cell] = at
    stand = holder[cell]
    stand = np.where(key[stand] == key, stand, at)
    own = stand == at
    return np.flatnonzero(own), (np.cumsum(own) - 1)[stand]


class Cut:
    """The bytes of plain texts in two parts. A byte with a space among the five before it is told by these six (and the class): ``keys``, of each text so many as
    ``heads``. The others lie further in a word, and are the same wherever the word is: ``name`` and place of every word that has such, of each text so many
    as ``tails``."""

    def __init__(self, plain_texts: list[tuple[bytes, int]]):
        parts_, at, n = [], 0, 0
        self.keys = np.empty(sum(len(t) for t, _ in plain_texts), np.uint64)
        for piece in pieces(plain_texts, 1 << 17):  # stays in a processor's cache
            keys, buffer, heads, kind, name, start, end, tails = cut(piece)
            self.keys[n : n + len(keys)] = keys
            parts_.append((buffer, heads, kind, name, start + at, end + at, tails))
            at, n = at + len(buffer), n + len(keys)
        self.keys = self.keys[:n]
        self.buffer, self.heads, self.kind, self.name, self.start, self.end, self.tails = (np.concatenate(x) for x in zip(*parts_, strict=True))

    def spread(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``grams`` of the bytes of ``some`` words from the sixth on, and how many there are in each."""
        start, size, kind = self.start[some], self.end[some] - self.start[some], self.kind[some]
        out = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for i, j in chunks(np.concatenate([[0], np.cumsum(size)]), 1 << 16):
            length, late = size[i:j], size[i:j] - LAST
            first = np.cumsum(length) - length
            buffer = np.concatenate([self.buffer[ramp(length) + np.repeat(start[i:j], length)], np.zeros(2, np.uint8)])
            at = ramp(late) + np.repeat(first, late)
            context = np.ndarray((len(buffer) - 7,), ">u8", buffer, strides=(1,)).astype(np.uint64)[at] >> np.uint64(16)
            word = spans(prefix(byte_values(buffer)), np.repeat(first, late), at + LAST)
            out.append((context | np.repeat(kind[i:j] << np.uint64(60), late), word, late))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def cut(plain_texts: list[tuple[bytes, int]]) -> tuple[np.ndarray, ...]:
    buffer = np.frombuffer(PADDING + PADDING.join(t for t, _ in plain_texts) + PADDING, np.uint8)
    kinds, sizes = np.array([k for _, k in plain_texts], np.uint64), np.array([len(t) for t, _ in plain_texts], np.int64)
    begins = np.cumsum(sizes + LAST) - sizes
    space, last = buffer == 0x20, buffer == END[0]
    near = space[:-LAST].copy()  # of the place LAST later
    for i in range(1, LAST):
        near |= space[i : i - LAST]
    near &= ~(space[LAST:] & (space[LAST - 1 : -1] | last[LAST - 1 : -1]))  # padding
    at = np.flatnonzero(near)
    heads = np.diff(np.searchsorted(at, begins - LAST), append=len(at))
    keys = np.ndarray((len(buffer) - 7,), ">u8", buffer, strides=(1,)).astype(np.uint64)[at] >> np.uint64(16) | np.repeat(kinds << np.uint64(60), heads)
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    end = end + ~last[end - 1]  # with the space after it
    long = end - start > LAST
    start, end = start[long], end[long]
    tails = np.diff(np.searchsorted(start, begins), append=len(start))
    kind = np.repeat(kinds, tails)
    return keys, buffer, heads, kind, names(kind, spans(prefix(byte_values(buffer)), start, end)), start, end, tails


def word_so_far(keys: np.ndarray) -> np.ndarray:
    """Of ``Cut.keys``, the hash that ``grams`` gives."""
    out = np.empty(len(keys), np.uint64)
    for i in range(0, len(keys), 1 << 14):
        some = keys[i : i + (1 << 14)]
        h, inside = np.zeros(len(some), np.uint64), np.ones(len(some), bool)
        for k in range(1, LAST + 1):
            byte = (some >> np.uint64(8 * k)).astype(np.uint8)
            inside &= byte != 0x20
            h = np.where(inside, longer(byte_values(byte), h), h)
        out[i : i + (1 << 14)] = mix(h)
    return out


def backwards(keys: np.ndarray) -> np.ndarray:
    """``keys`` with the byte in front and the ones before it after it, and back again. In this order neighbours share most of their slots."""
    return keys >> np.uint64(60) << np.uint64(60) | (keys << np.uint64(16)).byteswap()


def distinct_bytes(plain_texts: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct bytes with their contexts: byte and context, word, and how often they came. Both parts are in the order of ``backwards``."""
    c = Cut(plain_texts)
    keys = c.keys
    for i in range(0, len(keys), 1 << 16):  # in place, for the memory
        keys[i : i + (1 << 16)] = backwards(keys[i : i + (1 << 16)])
    keys.sort()
    at = runs(keys)
    n = np.diff(at, append=len(keys))
    keys = backwards(keys[at])
    c.keys = None
    some, stand = distinct(c.name)
    tails, word, size = c.spread(some)
    name = names(tails, word)
    order = np.argsort(name)
    at = runs(name[order])
    if len(at):
        many = np.add.reduceat(np.repeat(np.bincount(stand, minlength=len(some)), size)[order], at)
        first = order[at]
        order = np.argsort(backwards(tails[first]))
        n, first = np.concatenate([n, many[order]]), first[order]
    else:
        first = order
    return np.concatenate([keys, tails[first]]), np.concatenate([word_so_far(keys), word[first]]), n


def pieces(texts: list[tuple[bytes, int]], most: int = 1 << 20):
    """Runs of texts of about ``most`` bytes."""
    i, size = 0, 0
    for j, (t, _) in enumerate(texts):
        size += len(t)
        if size >= most or j + 1 == len(texts):
            yield texts[i : j + 1]
            i, size = j + 1, 0


def places(keys: np.ndarray, word: np.ndarray):
    """For each bit of the byte: slots of all contexts, the bit, and the bits before it in the byte with a 1 in front. A context has 16 neighbouring slots for the
    first half of the byte and 16 for the second after the first, so that a processor finds its four bits together."""
    byte, context, kind = keys & np.uint64(255), keys >> np.uint64(8) & np.uint64((1 << 8 * LAST) - 1), (keys >> np.uint64(60)) << np.uint64(52)
    base = [mix((context & np.uint64((1 << 8 * o) - 1)) + np.uint64(o << 56) + (kind if o < LAST else np.uint64(0))) for o in range(1, LAST + 1)] + [mix(word + kind)]
    byte = byte.view(np.int64)
    first = (byte >> 4 | 16).view(np.uint64) * _TURN
    halves = [[(x >> np.uint64(64 - BITS)).view(np.int64) for x in base], [(((x ^ first) * _TURN) >> np.uint64(64 - BITS)).view(np.int64) for x in base]]
    for b in range(8):
        node = (byte | 256) >> 8 - b
        own = node if b < 4 else node & (1 << b - 4) - 1 | 1 << b - 4  # 1 to 15
        yield [x ^ own for x in halves[b >> 2]], byte >> 7 - b & 1, node


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def whole(data) -> pa.Buffer:
    return pa.decompress(memoryview(data)[8:], int.from_bytes(memoryview(data)[:8], "little"), "zstd")


def _count(batches):
    """Slices of the tables of one task: order, slice, zeros and ones of its slots."""
    sums = np.zeros((ORDERS, 2 * SLOTS), np.uint32)

    def put(texts):
        keys, word, n = distinct_bytes(texts)
        n = n.astype(np.uint32)
        for i in range(0, len(keys), 1 << 13):
            here = n[i : i + (1 << 13)]
            for slots, bit, _ in places(keys[i : i + (1 << 13)], word[i : i + (1 << 13)]):
                for o, s in enumerate(slots):
                    np.add.at(sums[o], s << 1 | bit, here)

    texts, size, some = [], 0, False
    for batch in batches:
        for t in batch.column(0).to_pylist():
            texts.append(plain((t or "").encode()))
            size += len(texts[-1][0])
            if size >= BLOCK_BYTES:
                put(texts)
                texts, size, some = [], 0, True
    if texts:
        put(texts)
    if texts or some:
        for o in range(ORDERS):
            for k in range(SLOTS // SLICE):
                part = sums[o, 2 * k * SLICE : 2 * (k + 1) * SLICE]
                if part.any():
                    high = np.flatnonzero(part >> 16)  # few counts need more than 16 bits; where these are, and what is above
                    data = squeezed(part.astype("<u2").tobytes() + high.astype("<u4").tobytes() + (part[high] >> 16).astype("<u4").tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([o * (SLOTS // SLICE) + k]), pa.array([data])], ["slice", "data"])


def _add_up(batches):
    """Sums of rows with the same slice, which come one after the other."""
    now, total = None, None
    for batch in batches:
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = whole(data.as_buffer())
            low, (at, high) = np.frombuffer(data, "<u2", 2 * SLICE), np.frombuffer(data, "<u4", offset=4 * SLICE).reshape(2, -1)
            if k != now:
                if now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([total.tobytes()])], ["slice", "data"])
                now, total = k, np.zeros(2 * SLICE, np.int64)
            total += low
            total[at] += high.astype(np.int64) << 16
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([total.tobytes()])], ["slice", "data"])


def cells_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of zeros and ones of some slots: log-odds in 1/256 with how often seen in the low 3 bits, and the smaller count up to 255."""
    n = counts.reshape(-1, 2)
    total, fewer = n.sum(1), n.min(1)
    odds = np.where(total > 0, np.log((n[:, 1] + 0.05) / (n[:, 0] + 0.05)), 0)
    odds = np.clip(np.round(odds * 256), -4096, 4095)  # 13 bits
    return odds.astype(np.int16) << 3 | np.searchsorted([1, 2, 4, 16], total, "right").astype(np.int16), np.minimum(fewer, 255).astype(np.uint8)


def _add_up_cells(batches):
    """Cells of the sums, compressed: 3 bytes a slot at most for the driver, where the sums have 16."""
    for batch in _add_up(batches):
        cells, few = cells_of(np.frombuffer(batch.column(1)[0].as_buffer(), np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([squeezed(cells.tobytes() + few.tobytes())])], ["slice", "data"])


@functools.lru_cache(maxsize=1)
def one_less() -> np.ndarray:
    """By bit, log-odds (13 bits) and smaller count (8 bits) of a cell, the cell with that bit counted once less. A cell whose smaller count is 255 or more,
    or that does not have the bit, stays as it is."""
    odds, few = np.divmod(np.arange(1 << 21, dtype=np.int32), 256)
    odds, few = (odds - 4096).astype(np.float32) * np.float32(1 / 256), few.astype(np.float32)
    many = np.maximum(np.rint(np.exp(np.abs(odds)) * (few + np.float32(0.05)) - np.float32(0.05)), few)

    def seen(total):
        return np.searchsorted([1, 2, 4, 16], total, "right").astype(np.int16)

    as_it_is = np.rint(odds * 256).astype(np.int16) << 3 | seen(many + few)
    out = []
    for one in (False, True):
        mine = np.where(one == (odds > 0), many, few) - 1  # the count of this bit; of two equal ones it does not matter which
        other = np.where(one == (odds > 0), few, many)
        total = mine + other
        left = np.log((np.maximum(mine, 0) + np.float32(0.05)) / (other + np.float32(0.05))) * np.float32(256 if one else -256)
        left = np.where(total > 0, np.clip(np.rint(left), -4096, 4095), 0).astype(np.int16) << 3 | seen(total)
        out.append(np.where((few == 255) | (mine < 0), as_it_is, left))
    return np.concatenate(out)


class Mixer:
    def __init__(self):
        self.memo: tuple[np.ndarray, np.ndarray] | None = None
        self.cells = np.zeros((ORDERS, SLOTS), np.int16)  # log-odds in 1/256, and how often seen in the low 3 bits
        self.few: np.ndarray | None = np.zeros((ORDERS, SLOTS), np.uint8)  # the smaller count up to 255; only learning needs it
        self.both: np.ndarray | None = None  # cells without one 0 and without one 1, side by side, made where learning begins
        self.weights = np.full((ORDERS, GATES), 0.35, np.float32)
        grid = np.linspace(-8, 8, STEPS)
        self.refined = np.tile(1 / (1 + np.exp(-grid)), (256, 1)).astype(np.float32)

    def put(self, k: int, counts: np.ndarray) -> None:
        """A slice of summed counts."""
        self.put_cells(k, *cells_of(counts))

    def put_cells(self, k: int, cells: np.ndarray, few: np.ndarray) -> None:
        o, i = divmod(k, SLOTS // SLICE)
        here = slice(i * SLICE, (i + 1) * SLICE)
        self.cells[o, here], self.few[o, here] = cells, few

    def without(self, o: int, slots: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """The cells as they would be if ``bit`` had been counted once less."""
        if self.both is None:
            self.both = np.empty((ORDERS, 2 * SLOTS), np.int16)
            table_ = one_less()
            for p in range(ORDERS):
                for i in range(0, SLOTS, SLICE):
                    at = (self.cells[p, i : i + SLICE] >> 3).astype(np.int32) + 4096 << 8 | self.few[p, i : i + SLICE]
                    self.both[p, 2 * i : 2 * (i + SLICE) : 2], self.both[p, 2 * i + 1 : 2 * (i + SLICE) : 2] = table_[at], table_[at | 1 << 21]
        return self.both[o].take(slots << 1 | bit)

    def inputs(self, slots, counted=None) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of every context, and the gate. ``counted``: the bit that came, where the tables have it, to be left out of them."""
        got = np.empty((ORDERS, len(slots[0])), np.int16)
        for o, s in enumerate(slots):
            got[o] = self.cells[o].take(s) if counted is None else self.without(o, s, counted)
        seen = np.add.reduce(((got & 7) != 0).view(np.int8), axis=0, dtype=np.int8)
        odds = (got >> 3).astype(np.float32)
        odds *= np.float32(1 / 256)
        return odds, seen.astype(np.int64) * 5 + (got[2] & 7)

    def mixed(self, x, gate):
        z = self.weights.take(gate, axis=1)
        z *= x
        return np.clip(z.sum(0), -8, 8)

    def steps(self, z):
        """The step of the grid below ``z``, and how far it is beyond it."""
        at = (z + 8) * np.float32((STEPS - 1) / 16)
        low = np.minimum(at.astype(np.int32), STEPS - 2)
        return low, at - low.astype(np.float32)

    def refine(self, z, node):
        low, part = self.steps(z)
        cell, flat = node * STEPS + low, self.refined.reshape(-1)
        return (1 - part) * flat.take(cell) + part * flat.take(cell + 1)

    def learn(self, texts: list[tuple[bytes, int]], batch: int = 4096, rate: float = 0.02, pace: float = 0.02, counted: bool = False) -> None:
        """Online: predict a batch of bits, then move the weights and the refinement towards what came.

        Equal bytes after equal contexts are one place that weighs as often as it occurs. Places come in the order of their hashes, whatever the texts'.
        ``counted``: the tables have these texts, so each bit is predicted without its own count."""
        if not texts:
            return
        keys, word, often = distinct_bytes(texts)
        order = np.argsort(names(keys, word))
        keys, word, often = keys[order], word[order], often[order]
        for i in range(0, len(keys), batch):
            n = often[i : i + batch].astype(np.float32)
            for b, (slots, bit, node) in enumerate(places(keys[i : i + batch], word[i : i + batch])):
                x, gate = self.inputs(slots, bit if counted else None)
                z = self.mixed(x, gate)
                low, part = self.steps(z)
                error = (bit.astype(np.float32) - 1 / (1 + np.exp(-z))) * n
                total = np.maximum(np.bincount(gate, n, GATES), 1)
                pull = rate * np.minimum(np.sqrt(total) / 8, 4) / total
                for w, y in zip(self.weights, error * x, strict=True):
                    w += pull * np.bincount(gate, y, GATES)
                size = STEPS << b  # the nodes of this bit
                flat = self.refined.reshape(-1)[size : 2 * size]
                for cell, w in ((node * STEPS + low - size, (1 - part) * n), (node * STEPS + low + 1 - size, part * n)):
                    each = np.bincount(cell << 1 | bit, w, 2 * size).reshape(-1, 2)
                    many = each[:, 0] + each[:, 1]
                    here = np.flatnonzero(many)
                    many, ones = many[here], each[here, 1]
                    flat[here] -= np.expm1(many * np.log1p(-pace)) * (ones / np.maximum(many, 1e-9) - flat[here])

    def bits(self, keys: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The cost in bits of each byte after its contexts."""
        order = np.argsort(backwards(keys))
        keys, word, out = keys[order], word[order], np.empty(len(keys))
        for i in range(0, len(keys), 1 << 12):
            part = np.ones(len(keys[i : i + (1 << 12)]))  # the probability of all bits, 1e-40 or more
            for slots, bit, node in places(keys[i : i + (1 << 12)], word[i : i + (1 << 12)]):
                z = self.mixed(*self.inputs(slots))
                p = (1 / (1 + np.exp(-z)) + self.refine(z, node)) * np.float32(0.5)
                part *= np.clip(np.abs(p - (1 - bit).astype(np.float32)), np.float32(1e-5), 1)
            out[i : i + (1 << 12)] = -np.log2(part)
        cost = np.empty(len(out))
        cost[order] = out
        return cost

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Total bits of each plain text; equal bytes after equal contexts are predicted once."""
        if self.memo is None:
            self.memo = np.zeros(HELD, np.uint64), np.zeros(HELD, np.float32)  # what was predicted before in this worker
        c = Cut(texts)

        def tail(some):
            keys, word, size = c.spread(some)
            own, stand = distinct(names(keys, word))
            return np.add.reduceat(self.bits(keys[own], word[own])[stand], np.cumsum(size) - size)

        heads = self.recalled(mix(c.keys), lambda some: self.bits(c.keys[some], word_so_far(c.keys[some])))
        tails = self.recalled(c.name, tail)
        return CLASS_BITS + np.add.reduceat(heads.astype(np.float64), np.cumsum(c.heads) - c.heads) + np.bincount(np.repeat(np.arange(len(texts)), c.tails), tails, len(texts))

    def recalled(self, name: np.ndarray, work: Callable) -> np.ndarray:
        """The cost of each name; ``work`` tells it for places whose names this worker does not keep."""
        known, costs = self.memo
        cell = (name >> np.uint64(64 - HELD_BITS)).view(np.int64)
        cost = costs[cell]
        new = np.flatnonzero(known[cell] != name)
        if len(new):
            some, stand = distinct(name[new])
            own = work(new[some]).astype(np.float32)
            cost[new] = own[stand]
            cell = cell[new[some]]
            known[cell], costs[cell] = name[new[some]], own
        return cost


LEARNED = "block bigint, data binary"


def _averaged(t: pa.Table) -> pa.Table:
    """Sums of what blocks learned, in order of the blocks."""
    t = t.sort_by("block")
    total = np.sum([np.frombuffer(x.as_py(), np.float64) for x in t.column("data")], axis=0)
    return pa.table([t.column("block").slice(0, 1), pa.array([total.tobytes()])], ["block", "data"])


def count_contexts(known: DataFrame) -> Mixer:
    """Tables of all texts, with weights that have learned nothing."""
    slices = known.select("text").mapInArrow(_count, "slice bigint, data binary")
    summed = slices.repartition(F.col("slice")).sortWithinPartitions("slice").mapInArrow(_add_up_cells, "slice bigint, data binary")
    mixer = Mixer()
    for r in summed.toLocalIterator():  # ORDERS x SLOTS cells, 38 MB before they are compressed, however large the input is
        data = whole(r["data"])
        mixer.put_cells(r["slice"], np.frombuffer(data, np.int16, SLICE), np.frombuffer(data, np.uint8, offset=2 * SLICE))
    return mixer


def texts_of(data: np.ndarray, starts: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


def learned(mixer: Mixer, t: pa.Table, ids: set | None) -> bytes:
    """What a block's training documents teach: their bytes, then weights and refinement times these."""
    kept, texts = t.column("training").to_numpy(), []
    if ids is not None:
        kept = kept & np.array([d in ids for d in t.column("doc_id").to_pylist()], bool)
    for i, j, data, starts in parts(t):
        texts += [plain(x) for x, own in zip(texts_of(data, starts), kept[i:j].tolist(), strict=True) if own]
    mixer.without(0, np.zeros(1, np.int64), np.zeros(1, np.int64))  # the copies of a worker share what is made for learning
    own, n = copy(mixer), sum(len(x) for x, _ in texts)
    own.weights, own.refined = own.weights.copy(), own.refined.copy()
    own.learn(texts, counted=True)
    return np.concatenate([[n], own.weights.ravel() * float(n), own.refined.ravel() * float(n)]).astype(np.float64).tobytes()


def finished(mixer: Mixer, blocks: DataFrame) -> Mixer:
    """``mixer`` with the average of what ``blocks`` (block, data) learned, weighted by bytes."""
    parts_ = blocks.groupBy(F.pmod("block", F.lit(32))).applyInArrow(_averaged, LEARNED).collect()  # at most 32 rows
    if parts_:
        n, *_ = data = np.sum([np.frombuffer(r["data"], np.float64) for r in sorted(parts_, key=lambda r: r["block"])], axis=0)
        if n:
            data = data[1:] / n
            mixer.weights = data[: mixer.weights.size].reshape(mixer.weights.shape).astype(np.float32)
            mixer.refined = data[mixer.weights.size :].reshape(mixer.refined.shape).astype(np.float32)
    mixer.few = mixer.both = None
    return mixer


def _sampled_ids(known: DataFrame, sample: int | None) -> set | None:
    return None if sample is None else {r["doc_id"] for r in sampled(known.select("doc_id"), sample, known.count(), "doc_id").collect()}


def train(docs: DataFrame, blocks: Blocks, sample: int | None = None) -> Mixer:
    """``docs`` (doc_id, text, training), dealt into ``blocks``, are the training documents where ``training``.

    Each block learns mixer and refinement from all its training documents; the result is their average, weighted by bytes. ``sample``: learn from so many documents only."""
    known = docs.where("training")
    mixer, ids = count_contexts(known), _sampled_ids(known, sample)
    shared = docs.sparkSession.sparkContext.broadcast(mixer)
    mixer = finished(mixer, blocks.finish(
        lambda block, t, told: pa.table([pa.array([block], pa.int64()), pa.array([learned(shared.value, t, ids)])], ["block", "data"]), LEARNED))
    shared.unpersist()
    return mixer


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in lower case, and the first word of each document."""
    begin, end, first = words(LOWER[data], starts, NOT_SPACE)
    return spans(prefix(byte_values(LOWER[data])), begin, end), first


def _say_counts(docs, buckets):
    """The block's distinct words by bucket with how often its training documents have them: bucket, number of words, words, counts."""
    train_, keys, n = docs.column("training").to_numpy(), [], []
    for i, j, data, starts in parts(docs):
        h, first = word_hashes(data, starts)
        keys.append(h)
        n.append(np.repeat(train_[i:j].astype(np.int64), np.diff(first)))
    keys, n = np.concatenate(keys), np.concatenate(n)
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    at = runs(keys)
    if len(at):
        keys, n = keys[at], np.add.reduceat(n, at)
        for bucket, idx in by_bucket(keys, buckets):
            yield bucket, np.array([bucket, len(idx)], np.int64).tobytes() + keys[idx].tobytes() + squeezed(n[idx].tobytes())


def _hear_counts(blocks, data):
    """To each block the corpus counts of its words, in the order in which it named them; to block -1 the distinct words and occurrences in training documents."""
    sizes = [int(x[8:16].view(np.int64)[0]) for x in data]
    own = [x[16 : 16 + 8 * m].view(np.uint64) for x, m in zip(data, sizes, strict=True)]
    n = np.concatenate([np.frombuffer(whole(x[16 + 8 * m :]), np.int64) for x, m in zip(data, sizes, strict=True)])
    keys = np.concatenate(own)
    order = np.argsort(keys)
    at = runs(keys[order])
    key, total = keys[order][at], np.add.reduceat(n[order], at)
    yield -1, np.array([(total > 0).sum(), total.sum()], np.int64).tobytes()
    for b, x, k in zip(blocks, data, own, strict=True):
        yield int(b), x[:8].tobytes() + squeezed(total[np.searchsorted(key, k)].tobytes())


def _heard_counts(keys: np.ndarray, told: list[np.ndarray], buckets: int) -> np.ndarray:
    """The corpus counts of a block's distinct words."""
    got = {int(x[:8].view(np.int64)[0]): np.frombuffer(whole(x[8:]), np.int64) for x in told}
    n = np.zeros(len(keys), np.int64)
    for bucket, idx in by_bucket(keys, buckets):
        n[idx] = got[bucket]
    return n


RESULT = "doc_id bigint, held_out boolean, n_words bigint, known bigint, logs double, bits double, n_bytes bigint"


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int | None = None) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    d = d.withColumn("training", fold() != HELD_OUT)
    blocks, known, context = Blocks(d, carry=("training",), block_bytes=BLOCK_BYTES), d.where("training"), docs.sparkSession.sparkContext
    mixer, ids, buckets = count_contexts(known), _sampled_ids(known, sample), blocks.buckets
    first = context.broadcast(mixer)  # 38 MB, whatever the input

    def said(block, t, told, buckets):  # one pass over a block learns and counts its words
        yield -1, learned(first.value, t, ids)
        yield from _say_counts(t, buckets)

    said_ = staged(blocks.say(said), "word-counts")
    shared = context.broadcast(finished(mixer, said_.where("bucket = -1").select("block", "data")))
    first.unpersist()
    heard = staged(blocks.hear(said_.where("bucket >= 0"), _hear_counts), "word-totals")

    def result(block, docs, told):
        model = shared.value
        hashes = [word_hashes(data, starts) for _, _, data, starts in parts(docs)]
        keys = np.unique(np.concatenate([h for h, _ in hashes])) if hashes else np.zeros(0, np.uint64)
        n = _heard_counts(keys, told, buckets)
        logs = np.log10(n + 1)
        size, known, total, bits, length, texts = [], [], [], [], [], []
        for (h, first), (i, j, data, starts) in zip(hashes, parts(docs), strict=True):
            at = np.searchsorted(keys, h)
            doc = np.repeat(np.arange(j - i), np.diff(first))
            size.append(np.diff(first))
            known.append(np.bincount(doc, n[at] > 0, j - i).astype(np.int64))
            total.append(np.bincount(doc, logs[at], j - i))
            texts += [plain(x) for x in texts_of(data, starts)]
            if sum(len(t) for t, _ in texts) >= 1 << 20 or j == docs.num_rows:
                bits.append(model.score(texts))
                length.append(np.array([len(t) for t, _ in texts], np.int64))
                texts = []
        join = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
        held = pa.array(~docs.column("training").to_numpy(), pa.bool_()) if docs.num_rows else pa.array([], pa.bool_())
        return pa.table([docs.column("doc_id").combine_chunks(), held, join(size, pa.int64()), join(known, pa.int64()), join(total, pa.float64()), join(bits, pa.float64()), join(length, pa.int64())],
                        names=["doc_id", "held_out", "n_words", "known", "logs", "bits", "n_bytes"])

    # Distinct words and occurrences: one pair of numbers from each bucket. The end mark is one more word, once in each training document.
    numbers = heard.where("block = -1").mapInArrow(_numbers, "v bigint, n bigint").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    ends = d.agg(F.count_if("training").alias("ends"))
    total = numbers.crossJoin(ends).select(
        (F.coalesce("v", F.lit(0)) + (F.col("ends") > 0).cast("int")).alias("v"), (F.coalesce("n", F.lit(0)) + F.col("ends")).alias("n"), "ends")
    out = blocks.finish(result, RESULT, heard.where("block >= 0")).crossJoin(F.broadcast(total))  # one row
    tokens = F.col("n_words") + 1
    return out.select(
        "doc_id", "held_out", tokens.alias("n_tokens"), (F.col("known") + (F.col("ends") > 0).cast("int")).cast("bigint").alias("n_known"),
        F.col("n").alias("train_tokens"), (F.col("logs") + F.log10(F.col("ends") + 1) - tokens * F.log10(F.col("n") + F.col("v") + 1)).alias("base_score"),
        (-F.col("bits") * F.lit(float(np.log10(2)))).alias("score"), (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"))


def _numbers(batches):
    for batch in batches:
        x = np.array([np.frombuffer(b.as_py(), np.int64) for b in batch.column("data")], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["v", "n"])


@query("op4_context_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
