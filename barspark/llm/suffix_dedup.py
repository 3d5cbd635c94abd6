"""Suffix-array dedup: removes every byte in a 50-byte string that also starts in a document with a smaller id.

A whole corpus cannot be one suffix array, and most of it repeats nowhere. So three passes over blocks of documents (see ``blocks``) find what has to be sorted:

1. Anchors: the smallest of 31 neighbouring 20-byte hashes. Two equal 50-byte strings hold an equal anchor at the same place.
2. Around an anchor that several documents have, every 50-byte string that holds it lies in its *cell*, the anchor with 30 bytes on either side.
   A block sends each distinct cell once, with its smallest document. A bucket has all cells of an anchor. Where there is one cell, its smallest
   document is the answer for all its strings. Otherwise the cells (the anchor as one symbol, a separator after each) make one sequence, whose suffix array
   brings equal strings together; each run of equal strings knows its smallest document. Cells that share no string hash are left out, of the others what
   no other cell has at their ends; cells that are equal in between are sorted once.
3. Blocks hear which strings of their cells a smaller document has, and remove them.

Nulls are empty texts; texts under 50 bytes lose nothing. Repeated doc_ids do not cover each other. A null doc_id counts as larger than all
others. Removal is by bytes and may cut a character; an empty table gives an empty result. Anchors and cells are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .blocks import Blocks, by_bucket, heard_keys, member, runs, say_keys, shared_keys, short
from .files import table
from .gsaca import suffix_array
from .registry import query
from .substrings import ids_of
from .text import byte_values, bytes_of, chunks, covered, mix, prefix, sliding_min, spans

LENGTH = 50
ANCHOR = 20
SIDE = LENGTH - ANCHOR
CELL = LENGTH + SIDE
PIECE = 1 << 18  # bytes that are worked on together
SORTED = 1 << 19  # symbols of one suffix array
_LEFT = np.uint64(0xA24BAED4963EE407)
_ENTRY = np.dtype([("anchor", "<u8"), ("cell", "<u8"), ("doc", "<i8"), ("left", "u1"), ("right", "u1"), ("text", "u1", (CELL,))])


def squeeze(cells: np.ndarray) -> bytes:
    """Cells column by column; hashes as they are, the rest compressed."""
    rest = cells["doc"].tobytes() + cells["left"].tobytes() + cells["right"].tobytes() + cells["text"].tobytes()
    return cells["anchor"].tobytes() + cells["cell"].tobytes() + zstandard.ZstdCompressor(level=1).compress(rest) + len(cells).to_bytes(4, "little")


def expand(data: np.ndarray) -> np.ndarray:
    n = int.from_bytes(data[-4:].tobytes(), "little")
    out = np.zeros(n, _ENTRY)
    out["anchor"], out["cell"] = data[: 8 * n].view("<u8"), data[8 * n : 16 * n].view("<u8")
    rest = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[16 * n : -4].tobytes()), np.uint8)
    out["doc"], out["left"], out["right"] = rest[: 8 * n].view("<i8"), rest[8 * n : 9 * n], rest[9 * n : 10 * n]
    out["text"] = rest[10 * n :].reshape(n, CELL)
    return out


class Anchors:
    """Anchors of some documents and their cells."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.data = data
        n = len(data)
        none = np.zeros(0, np.int64)
        self.at = self.doc = self.low = self.high = none
        self.hash = self.cell = np.zeros(0, np.uint64)
        if n < LENGTH:
            return
        sums = prefix(byte_values(data))
        places = np.arange(n - ANCHOR + 1)
        h = spans(sums, places, places + ANCHOR) | np.uint64(1)
        least = sliding_min(h, SIDE + 1)
        whole = np.zeros(n + 1, bool)  # where a string of LENGTH bytes starts inside a document
        size = np.diff(starts)
        long = size >= LENGTH
        whole[: len(whole)] = covered(n + 1, starts[:-1][long], starts[1:][long] - LENGTH + 1)
        least[~whole[: len(least)]] = 0
        pad = np.zeros(SIDE, np.uint64)
        keep = ~sliding_min(~np.concatenate([pad, least, pad]), SIDE + 1) == h
        self.at = np.flatnonzero(keep)
        self.doc = np.searchsorted(starts, self.at, "right") - 1
        self.hash = h[self.at]
        self.low = np.maximum(self.at - SIDE, starts[self.doc])
        self.high = np.minimum(self.at + LENGTH, starts[self.doc + 1])
        self.cell = mix(spans(sums, self.low, self.high) ^ (self.at - self.low).astype(np.uint64) * _LEFT)

    def only(self, keep: np.ndarray) -> Anchors:
        for name in ("at", "doc", "hash", "low", "high", "cell"):
            setattr(self, name, getattr(self, name)[keep])
        return self

    def strings(self) -> np.ndarray:
        """Bit j of an anchor: a whole string starts j bytes before it."""
        most, fewest = self.at - self.low, np.maximum(0, self.at + LENGTH - self.high)
        one = np.uint32(1)
        return np.where(most >= fewest, (one << (most + 1).astype(np.uint32)) - (one << fewest.astype(np.uint32)), 0).astype(np.uint32)


def pieces(docs: pa.Table):
    data, starts = bytes_of(docs.column("text"))
    for i, j in chunks(starts, PIECE):
        yield i, j, data[starts[i] : starts[j]], starts[i : j + 1] - starts[i]


def shared_anchors(docs: pa.Table, told):
    heard = heard_keys(told)
    for i, j, data, starts in pieces(docs):
        a = Anchors(data, starts)
        yield i, j, data, starts, a.only(member(short(a.hash), heard))


def smallest(cells: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct cells, the smallest document of each and its place."""
    order = np.lexsort((docs, cells))
    at = runs(cells[order])
    return cells[order][at], docs[order][at], order[at]


def _say_anchors(block, docs, told, buckets):
    ids, keys, who = ids_of(docs), [], []
    for i, _, data, starts in pieces(docs):
        a = Anchors(data, starts)
        keys.append(a.hash)
        who.append(ids[i + a.doc])
    yield from say_keys(np.concatenate(keys), np.concatenate(who), buckets)


def _say_cells(block, docs, told, buckets):
    ids, parts = ids_of(docs), []
    for i, _, data, _, a in shared_anchors(docs, told):
        who = ids[i + a.doc]
        _, doc, place = smallest(a.cell, who)
        out = np.zeros(len(place), _ENTRY)
        out["anchor"], out["cell"], out["doc"] = a.hash[place], a.cell[place], doc
        out["left"], out["right"] = (a.at - a.low)[place], (a.high - a.at)[place]
        padded = np.concatenate([np.zeros(SIDE, np.uint8), data, np.zeros(LENGTH, np.uint8)])
        text = padded[a.at[place][:, None] + np.arange(CELL)]
        k = np.arange(CELL)
        out["text"] = np.where((k >= SIDE - out["left"][:, None]) & (k < SIDE + out["right"][:, None].astype(int)), text, 0)
        parts.append(out)
    if parts:
        every = np.concatenate(parts)
        every = every[smallest(every["cell"], every["doc"])[2]]
        for bucket, idx in by_bucket(every["anchor"], buckets):
            yield bucket, squeeze(every[idx])


def string_owners(cells: np.ndarray) -> np.ndarray:
    """For distinct cells in order of their anchors: the smallest document of each string (cell, bytes before the anchor); the largest number for none."""
    none = np.iinfo(np.int64).max
    j = np.arange(SIDE + 1)
    left, right = cells["left"].astype(int)[:, None], cells["right"].astype(int)[:, None]
    there = (j <= left) & (LENGTH - j <= right)
    owner = np.where(there, cells["doc"][:, None], none)
    begin = runs(cells["anchor"])
    group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(cells))))
    # Symbols: 0 after a cell, 1 for no byte, 2 to 257 for bytes, then one for each anchor.
    symbols = np.zeros((len(cells), 2 * SIDE + 2), np.int64)
    place = np.arange(CELL)
    bytes_ = np.where((place >= SIDE - left) & (place < SIDE + right), cells["text"].astype(np.int64) + 2, 1)
    symbols[:, :SIDE], symbols[:, SIDE], symbols[:, SIDE + 1 : -1] = bytes_[:, :SIDE], 258 + group, bytes_[:, SIDE + ANCHOR :]
    width = symbols.shape[1]
    sums = prefix(mix(symbols.reshape(-1).astype(np.uint64) + np.uint64(1)))
    at = (np.arange(len(cells)) * width + SIDE)[:, None] - j
    h = spans(sums, at.ravel(), at.ravel() + SIDE + 1).reshape(at.shape)
    seen, many = np.unique(h[there], return_counts=True)
    often = there & member(h, seen[many > 1])
    todo = np.flatnonzero(often.any(1))
    # What is sorted of a cell goes from its first to its last string that another cell has; of cells that are equal there, one stands for all, with the
    # smallest document.
    most, fewest = SIDE - np.argmax(often[todo, ::-1], 1), np.argmax(often[todo], 1)
    inside = (j >= fewest[:, None]) & (j <= most[:, None])
    _, one, piece = np.unique(spans(sums, todo * width + SIDE - most, todo * width + 2 * SIDE + 1 - fewest), return_index=True, return_inverse=True)
    least = np.full(len(one), none)
    np.minimum.at(least, piece, cells["doc"][todo])
    owner[todo[one]] = np.where(inside[one], least[:, None], owner[todo[one]])
    sorted_ = np.sort(one)  # in order of the anchors
    cut = np.flatnonzero(np.diff(group[todo[sorted_]], prepend=-1))  # whole anchors to one array
    edges, last = [0], 0
    for c in [*cut[1:].tolist(), len(sorted_)]:
        if c - edges[-1] > SORTED // width and last > edges[-1]:
            edges.append(last)
        last = c
    column = np.arange(width)
    for a, b in zip(edges, [*edges[1:], len(sorted_)], strict=True):
        some = sorted_[a:b]
        if not len(some):
            continue
        rows, end = symbols[todo[some]], 2 * SIDE + 1 - fewest[some]
        rows[np.arange(len(some)), end] = 0
        row, at = np.nonzero((column >= (SIDE - most[some])[:, None]) & (column <= end[:, None]))
        sa = suffix_array(rows[row, at])
        row, before = some[row[sa]], SIDE - at[sa]
        whole = before >= fewest[row]
        cell, before = todo[row[whole]], before[whole]
        own = h[cell, before]  # equal strings are neighbours now
        first = runs(own)
        low = np.minimum.reduceat(owner[cell, before], first) if len(first) else first
        owner[cell, before] = np.repeat(low, np.diff(np.append(first, len(own))))
    owner[todo] = np.where(inside, owner[todo[one[piece]]], owner[todo])
    return owner


def _hear_cells(blocks, data):
    """To each block, for its cells: the strings that a smaller document has (bit j: the one that starts j bytes before the anchor)."""
    sent = [expand(x) for x in data]
    every = np.concatenate(sent)
    _, _, place = smallest(every["cell"], every["doc"])
    distinct = every[place]
    distinct = distinct[np.lexsort((distinct["cell"], distinct["anchor"]))]
    begin = runs(distinct["anchor"])
    several = np.repeat(np.diff(np.append(begin, len(distinct))) > 1, np.diff(np.append(begin, len(distinct))))
    j = np.arange(SIDE + 1)
    there = (j <= distinct["left"].astype(int)[:, None]) & (LENGTH - j <= distinct["right"].astype(int)[:, None])
    owner = np.where(there, distinct["doc"][:, None], np.iinfo(np.int64).max)
    if several.any():
        owner[several] = string_owners(distinct[several])
    order = np.argsort(distinct["cell"])
    cells, owner = distinct["cell"][order], owner[order]
    for b, own in zip(blocks, sent, strict=True):
        smaller = owner[np.searchsorted(cells, own["cell"])] < own["doc"][:, None]
        mask = (smaller.astype(np.uint32) << j.astype(np.uint32)).sum(1, dtype=np.uint32)
        if (hit := mask > 0).any():
            yield int(b), own["cell"][hit].tobytes() + mask[hit].tobytes()


NAMES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
KINDS = ["bigint", "bigint", "bigint", "bigint", "string", "binary"]
_SCHEMA = pa.schema([(n, {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in zip(NAMES, KINDS, strict=True)])


def _result(docs: pa.Table, told, width: int) -> pa.Table:
    ids, out = ids_of(docs), []
    null = docs.column("doc_id").is_null().to_pylist()
    found = list(shared_anchors(docs, [x[1:] for x in told if len(x) and x[0] == 0])) if docs.num_rows else []
    masks = [x[1:] for x in told if len(x) and x[0] == 1]
    cut = [len(x) // 12 * 8 for x in masks]
    cells = np.concatenate([np.zeros(0, np.uint64), *[x[:c].copy().view(np.uint64) for x, c in zip(masks, cut, strict=True)]])
    mask = np.concatenate([np.zeros(0, np.uint32), *[x[c:].copy().view(np.uint32) for x, c in zip(masks, cut, strict=True)]])
    order = np.argsort(cells)
    cells, mask = cells[order], mask[order]
    if found:
        own, low, _ = smallest(np.concatenate([f[4].cell for f in found]), np.concatenate([ids[f[0] + f[4].doc] for f in found]))
    for i, j, data, starts, a in found:
        all_ = a.strings()
        bits = np.zeros(len(all_), np.uint32)
        if len(all_):
            hit = member(a.cell, cells)
            if len(cells):
                bits[hit] = mask[np.searchsorted(cells, a.cell[hit])]
            # Another document of the block has the whole cell and is smaller: all strings go.
            bits = np.where(low[np.searchsorted(own, a.cell)] < ids[i + a.doc], all_, bits)
        gone = [a.at[bits >> np.uint32(k) & np.uint32(1) == 1] - k for k in range(SIDE + 1)]
        gone = np.unique(np.concatenate(gone))
        lost = covered(len(data), gone, gone + LENGTH)
        raw = data.tobytes()
        for x in range(j - i):
            s, e = int(starts[x]), int(starts[x + 1])
            drop = lost[s:e]
            n = int(drop.sum())
            kept = data[s:e][~drop].tobytes() if n else raw[s:e]
            n_spans = int(drop[:1].sum() + (drop[1:] & ~drop[:-1]).sum()) if n else 0
            out.append([None if null[i + x] else int(ids[i + x]), e - s, n, n_spans, hashlib.sha256(kept).hexdigest(), kept][:width])
    schema = pa.schema(list(_SCHEMA)[:width])
    return pa.table([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [[]] * width, schema, strict=True)], schema=schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the bytes that stay, where ``texts``)."""
    blocks, width = Blocks(docs, id_col, text_col), len(NAMES) - (not texts)
    shared = blocks.hear(blocks.say(_say_anchors), shared_keys)
    masks = blocks.hear(blocks.say(_say_cells, shared), _hear_cells)
    kinds = ", ".join(f"{n} {t}" for n, t in zip(NAMES[:width], KINDS, strict=False))
    return blocks.finish(lambda b, docs, told: _result(docs, told, width), kinds, blocks.both(shared, masks))


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT doc_id, i, hash(substr(x, 2 * i + 1, 100)) AS h, substr(x, 2 * i + 1, 100) AS s FROM d, unnest(range(0, len(x) // 2 - 49)) AS t(i)),
m AS (SELECT s, min(doc_id) AS lo FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)),
c AS (SELECT g.doc_id, g.i FROM g JOIN m USING (s) WHERE m.lo < g.doc_id),
e AS (SELECT doc_id, i, coalesce(i > lag(i) OVER w + 50, true) AS new, coalesce(least(i - lag(i) OVER w, 50), 50) AS step FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, sum(step)::BIGINT AS n_removed, count(*) FILTER (new) AS n_spans FROM e GROUP BY doc_id),
s AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM e) GROUP BY doc_id, k),
o AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
q AS (SELECT doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept FROM o JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN r.doc_id IS NULL THEN x ELSE coalesce(q.kept, '') END)) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN q USING (doc_id)
"""


@query("op5_suffix_dedup", SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
