"""Substring dedup by difference-cover anchors.

For a cover D of the residues modulo a period v, any two places i and j have a shift s < v with i + s and j + s both in D (modulo v). So two
equal windows of ``window`` words hold an equal, aligned *anchor* of ``window - v + 1`` words that starts at cover places in both. Only anchors at
cover places are hashed (6 of 31); windows are extended around anchors that another document has too, and compared as whole windows.

Three passes over blocks of documents (see ``blocks``): anchors; windows around shared anchors with the smallest doc_id of each block; result.
Equality is that of 64-bit hashes of the words' bytes. Nulls and empty texts have no words. Repeated doc_ids do not cover each other. A null doc_id counts
as larger than all others. Texts of fewer than ``window`` words lose nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .blocks import Blocks, by_bucket, heard_keys, member, runs, say_keys, shared_keys, short
from .files import table
from .registry import query
from .text import NOT_SPACE, byte_values, bytes_of, chunks, covered, mix, prefix, ramp, spans, words

WINDOW = 50
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)  # every residue modulo 31 is a difference of two of these
LAST = np.iinfo(np.int64).max


def ids_of(docs: pa.Table) -> np.ndarray:
    return docs.column("doc_id").combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


class Words:
    """Words of some documents: ``size`` and ``first`` word of each, and ``sums`` for hashes of word sequences."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        begin, end, self.first = words(data, starts, NOT_SPACE)
        self.size = np.diff(self.first)
        self.sums = prefix(spans(prefix(byte_values(data)), begin, end))

    def anchors(self, window: int, period: int, cover) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, word number and document of every anchor."""
        length = window - period + 1
        n = np.where(self.size >= window, self.size - length + 1, 0)
        at = ramp(n)
        doc = np.repeat(np.arange(len(n)), n)
        keep = np.isin(np.arange(period), cover)[at % period]
        at, doc = at[keep], doc[keep]
        place = self.first[doc] + at
        return spans(self.sums, place, place + length), place, doc

    def windows(self, window: int, period: int, place: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, word number and document of the windows that hold one of the anchors."""
        low = np.maximum(place - period + 1, self.first[doc])
        high = np.minimum(place, self.first[doc + 1] - window)
        ok = high >= low
        start = np.flatnonzero(covered(int(self.first[-1]), low[ok], high[ok] + 1))
        return spans(self.sums, start, start + window), start, np.searchsorted(self.first, start, "right") - 1


def parts(docs: pa.Table):
    """Chunks of the block: documents' numbers, bytes and starts."""
    data, starts = bytes_of(docs.column("text"))
    for i, j in chunks(starts):
        yield i, j, data[starts[i] : starts[j]], starts[i : j + 1] - starts[i]


def shared_windows(docs: pa.Table, told, window, period, cover):
    """Windows (hash, place, document) of each chunk around the anchors that others have."""
    heard = heard_keys(told)
    for i, j, data, starts in parts(docs):
        w = Words(data, starts)
        h, place, doc = w.anchors(window, period, cover)
        hit = member(short(h), heard)
        yield i, j, data, starts, w, w.windows(window, period, place[hit], doc[hit])


def least(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the smallest document of each."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    at = runs(keys)
    return keys[at], docs[at]


def say_least(keys: np.ndarray, docs: np.ndarray, buckets: int):
    for bucket, idx in by_bucket(keys, buckets):
        yield bucket, keys[idx].tobytes() + docs[idx].astype(np.int64).tobytes()


def _pairs(data: list[np.ndarray]):
    keys = [x[: len(x) // 2].view(np.uint64) for x in data]
    docs = [x[len(x) // 2 :].view(np.int64) for x in data]
    return keys, docs


def hear_least(blocks: np.ndarray, data: list[np.ndarray]):
    """To each block the keys that a smaller document elsewhere has, with that document."""
    keys, docs = _pairs(data)
    k, d = least(np.concatenate(keys), np.concatenate(docs))
    for b, own, doc in zip(blocks, keys, docs, strict=True):
        smallest = d[np.searchsorted(k, own)]
        if (smaller := smallest < doc).any():
            yield int(b), own[smaller].tobytes() + smallest[smaller].tobytes()


def merged(keys: np.ndarray, docs: np.ndarray, told: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The block's own smallest documents, and what it heard."""
    k, d = _pairs(told)
    return least(np.concatenate([keys, *k]), np.concatenate([docs, *d]))


def remove_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, period: int = PERIOD,
                      cover: tuple[int, ...] = COVER, texts: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (and ``kept``, the words that stay, where ``texts``)."""
    if {(a - b) % period for a in cover for b in cover} != set(range(period)) or window < period:
        raise ValueError("not a difference cover of a period within the window")
    blocks = Blocks(docs, id_col, text_col)
    how = (window, period, cover)

    def say_anchors(block, docs, told, buckets):
        ids, keys, who = ids_of(docs), [], []
        for i, _, data, starts in parts(docs):
            h, _, doc = Words(data, starts).anchors(*how)
            keys.append(h)
            who.append(ids[i + doc])
        yield from say_keys(np.concatenate(keys), np.concatenate(who), buckets)

    def say_windows(block, docs, told, buckets):
        ids, keys, who = ids_of(docs), [], []
        for i, _, _, _, _, (h, _, doc) in shared_windows(docs, told, *how):
            keys.append(h)
            who.append(ids[i + doc])
        if keys:
            yield from say_least(*least(np.concatenate(keys), np.concatenate(who)), buckets)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * texts]
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())][: len(names)])

    def result(block, docs, told):
        ids, out = ids_of(docs), []
        anchors = [x[1:] for x in told if len(x) and x[0] == 0]
        smaller = [x[1:] for x in told if len(x) and x[0] == 1]
        found = list(shared_windows(docs, anchors, *how)) if docs.num_rows else []
        k, d = merged(*least(np.concatenate([f[5][0] for f in found]), np.concatenate([ids[f[0] + f[5][2]] for f in found])), smaller) if found else (None, None)
        null = docs.column("doc_id").is_null().to_pylist()
        for i, j, data, starts, w, (h, start, doc) in found:
            gone = d[np.searchsorted(k, h)] < ids[i + doc] if len(h) else np.zeros(0, bool)
            lost = covered(int(w.first[-1]), start[gone], start[gone] + window)
            raw = data.tobytes()
            for x in range(j - i):
                own = raw[starts[x] : starts[x + 1]].split()
                drop = lost[w.first[x] : w.first[x + 1]]
                kept = b" ".join(compress(own, ~drop) if drop.any() else own)
                row = [None if null[i + x] else int(ids[i + x]), len(own), int(drop.sum()), hashlib.sha256(kept).hexdigest()]
                out.append(row + [kept.decode()] * texts)
        return pa.table([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [[]] * len(names), schema, strict=True)], schema=schema)

    shared = blocks.hear(blocks.say(say_anchors), shared_keys)
    smaller = blocks.hear(blocks.say(say_windows, shared), hear_least)
    kinds = ", ".join(f"{n} {'bigint' if t == pa.int64() else 'string'}" for n, t in zip(schema.names, schema.types, strict=True))
    return blocks.finish(result, kinds, blocks.both(shared, smaller))


SQL = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, ws, i, array_to_string(ws[i:i + 49], ' ') AS win FROM w, unnest(range(1, len(ws) - 48)) AS t(i)),
m AS (SELECT win, min(doc_id) AS lo FROM g GROUP BY win),
c AS (SELECT DISTINCT g.doc_id, g.i + k.k AS p FROM g JOIN m USING (win), range(0, 50) AS k(k) WHERE m.lo < g.doc_id),
r AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM c GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(r.n, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN r.n IS NULL THEN array_to_string(ws, ' ')
              ELSE coalesce((SELECT string_agg(ws[q], ' ' ORDER BY q) FROM unnest(range(1, len(ws) + 1)) AS u(q)
                    WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = w.doc_id AND c.p = q)), '') END) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""


@query("op6_substring_dedup", SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_substrings(table(spark, sf_dir, "documents"))
