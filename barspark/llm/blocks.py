"""Questions about the whole corpus, answered block by block.

Documents are dealt into blocks of a few MB by a hash of their id. A block tells many *buckets* what it holds: sorted arrays of 64-bit keys, one
row per block and bucket. A bucket compares the blocks and sends each what it has to know. A key that a third of all documents share is one
entry per block, however many documents of the block hold it, so no bucket grows with a hot key. All passes over the text read the same exchange.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A block and a bucket exchange one row, so their numbers follow the text and not the session's partitions, and blocks grow before they become too many.
BLOCK_BYTES, LARGEST_BLOCK = 2 << 20, 32 << 20
MOST_BLOCKS = 4096
LEAST = 24
SAID = "bucket bigint, block bigint, data binary"
HEARD = "block bigint, data binary"
_SAID = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])
_HEARD = pa.schema([("block", pa.int64()), ("data", pa.binary())])


class Blocks:
    """Documents by block, with the number of blocks and of buckets for their size."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES,
                 carry: tuple[str, ...] = ()):
        spark = docs.sparkSession
        total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
        self.count = max(LEAST, -(-total // min(max(block_bytes, total // MOST_BLOCKS), LARGEST_BLOCK)))
        self.buckets = max(LEAST, self.count // 4)
        self.spark = spark
        self.docs = docs.select(
            F.pmod(F.xxhash64(F.col(id_col)), F.lit(self.count)).alias("block"), F.col(id_col).cast("bigint").alias("doc_id"),
            F.col(text_col).cast("string").alias("text"), *carry,
        )

    def say(self, fn: Callable, heard: DataFrame | None = None) -> DataFrame:
        """``fn(block, docs, heard)`` yields (bucket, bytes) of every block."""
        buckets = self.buckets
        return self.finish(lambda b, docs, told: _rows(_SAID, ((k, b, d) for k, d in fn(b, docs, told, buckets))), SAID, heard)

    def hear(self, said: DataFrame, fn: Callable) -> DataFrame:
        """``fn(blocks, data)`` yields (block, bytes) of every bucket."""
        return said.groupBy("bucket").applyInArrow(
            lambda t: _rows(_HEARD, fn(t.column("block").to_numpy(), [np.frombuffer(x.as_py(), np.uint8) for x in t.column("data")])), HEARD)

    def both(self, first: DataFrame, second: DataFrame) -> DataFrame:
        """What a block heard in two rounds: data with a byte 0 or 1 before it."""
        tag = lambda df, x: df.select("block", F.concat(F.lit(bytes([x])), F.col("data")).alias("data"))
        return tag(first, 0).unionAll(tag(second, 1))

    def finish(self, fn: Callable, schema: str, heard: DataFrame | None = None) -> DataFrame:
        """``fn(block, docs, heard)`` returns the table of every block."""
        if heard is None:
            return self.docs.groupBy("block").applyInArrow(lambda t: fn(t.column("block")[0].as_py(), t, []), schema)

        def both(docs, told):
            if not docs.num_rows:  # a block hears only what it asked
                return fn(None, docs, [])
            return fn(docs.column("block")[0].as_py(), docs, [np.frombuffer(x.as_py(), np.uint8) for x in told.column("data")])

        return self.docs.groupBy("block").cogroup(heard.groupBy("block")).applyInArrow(both, schema)


def _rows(schema: pa.Schema, rows) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def by_bucket(keys: np.ndarray, buckets: int):
    """The places of ``keys`` by bucket: (bucket, indices in order of the key)."""
    if not len(keys):
        return
    bucket = (keys >> np.uint64(1)) % np.uint64(buckets)
    order = np.lexsort((keys, bucket))
    bucket = bucket[order]
    cut = runs(bucket)
    for i, j in zip(cut, [*cut[1:], len(keys)], strict=True):
        yield int(bucket[i]), order[i:j]


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins in sorted columns."""
    if not len(keys[0]):
        return np.zeros(0, int)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


# Keys that more than one document holds, by 47 bits of their hash: a chance match only means more to compare later. Six bytes a key are sent, the
# lowest bit is 1 if several documents of the block hold it.


def short(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(17)


def six_bytes(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = data.reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def say_keys(hashes: np.ndarray, docs: np.ndarray, buckets: int):
    keys = short(hashes)
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    at = runs(keys)
    if not len(at):
        return
    several = np.minimum.reduceat(docs, at) != np.maximum.reduceat(docs, at)
    sent = keys[at] << np.uint64(1) | several.astype(np.uint64)
    for bucket, idx in by_bucket(sent, buckets):
        yield bucket, six_bytes(sent[idx])


def shared_keys(blocks: np.ndarray, data: list[np.ndarray]):
    """To each block those of its keys that another document has too."""
    sent = [from_six(x) for x in data]
    every = np.concatenate(sent)
    key = np.sort(every >> np.uint64(1))
    at = runs(key)
    twice = key[at][np.diff(np.append(at, len(key))) > 1]
    flagged = every[(every & np.uint64(1)) == 1] >> np.uint64(1)
    shared = np.union1d(twice, flagged)
    for b, x in zip(blocks, sent, strict=True):
        own = x >> np.uint64(1)
        if len(out := own[member(own, shared)]):
            yield int(b), six_bytes(out)


def member(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """True where a key is in the sorted ``table``."""
    if not len(table):
        return np.zeros(np.shape(keys), bool)
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys


def heard_keys(told: list[np.ndarray]) -> np.ndarray:
    return np.sort(np.concatenate([from_six(x) for x in told])) if told else np.zeros(0, np.uint64)
