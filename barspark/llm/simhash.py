"""SimHash near-dedup by anchor-point covering.

A fingerprint's first 46 bits are two vectors of 23 bits. The binary Golay code covers each with radius 3 (every vector has exactly one codeword within
3), so pairs of codewords are anchors. A fingerprint x lives at its home anchor. If y differs from x in at most 2 bits, y's two parts are within
(3, 5), (4, 4) or (5, 3) of x's home; so y is copied to every anchor that near to it (about 60), and x meets y at x's home. Homes and copies
meet in a Spark join on the anchor whose condition counts the differing bits of all 64. A fingerprint has at most 2,080 others within 2 bits, so the
links grow with the number of distinct fingerprints. Only distinct fingerprints take part: copies of a text are membership, not pairs.

Null and empty texts, and texts of white space, have the fingerprint zero and are linked like any other. Repeated rows keep a row each. A null doc_id gets a
component like any other but is never its smallest id unless the whole component has none. An empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .files import staged, table
from .registry import query

SHINGLE = 3
SEED = 42
GENERATOR = 0b110001110101  # of the binary Golay code of length 23: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
PART = 23
RADIUS = 3


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if more than half of the shingles' XXH64 have it."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    begin = np.concatenate([[0], np.cumsum(np.array([len(w) + 1 for w in words]))])
    k = min(shingle, len(words))
    spans = zip(begin[: len(words) - k + 1].tolist(), (begin[k:] - 1).tolist(), strict=True)
    h = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * ones > len(h)).tolist()))


def _fingerprints(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            fp = np.array([fingerprint(t) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], ["doc_id", "fp"])


@functools.lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, list[list[np.ndarray]]]:
    """Home codeword of each vector; its coset; for each coset and distance 4 and 5, what turns the home into the codewords that far away."""
    message = np.arange(4096, dtype=np.uint32)
    code = np.zeros(4096, np.uint32)
    for b in range(12):
        code ^= np.where(message >> b & 1, np.uint32(GENERATOR << b), np.uint32(0))
    vectors = np.arange(1 << PART, dtype=np.uint32)
    errors = vectors[np.bitwise_count(vectors) <= RADIUS]
    home, coset = np.zeros(1 << PART, np.uint16), np.zeros(1 << PART, np.uint16)
    near: list[list[np.ndarray]] = []
    for k, e in enumerate(errors):
        home[code ^ e], coset[code ^ e] = message, k
        weight = np.bitwise_count(code ^ e)
        near.append([np.flatnonzero(weight == d).astype(np.int64) for d in (RADIUS + 1, RADIUS + 2)])
    return home, coset, near


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home anchor of each fingerprint; and (number of the fingerprint, anchor) of every copy."""
    home, coset, near = golay()
    x = fp.view(np.uint64)
    mask = np.uint64((1 << PART) - 1)
    a, b = (x & mask).astype(np.int64), (x >> np.uint64(PART) & mask).astype(np.int64)
    ha, hb = home[a].astype(np.int64), home[b].astype(np.int64)
    who, where = [], []
    zero = np.zeros(1, np.int64)
    for i, (p, q, ca, cb) in enumerate(zip(ha.tolist(), hb.tolist(), coset[a].tolist(), coset[b].tolist(), strict=True)):
        a4, a5 = near[ca]
        b4, b5 = near[cb]
        left = np.concatenate([zero, a4, a5]) ^ p
        right = np.concatenate([b4, b5]) ^ q
        at = np.concatenate([left << 12 | q, p << 12 | right, ((a4 ^ p)[:, None] << 12 | (b4 ^ q)[None, :]).ravel()])
        who.append(np.full(len(at), i))
        where.append(at)
    return ha << 12 | hb, np.concatenate(who) if who else zero[:0], np.concatenate(where) if where else zero[:0]


def _copies(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 2048):
            fp = batch.column(0).slice(i, 2048).to_numpy()
            _, who, where = anchors(fp)
            yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), pa.array(fp[who])], ["anchor", "fp"])


def _homes(batches):
    for batch in batches:
        fp = batch.column(0).to_numpy()
        home, coset, _ = golay()
        x, mask = fp.view(np.uint64), np.uint64((1 << PART) - 1)
        at = home[(x & mask).astype(np.int64)].astype(np.int32) << 12 | home[(x >> np.uint64(PART) & mask).astype(np.int64)].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(0)], ["anchor", "fp"])


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints at 2 or fewer differing bits, each once.

    Neither side is broadcast: Spark takes the copies to be as small as the table of fingerprints they are made from, which is about 60 times too little."""
    homes = fps.select("fp").mapInArrow(_homes, "anchor int, fp bigint").withColumnRenamed("fp", "a")
    copies = fps.select("fp").mapInArrow(_copies, "anchor int, fp bigint").withColumnRenamed("fp", "b")
    met = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
    return homes.join(copies.hint("merge"), "anchor").where(met).select("a", "b")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, fingerprint (hex), component_id."""
    d = staged(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _fingerprints, "doc_id bigint, fp bigint"), "fingerprints")
    fps = staged(d.groupBy("fp").agg(F.min("doc_id").alias("lo")), "distinct-fingerprints")
    roots = components(staged(links(fps), "links"))
    member = staged(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "lo", F.coalesce("root", "fp").alias("root")), "members")
    group = member.groupBy("root").agg(F.min("lo").alias("component_id"))
    return d.join(member.join(group, "root").select("fp", "component_id"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_simhash_groups")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
