"""Benchmark decontamination by winnowing.

Every document keeps the smallest 5-gram hash of each 9 neighbours. A shared span of 13 words holds 9 neighbouring 5-grams on both sides and so a
shared fingerprint. A fixed-size bit filter of the benchmark's fingerprints drops most of a document's fingerprints inside the scan; the rest join the
benchmark's fingerprints exactly. Hits are extended to the whole windows around them, which join the benchmark's windows on two independent
64-bit hashes. The filter's size does not depend on the benchmark: a large benchmark lets more fingerprints through to the join, and results stay the same.

An item of fewer than 13 words is one window; for each such length (at most 12) documents emit the hits of all their windows of that length.

Null and empty texts have no words: nothing is hit, and an item without words has no window. Repeated documents keep a row each; repeated items
count once per item_id. Other columns are not read. An empty benchmark leaves every document clean; an empty document table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import staged, table
from .registry import query
from .text import LETTERS, LOWER, byte_values, bytes_of, chunks, mix, prefix, ramp, spans, winnowed, words

WINDOW = 13
GRAM = 5
FILTER_BITS = 1 << 23
_OTHER = np.uint64(0xA0761D6478BD642F)
_KEYS = pa.struct([("m", pa.int32()), ("f", pa.int64()), ("at", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64())])
KEYS = "array<struct<m: int, f: bigint, at: bigint, w1: bigint, w2: bigint>>"


class Words:
    """Word hashes of some texts, lower-cased, under two independent functions."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        data = LOWER[data]
        begin, end, self.first = words(data, starts, LETTERS)
        self.size = np.diff(self.first)
        one = spans(prefix(byte_values(data)), begin, end)
        two = spans(prefix(mix(byte_values(data) ^ _OTHER)), begin, end)
        self.one, self.two = prefix(one), prefix(two)

    def starts(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word of every run of ``n`` words, and its text."""
        count = np.maximum(self.size - n + 1, 0)
        text = np.repeat(np.arange(len(count)), count)
        return self.first[text] + ramp(count), text

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Place and hash of the winnowed 5-grams of texts with a whole window."""
        out = []
        for x in np.flatnonzero(self.size >= WINDOW):
            at = np.arange(self.first[x], self.first[x + 1] - GRAM + 1)
            h = spans(self.one, at, at + GRAM)
            keep = winnowed(h, WINDOW - GRAM + 1)
            out.append((at[keep], h[keep]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    def both(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        return spans(self.one, at, at + n), spans(self.two, at, at + n)


def _texts(batches, kept: int):
    for batch in batches:
        data, starts = bytes_of(batch.column(kept))
        for i, j in chunks(starts):
            yield batch.slice(i, j - i), Words(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _item_windows(batches):
    for batch, w in _texts(batches, 1):
        for m in np.unique(np.minimum(w.size, WINDOW)):
            if m:
                at, text = w.starts(int(m))
                ok = w.size[text] >= WINDOW if m == WINDOW else w.size[text] == m
                one, two = w.both(at[ok], int(m))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(ok.sum()), m, np.int32)), pa.array(_signed(one)), pa.array(_signed(two)),
                                                  batch.column(0).take(pa.array(text[ok]))], ["m", "w1", "w2", "item_id"])


def _item_grams(batches):
    for _, w in _texts(batches, 1):
        yield pa.RecordBatch.from_arrays([pa.array(_signed(w.grams()[1]))], ["f"])


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(len(bits) * 8 - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _documents(batches, filters, lengths: list[int]):
    """Every document's number of words and the windows around its fingerprints that pass the filter."""
    bits = filters.value
    for batch, w in _texts(batches, 1):
        parts = []
        at, h = w.grams()
        hit = _passes(bits, h)
        at, h = at[hit], h[hit]
        text = np.searchsorted(w.first, at, "right") - 1
        low = np.maximum(at - (WINDOW - GRAM), w.first[text])
        many = np.maximum(np.minimum(at, w.first[text + 1] - WINDOW) - low + 1, 0)
        start = np.repeat(low, many) + ramp(many)
        parts.append((np.full(len(start), WINDOW), np.repeat(h, many), start, np.repeat(text, many)))
        for m in lengths:
            at, text = w.starts(m)
            h = spans(w.one, at, at + m)
            hit = _passes(bits, h)
            parts.append((np.full(int(hit.sum()), m), h[hit], at[hit], text[hit]))
        m, f, start, text = (np.concatenate([p[k] for p in parts]) for k in range(4))
        order = np.argsort(text, kind="stable")
        m, f, start, text = m[order], f[order].astype(np.uint64), start[order], text[order]
        one, two = spans(w.one, start, start + m), spans(w.two, start, start + m)
        keys = pa.StructArray.from_arrays([pa.array(m.astype(np.int32)), pa.array(_signed(f)), pa.array(start - w.first[text]), pa.array(_signed(one)),
                                           pa.array(_signed(two))], fields=list(_KEYS))
        ends = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
        whole = spans(w.one, w.first[:-1], w.first[1:])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_signed(whole)), pa.array(w.size.astype(np.int64)),
                                          pa.ListArray.from_arrays(pa.array(ends), keys)], ["doc_id", "sequence", "n_words", "hits"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and ``items`` (sorted as strings)."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    windows = staged(bench.mapInArrow(_item_windows, "m int, w1 bigint, w2 bigint, item_id string").distinct(), "item-windows")
    short = windows.where(F.col("m") < WINDOW).select("m", F.col("w1").alias("f"))
    grams = staged(bench.mapInArrow(_item_grams, "f bigint").select(F.lit(WINDOW).alias("m"), "f").unionAll(short).distinct(), "item-grams")
    lengths = sorted(r[0] for r in short.select("m").distinct().collect())  # at most 12 numbers
    # Set bytes of the filter: at most FILTER_BITS / 8 rows, however large the benchmark is.
    place = F.col("f").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("p")
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in grams.select(place).groupBy(F.expr("cast(shiftright(p, 3) as int)").alias("byte")).agg(
            F.bit_or(F.expr("shiftleft(1, cast(p & 7 as int))")).alias("v")).toLocalIterator():
        bits[r["byte"]] = r["v"]
    filters = spark.sparkContext.broadcast(bits)
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = staged(d.mapInArrow(lambda b: _documents(b, filters, lengths), f"doc_id bigint, sequence bigint, n_words bigint, hits {KEYS}"), "document-hits")
    key = ["doc_id", "sequence"]
    near = found.where(F.size("hits") > 0).select(*key, F.explode("hits").alias("h")).select(*key, "h.*")
    near = near.join(grams, ["m", "f"], "left_semi").select(*key, "m", "at", "w1", "w2").distinct()
    hits = near.join(windows, ["m", "w1", "w2"])
    span = F.struct(F.col("at"), (F.col("at") + F.col("m")).alias("end"))
    result = hits.groupBy(*key).agg(F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    n_hit = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), lambda a, s: F.struct(
        (a["n"] + F.greatest(s["end"] - F.greatest(a["to"], s["at"]), F.lit(0))).alias("n"), F.greatest(a["to"], s["end"]).alias("to")), lambda a: a["n"])
    result = result.select(F.col("doc_id").alias("d"), F.col("sequence").alias("q"), n_hit.alias("hit"), "items")
    none = F.array().cast("array<string>")
    out = found.select(*key, "n_words").join(result, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sequence") == F.col("q")), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        ((F.coalesce("hit", F.lit(0)) > 0) & (20 * F.coalesce("hit", F.lit(0)) >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("items", none).alias("items"),
    )


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
bw AS (SELECT item_id, least(len(ws), 13) AS m, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS win
       FROM b, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS t(i) WHERE len(ws) > 0),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS win FROM d, ms, unnest(range(1, len(ws) - m + 2)) AS t(i)),
h AS (SELECT DISTINCT doc_id, i, m, item_id FROM dw JOIN bw USING (m, win)),
n AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM h, unnest(range(0, m)) AS r(k) GROUP BY doc_id),
x AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM h GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(x.n, 0)::BIGINT AS n_items, sha256(coalesce(x.s, '')) AS items_sha256,
       coalesce(n.n, 0) > 0 AND 20 * coalesce(n.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN x USING (doc_id)
"""


@query("op3_decontamination", SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")
