"""Importance resampling towards a target text by bit-sliced sums.

Features are runs of 1 to 3 words, hashed into 10,000 buckets. A document's bucket counts become *planes*: plane j holds bit j of all 10,000 counts, so
a document is a few bitmaps of 1,250 bytes, written once. The gains of the buckets become planes in the same way, those of positive and of negative gains
apart. A weight is then the sum over pairs of planes of 2^(j + k) * popcount(count plane j AND gain plane k), with the sign of the gain: whole numbers
only, hence exact whatever the order.

Counts of the corpus are sums of one array of 10,000 numbers per task. Ranks come from ranges of scores: each range is numbered by itself and moved by
the sizes of the ranges before it, so no task sees all documents.

Null and empty texts have no words: no features, weight 0, never drawn. A null id is read as an empty text where it is hashed and loses ties. Repeated rows are
documents of their own; those with equal score and id take successive ranks. An empty benchmark has T = 0. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .files import staged, table
from .registry import query

BUCKETS = 10_000
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PLANE = -(-BUCKETS // 64) * 8  # bytes of a plane
RANGE = 1 << 20  # rows that are ranked together
_ROWS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("planes", pa.binary()), ("totals", pa.list_(pa.int64()))])
ROWS = "doc_id bigint, n_words bigint, n_features bigint, planes binary, totals array<bigint>"


def buckets(text: bytes | None) -> tuple[int, np.ndarray]:
    """The number of words and the bucket of every feature: a feature's checksum goes on from that of the feature one word shorter."""
    words = WORD.findall((text or b"").lower())
    after = [b" " + w for w in words]
    one = list(map(crc32, words))
    two = list(map(crc32, after[1:], one))
    three = list(map(crc32, after[2:], two))
    return len(words), np.array(one + two + three, np.int64) % BUCKETS


def planes(values: np.ndarray) -> np.ndarray:
    """Plane j of non-negative numbers holds their bits j; no planes if all are 0."""
    bits = int(values.max(initial=0)).bit_length()
    packed = np.packbits((values >> np.arange(bits)[:, None]).astype(np.uint8) & 1, axis=1)
    out = np.zeros((bits, PLANE), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out


def _count(batches):
    """A row for every document, and one with the sums of the task."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        n_words, n_features, data = [], [], []
        for text in batch.column(1).to_pylist():
            n, found = buckets(text)
            count = np.bincount(found, minlength=BUCKETS)
            total += count
            n_words.append(n)
            n_features.append(len(found))
            data.append(planes(count).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(data, pa.binary()),
                                          pa.nulls(len(data), pa.list_(pa.int64()))], schema=_ROWS)
    yield pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in _ROWS][:4] + [pa.array([total.tolist()], pa.list_(pa.int64()))], schema=_ROWS)


def _sums(rows: DataFrame) -> np.ndarray:
    """Features of every bucket: 10,000 numbers, whatever the input."""
    each = rows.where(F.col("totals").isNotNull()).select(F.posexplode("totals").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in each.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t = float(source.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((float(b) + 1) * s / ((float(a) + 1) * t))) for a, b in zip(source, target, strict=True)], np.int64)


def _weigh(batches, sliced):
    """Weights of the documents of a batch, all their planes together."""
    plus, minus = sliced.value
    for batch in batches:
        data = [np.frombuffer(x, np.uint8).reshape(-1, PLANE).view(np.uint64) for x in batch.column(2).to_pylist()]
        size = np.array([len(x) for x in data], np.int64)
        rows = np.concatenate(data) if size.sum() else np.zeros((0, PLANE // 8), np.uint64)
        each = np.zeros(len(rows), np.int64)
        for sign, g in ((1, plus), (-1, minus)):
            for k, plane in enumerate(g.view(np.uint64)):
                each += sign * (np.bitwise_count(rows & plane).sum(axis=1, dtype=np.int64) << k)
        ends = np.cumsum(size)
        power = np.arange(len(rows)) - np.repeat(ends - size, size)
        sums = np.concatenate([[0], np.cumsum(each << power)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(sums[ends] - sums[ends - size])],
                                         ["doc_id", "n_words", "n_features", "weight"])


def ranked(rows: DataFrame, first: str, *order) -> DataFrame:
    """``rows`` with their place (1, 2, ...) in the column ``rank`` by ``first`` and ``order``, counted range by range."""
    n = max(8, -(-rows.count() // RANGE))
    dealt = staged(rows.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), first)
    size = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = size.select(F.col("__range").alias("__r"), (F.sum("__n").over(W.orderBy("__range")) - F.col("__n")).alias("__before"))  # a row for each range
    place = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    return dealt.withColumn("__place", place).join(before, F.col("__range") == F.col("__r")).withColumn(
        "rank", F.col("__place") + F.col("__before")).drop("__range", "__r", "__place", "__before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_features, weight, score, rank (null where it is not drawn)."""
    spark = docs.sparkSession
    wanted = target.select(F.lit(None).cast("bigint").alias("doc_id"), F.col(target_col).cast("string").cast("binary").alias("text"))
    given = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    counted = staged(given.mapInArrow(_count, ROWS), "planes")
    gain = gains(_sums(counted), _sums(wanted.mapInArrow(_count, ROWS)))
    sliced = spark.sparkContext.broadcast((planes(np.maximum(gain, 0)), planes(np.maximum(-gain, 0))))
    weighed = counted.where(F.col("totals").isNull()).select("doc_id", "n_words", "planes", "n_features").mapInArrow(
        lambda b: _weigh(b, sliced), "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = staged(weighed.withColumn("score", (F.col("weight") + noise).cast("bigint")), "scores")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    out = ranked(able, "ranks", F.desc("score"), F.asc_nulls_last("doc_id")).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("bigint"))
    return out.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))).select(
        "doc_id", "n_words", "n_features", "weight", "score", "rank")


# The checksum's table follows from its polynomial; a feature is the bytes of its words, and each distinct feature is hashed once.
SQL = """
WITH polynomial AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
w AS (SELECT 0 AS target, row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
f AS (SELECT target, r, array_to_string(ws[i:i + m - 1], ' ') AS feature, count(*) AS n FROM w, range(1, 4) AS k(m), unnest(range(1, len(ws) - m + 2)) AS t(i) GROUP BY ALL),
d AS (SELECT DISTINCT feature FROM f),
u AS (SELECT feature, list_transform(range(1, 2 * octet_length(encode(feature)), 2), lambda i: ('0x' || substr(hex(encode(feature)), i, 2))::BIGINT) AS bytes FROM d),
c AS (SELECT feature, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket FROM u, polynomial),
x AS (SELECT target, r, bucket, sum(n) AS n FROM f JOIN c USING (feature) GROUP BY ALL),
s AS (SELECT bucket, sum(n) FILTER (target = 0) AS s, sum(n) FILTER (target = 1) AS t FROM x GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM s),
y AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM x JOIN g USING (bucket) WHERE target = 0 GROUP BY r),
z AS (SELECT w.r, doc_id, len(ws) AS k, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score FROM w LEFT JOIN y USING (r) WHERE target = 0),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM z WHERE k >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * able // 100 THEN rank END AS rank FROM z LEFT JOIN o USING (r)
"""


@query("op12_importance_resampling", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")
