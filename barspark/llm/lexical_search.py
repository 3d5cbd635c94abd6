"""Ranked lexical search, term at a time with limited accumulators.

Queries come in blocks of bounded size, and the words of a block are its dictionary. One pass over the texts counts terms and leaves *segments*: a few
thousand documents with their lengths and, for each word of the dictionary, its postings. Document frequencies are sums over the segments, so weights are
those of the whole corpus.

Every segment answers every query of the block by itself. Terms go rarest first; each adds its part to the documents' accumulators. The largest parts of
the terms still to come bound what a document without an accumulator can reach. As soon as that is below the k-th best partial score (or the k-th best
score that this task already has), no accumulator is created any more; those that exist are still updated by every term, so the scores of all that
can be among the k best are exact. Tasks pass k documents for each query on, and the best k of those are the result.

Null and empty texts have no terms: such documents count nowhere and are never found, such queries find nothing. A null id comes after all others
among equal scores. Every row of the queries is a query of its own, every row of the documents a document of its own. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .files import staged, table
from .registry import query

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BLOCK = 4 << 20  # bytes of queries that are asked together
SEGMENT = 16 << 20  # bytes of text in a segment
SEGMENT_ROWS = 1 << 16
LAST = np.int64(2**63 - 1)  # the place of a null id among equal scores
_SEGMENT = pa.schema([("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("terms", pa.list_(pa.int32())), ("ends", pa.list_(pa.int64())),
                      ("docs", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
SEGMENTS = "ids array<bigint>, sizes array<bigint>, terms array<int>, ends array<bigint>, docs array<int>, counts array<int>"
_FOUND = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])
FOUND = "query int, doc_id bigint, score bigint"


def words(text: bytes | None) -> list[bytes]:
    return WORD.findall((text or b"").lower())


def _segment(ids: list, sizes: list[int], postings: list[tuple[int, Counter]]) -> pa.RecordBatch:
    """One row: the documents, and term by term the places and counts of its documents."""
    place = np.repeat(np.array([p for p, _ in postings], np.int32), [len(c) for _, c in postings])
    term = np.fromiter((t for _, c in postings for t in c), np.int32)
    count = np.fromiter((n for _, c in postings for n in c.values()), np.int32)
    order = np.argsort(term, kind="stable")
    seen, first = np.unique(term[order], return_index=True)
    ends = np.append(first[1:], len(order)) if len(seen) else first
    values = (ids, sizes, seen, ends, place[order], count[order])
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _SEGMENT, strict=True)], schema=_SEGMENT)


def _index(batches, dictionary):
    """Segments of the documents that have terms."""
    known = dictionary.value
    ids, sizes, postings, held = [], [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = words(text)
            if not found:
                continue
            count = Counter(map(known.get, found))
            count.pop(None, None)
            postings.append((len(ids), count))
            ids.append(doc_id)
            sizes.append(len(found))
            held += len(text)
            if held > SEGMENT or len(ids) == SEGMENT_ROWS:
                yield _segment(ids, sizes, postings)
                ids, sizes, postings, held = [], [], [], 0
    if ids:
        yield _segment(ids, sizes, postings)


class Corpus:
    """What scores need of the whole corpus, and the queries of a block as (term, repeats), rarest first."""

    def __init__(self, n_docs: int, n_terms: int, frequency: dict[int, int], asked: list[Counter], k: int):
        self.n_docs, self.n_terms, self.k = n_docs, n_terms, k
        self.weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in frequency.items()}
        self.asked = [sorted(((t, q) for t, q in c.items() if t in frequency), key=lambda x: (frequency[x[0]], x[0])) for c in asked]

    def lengths(self, sizes: np.ndarray) -> np.ndarray:
        """The factor m of every document."""
        if len(sizes) and 25 * int(sizes.max()) * self.n_docs >= 2**63:
            return np.array([75 + 25 * int(n) * self.n_docs // self.n_terms for n in sizes], np.int64)
        return 75 + 25 * sizes * self.n_docs // self.n_terms


class Segment:
    """The postings of a segment as score parts, each computed when it is first asked for."""

    def __init__(self, corpus: Corpus, row: dict):
        self.corpus = corpus
        self.ids, self.m = row["ids"], corpus.lengths(row["sizes"])
        self.at = {int(t): (int(b), int(e)) for t, b, e in zip(row["terms"], np.append(0, row["ends"])[:-1], row["ends"], strict=True)}
        self.docs, self.counts, self.parts = row["docs"], row["counts"].astype(np.int64), {}

    def part(self, term: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents of a term, what it adds to each, and the largest of that."""
        if term not in self.parts:
            b, e = self.at.get(term, (0, 0))
            docs, tf = self.docs[b:e], self.counts[b:e]
            value = self.corpus.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * self.m[docs]))
            self.parts[term] = docs, value, int(value.max(initial=0))
        return self.parts[term]

    def best(self, asked: list[tuple[int, int]], floor: int) -> tuple[np.ndarray, np.ndarray]:
        """The places and scores of the documents that can be among the k best; ``floor`` is a score that k others have."""
        k, parts = self.corpus.k, [(*self.part(t), q) for t, q in asked]
        left = sum(most * q for _, _, most, q in parts)
        score, open_, creating = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool), True
        made = 0
        for docs, value, most, q in parts:
            if creating and made >= k:
                floor = max(floor, int(np.partition(score[open_], made - k)[made - k]))
            creating = creating and left >= floor
            left -= most * q
            if creating:
                score[docs] += value * q
                made += int(len(docs) - np.count_nonzero(open_[docs]))
                open_[docs] = True
            else:
                old = open_[docs]
                score[docs[old]] += value[old] * q
        found = np.flatnonzero(open_ & (score > 0))
        return found, score[found]


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _search(batches, shared):
    """The k best documents of this task's segments for every query."""
    corpus: Corpus = shared.value
    none = np.zeros(0, np.int64)
    best = [(none, none)] * len(corpus.asked)
    for batch in batches:
        for i in range(batch.num_rows):
            row = {f.name: c[i].values.to_numpy(zero_copy_only=False) if f.name != "ids" else c[i].values.fill_null(LAST).to_numpy()
                   for f, c in zip(_SEGMENT, batch.columns, strict=True)}
            segment = Segment(corpus, row)
            for q, asked in enumerate(corpus.asked):
                ids, scores = best[q]
                at, value = segment.best(asked, int(scores[-1]) if len(ids) == corpus.k else 0)
                best[q] = _first(np.concatenate([ids, segment.ids[at]]), np.concatenate([scores, value]), corpus.k)
    rows = [(np.full(len(ids), q, np.int32), ids, scores) for q, (ids, scores) in enumerate(best) if len(ids)]
    if rows:
        q, ids, scores = (np.concatenate(x) for x in zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids, mask=ids == LAST), pa.array(scores)], schema=_FOUND)


def _answers(docs: DataFrame, block: list, k: int) -> DataFrame:
    """The k best documents of each query of a block."""
    spark = docs.sparkSession
    found = [words(text) for _, text in block]
    dictionary = {w: i for i, w in enumerate(sorted(set().union(*found)))}
    asked = [Counter(map(dictionary.get, f)) for f in found]
    known = spark.sparkContext.broadcast(dictionary)
    segments = staged(docs.mapInArrow(lambda b: _index(b, known), SEGMENTS), "segments")
    n_docs, n_terms = segments.agg(F.sum(F.size("ids")), F.sum(F.expr("aggregate(sizes, 0L, (a, n) -> a + n)"))).first()
    spread = segments.select(F.posexplode("terms").alias("i", "term"), "ends").select(
        "term", (F.col("ends")[F.col("i")] - F.when(F.col("i") > 0, F.col("ends")[F.col("i") - 1]).otherwise(0)).alias("df"))
    frequency = {r["term"]: r["df"] for r in spread.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # words of a block
    corpus = spark.sparkContext.broadcast(Corpus(n_docs or 0, n_terms or 0, frequency, asked, k))
    some = segments.mapInArrow(lambda b: _search(b, corpus), FOUND).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(256)))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = some.withColumn("rank", F.row_number().over(W.partitionBy("query", "part").orderBy(*order))).where(F.col("rank") <= k)
    top = some.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], "query int, item_id bigint")
    return top.join(names, "query").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id",
           query_text_col: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents of every query."""
    given = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    asked = queries.select(F.col(query_col).cast("bigint").alias("item_id"), F.col(query_text_col).cast("string").cast("binary").alias("text"))
    size = asked.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = None
    for b in range(blocks):
        block = [(r["item_id"], bytes(r["text"]) if r["text"] is not None else None) for r in asked.where(place == b).toLocalIterator()]
        found = _answers(given, block, k)
        out = found if out is None else out.unionAll(found)
    return out


_CUT = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_CUT} AS ws FROM documents),
a AS (SELECT r, doc_id, len(ws)::BIGINT AS n, ws FROM d WHERE len(ws) > 0),
c AS (SELECT count(*)::BIGINT AS N_all, sum(n)::BIGINT AS L FROM a),
m AS (SELECT r, doc_id, 75 + (25 * n * N_all) // L AS m FROM a, c),
t AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ws) AS term FROM a) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * N_all + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, c GROUP BY term, N_all),
q AS (SELECT item_id, term, count(*)::BIGINT AS q FROM (SELECT item_id, unnest({_CUT}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, r, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN f USING (term) JOIN t USING (term) JOIN m USING (r) GROUP BY ALL),
o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= 20
"""


@query("op13_lexical_search", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
