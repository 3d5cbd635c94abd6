"""Quality classifier: a byte-level convolutional network in numpy.

Input symbols are the bytes, each marked if it lies in a run that repeats the bytes a few places before (lags of 2 to 24). Learned filters slide over
overlapping chunks that cover the whole document; every filter keeps its largest response in a chunk, a dense layer turns a chunk into hidden units, and their mean and
maximum over all chunks give one probability. The network is fitted on the driver on a bounded sample of labelled texts
(``SAMPLE`` of each class, those with the smallest hash of the id); scoring reads every text whole, in slices of bounded size.

A null or empty text is one chunk of padding and gets the score that the network gives it. Repeated rows are scored one by one; an empty table
gives an empty result; without labels of both classes the score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import sampled, table
from .registry import query
from .text import bytes_of, chunks, ramp

FOLDS = 5
SAMPLE = 1000
WIDTH = 5
FILTERS = 12
HIDDEN = 8
CHUNK, STEP = 256, 192  # bytes of a chunk, and between two chunks
STRIDE = 2
LAGS = range(2, 25)
RUN = 8
PAD = 512


def symbols(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes, plus 256 where 8 bytes in a row equal those some lag before in the document; and where each document begins. WIDTH of padding comes after each."""
    sizes = np.diff(starts)
    begin = starts[:-1] + WIDTH * np.arange(len(sizes))
    out = np.full(len(data) + WIDTH * len(sizes), PAD, np.uint16)
    # Padding ends every run of equal bytes, but it equals itself where documents are shorter than a lag.
    own = np.repeat(begin - starts[:-1], sizes) + np.arange(len(data))
    out[own] = data
    plain, inside = out.copy(), out < PAD
    for lag in LAGS:
        if len(out) < lag + RUN:
            break
        same = (plain[lag:] == plain[:-lag]) & inside[lag:]
        span = 1
        while span < RUN:
            same, span = same[:-span] & same[span:], span * 2
        # RUN bytes in a row lie in one document; the bytes a lag before have to lie in it too.
        hit = np.flatnonzero(same)
        hit = hit[hit >= begin[np.searchsorted(begin, hit + lag, "right") - 1]]
        out[lag + hit] |= 256
    return out, begin


def layout(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first byte and length of every chunk; chunks overlap and cover the document; an empty one has an empty chunk."""
    many = np.maximum(1, -(-(sizes - (CHUNK - STEP)) // STEP))
    doc = np.repeat(np.arange(len(sizes)), many)
    at = ramp(many) * STEP
    return doc, at, np.minimum(CHUNK, sizes[doc] - at)


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.w = (r.normal(0, 0.15, (WIDTH, PAD + 1, FILTERS))).astype(np.float32)
        self.b = np.zeros(FILTERS, np.float32)
        self.h = r.normal(0, 0.4, (FILTERS, HIDDEN)).astype(np.float32)
        self.hb = np.zeros(HIDDEN, np.float32)
        self.o = r.normal(0, 0.4, 2 * HIDDEN).astype(np.float32)
        self.ob = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.w, self.b, self.h, self.hb, self.o, self.ob]

    def _responses(self, x: np.ndarray, first: np.ndarray, length: np.ndarray):
        """Filter responses at every second place of the chunks; where each chunk begins among them; the places."""
        count = np.maximum(1, -(-length // STRIDE))
        place = np.repeat(first, count) + ramp(count) * STRIDE
        y = np.zeros((len(place), FILTERS), np.float32)
        for j in range(WIDTH):
            y += self.w[j][x[place + j]]
        return y, np.cumsum(count) - count, place

    def forward(self, data: np.ndarray, starts: np.ndarray, keep: bool = False):
        """Probability of each document; ``keep`` returns what ``step`` needs."""
        x, begins = symbols(data, starts)
        doc, at, length = layout(np.diff(starts))
        first = begins[doc] + at
        pooled = np.zeros((len(doc), FILTERS), np.float32)
        arg = np.zeros((len(doc), FILTERS), np.int64)
        for i in range(0, len(doc), 1024):
            y, begin, place = self._responses(x, first[i : i + 1024], length[i : i + 1024])
            top = np.maximum.reduceat(y, begin)
            pooled[i : i + 1024] = top
            if keep:
                which = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(y))))
                for f in range(FILTERS):
                    hit = np.flatnonzero(y[:, f] == top[which, f])
                    arg[i + which[hit[::-1]], f] = place[hit[::-1]]
        z = np.maximum(pooled + self.b, 0)
        hid = np.tanh(z @ self.h + self.hb)
        cut = np.searchsorted(doc, np.arange(len(starts) - 1))
        n = np.diff(np.append(cut, len(doc)))[:, None]
        mean, high = np.add.reduceat(hid, cut) / n, np.maximum.reduceat(hid, cut)
        logit = np.concatenate([mean, high], 1) @ self.o + self.ob
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return (p, (x, doc, arg, z, hid, mean, high, n, cut)) if keep else p

    def gradients(self, p, y, kept):
        x, doc, arg, z, hid, mean, high, n, cut = kept
        d = ((p - y) / len(y)).astype(np.float32)
        go, gob = np.concatenate([mean, high], 1).T @ d, np.array([d.sum()], np.float32)
        back = d[:, None] * self.o[None, :]
        first = hid == high[doc]
        first &= np.cumsum(first, 0) - (np.cumsum(first, 0) - first)[cut][doc] == 1  # the first of equal maxima
        gh = back[doc, :HIDDEN] / n[doc] + back[doc, HIDDEN:] * first
        gh *= 1 - hid**2
        gz = (gh @ self.h.T) * (z > 0)
        gw = np.zeros_like(self.w)
        f = np.broadcast_to(np.arange(FILTERS), arg.shape)
        for j in range(WIDTH):
            np.add.at(gw[j], (x[arg + j], f), gz)
        return [gw, gz.sum(0), z.T @ gh, gh.sum(0), go, gob]

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.02, seed: int = 11) -> Network:
        """Adam on batches of whole texts."""
        r = np.random.default_rng(seed)
        m, v, t = [np.zeros_like(p) for p in self.parameters()], [np.zeros_like(p) for p in self.parameters()], 0
        for epoch in range(epochs):
            order = r.permutation(len(texts))
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                data = np.frombuffer(b"".join(texts[k] for k in part), np.uint8)
                starts = np.cumsum([0] + [len(texts[k]) for k in part])
                p, kept = self.forward(data, starts, keep=True)
                t += 1
                for q, g, a, b in zip(self.parameters(), self.gradients(p, labels[part], kept), m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    q -= rate * (0.5 ** (epoch // 3)) * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
        return self


def _score(batches, network):
    net = network.value
    for batch in batches:
        data, starts = bytes_of(batch.column(1))
        for i, j in chunks(starts, 1 << 19):
            p = net.forward(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(p.astype(np.float64))], ["doc_id", "score"])


def held_out(id_col: str = "doc_id", folds: int = FOLDS):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE) -> Network | float:
    """A network fitted on a bounded sample of the labelled documents outside the held-out fold, or the share of label 1."""
    marks = labels.where(F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    known = marks.where(~held_out()).withColumn("h", F.xxhash64("doc_id"))
    n = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = reduce(DataFrame.unionAll, [sampled(known.where(F.col("label") == v), sample, n.get(v, 0), "doc_id") for v in (0, 1)])  # at most 2 x sample ids
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").dropDuplicates(["doc_id"]).orderBy("h").limit(2 * sample).collect()
    y = np.array([r["label"] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    return Network().fit([(r["text"] or "").encode() for r in rows], y)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    network = train(d, labels)
    if isinstance(network, float):
        scored = d.select("doc_id", F.lit(network).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(network)  # about 0.13 MB, whatever the input
        scored = d.mapInArrow(lambda b: _score(b, shared), "doc_id bigint, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@query("op7_byte_cnn")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
