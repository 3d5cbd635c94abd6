"""Mixing sources to target weights with soft membership.

A classifier fitted on labelled rows (documents whose domain is known; a bounded sample of ``SAMPLE`` for each domain) gives every document posteriors over
the domains from its hashed byte trigrams. Document rates r >= 0 then solve the least squares

    minimise  1/2 sum_k (sum_d r_d n_d p_dk - T_k)^2 / N_k   from r = 1, where N_k are the domain's tokens now

by projected gradient in the metric that weighs documents by their tokens: r_d <- max(0, r_d - step * sum_k p_dk (total_k - T_k) / N_k). The scales
N_k make the curvature nearly equal in all directions, so few steps are needed; Nesterov's momentum follows the curvature that is left. A step
needs one sum over all documents of as many numbers as there are domains, and a document's rate is a function of its posteriors and the
past residuals, so nothing is collected per document; the table is written anew every ``REWRITE`` steps to keep that function short.

Domains that the posteriors cannot tell apart get equal rates. Targets that are not reachable with nonnegative rates get the nearest ones. A null
or empty text has no tokens; its posterior is the classifier's for no evidence. A null domain is not a labelled row. Repeated rows are weighed one by
one. An empty table gives an empty result; with fewer than two known domains every rate is 1.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import sampled, staged, table
from .registry import query
from .text import bytes_of, chunks

SAMPLE = 600
DOMAINS = 64
BUCKETS = 4096
STEPS, REWRITE, TOLERANCE = 200, 10, 1e-4
TEMPERATURE = 0.7


def features(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed trigrams of each text (rows of length 1)."""
    n = len(starts) - 1
    out = np.zeros((n, BUCKETS), np.float32)
    if len(data) >= 3:
        x = data.astype(np.uint32)
        h = ((x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(20)
        for i in range(n):  # trigrams inside the text only
            if starts[i + 1] - starts[i] >= 3:
                out[i] = np.bincount(h[starts[i] : starts[i + 1] - 2], minlength=BUCKETS)
        out = np.sqrt(out / np.maximum(out.sum(1, keepdims=True), 1))
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


class Classifier:
    """Multinomial logistic regression on the features, by full-batch gradient with momentum."""

    def __init__(self, x: np.ndarray, y: np.ndarray, domains: int, steps: int = 300, decay: float = 1e-5, rate: float = 8.0):
        self.w, self.b = np.zeros((x.shape[1], domains), np.float32), np.zeros(domains, np.float32)
        one = np.eye(domains, dtype=np.float32)[y]
        weight = (1 / np.maximum(one.sum(0), 1))[y][:, None].astype(np.float32)
        weight /= weight.sum()
        v, vb = np.zeros_like(self.w), np.zeros_like(self.b)
        for _ in range(steps):
            g = (softmax(x @ self.w + self.b) - one) * weight
            v = 0.9 * v - rate * (x.T @ g + decay * self.w)
            vb = 0.9 * vb - 0.1 * rate * g.sum(0)
            self.w, self.b = self.w + v, self.b + vb

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        return softmax(x @ self.w + self.b)


def _posteriors(batches, shared):
    model = shared.value
    for batch in batches:
        data, starts = bytes_of(batch.column(1))
        inside = np.isin(data, np.array([0x20, *range(9, 14)], np.uint8), invert=True)
        first = np.concatenate([[0], np.cumsum(inside & ~np.concatenate([[False], inside[:-1]]))]) if len(data) else np.zeros(1, np.int64)
        for i, j in chunks(starts, 1 << 19):
            for a in range(i, j, 256):
                b = min(j, a + 256)
                p = model.posteriors(features(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])).astype(np.float64)
                # A word that ends one text and the next text's first may touch: count the latter too.
                touch = np.array([starts[k] > 0 and starts[k] < starts[k + 1] and inside[starts[k]] and inside[starts[k] - 1] for k in range(a, b)], np.int64)
                words = first[starts[a + 1 : b + 1]] - first[starts[a:b]] + touch
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(words.astype(np.int64)), pa.array(list(p), pa.list_(pa.float64()))],
                                                 ["doc_id", "text_hash", "n_tokens", "p"])


def posteriors(docs: DataFrame, labels: DataFrame, domain_col: str = "lang", sample: int = SAMPLE) -> tuple[DataFrame, list[str]]:
    """(doc_id, text_hash, n_tokens, p) of all documents and the names of the domains (at most ``DOMAINS``, the most frequent labelled ones).

    A document is labelled if ``labels`` has its id; its domain is then taken from the table."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text")).alias("text_hash"), F.col(domain_col).cast("string").alias("domain"))
    known = d.join(labels.select("doc_id").distinct(), "doc_id").where(F.col("domain").isNotNull())
    many = {r["domain"]: r["count"] for r in known.groupBy("domain").count().orderBy(F.desc("count"), "domain").limit(DOMAINS).collect()}
    names = sorted(many)
    if len(names) < 2:
        return d.select("doc_id", "text_hash", F.lit(0).cast("bigint").alias("n_tokens"), F.array(F.lit(1.0)).alias("p")), names
    narrow = known.select("doc_id", "domain", F.xxhash64("doc_id", F.lit("mix")).alias("h"))
    chosen = [sampled(narrow.where(F.col("domain") == name), sample, many[name], "doc_id") for name in names]  # at most ``sample`` ids of each domain
    rows = d.select("doc_id", "text").join(reduce(DataFrame.unionAll, chosen), "doc_id").dropDuplicates(["doc_id"]).orderBy("h", "doc_id").collect()
    texts = [(r["text"] or "").encode() for r in rows]
    x = features(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts]))
    model = Classifier(x, np.array([names.index(r["domain"]) for r in rows]), len(names))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x DOMAINS numbers of 4 bytes at most
    return d.select("doc_id", "text", "text_hash").mapInArrow(lambda b: _posteriors(b, shared), "doc_id bigint, text_hash bigint, n_tokens bigint, p array<double>"), names


def fit_rates(members: DataFrame, k: int, targets: list[float] | None = None, temperature: float = TEMPERATURE) -> tuple[DataFrame, list[float]]:
    """``members`` (n_tokens, p of ``k`` domains) with ``rate``, and the token totals that were asked for.

    Without targets, the weights are the domains' shares to the power ``temperature``, scaled so that the domain which
    loses most keeps its total, and no rate is below 1: nothing has to be thrown away."""
    p = [F.element_at("p", i + 1) for i in range(k)]
    n = F.col("n_tokens").cast("double")
    m = staged(members.withColumn("rate", F.lit(1.0)).withColumn("ahead", F.lit(1.0)), "rates")
    sums = [F.sum(n * c) for c in p] + [F.sum(n * a * b) for a in p for b in p]
    got = np.array([x or 0.0 for x in m.agg(*sums).first()]) if k else np.zeros(0)
    have, gram = got[:k], got[k:].reshape(k, k)
    total = have.sum()
    if k < 2 or total <= 0:
        return m.drop("ahead"), have.tolist()
    least = 0.0
    if targets is None:
        least = 1.0
        w = (have / total) ** temperature
        w /= w.sum()
        targets = (w * (have[have > 0] / w[have > 0]).max()).tolist()
    want = np.array(targets, float)
    scale = np.maximum(have, 1e-9 * total)
    curve = np.linalg.eigvalsh(gram / np.sqrt(np.outer(scale, scale)))
    step = 1 / max(1e-12, float(curve[-1]))
    flat = np.sqrt(max(curve[curve > 1e-6].min() * step, 0.0)) if (curve > 1e-6).any() else 1.0
    momentum = (1 - flat) / (1 + flat)
    pending, now, last = [], have, None
    for _ in range(STEPS):
        residual = (now - want) / scale
        still = last is not None and np.abs(now - last).max() < TOLERANCE / 10 * total  # the bound keeps it from the targets
        done, last = still or np.abs(now - want).max() < TOLERANCE * total, now
        pending.append((residual * step, momentum))
        if done or len(pending) == REWRITE:
            m, pending = staged(m.select(*[c for c in m.columns if c not in ("rate", "ahead")], *_replay(pending, least)), "rates"), []
        if done:
            break
        ahead = m.select("n_tokens", "p", *_replay(pending, least))
        now = np.array([x or 0.0 for x in ahead.agg(*[F.sum(n * F.col("ahead") * c) for c in p]).first()])
    if pending:
        m = staged(m.select(*[c for c in m.columns if c not in ("rate", "ahead")], *_replay(pending, least)), "rates")
    return m.drop("ahead"), want.tolist()


def _replay(steps, least: float):
    """``rate`` and ``ahead`` after some steps, as expressions over the written ones."""
    state = F.struct(F.col("rate"), F.col("ahead"))
    if steps:
        table_ = F.array(*[F.struct(F.array(*[F.lit(float(x)) for x in r]).alias("r"), F.lit(float(b)).alias("b")) for r, b in steps])

        def one(a, s):
            dot = F.aggregate(F.zip_with(s["r"], F.col("p"), lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
            rate = F.greatest(F.lit(least), a["ahead"] - dot)
            return F.struct(rate.alias("rate"), (rate + s["b"] * (rate - a["rate"])).alias("ahead"))

        state = F.aggregate(table_, state, one)
    return state["rate"].alias("rate"), state["ahead"].alias("ahead")


def copies(rate, key):
    """How often a document is taken: its rate, rounded up or down by a hash so that the expected number is the rate."""
    u = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + u).cast("int")


def mix(docs: DataFrame, labels: DataFrame, domain_col: str = "lang", targets: list[float] | None = None) -> tuple[DataFrame, list[str], list[float]]:
    """Per document: doc_id, text_hash, n_tokens, p, rate, copies; the domains; the targets."""
    members, names = posteriors(docs, labels, domain_col)
    rates, want = fit_rates(members, max(1, len(names)), targets)
    return rates.withColumn("copies", copies(F.col("rate"), F.col("doc_id"))), names, want


@query("op2_mixing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, names, _ = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    best = F.array_position("p", F.array_max("p")).cast("int")
    domain = F.element_at(F.array(*[F.lit(n) for n in names]), best) if len(names) > 1 else F.lit(names[0] if names else None)
    return out.select("doc_id", "n_tokens", domain.alias("domain"), F.array_max("p").alias("posterior"), "rate", "copies")
