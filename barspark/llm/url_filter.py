"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the URLs that no rule decides.

URLs that a rule decides are the labelled ones. A bounded sample of them (``SAMPLE`` rows with the smallest hash of id and URL) fits the trees on the driver;
suffix statistics (how often a host suffix is blocked) come from all labelled URLs, for the ``SUFFIXES`` most frequent suffixes, others get the mean.
Features, rules and trees are then column expressions, so all URLs are judged inside the scan's stage, without a shuffle.

A null URL or one without ``://`` has an empty host and path, no rule, and is judged by the trees like any other (its text counts as empty).
Repeated rows are judged one by one; an empty table gives an empty result; with fewer than two classes of labelled URLs the verdict is the only
class, or allow without any.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import sampled, table
from .registry import query

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
SAMPLE = 20_000
SUFFIXES = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEXICAL = ["length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "labels", "segment_length"]
SUFFIX_KEYS = ["last", "domain", "section"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def with_features(pages: DataFrame) -> DataFrame:
    """Adds the lexical features and the suffix keys of ``__url``, ``host`` and ``path``."""
    u, host, path = F.col("__url"), F.col("host"), F.col("path")
    n = F.greatest(F.length(u), F.lit(1))
    share = lambda c: F.length(F.replace(u, c, F.lit(""))) / n  # noqa: E731  of all other characters
    labels = F.split(host, r"\.")
    return pages.withColumns({
        "length": F.length(u).cast("double"),
        "host_length": F.length(host).cast("double"),
        "depth": (F.length(path) - F.length(F.translate(path, "/", ""))).cast("double"),
        "digit_ratio": (F.length(u) - F.length(F.translate(u, "0123456789", ""))) / n,
        "entropy": F.aggregate(F.array_distinct(F.split(u, "")), F.lit(0.0), lambda a, c: a - F.when(
            F.length(c) > 0, (1 - share(c)) * F.log2(F.greatest(1 - share(c), F.lit(1e-9)))).otherwise(0.0)),
        "parameters": F.when(u.contains("?"), F.length(u) - F.length(F.translate(u, "&", "")) + 1).otherwise(0).cast("double"),
        "labels": F.size(labels).cast("double"),
        "segment_length": F.length(F.regexp_extract(path, r"([^/]*)$", 1)).cast("double"),
        "last": F.element_at(labels, -1),
        "domain": F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1),
        "section": F.concat(F.element_at(labels, -1), F.lit("/"), F.regexp_extract(path, r"^/([^/]*)", 1)),
    })


class Trees:
    """Boosted regression trees on binned features, logistic loss."""

    def __init__(self, rounds: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 32, smooth: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.smooth = rounds, depth, rate, bins, smooth
        self.trees: list = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "right") for c, v in zip(cuts, x.T, strict=True)], 1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)

        def grow(rows, depth):
            g, h = grad[rows], hess[rows]
            leaf = float(g.sum() / (h.sum() + self.smooth))
            best = (1e-6, None)
            for f in range(x.shape[1] if depth else 0):
                gs, hs = (np.cumsum(np.bincount(binned[rows, f], w, len(cuts[f]) + 1)) for w in (g, h))
                gain = gs**2 / (hs + self.smooth) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + self.smooth) - gs[-1] ** 2 / (hs[-1] + self.smooth)
                gain = np.where((hs > 1e-3) & (hs[-1] - hs > 1e-3), gain, 0)
                k = int(np.argmax(gain[:-1])) if len(cuts[f]) else -1
                if k >= 0 and gain[k] > best[0]:
                    best = (gain[k], (f, k))
            if best[1] is None:
                score[rows] += self.rate * leaf
                return self.rate * leaf
            f, k = best[1]
            left = binned[rows, f] <= k
            return f, float(cuts[f][k]), grow(rows[left], depth - 1), grow(rows[~left], depth - 1)

        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            grad, hess = y - prob, prob * (1 - prob)
            self.trees.append(grow(np.arange(len(y)), self.depth))
        return self

    def column(self, names: list[str]) -> Column:
        """The sum of all trees as an expression."""
        def node(t) -> Column:
            return F.lit(t) if isinstance(t, float) else F.when(F.col(names[t[0]]) < t[1], node(t[2])).otherwise(node(t[3]))

        return reduce(lambda a, b: a + b, [node(t) for t in self.trees], F.lit(self.base))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, score (the trees' log-odds of a block)."""
    d = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("__url"))
    host, path = host_and_path(F.col("__url"))
    d = d.withColumns({"host": host, "path": path})
    d = with_features(d.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)))
    says = F.lit(None).cast("string")
    for rule, verdict in rules:
        says = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(says)
    d = d.withColumn("__said", says)
    known = d.where(F.col("rule").isNotNull()).withColumn("__block", (F.col("__said") == "block").cast("double"))
    total = known.agg(F.count("*").alias("n"), F.sum("__block").alias("b")).first()
    if not total["n"] or total["b"] in (0, total["n"]):
        only = "block" if total["n"] and total["b"] else "allow"
        return d.select("page_id", "host", "path", "rule", F.coalesce("__said", F.lit(only)).alias("verdict"), F.lit(0.0).alias("score"))
    mean = total["b"] / total["n"]
    for key in SUFFIX_KEYS:
        top = known.groupBy(key).agg(F.count("*").alias("n"), F.sum("__block").alias("b")).orderBy(F.desc("n"), key).limit(SUFFIXES).collect()
        rates = F.create_map(*[F.lit(v) for r in top for v in (r[0], (r["b"] + 5 * mean) / (r["n"] + 5))])
        rate = F.coalesce(F.try_element_at(rates, F.col(key)), F.lit(mean))
        d, known = d.withColumn(f"{key}_rate", rate), known.withColumn(f"{key}_rate", rate)
    names = LEXICAL + [f"{k}_rate" for k in SUFFIX_KEYS]
    rows = sampled(known.select("page_id", "__url", *names, "__block"), SAMPLE, total["n"], "page_id", "__url").select(*names, "__block").collect()
    xy = np.array(rows, float)
    trees = Trees().fit(xy[:, :-1], xy[:, -1])
    return d.withColumn("score", trees.column(names)).select(
        "page_id", "host", "path", "rule", F.coalesce("__said", F.when(F.col("score") >= 0, "block").otherwise("allow")).alias("verdict"), "score")


@query("op8_url_filter")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES)
