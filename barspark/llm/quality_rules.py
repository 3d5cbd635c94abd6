"""Quality rules: base statistics of every whole text, and a decision list that is learned from labelled documents.

All of it is DataFrame work. ``text_features`` computes the statistics inside the row, without a shuffle. ``learn_rules`` grows and prunes
conjunctions of thresholds by sequential covering: the labelled rows are split by a hash into a grow and a prune part, features are cut into
bins by quantiles, and every step is one grouped count over all labelled rows still uncovered, whose result has at most features x bins rows.
``verdict`` turns the rules into one conditional expression.

Nulls and empty texts have zero words and fail the base rule; a null doc_id is carried through; repeated rows are judged one by one; an empty table gives
an empty result; without labelled rows of both classes no rule is learned and only the base rule decides.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import staged, table
from .registry import query

SPACES = "\t\n\x0b\f\r "
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5

FEATURES = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
    "shout_rate": "n_marks / greatest(n_words, 1)",
    "digit_rate": "n_digits / greatest(word_chars, 1)",
    "stop_rate": "n_stops / greatest(n_words, 1)",
    "distinct_rate": "n_distinct / greatest(n_words, 1)",
    "words": "cast(n_words as double)",
}


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Counts of every text (null: empty): the contract's and those that the rules look at. ``carry`` are columns to keep."""
    d = docs.select(F.col(id_col).alias("doc_id"), *carry, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    d = d.withColumns({
        "__words": F.array_remove(F.split(F.translate("__text", SPACES, " " * len(SPACES)), " "), ""),
        "__lines": F.filter(F.split("__text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0),
    })
    w = F.col("__words")
    d = d.withColumns({
        "n_words": F.size(w).cast("long"),
        "__grams": F.when(F.size(w) >= WINDOW, F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(w) - WINDOW, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])))
        .otherwise(F.array().cast("array<bigint>")),
    })
    g = F.col("__grams")
    # Places of windows that occur more than once, in order; only texts that have one sort their windows.
    d = d.withColumn("__sorted", F.when(
        F.size(F.array_distinct(g)) < F.size(g), F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col("__sorted")
    same = lambda x, j: (F.get(s, j)["h"] == x["h"])
    d = d.withColumn("__places", F.when(s.isNotNull(), F.array_sort(F.transform(
        F.filter(s, lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False))), lambda x: x["i"]))))
    p = F.col("__places")
    repeated = F.aggregate(
        p, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i)).cast("int").alias("n"), (i + WINDOW).cast("int").alias("end")), lambda a: a["n"])
    t = F.col("__text")
    return d.select(
        "doc_id", *carry, "n_words",
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        _count(t, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(repeated, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__lines").alias("n_lines"), _count(t, UPPER).alias("n_upper"), _count(t, "!?").alias("n_marks"), _count(t, "0123456789").alias("n_digits"),
        F.size(F.filter(w, lambda x: F.length(x) <= 3)).alias("n_stops"), F.size(F.array_distinct(w)).alias("n_distinct"),
    ).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).withColumns(
        {k: F.expr(e) for k, e in FEATURES.items()})


@dataclass(frozen=True)
class Test:
    """``feature`` at least (or below) ``value``."""

    feature: str
    above: bool
    value: float

    def holds(self) -> Column:
        c = F.col(self.feature)
        return (c >= self.value) if self.above else (c < self.value)


Rule = tuple[Test, ...]


def fires(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (t.holds() for t in rule))


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that fires, or null: an ordered conditional expression."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        out = F.when(fires(rule), F.lit(k)).otherwise(out)
    return out


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    from math import log2

    return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))) if p > 0 else 0.0


def learn_rules(rows: DataFrame, features: list[str], target: str = "bad", bins: int = 32, most_rules: int = 8, most_tests: int = 3,
                precision: float = 0.97, least_cover: float = 0.004) -> list[Rule]:
    """Rules for ``target`` (boolean), best first, from all ``rows``.

    A rule grows by the threshold with the highest information gain on the grow part until it is pure there, loses its last tests while that raises its
    worth (p - n) / (p + n) on the prune part, and is kept if it is right on ``precision`` of the prune rows that it covers and covers
    ``least_cover`` of the target rows (at least 3) there. Covered rows go before the next rule is grown.
    """
    cuts = rows.select(*[F.percentile_approx(f, [k / bins for k in range(1, bins)], 1000).alias(f) for f in features]).first()
    cuts = {f: sorted(set(cuts[f] or [])) for f in features}
    if not any(cuts.values()):
        return []
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("part")), F.lit(3)) < 2
    rows = rows.select(F.col(target).alias("__bad"), part.alias("__grow"), *features)

    def bin_of(f: str) -> Column:  # how many cuts are at most the value
        return F.size(F.filter(F.lit(cuts[f]).cast("array<double>"), lambda c: c <= F.col(f)))

    binned = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), bin_of(f).alias("b")) for k, f in enumerate(features) if cuts[f]])).alias("x")

    def counts(df: DataFrame) -> tuple[int, int]:
        r = df.agg(F.count_if("__bad").alias("p"), F.count_if(~F.col("__bad")).alias("n")).first()
        return r["p"], r["n"]

    grow, prune = rows.where("__grow"), rows.where("not __grow")
    total = counts(prune)[0]
    rules: list[Rule] = []
    while len(rules) < most_rules:
        rest = [~F.coalesce(fires(r), F.lit(False)) for r in rules]
        left = reduce(lambda d, c: d.where(c), rest, grow)
        rule: Rule = ()
        while len(rule) < most_tests:
            inside = left.where(fires(rule)) if rule else left
            table_ = inside.select("__bad", binned).groupBy("x.f", "x.b").agg(
                F.count_if("__bad").alias("p"), F.count_if(~F.col("__bad")).alias("n")).collect()  # at most features x bins rows
            by: dict[int, dict[int, tuple[int, int]]] = {}
            for r in table_:
                by.setdefault(r["f"], {})[r["b"]] = (r["p"], r["n"])
            p0, n0 = (sum(x[k] for x in next(iter(by.values()), {}).values()) for k in (0, 1))
            if not p0 or not n0:
                break
            best, test = 1e-9, None
            for k in sorted(by):
                f = features[k]
                for j, c in enumerate(cuts[f]):
                    p = sum(x[0] for b, x in by[k].items() if b > j)
                    n = sum(x[1] for b, x in by[k].items() if b > j)
                    for above, pp, nn in ((True, p, n), (False, p0 - p, n0 - n)):
                        if (g := _gain(pp, nn, p0, n0)) > best:
                            best, test = g, Test(f, above, float(c))
            if test is None:
                break
            rule += (test,)
        if not rule:
            break
        seen = reduce(lambda d, c: d.where(c), rest, prune)
        sums = seen.agg(*[F.count_if(fires(rule[:k]) & (F.col("__bad") == v)).alias(f"{c}{k}") for k in range(1, len(rule) + 1) for c, v in (("p", True), ("n", False))]).first()
        worth = {k: ((sums[f"p{k}"] - sums[f"n{k}"]) / max(1, sums[f"p{k}"] + sums[f"n{k}"]), -k) for k in range(1, len(rule) + 1)}
        k = max(worth, key=worth.get)
        p, n = sums[f"p{k}"], sums[f"n{k}"]
        if p < max(3, least_cover * total) or p < precision * (p + n):
            break
        rules.append(rule[:k])
    return rules


def learned(features: DataFrame, labels: DataFrame, label_col: str = "quality", **how) -> list[Rule]:
    """Rules from the labelled documents that pass the base rule. ``features`` is a written table: only its counts meet the labels, not texts."""
    marked = labels.where(F.col(label_col).isNotNull()).groupBy("doc_id").agg((F.min(label_col) == 0).alias("bad"))
    known = features.where("not base_failed").select("doc_id", *FEATURES).join(marked, "doc_id")
    return learn_rules(staged(known, "quality-labelled"), list(FEATURES), **how)


def quality_rules(docs: DataFrame, labels: DataFrame, **how) -> tuple[DataFrame, list[Rule]]:
    """Every document's counts with ``base_failed``, ``rule`` (the number of the rule that rejects it) and ``kept``; and the rules."""
    features = staged(text_features(docs), "quality-features")
    rules = learned(features, labels, **how)
    return _judged(features, rules), rules


def _judged(features: DataFrame, rules: list[Rule]) -> DataFrame:
    out = features.withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of the documents that are kept, whole."""
    # Rows are judged where they are: texts are read twice but never shuffled, and repeated ids need no telling apart.
    names = {c: f"__own_{c}" for c in docs.columns}
    own = docs.withColumns({n: F.col(c) for c, n in names.items()})
    _, rules = quality_rules(docs, labels)
    out = _judged(text_features(own, carry=tuple(names.values())), rules)
    # The row number keeps the filter above the features, which would be computed again inside it.
    out = out.withColumn("__row", F.monotonically_increasing_id()).where(F.col("kept") & (F.col("__row") >= 0))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])


@query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
