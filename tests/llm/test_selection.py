"""Exact deduplication, importance resampling and ranked search against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from barspark.llm import exact_dedup, lexical_search, resampling
from barspark.llm.exact_dedup import Trie, deduplicate
from barspark.llm.lexical_search import search
from barspark.llm.resampling import gains, planes, ranked, resample

from .brute import lower
from .conftest import rows_of
from .test_exact import ITEMS, same


def exact_groups(rows, best=max):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = []
    for t, ids in groups.items():
        known = [d for d in ids if d is not None]
        keep, left = best(known) if known else None, 1
        for d in ids:
            kept = d == keep and left == 1
            left -= kept
            out.append((d, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return out


GROUP = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_groups(messy, messy_rows, no_documents, keep):
    same(rows_of(deduplicate(messy, keep=keep), *GROUP), exact_groups(messy_rows, max if keep == "largest" else min))
    assert deduplicate(no_documents).count() == 0


def test_exact_groups_with_spilled_tries(spark, messy, messy_rows):
    """Tries of a few bytes: subtrees go from round to round until each string is alone in its trie."""
    same(rows_of(deduplicate(messy, limit=2_000, combined=3_000), *GROUP), exact_groups(messy_rows))
    rows = [(i, "a" * (i % 37) + "b" * (i % 5)) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    same(rows_of(deduplicate(d, limit=1_200, combined=900), *GROUP), exact_groups(rows))


def test_normalised_texts_and_unknown_choice(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "c")], "doc_id bigint, text string")
    assert [tuple(r) for r in deduplicate(d, normal=F.lower).orderBy("doc_id").select("keep_id", "kept").collect()] == [(2, False), (2, True), (3, True)]
    with pytest.raises(ValueError):
        deduplicate(d, keep="any")


def test_trie_holds_what_is_put_in():
    r = random.Random(1)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randrange(12))) for _ in range(3000)] + [b"x" * 500 + bytes([i % 7]) for i in range(50)]
    trie, spilled, numbers = Trie(), [], iter(range(10**6))
    gone = []
    for i, t in enumerate(texts):
        if trie.add(t, (False, i, i), 1, lambda: next(numbers)) is None:
            gone.append(t)
        while trie.bytes > 20_000 and trie.entries > 1:
            spilled += trie.spill()
    kept = dict((t, e.size) for t, e in trie.strings())
    assert spilled and gone and trie.entries == len(kept) > 0
    total = Counter(kept)
    for t, e in spilled:
        total[t] += e.size
    total.update(gone)
    assert total == Counter(texts)
    assert not set(kept) & (set(gone) | {t for t, _ in spilled})


def resampled(rows, items, percent=5):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))

    def features(t):
        w = cut(t)
        return Counter(zlib.crc32(" ".join(w[i : i + m]).encode()) % 10000 for m in (1, 2, 3) for i in range(len(w) - m + 1))

    source, target = Counter(), Counter()
    for _, t in rows:
        source.update(features(t))
    for _, t in items:
        target.update(features(t))
    s, t = sum(source.values()), sum(target.values())
    gain = [math.floor(1000 * math.log((target[b] + 1) * (s + 10000) / ((source[b] + 1) * (t + 10000)))) for b in range(10000)]
    out = []
    for d, text in rows:
        f = features(text)
        weight = sum(n * gain[b] for b, n in f.items())
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(cut(text)), sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    for i, x in enumerate(able[: percent * len(able) // 100]):
        x[5] = i + 1
    return [tuple(x) for x in out]


DRAWN = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]


@pytest.mark.parametrize("items", [ITEMS, []])
@pytest.mark.parametrize("percent", [5, 100])
def test_resampling(spark, messy, messy_rows, items, percent):
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, bucket int")
    got, want = rows_of(resample(messy, bench, percent), *DRAWN), resampled(messy_rows, items, percent)
    strip = lambda rows: sorted((r[:5] for r in rows), key=repr)
    assert strip(got) == strip(want)
    # Rows of one id and score may change places.
    assert sorted(((r[0], r[4], r[5]) for r in got), key=repr) == sorted(((r[0], r[4], r[5]) for r in want), key=repr)


def test_resampling_of_nothing(spark, no_documents):
    assert resample(no_documents, spark.createDataFrame(ITEMS, "item_id bigint, text string")).count() == 0


def test_sliced_weights_are_the_plain_sums():
    r = np.random.default_rng(5)
    count = (r.integers(0, 3, resampling.BUCKETS) ** r.integers(1, 12, resampling.BUCKETS)).astype(np.int64)
    gain = gains(r.integers(0, 1000, resampling.BUCKETS), r.integers(0, 5, resampling.BUCKETS) ** 5)
    assert gain.min() < 0 < gain.max()
    total = sum(sign * (int(np.bitwise_count(c.view(np.uint64) & g.view(np.uint64)).sum()) << j + k)
                for sign, p in ((1, planes(np.maximum(gain, 0))), (-1, planes(np.maximum(-gain, 0)))) for j, c in enumerate(planes(count)) for k, g in enumerate(p))
    assert total == int((count * gain).sum())
    assert planes(np.zeros(10, np.int64)).shape[0] == 0


def test_ranks_over_many_ranges(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(resampling, "RANGE", 100)
    d = spark.range(5000).select((F.col("id") % 700).alias("score"), F.col("id").alias("doc_id"))
    got = sorted((r["rank"], r["score"], r["doc_id"]) for r in ranked(d, "ranks", F.desc("score"), F.asc("doc_id")).collect())
    want = sorted(((i % 700, i) for i in range(5000)), key=lambda x: (-x[0], x[1]))
    assert got == [(i + 1, *x) for i, x in enumerate(want)]


def searched(rows, items, k=20):
    cut = lambda t: [lower(w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    docs = [(d, Counter(w), len(w)) for d, t in rows if (w := cut(t))]
    n_all, length = len(docs), sum(n for _, _, n in docs)
    df = Counter(w for _, c, _ in docs for w in c)
    out = []
    for item, text in items:
        asked = Counter(cut(text))
        found = []
        for d, c, n in docs:
            m = 100 - 25 + 25 * n * n_all // length
            score = sum(q * math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 12 * m)) for w, q in asked.items() if c[w])
            if score > 0:
                found.append((d, score))
        found.sort(key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        out += [(item, i + 1, *x) for i, x in enumerate(found[:k])]
    return out


HIT = ["item_id", "rank", "doc_id", "score"]


def questions(rows):
    r = random.Random(8)
    texts = [t for _, t in rows if t and len(t) > 100]
    return ITEMS + [(20 + i, " ".join(r.sample(r.choice(texts).split(), 10) * r.choice([1, 1, 3]))) for i in range(12)] + [(50, "nowhere found"), (51, "été 日本")]


@pytest.mark.parametrize("k", [1, 3, 20])
@pytest.mark.parametrize("small", [False, True])
def test_search(spark, messy, messy_rows, monkeypatch, k, small):
    """``small``: several blocks of queries and a segment for each few documents."""
    items = questions(messy_rows)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, rank int")
    if small:
        monkeypatch.setattr(lexical_search, "SEGMENT", 500)
    got = search(messy, asked, k, block_bytes=300 if small else lexical_search.BLOCK)
    same(rows_of(got, *HIT), searched(messy_rows, items, k))


def test_search_stops_creating_accumulators():
    """A frequent word creates none once the rare word's documents are ahead, and updates those exactly."""
    frequency = {0: 30, 1: 9_000}
    corpus = lexical_search.Corpus(10_000, 500_000, frequency, [Counter([0, 1])], 20)
    docs = np.concatenate([np.arange(30), np.arange(9_000)]).astype(np.int32)
    row = {"ids": np.arange(10_000), "sizes": np.full(10_000, 50), "terms": np.array([0, 1]), "ends": np.array([30, 9_030]), "docs": docs, "counts": np.ones(9_030, np.int32)}
    at, score = lexical_search.Segment(corpus, row).best(corpus.asked[0], 0)
    assert list(at) == list(range(30)) and len(set(score.tolist())) == 1


def test_search_of_nothing(spark, messy, no_documents):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert search(no_documents, items).count() == 0
    assert search(messy, items.limit(0)).count() == 0


def test_long_corpora_do_not_overflow():
    corpus = lexical_search.Corpus(10**12, 5 * 10**14, {}, [], 20)
    assert corpus.lengths(np.array([10**9, 1])).tolist() == [75 + 25 * 10**9 * 10**12 // (5 * 10**14), 75]


def test_numbers_of_the_trie_rows_are_unique(messy):
    rows = messy.select("doc_id", messy["text"].cast("binary")).mapInArrow(lambda b: exact_dedup._combine(b, -1, 10_000), exact_dedup.ROWS).collect()
    classes, links = [r["node"] for r in rows if r["kind"] == exact_dedup.CLASS], [r["member"] for r in rows if r["kind"] == exact_dedup.LINK]
    assert len(set(classes + links)) == len(classes) + len(links) and {r["node"] for r in rows if r["kind"] == exact_dedup.LINK} == set(classes)
