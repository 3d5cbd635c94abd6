"""Operators that learn: exact parts against plain Python, the rest by held-out accuracy and by what they promise."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from barspark.llm import byte_cnn, context_mixing, mixing, quality_rules, url_filter

from . import brute
from .conftest import rows_of


def tables(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_rules_reject_junk_and_keep_the_rest(spark, sf):
    docs, labels = tables(spark, sf.replace("sf0.001", "sf0.01"))
    out, rules = quality_rules.quality_rules(docs, labels)
    r = out.where("not base_failed").join(labels, "doc_id").agg(
        F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int"))).alias("good"), F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("int"))).alias("bad")).first()
    assert rules and r["good"] >= 0.99 and r["bad"] <= 0.15


def test_rules_on_messy_rows(messy, marks, no_documents):
    out, _ = quality_rules.quality_rules(messy, marks)
    assert out.count() == messy.count() and out.where("base_failed and kept").count() == 0
    assert quality_rules.keep_good(messy, marks).columns == messy.columns
    assert quality_rules.quality_rules(no_documents, marks)[0].count() == 0
    assert quality_rules.quality_rules(messy, marks.limit(0))[1] == []


def test_planted_rule_is_found(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 / 10).alias("a"), (F.col("id") % 7 / 7).alias("b"))
    rows = rows.withColumn("bad", (F.col("a") >= 0.7) & (F.col("b") < 0.5))
    rules = quality_rules.learn_rules(rows, ["a", "b"])
    fired = rows.withColumn("rule", quality_rules.verdict(rules).isNotNull())
    assert fired.where("rule <> bad").count() == 0
    assert quality_rules.learn_rules(rows.where("not bad"), ["a", "b"]) == []


def test_expected_totals_match_targets(spark, sf):
    docs, labels = tables(spark, sf.replace("sf0.001", "sf0.01"))
    out, names, want = mixing.mix(docs, labels)
    out = out.cache()
    got = np.array(out.agg(*[F.sum(F.col("rate") * F.col("n_tokens") * F.element_at("p", i + 1)) for i in range(len(names))]).first(), float)
    assert np.abs(got - want).max() < 2e-3 * sum(want)
    assert out.agg(F.min("rate")).first()[0] >= 1 and out.where("copies < 1").count() == 0
    best = F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position("p", F.array_max("p")).cast("int"))
    assert out.join(docs.select("doc_id", "lang"), "doc_id").agg(F.avg((best == F.col("lang")).cast("int"))).first()[0] > 0.97
    total = out.agg(F.sum("n_tokens")).first()[0]
    half, _ = mixing.fit_rates(out.select("n_tokens", "p"), len(names), [total / 4 / len(names)] * len(names))
    got = np.array(half.agg(*[F.sum(F.col("rate") * F.col("n_tokens") * F.element_at("p", i + 1)) for i in range(len(names))]).first(), float)
    assert half.agg(F.min("rate")).first()[0] >= 0 and np.abs(got - total / 4 / len(names)).max() < 1e-3 * total


def test_mixing_messy_rows(messy, messy_rows, marks, no_documents):
    out, names, _ = mixing.mix(messy, marks)
    assert names == ["de", "en"]
    assert rows_of(out, "doc_id", "n_tokens") == sorted(((d, len((t or "").encode().split())) for d, t in messy_rows), key=repr)
    assert mixing.mix(no_documents, marks)[0].count() == 0
    alone, _, _ = mixing.mix(messy, marks.limit(0))
    assert alone.where("rate <> 1").count() == 0 and alone.count() == len(messy_rows)


def test_base_scores(messy, messy_rows, no_documents):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]
    out = context_mixing.score_texts(messy, sample=5)
    want = sorted(brute.base_scores(messy_rows), key=repr)
    got = rows_of(out, *names)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    assert out.where("score >= 0 or score is null").count() == 0
    assert context_mixing.score_texts(no_documents).count() == 0


def test_score_is_a_probability():
    """The bits of all 256 next bytes after a text add up to one."""
    m = context_mixing.Mixer()
    r = np.random.default_rng(2)
    m.cells[:] = r.integers(-900, 900, m.cells.shape).astype(np.int16) << 3 | r.integers(0, 5, m.cells.shape).astype(np.int16)
    m.learn([context_mixing.plain(b"the river and the stone")])
    keys, word, _ = context_mixing.grams([(b"stone\x00", 3)])
    every = (keys[-1] & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
    assert abs((2.0 ** -m.bits(every, np.repeat(word[-1], 256))).sum() - 1) < 2e-3


def test_certain_slots_keep_their_sign():
    m = context_mixing.Mixer()
    n = np.zeros((context_mixing.SLICE, 2), np.int64)
    n[:9, 0] = n[10:19, 1] = [1, 1000, 444_000, 450_000, 10**6, 10**7, 10**8, 10**9, 10**10]
    m.put(0, n.ravel())
    odds = m.inputs([np.arange(19)] * context_mixing.ORDERS)[0][0]
    assert (np.diff(odds[:9]) <= 0).all() and (np.diff(odds[10:]) >= 0).all() and odds[9] == 0
    assert odds[8] == -16 and odds[18] > 15.9 and (m.cells[0, :9] & 7).tolist() == [1, 4, 4, 4, 4, 4, 4, 4, 4]


def summed(*tasks):
    slices = sorted((k, d) for t in tasks for b in context_mixing._count([pa.record_batch([pa.array(t)], ["text"])]) for k, d in zip(*b.to_pydict().values(), strict=True))
    out = context_mixing._add_up([pa.record_batch([pa.array([k]), pa.array([d])], ["slice", "data"]) for k, d in slices])
    return {k: np.frombuffer(d, np.int64) for b in out for k, d in zip(*b.to_pydict().values(), strict=True)}


def test_counts_do_not_depend_on_tasks():
    texts = ["stone of paper " * 4000 + "stone of sand"] * 20
    one, many = summed(texts), summed(*[[t] for t in texts])
    assert max(x.max() for x in one.values()) > 2 * 65_535  # both values of a bit, each above 16 bits
    assert one.keys() == many.keys() and all((one[k] == many[k]).all() for k in one)


def test_model_beats_the_base_on_held_out_texts(spark, sf):
    docs, _ = tables(spark, sf.replace("sf0.001", "sf0.01"))
    r = context_mixing.score_texts(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.avg("bits_per_byte")).first()
    assert r[0] > r[1] and r[2] < 3


def test_word_counts_have_64_bits():
    def say(bucket, keys, n):
        head = np.array([bucket, len(keys)], np.int64).tobytes() + np.array(keys, np.uint64).tobytes()
        return np.frombuffer(head + context_mixing.squeezed(np.array(n, np.int64).tobytes()), np.uint8)

    many = 2**32 - 1
    told = dict(context_mixing._hear_counts([7, 9], [say(1, [3, 27, 51], [many, 1, 0]), say(1, [3, 27], [many, many])]))
    assert np.frombuffer(told[-1], np.int64).tolist() == [2, 3 * many + 1]
    assert np.frombuffer(context_mixing.whole(told[7][8:]), np.int64).tolist() == [2 * many, many + 1, 0]
    assert np.frombuffer(context_mixing.whole(told[9][8:]), np.int64).tolist() == [2 * many, many + 1]


def test_contexts_reach_across_words():
    keys, _, _ = context_mixing.grams([context_mixing.plain(b"red house"), context_mixing.plain(b"big house")])
    assert keys[4] & np.uint64((1 << 48) - 1) == int.from_bytes(b" red h", "big") and keys[4] != keys[14]


def test_learning_leaves_out_the_bit_to_predict():
    counts = [(0, 1), (1, 0), (1, 1), (3, 1), (1, 3), (0, 9), (40, 1), (1, 40), (700, 3), (3, 700), (20, 0), (60, 60)]
    for bit in (0, 1):
        full, less = context_mixing.Mixer(), context_mixing.Mixer()
        n = np.zeros((context_mixing.SLICE, 2), np.int64)
        n[: len(counts)] = counts
        full.put(0, n.ravel())
        at = np.flatnonzero(n[:, bit])
        n[at, bit] -= 1
        less.put(0, n.ravel())
        assert np.abs((full.without(0, at, np.full(len(at), bit)) >> 3) - (less.cells[0, at] >> 3)).max() <= 2
        assert ((full.without(0, at, np.full(len(at), bit)) & 7) == (less.cells[0, at] & 7)).all()


def test_mixer_learns_from_all_training_texts(spark, messy):
    d = messy.select("doc_id", "text", (context_mixing.fold() != context_mixing.HELD_OUT).alias("training"))
    one, two, some = (context_mixing.train(x, context_mixing.Blocks(x, carry=("training",)), n) for x, n in ((d, None), (d.repartition(9), None), (d, 5)))
    assert (one.weights == two.weights).all() and (one.refined == two.refined).all() and (one.cells == two.cells).all()
    assert (one.weights != some.weights).any() and (one.cells == some.cells).all()


def test_network_on_held_out_texts(spark, sf):
    docs, labels = tables(spark, sf.replace("sf0.001", "sf0.01"))
    out = byte_cnn.classify(docs, labels).join(labels, "doc_id").where("held_out")
    r = out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.min("score"), F.max("score"), F.count("*")).first()
    assert r[0] > 0.95 and 0 <= r[1] <= r[2] <= 1


def test_network_on_messy_rows(messy, messy_rows, marks, no_documents):
    out = byte_cnn.classify(messy, marks)
    want = [(d, zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 0) for d, _ in messy_rows]
    assert rows_of(out, "doc_id", "held_out") == sorted(want, key=repr)
    assert out.where("score is null or (score >= 0.3) <> (predicted = 1)").count() == 0
    assert byte_cnn.classify(no_documents, marks).count() == 0
    assert rows_of(byte_cnn.classify(messy, marks.limit(0)).select("score").distinct(), "score") == [(0.5,)]


def test_a_text_scores_the_same_alone_and_between_others():
    r = np.random.default_rng(4)
    texts = [b"", b"a", b"stone house", b"", b"house stone house stone", b"stone house stone ", b"house stone house st", b"x" * 9, b"x" * 40, b"", b"", b"", b"", b"", b"", b"xxxxxxxx"]
    texts += [bytes(r.integers(97, 101, n).astype(np.uint8)) for n in (3, 254, 255, 256, 257, 448, 449, 900)] + [b""]
    net = byte_cnn.Network()
    run = lambda some: net.forward(np.frombuffer(b"".join(some), np.uint8), np.cumsum([0] + [len(t) for t in some]))
    alone = np.concatenate([run([t]) for t in texts])
    np.testing.assert_allclose(run(texts), alone, rtol=1e-6)
    np.testing.assert_allclose(run(texts[::-1])[::-1], alone, rtol=1e-6)
    assert np.ptp(alone[[k for k, t in enumerate(texts) if not t]]) < 1e-6


def test_chunks_cover_a_text():
    sizes = np.array([0, 1, 255, 256, 257, 1000, 5000])
    doc, at, length = byte_cnn.layout(sizes)
    for k, n in enumerate(sizes):
        seen = {b for a, m in zip(at[doc == k], length[doc == k], strict=True) for b in range(a, a + m)}
        assert seen == set(range(n))


URLS = [None, "", "no scheme/net/", "http://a.NET/x", "http://NET/", "http://xnet/", "http://a.net", "http://a.net?x/", "https://www.Example.net/en/1?a=b&c=d#e", "https://example.net/enx/",
        "ftp://m.example.com/de/", "http://example.com/DE/", "x://b.org/fr/y", "x://org/fr/", "http://a.org/fr/", "a://b://c.net/", "http://ex.com/q?u=http://d.net/", "http://é.net/ü", "http://a.net\n/x", "http://.net/"]


def test_urls(spark):
    rows = [(i, u, "x", 1) for i, u in enumerate(URLS * 3)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, length int")
    out = url_filter.judge_urls(pages, url_filter.RULES)
    got = {(r["page_id"], r["host"], r["path"], r["rule"]) for r in out.collect()}
    assert got == {(i, *brute.host_path(u), brute.rule(u, url_filter.RULES)) for i, u, *_ in rows}
    says = dict(url_filter.RULES)
    assert all(r["verdict"] == says.get(r["rule"], "block" if r["score"] >= 0 else "allow") for r in out.collect())
    assert url_filter.judge_urls(pages.limit(0), url_filter.RULES).count() == 0
    assert url_filter.judge_urls(pages, []).where("verdict <> 'allow'").count() == 0


def test_trees_on_held_out_rows():
    r = np.random.default_rng(5)
    x = r.normal(size=(4000, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < -0.2)).astype(float)
    t = url_filter.Trees().fit(x[:3000], y[:3000])

    def leaf(n, row):
        return n if isinstance(n, float) else leaf(n[2] if row[n[0]] < n[1] else n[3], row)

    z = np.array([t.base + sum(leaf(n, row) for n in t.trees) for row in x[3000:]])
    assert ((z >= 0) == (y[3000:] > 0.5)).mean() > 0.95
