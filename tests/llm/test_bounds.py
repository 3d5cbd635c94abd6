"""Sizes of what operators send to the driver, and of what they sort."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from barspark.llm import context_mixing, simhash, suffix_dedup


def slices():
    texts = ["stone of paper " * 3000 + f"stone of sand {i}" for i in range(20)]
    return sorted((k, d) for b in context_mixing._count([pa.record_batch([pa.array(texts)], ["text"])]) for k, d in zip(*b.to_pydict().values(), strict=True))


def batches():
    return [pa.record_batch([pa.array([k]), pa.array([d])], ["slice", "data"]) for k, d in slices()]


def test_cells_for_the_driver_are_small_and_equal_those_of_the_counts():
    want, got, sent = context_mixing.Mixer(), context_mixing.Mixer(), []
    for b in context_mixing._add_up(batches()):
        want.put(b.column(0)[0].as_py(), np.frombuffer(b.column(1)[0].as_py(), np.int64))
    for b in context_mixing._add_up_cells(batches()):
        sent.append(len(b.column(1)[0].as_py()))
        data = context_mixing.whole(b.column(1)[0].as_py())
        got.put_cells(b.column(0)[0].as_py(), np.frombuffer(data, np.int16, context_mixing.SLICE), np.frombuffer(data, np.uint8, offset=2 * context_mixing.SLICE))
    assert max(sent) < 3 * context_mixing.SLICE + 1024  # the counts have 16 bytes a slot
    assert (want.cells == got.cells).all() and (want.few == got.few).all() and want.cells.any()


def test_equal_parts_of_cells_are_sorted_once(monkeypatch):
    """A passage between other texts in many documents: the suffix arrays get what its cells share once, and every string still knows its smallest document."""
    r = np.random.default_rng(5)
    passage = bytes(r.integers(97, 123, 70).astype(np.uint8))
    texts = [bytes(r.integers(97, 123, 40).astype(np.uint8)) + passage[d % 3 :] + bytes(r.integers(97, 123, 40).astype(np.uint8)) for d in range(200)]
    data, starts = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    sizes = []
    array = suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda x: sizes.append(len(x)) or array(x))
    docs = pa.table({"doc_id": pa.array(range(200)), "text": pa.array([t.decode() for t in texts])})
    shared = [np.frombuffer(d, np.uint8) for _, d in suffix_dedup._say_anchors(0, docs, [], 1)]
    told = [np.frombuffer(d, np.uint8) for _, d in suffix_dedup.shared_keys(np.array([0]), shared)]
    said = [np.frombuffer(d, np.uint8) for _, d in suffix_dedup._say_cells(0, docs, told, 1)]
    cells = np.sort(np.concatenate([suffix_dedup.expand(x) for x in said]), order=["anchor", "cell"])
    owner = suffix_dedup.string_owners(cells)
    first = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - 49):
            first.setdefault(t[i : i + 50], d)
    got = {}  # a string can lie around several anchors; one of them has it in all documents
    for c, own in zip(cells, owner, strict=True):
        text = c["text"].tobytes()
        for k in range(31):
            if k <= c["left"] and 50 - k <= c["right"]:
                string = text[30 - k : 80 - k]
                got[string] = min(got.get(string, 200), own[k])
    assert got and got == {k: first[k] for k in got}
    assert len(cells) >= 200 and 0 < sum(sizes) < 31 * len(cells)  # 62 for each, were all of them sorted whole


def test_copies_of_fingerprints_are_not_broadcast(spark, tmp_path):
    """A small table of fingerprints has about 60 times as many copies, whatever size Spark gives them."""
    r = np.random.default_rng(7)
    own = r.integers(-(1 << 63), 1 << 63, 300)
    near = own[:200] ^ (1 << r.integers(0, 63, 200)) ^ (1 << r.integers(0, 63, 200))
    fps = sorted({*own.tolist(), *near.tolist()})
    spark.createDataFrame([(x,) for x in fps], "fp bigint").write.parquet(f"{tmp_path}/fps")
    links = simhash.links(spark.read.parquet(f"{tmp_path}/fps"))
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    assert len(want) >= 190 and sorted(map(tuple, links.collect())) == sorted(want)
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()


def test_near_duplicates_of_the_pipeline_broadcast_no_copies(spark, messy, monkeypatch):
    plans, links = [], simhash.links

    def seen(fps):
        out = links(fps)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(simhash, "links", seen)
    assert corpus_pipeline.near_duplicates(spark, messy, "").columns == corpus_pipeline.COLUMNS
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]
