"""The registered queries against their SQL or plain Python on the small tables, and the pipeline stage by stage."""

import pytest

import corpus_pipeline
from barspark.llm import load
from barspark.llm.files import staged

from ..compare import compare, duck
from . import brute
from .conftest import rows_of

REGISTRY = load()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(REGISTRY.SQL))
def test_query_equals_sql(spark, sf, con, name):
    rows, verdict = compare(spark, con, REGISTRY.QUERIES[name], REGISTRY.SQL[name], sf)
    assert verdict.split()[0] == "ok" and rows > 0  # a column of numbers with nulls has another kind in pandas


@pytest.mark.parametrize("name", sorted(set(REGISTRY.QUERIES) - set(REGISTRY.SQL) - {"pipeline"}))
def test_query_has_a_row_for_each_input_row(spark, sf, name):
    table = "pages" if name.startswith("op8") else "documents"
    assert REGISTRY.QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


def test_simhash_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = rows_of(REGISTRY.QUERIES["op9_simhash_groups"](spark, sf), "doc_id", "fingerprint", "component_id")
    assert got == sorted(brute.simhash_groups(docs), key=repr)


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    kept = []
    d = docs
    for _, stage in corpus_pipeline.STAGES:
        d = staged(stage(spark, d, sf), "pipeline")
        kept.append(sorted(r["doc_id"] for r in d.select("doc_id").collect()))
    good, first, clean, mixed, last = kept
    assert set(good) <= {i for i, t in text.items() if not brute.quality(t)[5]}
    groups = brute.simhash_groups([(i, text[i]) for i in good])
    assert first == sorted({c for _, _, c in groups})
    assert clean == sorted(r[0] for r in brute.contamination([(i, text[i]) for i in first], items) if not r[5])
    assert set(mixed) == set(clean) and len(mixed) >= len(clean) and last == mixed
    assert d.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_pipeline_of_nothing_and_of_messy_rows(spark, sf, messy, no_documents):
    for docs in (no_documents, messy):
        d, n = docs, 0
        for _, stage in corpus_pipeline.STAGES[:-1]:
            d = staged(stage(spark, d, sf), "pipeline")
            n = d.count()
            assert d.columns == corpus_pipeline.COLUMNS
        assert staged(corpus_pipeline.STAGES[-1][1](spark, d, sf), "pipeline").count() == n
