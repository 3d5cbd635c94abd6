"""The corpus pipeline: documents in, token files out.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the columns of documents.
``run`` writes every stage's result as Parquet in the shared folder and reads it again, so each starts from a table. Rows are told apart by doc_id:
repeated rows of one id share its fate. Null texts fail the quality rules and go; an empty table passes through every stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm.decontamination import contamination
from barspark.llm.files import staged, table
from barspark.llm.mixing import mix
from barspark.llm.quality_rules import keep_good
from barspark.llm.registry import query
from barspark.llm.simhash import simhash_groups
from barspark.llm.token_files import tokenized

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a learned rule go."""
    return keep_good(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints, the document with the smallest id stays."""
    groups = simhash_groups(docs)
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("first")).distinct()
    return docs.select(COLUMNS).join(first, F.col("doc_id").eqNullSafe(F.col("first")), "left_semi")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go."""
    bad = contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("bad")).distinct()
    return docs.select(COLUMNS).join(bad, F.col("doc_id").eqNullSafe(F.col("bad")), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its rate says: domains below their target weight repeat documents, none is lost."""
    rates, _, _ = mix(docs, table(spark, sf_dir, "labels"))
    times = rates.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "copies").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64(F.col("text")) == F.col("h"))
    return docs.select(COLUMNS).join(times, same).withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write every text's ids and return the digests read back from the files."""
    return tokenized(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token ids", token_ids),
]

# Learned rules, XXH64 fingerprints, posteriors and the tokenizer are not SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return reduce(lambda d, stage: staged(stage[1](spark, d, sf_dir), "pipeline"), STAGES, docs)
