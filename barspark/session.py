"""A local session for tests and benchmarks; on a cluster the caller brings its own."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the library relies on; all can be set on any cluster.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Generated methods above this size are never compiled by the JVM; smaller pieces are.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def small_methods(spark: SparkSession) -> None:
    """Lets a session whose limit for generated methods is Spark's default use the recommended one: wide projections run several times as long in methods that
    the JVM does not compile. Results do not depend on it."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(key, "65535")) > int(RECOMMENDED[key]):
        spark.conf.set(key, RECOMMENDED[key])


def local_session(name: str, cores: int | None = None, partitions: int | None = None) -> SparkSession:
    cores = cores or min(8, os.cpu_count() or 8)
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
    )
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
