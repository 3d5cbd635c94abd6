"""Tables that cut lineage or hold a result, in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.plans.staging import work_dir


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet under ``spark.checkpoint.dir`` and read back."""
    spark, path = df.sparkSession, work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sampled(df: DataFrame, n: int, total: int, *key: str) -> DataFrame:
    """At most ``n`` of ``total`` rows, those with the smallest hash of ``key``.

    Rows that cannot be among them are dropped in their tasks first (about 2 n are left of all tasks), so what reaches one place does not grow."""
    place = F.pmod(F.xxhash64(*key, F.lit("sample")), F.lit(1 << 30))
    if total > 2 * n:
        df = df.where(place <= int((1 << 30) * 2 * n / total))
    return df.orderBy(place, *key).limit(n)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
