"""Bars with a price of zero against the SQL forms' rules."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from barspark.catalog import load
from barspark.operators.features import bar_features
from barspark.operators.snapshot import feature_states, snapshot_features
from barspark.plans.registry import FeatureSpec, compile_blueprint, needed_spec

from .compare import compare

_PLAIN = FeatureSpec(indicators=())

_BAR = "symbol string, datetime timestamp_ntz, open double, high double, low double, close double, volume double, amount double, freq string, adjust string"


def bars_of(spark, *prices):
    start = dt.datetime(2024, 1, 2, 9, 35)
    rows = [("000001.SZ", start + dt.timedelta(minutes=5 * i), o, max(o, c), min(o, c), c, 1.0, c, "5min", "none") for i, (o, c) in enumerate(prices)]
    return spark.createDataFrame(rows, _BAR)


def test_log_return_of_a_zero_close_is_at_its_bound(spark):
    bars = bars_of(spark, (2.0, 2.0), (2.0, 0.0), (1.0, 1.0))
    got = [r["log_ret"] for r in bar_features(bars, _PLAIN, gaps=False).orderBy("datetime").collect()]
    assert got[1] == -0.3 and got[0] == got[2] == 0.0
    partial = bars.filter("close = 0").withColumnRenamed("datetime", "bar_datetime").withColumns({
        "stable_end_datetime": F.lit(dt.datetime(2024, 1, 2, 9, 35)), "pctChg": F.lit(None).cast("double"), "turn": F.lit(None).cast("double"),
        "progress": F.lit(1.0), "snapshot_id": F.lit(""), "decision_id": F.lit("")})
    assert snapshot_features(partial, feature_states(bars, _PLAIN, gaps=False), _PLAIN).first()["log_ret"] == -0.3


def test_return_of_a_zero_open_is_as_the_spec_says(spark):
    bars = bars_of(spark, (2.0, 2.0), (0.0, 1.0), (0.0, 0.0))
    for ret, want in ((None, 0.0), (float("inf"), 0.3)):
        spec = FeatureSpec(indicators=(), zero_open_ret=ret)
        assert [r["open_close_ret"] for r in bar_features(bars, spec, gaps=False).orderBy("datetime").collect()] == [0.0, want, want]
        partial = bars.filter("open = 0").withColumnRenamed("datetime", "bar_datetime").withColumns({
            "stable_end_datetime": F.lit(dt.datetime(2024, 1, 2, 9, 35)), "pctChg": F.lit(None).cast("double"), "turn": F.lit(None).cast("double"),
            "progress": F.lit(1.0), "snapshot_id": F.lit(""), "decision_id": F.lit("")})
        kept = needed_spec(spec, compile_blueprint([{"name": "open_close_ret", "stream": "market_sequence", "frequencies": ["5min"]}]))
        assert {r["open_close_ret"] for r in snapshot_features(partial, feature_states(bars, kept, gaps=False), kept).collect()} == {want}


def test_queries_of_zero_opens_equal_their_sql(spark, sf, tmp_path):
    """A day's first tick is zero, so bars of several frequencies open at zero."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    first = events.groupBy("event_type", F.to_date("ts").alias("d")).agg(F.min("ts").alias("ts")).filter("day(d) % 3 = 2").select("event_type", "ts", F.lit(True).alias("zero"))
    changed = events.join(first, ["event_type", "ts"], "left").withColumn("value", F.when(F.col("zero"), 0.0).otherwise(F.col("value"))).drop("zero")
    changed.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con, reg = duckdb.connect(), load()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("frame_quality", "features_with_raw_bars"):
        rows, verdict = compare(spark, con, reg.QUERIES[name], reg.SQL[name], str(tmp_path))
        assert verdict == "ok", f"{name}: {verdict}"
