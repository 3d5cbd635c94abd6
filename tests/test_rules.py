"""Errors, configuration and incremental behaviour."""

import pytest
from pyspark.sql import functions as F

from barspark.catalog import inputs as I
from barspark.operators import quality as Q
from barspark.operators.bars import aggregate_bars, stored_bars
from barspark.operators.decisions import decision_points, pick_decisions
from barspark.operators.sequences import assert_complete_index
from barspark.plans import incremental as N
from barspark.plans.registry import (
    DEFAULT_SPEC, compile_blueprint, default_blueprint, indicators_from_config, needed_spec, schema_hash,
)
from barspark.schema import DERIVED_MANIFEST
from barspark.streaming import streams as S

MACD = {"id": "m", "kind": "macd", "params": {"fast": 3, "slow": 6, "signal": 2}, "frequencies": ["5min"]}


@pytest.mark.parametrize("change, text", [
    ({"id": "has space"}, "id"), ({"kind": "rsi"}, "kind"), ({"frequencies": []}, "frequencies"), ({"frequencies": ["tick"]}, "frequencies"),
    ({"params": {"fast": 3, "slow": 6}}, "signal"), ({"params": {"fast": 9, "slow": 6, "signal": 2}}, "fast"),
])
def test_bad_indicators_are_refused(change, text):
    with pytest.raises(ValueError, match=text):
        indicators_from_config([{**MACD, **change}])
    with pytest.raises(ValueError, match="twice"):
        indicators_from_config([MACD, MACD])


def test_blueprint():
    model = compile_blueprint()
    assert model.channels["5min"] == DEFAULT_SPEC.market_fields and len(model.context) == 12 and len(model.runtime) == 10
    items = default_blueprint()
    assert model.schema_hash == schema_hash(items) != schema_hash(items[1:])
    with pytest.raises(ValueError, match="unknown"):
        compile_blueprint([{"name": "nope", "frequencies": ["5min"]}])
    with pytest.raises(ValueError, match="stream"):
        compile_blueprint([{"name": "is_limit_up", "stream": "market_sequence", "frequencies": ["5min"]}])
    small = compile_blueprint([{"name": "kd_k_norm", "frequencies": ["daily"]}])
    assert [i.id for i in needed_spec(DEFAULT_SPEC, small).indicators] == ["kd"]


def test_refused_inputs(spark, sf):
    bars = I.bars_5min(spark, sf)
    with pytest.raises(ValueError):
        aggregate_bars(bars, "15min", "30min")
    with pytest.raises(ValueError):
        stored_bars(bars, "30min", "5min")
    with pytest.raises(ValueError):
        decision_points(bars, trade_freq="daily")
    with pytest.raises(ValueError, match="stages"):
        pick_decisions(decision_points(bars), stages=["noon"])
    with pytest.raises(ValueError, match="no status"):
        Q.require_status(bars, I.status(spark, sf))
    with pytest.raises(ValueError, match="invalid_close"):
        Q.assert_valid_bars(bars.withColumn("close", F.when(F.minute("datetime") != 5, F.col("close"))))
    d = decision_points(bars)
    with pytest.raises(ValueError, match="incomplete"):
        assert_complete_index(d, d.limit(1).select("decision_id", F.lit("5min").alias("freq")), ["5min"])


def test_missing_column_is_an_error_row(spark, sf):
    rows = Q.validate_bars(I.bars_5min(spark, sf).drop("low")).collect()
    assert [(r["check"], r["severity"]) for r in rows] == [("missing_column_low", "error")]


def test_correction_in_the_prefix_forces_a_full_rebuild(spark, sf):
    bars = I.bars_5min(spark, sf)
    empty = spark.createDataFrame([], DERIVED_MANIFEST)
    nothing = stored_bars(bars, "15min", "5min").limit(0)
    target, manifest, summary = N.materialize(bars, nothing, empty, base_freq="5min", target_freq="15min")
    assert {r["status"] for r in summary.collect()} == {"ok"}
    fixed = bars.withColumn("high", F.when(F.dayofmonth("datetime") == 5, F.col("high") + 1).otherwise(F.col("high")))
    plan = {r["action"] for r in N.plan_rebuild(fixed, target, manifest, base_freq="5min", target_freq="15min").collect()}
    assert plan == {"full"}
    again, _, _ = N.materialize(fixed, target, manifest, base_freq="5min", target_freq="15min")
    fresh = stored_bars(fixed, "15min", "5min")
    key = ["symbol", "datetime", "open", "high", "low", "close", "volume"]
    assert again.select(*key).exceptAll(fresh.select(*key)).count() == 0 and again.count() == fresh.count()


def test_stream_equals_batch_on_gap_free_input(spark):
    """With a tick in every five minutes clock buckets and position buckets agree."""
    ticks = spark.range(96 * 3).select(
        F.lit("a").alias("symbol"), (F.lit("2024-01-02 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int") * 5, secs=F.lit(1))).alias("ts"),
        (F.col("id") * 7 % 31 + 1).cast("double").alias("price"), F.lit(2.0).alias("volume"))
    path = S.work_dir(spark, "stream")
    ticks.repartition(3).write.parquet(f"{path}/in")
    stream = S.tick_stream(spark, f"{path}/in", ticks.schema, files_per_batch=1)
    S.publish(S.live_bars(stream, "15min", late="3 days"), f"{path}/out", f"{path}/log").awaitTermination()
    live = S.read_latest(spark, f"{path}/out", ["symbol", "bar_start"]).select("open", "high", "low", "close", "volume")
    base = ticks.groupBy("symbol", (F.col("ts") - F.make_dt_interval(secs=F.lit(1)) + F.make_dt_interval(mins=F.lit(5))).alias("datetime")).agg(
        F.first("price").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.first("price").alias("close"), F.sum("volume").alias("volume"))
    base = base.withColumns({"amount": F.lit(0.0), "freq": F.lit("5min"), "adjust": F.lit("none")})
    # The last bar of a day ends at midnight and counts to the next day, so days are shifted back to compare.
    shifted = base.withColumn("datetime", F.col("datetime") - F.make_dt_interval(mins=F.lit(5)))
    batch = aggregate_bars(shifted, "15min").select("open", "high", "low", "close", "volume")
    assert live.count() == 96 and live.exceptAll(batch).count() == 0


def test_calendar_neighbours_are_the_plain_ones(spark):
    """Every range of a small calendar with holes against plain Python, stored edges inside, outside and missing."""
    import datetime as dt
    import itertools

    days = [dt.date(2024, 1, d) for d in (2, 3, 4, 8, 9, 15)]
    cal = spark.createDataFrame([(d, True, "CN") for d in days] + [(dt.date(2024, 1, 6), False, "CN")], "date date, is_trading_day boolean, exchange string")
    edge = [dt.date(2024, 1, d) for d in (1, 3, 5, 9, 20)]
    ranges = list(itertools.combinations(edge, 2))
    got = {(r["start"], r["end"]): r for r in Q.calendar_covered(spark.createDataFrame(ranges, "start date, end date"), cal).collect()}
    every = sorted([*days, dt.date(2024, 1, 6)])
    for a, b in ranges:
        inside = [d for d in every if a <= d <= b]
        assert (got[a, b]["days"], got[a, b]["first"], got[a, b]["last"]) == (len(inside), inside[0] if inside else None, inside[-1] if inside else None)
    asked, stored, want = [], [], set()
    for i, (a, b) in enumerate(ranges):
        for j, (s, e) in enumerate([(None, None), (dt.date(2024, 1, 4), dt.date(2024, 1, 8)), (dt.date(2024, 1, 1), dt.date(2024, 1, 2)), (dt.date(2024, 1, 2), dt.date(2024, 1, 19))]):
            name = f"s{i}_{j}"
            asked.append((name, "daily", "none", a, b))
            if s:
                stored.append((name, "daily", "none", dt.datetime(s.year, s.month, s.day), dt.datetime(e.year, e.month, e.day), 5))
            inside = [d for d in days if a <= d <= b]
            if not inside or (s and s <= inside[0] and e >= inside[-1]):
                continue
            pre, post = ([d for d in inside if s and d < s], [d for d in inside if s and d > e])
            spans = [(x[0], x[-1], k) for x, k in ((pre, "before"), (post, "after")) if x] or [(inside[0], inside[-1], "whole")]
            want |= {(name, *x) for x in spans}
    catalog = spark.createDataFrame(stored, "symbol string, freq string, adjust string, start_datetime timestamp_ntz, end_datetime timestamp_ntz, rows int")
    out = Q.plan_gaps(spark.createDataFrame(asked, "symbol string, freq string, adjust string, start date, end date"), catalog, cal, today="2024-02-01")
    assert {tuple(r) for r in out.select("symbol", "from_date", "to_date", "kind").collect()} == want


def test_manifest_ranges_of_one_slice(spark, sf):
    """Many listed ranges of a slice, some wrong; each is checked by its two ends."""
    from barspark.operators import inventory as V

    bars = I.bars_5min(spark, sf).filter("symbol = '000001.SZ'")
    parts = []
    for i, (a, b) in enumerate([(2, 9), (3, 5), (8, 30), (4, 4)]):
        cut = bars.filter(F.dayofmonth("datetime").between(a, b))
        c = V.slice_catalog(cut)
        parts.append(c.select(F.lit(str(i)).alias("id"), "symbol", "freq", "adjust", F.col("start_datetime").alias("actual_start"), F.col("end_datetime").alias("actual_end"),
                              (F.col("rows") + (1 if i == 1 else 0)).alias("rows"), (F.col("data_hash") + (1 if i == 2 else 0)).alias("data_hash"), F.lit("completed").alias("status")))
    manifest = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    got = {r["id"]: r["reason"] for r in Q.verify_manifest(manifest, bars).collect()}
    assert got == {"0": "", "1": "rows_differ", "2": "hash_differs", "3": ""}
    moved = manifest.withColumn("actual_start", F.col("actual_start") - F.make_dt_interval(mins=F.lit(1))).filter("id = '3'")
    assert [r["reason"] for r in Q.verify_manifest(moved, bars).collect()] == ["start_differs"]
