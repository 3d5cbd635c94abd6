"""Series with one bar a day: one window each, no joins, and the averages of longer segments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barspark.catalog import inputs
from barspark.operators.ema import Ema, span, with_window_emas
from barspark.operators.features import bar_features, feature_frame


@pytest.mark.parametrize("name", ["kd_lines", "macd_lines", "indicator_chart_window", "bar_features_daily_history"])
def test_daily_queries_shuffle_bars_once(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") <= 2 and plan.count("FileScan") == 1


def test_averages_over_many_segments(spark):
    n = 1700  # more than three segments of the fastest average
    x = np.random.default_rng(3).uniform(1, 9, n)
    df = spark.createDataFrame([("a", i + 1, float(v)) for i, v in enumerate(x)], "s string, rn bigint, x double")
    emas = [Ema("fast", "x", span(2)), Ema("kd", "x", 1 / 3, 1 / 3), Ema("slow", "x", span(169)), Ema("dea", "x", span(12), span(9))]
    got = with_window_emas(df, ["s"], emas).orderBy("rn").toPandas()

    def average(values, a):
        out = [values[0]]
        for v in values[1:]:
            out.append(out[-1] + a * (v - out[-1]))
        return np.array(out)

    for e in emas:
        want = average(x, e.alpha)
        np.testing.assert_allclose(got[e.out], want if e.then is None else average(want, e.then), rtol=1e-9)


def test_features_equal_those_of_blocks(spark, sf):
    bars = inputs.bars_daily_long(spark, sf).filter(F.col("symbol") < "S3")
    a, b = (bar_features(bars, gaps=False, one_per_day=x).toPandas().sort_values(["symbol", "datetime"]) for x in (True, False))
    assert list(a.columns) == list(b.columns) and len(a) == len(b) > 0
    numbers = [c for c in a.columns if a[c].dtype == float]
    np.testing.assert_allclose(a[numbers].to_numpy(), b[numbers].to_numpy(), rtol=1e-7, atol=1e-9)


def test_wide_features_use_small_methods(spark, sf):
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "65535")
        plan = bar_features(inputs.bars_daily_long(spark, sf), gaps=False, one_per_day=True)._jdf.queryExecution().executedPlan().toString()
        assert spark.conf.get(key) == "8000"
        assert "lag(turn" not in plan and "avg(turn" not in plan  # bars without a turnover have none to look back at
        spark.conf.set(key, "4000")
        bar_features(inputs.bars_daily_long(spark, sf), gaps=False)
        assert spark.conf.get(key) == "4000"
    finally:
        spark.conf.set(key, before)


def test_one_per_day_is_for_complete_bars(spark, sf):
    with pytest.raises(ValueError):
        feature_frame(inputs.bars_daily(spark, sf), one_per_day=True)
