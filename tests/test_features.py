import numpy as np
import pytest
from pyspark.sql import functions as F

from barspark.catalog import inputs
from barspark.operators.ema import Ema, affine_carries, span, with_emas, with_gap_emas
from barspark.operators.features import bar_features
from barspark.operators.series import blocks, number_rows, time_chunk
from barspark.plans.registry import DEFAULT_SPEC, FeatureSpec
from barspark.schema import SLICE

from .reference_features import pandas_features


@pytest.mark.parametrize("size", [32, 512])
def test_features_match_pandas(spark, sf, size):
    bars = inputs.bars_5min(spark, sf)
    got = bar_features(bars, size=size).toPandas().sort_values(["symbol", "datetime"]).reset_index(drop=True)
    src = bars.toPandas().sort_values(["symbol", "datetime"]).reset_index(drop=True)
    want = src.groupby("symbol", group_keys=False)[src.columns.tolist()].apply(lambda g: pandas_features(g, 96))
    assert len(got) == len(src) and (got["datetime"] == src["datetime"]).all()
    for name, (lo, hi) in DEFAULT_SPEC.market_clip.items():
        expected = want[name].clip(lo, hi).replace([np.inf, -np.inf], np.nan).fillna(0.0)
        np.testing.assert_allclose(got[name], expected, rtol=1e-8, atol=1e-9, err_msg=name)


def test_average_of_average_for_equal_and_different_decays(spark, sf):
    bars = blocks(number_rows(inputs.bars_5min(spark, sf), SLICE, ["datetime"], time_chunk()), size=16, halo=3)
    out = with_emas(
        bars, SLICE,
        [Ema("same", "close", 1 / 3, 1 / 3), Ema("diff", "close", span(12), span(9)), Ema("slow", "close", span(500)),
         Ema("id", "close", 1.0), Ema("half", "close", 1.0, span(5))],
        size=16,
    ).filter("_core").toPandas().sort_values(["symbol", "datetime"])
    for _, g in out.groupby("symbol"):
        e = lambda s, a: s.ewm(alpha=a, adjust=False).mean()
        c = g["close"]
        np.testing.assert_allclose(g["same"], e(e(c, 1 / 3), 1 / 3), rtol=1e-10)
        np.testing.assert_allclose(g["diff"], e(e(c, 2 / 13), 0.2), rtol=1e-10)
        np.testing.assert_allclose(g["slow"], e(c, 2 / 501), rtol=1e-10)
        np.testing.assert_allclose(g["id"], c)
        np.testing.assert_allclose(g["half"], e(c, 2 / 6), rtol=1e-10)


def test_averages_over_missing_values(spark, sf):
    """NULLs first, alone, in runs, over block edges and over whole blocks; also an average of an average."""
    bars = number_rows(inputs.bars_5min(spark, sf).select("symbol", "freq", "adjust", "datetime", "close"), SLICE, ["datetime"], time_chunk())
    missing = F.col("rn").isin(1, 2, 9, 16, 17, 31, 32, 33) | F.col("rn").between(60, 105) | (F.pmod("rn", F.lit(7)) == 3)
    cut = blocks(bars.withColumn("close", F.when(~missing, F.col("close"))), size=16, halo=3)
    emas = [Ema("plain", "close", span(12)), Ema("slow", "close", span(100)), Ema("same", "close", 1 / 3, 1 / 3), Ema("diff", "close", span(12), span(9)), Ema("fast", "close", 2 / 3)]
    out = with_gap_emas(cut, SLICE, emas, size=16).filter("_core").toPandas().sort_values(["symbol", "datetime"])
    e = lambda s, a: s.ewm(alpha=a, adjust=False).mean()
    for _, g in out.groupby("symbol"):
        c = g["close"]
        want = {"plain": e(c, 2 / 13), "slow": e(c, 2 / 101), "same": e(e(c, 1 / 3), 1 / 3), "diff": e(e(c, 2 / 13), 0.2), "fast": e(c, 2 / 3)}
        for name, w in want.items():
            np.testing.assert_allclose(g[name], w, rtol=1e-9, err_msg=name)
            np.testing.assert_allclose(g[f"{name}__before"], w.shift(1), rtol=1e-9, err_msg=name)


@pytest.mark.parametrize("size", [32, 512])
def test_features_over_missing_closes_match_pandas(spark, sf, size):
    bars = number_rows(inputs.bars_5min(spark, sf), SLICE, ["datetime"], time_chunk())
    bars = bars.withColumn("close", F.when(~(F.col("rn").isin(5, 31, 32, 33, 70) | F.col("rn").between(40, 44)), F.col("close"))).drop("rn")
    got = bar_features(bars, size=size).toPandas().sort_values(["symbol", "datetime"]).reset_index(drop=True)
    src = bars.toPandas().sort_values(["symbol", "datetime"]).reset_index(drop=True)
    want = src.groupby("symbol", group_keys=False)[src.columns.tolist()].apply(lambda g: pandas_features(g, 96))
    for name, (lo, hi) in DEFAULT_SPEC.market_clip.items():
        if name.startswith(("macd", "kd", "efi", "ema_channel")):
            expected = want[name].clip(lo, hi).replace([np.inf, -np.inf], np.nan).fillna(0.0)
            np.testing.assert_allclose(got[name], expected, rtol=1e-7, atol=1e-8, err_msg=name)


def test_averages_hold_over_ten_thousand_missing_rows(spark):
    """No length of a gap changes a held average, also at a block's edge and over several chunks of the scan."""
    rows = [("a", "5min", "none", i, float(10 + i % 3) if i <= 96 or i in (10_100, 10_101) else None) for i in range(1, 10_103)]
    rows += [("b", "5min", "none", i, 5.0 if i <= 64 else 7.0 if i == 9_001 else None) for i in range(1, 9_100)]
    rows += [("c", "5min", "none", i, None if i < 700 else float(i % 5)) for i in range(1, 800)]
    bars = spark.createDataFrame(rows, "symbol string, freq string, adjust string, rn bigint, close double")
    emas = [Ema("third", "close", 1 / 3), Ema("slow", "close", span(169)), Ema("twice", "close", 1 / 3, 1 / 3), Ema("signal", "close", span(12), span(9))]
    out = with_gap_emas(blocks(bars, size=32, halo=3), SLICE, emas, size=32).filter("_core").toPandas().sort_values(["symbol", "rn"])
    e = lambda s, a: s.ewm(alpha=a, adjust=False).mean()
    for _, g in out.groupby("symbol"):
        c = g["close"]
        want = {"third": e(c, 1 / 3), "slow": e(c, 2 / 170), "twice": e(e(c, 1 / 3), 1 / 3), "signal": e(e(c, 2 / 13), 0.2)}
        for name, w in want.items():
            np.testing.assert_allclose(g[name], w, rtol=1e-9, err_msg=name)
        last = c.notna() * g["rn"]
        np.testing.assert_allclose(g["close__since"].astype(float), np.where(last.cummax() > 0, g["rn"] - last.cummax(), np.nan))


def test_carries_at_every_level(spark):
    rows = [("k", i, None if i % 7 == 3 else (0.5 + (i % 4) / 8, float(i % 5))) for i in range(300)] + [("m", 0, (0.0, 4.0)), ("m", 1, (1.0, 0.0))]
    table = spark.createDataFrame(rows, "k string, at bigint, s struct<r: double, z: double>")
    got = {(r["k"], r["at"]): r["s_c"] for r in affine_carries(table, ["k"], "at", ["s"], fan=8, levels=3).select('k', 'at', 's_c').collect()}
    want, state = {}, {}
    for k, at, step in rows:
        want[k, at] = state.get(k, 0.0)
        state[k] = want[k, at] if step is None else step[0] * want[k, at] + step[1]
    assert got.keys() == want.keys()
    for key, w in want.items():
        assert np.isclose(got[key], w, rtol=1e-12)
    with pytest.raises(Exception, match="too long"):
        affine_carries(table, ["k"], "at", ["s"], fan=8, levels=2).collect()


def test_missing_price_raises_where_none_was_promised(spark, sf):
    bars = inputs.bars_5min(spark, sf)
    assert bar_features(bars, FeatureSpec(indicators=())).count() == bars.count()  # no averages at all
    holes = bars.withColumn("close", F.when(F.hour("datetime") != 5, F.col("close")))
    assert bar_features(bars, gaps=False).count() == bars.count()
    with pytest.raises(Exception, match="price is missing"):
        bar_features(holes, gaps=False).collect()
