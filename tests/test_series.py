import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspark.operators.quality import consistency_report
from barspark.operators.normalize import keep_last
from barspark.operators.selection import last_rows, sample_by_board
from barspark.operators.sequences import tails
from barspark.operators.series import blocks, block_window, core_rows, number_rows, running


@pytest.fixture(scope="module")
def hot(spark):
    """One series holds almost all rows."""
    n = np.arange(3000)
    pdf = pd.DataFrame({"k": np.where(n % 50 == 0, "cold", "hot"), "t": n, "v": ((n * 7919) % 101).astype(float)})
    pdf.loc[pdf.t % 13 == 0, "v"] = None
    return pdf, spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))


@pytest.mark.parametrize("width", [1, 7, 5000])
def test_running_aggregates_do_not_depend_on_the_chunks(hot, width):
    pdf, df = hot
    got = running(
        df, ["k"], ["t"], F.floor(F.col("t") / width),
        {"n": ("count", None), "s": ("sum", "v"), "hi": ("max", "v"), "lo": ("min", "v"), "f": ("first_valid", "v"), "l": ("last_valid", "v")},
    ).toPandas().sort_values("t")
    ex = running(df, ["k"], ["t"], F.floor(F.col("t") / width), {"p": ("last", "v"), "m": ("count", None)}, exclusive=True).toPandas().sort_values("t")
    for key, g in pdf.groupby("k"):
        a, e = got[got.k == key], ex[ex.k == key]
        assert (a["n"].values == np.arange(1, len(g) + 1)).all() and (e["m"].values == np.arange(len(g))).all()
        np.testing.assert_allclose(a["s"], g["v"].cumsum().ffill())
        np.testing.assert_allclose(a["hi"], g["v"].cummax().ffill())
        np.testing.assert_allclose(a["lo"], g["v"].cummin().ffill())
        np.testing.assert_allclose(a["l"], g["v"].ffill())
        np.testing.assert_allclose(e["p"], g["v"].shift(1))
        assert a["f"].dropna().nunique() == 1


def test_no_block_is_longer_than_its_size_and_halo(hot):
    _, df = hot
    cut = blocks(number_rows(df, ["k"], ["t"], F.floor(F.col("t") / 100)), size=64, halo=20)
    assert cut.groupBy("k", "_blk").count().agg(F.max("count")).first()[0] <= 84
    mean = core_rows(cut.withColumn("m", F.avg("v").over(block_window(["k"]).rowsBetween(-19, 0)))).toPandas().sort_values("t")
    assert len(mean) == 3000
    want = hot[0].groupby("k")["v"].rolling(20, min_periods=1).mean().reset_index(level=0, drop=True)
    np.testing.assert_allclose(mean["m"].values, want.loc[mean["t"].values].values)


def test_halo_longer_than_the_block(spark):
    bars = spark.range(50).select(F.lit("a").alias("symbol"), F.lit("5min").alias("freq"), F.lit("n").alias("adjust"), F.col("id").cast("float").alias("close"),
                                  (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("datetime"))
    rows = tails(bars, {"5min": ("close",)}, size=8).orderBy("datetime").collect()
    assert [len(r["stable_rows"]) for r in rows] == [min(96, i + 1) for i in range(50)]
    assert all(r["stable_rows"][-1][0] == i and r["stable_rows"][0][0] == 0.0 for i, r in enumerate(rows))


def test_last_rows_and_keep_last(spark):
    rows = spark.sql("SELECT 'a' symbol, '5min' freq, 'n' adjust, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) datetime, id FROM range(40)")
    assert {r["id"] for r in last_rows(rows, 3).collect()} == {37, 38, 39}
    twice = rows.withColumn("seq", F.lit(1)).unionByName(rows.withColumns({"id": F.col("id") + 100, "seq": F.lit(2)}))
    assert keep_last(twice, ["datetime"], "seq").agg(F.min("id")).first()[0] == 100


def test_round_robin_takes_from_every_board(spark):
    names = spark.createDataFrame([(f"{p}{i:03d}.{m}",) for p, m, n in (("688", "SH", 30), ("600", "SH", 30), ("830", "BJ", 2)) for i in range(n)], "symbol STRING")
    got = {r["board"]: r["n"] for r in sample_by_board(names, 10, 3).groupBy("board").agg(F.count("*").alias("n")).collect()}
    assert got == {"beijing": 2, "sh": 4, "star": 4}


def test_gaps_and_repeats_of_spans_are_those_of_all_times(spark):
    """Long gaps are found from the first and last times of spans, whatever edge they fall on, and no row is sorted with all others of its symbol."""
    day, start = dt.timedelta(days=1), dt.datetime(1969, 12, 20)
    steps = [14 * day, 15 * day, 15 * day - dt.timedelta(seconds=1), 16 * day, 1 * day, 40 * day, 0 * day, 14 * day, 29 * day, 15 * day]
    for shift in range(0, 30, 7):
        times = [start + shift * day]
        for s in steps:
            times.append(times[-1] + s)
        rows = [(name, t, 1.0, 1.0, 1.0, 1.0, 1.0) for name in ("a", "b") for t in times] + [("b", None, 1.0, 1.0, 1.0, 1.0, 1.0)]
        bars = spark.createDataFrame(rows, "symbol string, datetime timestamp_ntz, open double, high double, low double, close double, volume double")
        report = consistency_report(bars)
        got = {r["symbol"]: (r["rows"], r["bad_datetime"], r["duplicates"], r["large_gaps"]) for r in report.collect()}
        assert got == {"a": (11, 0, 1, 5), "b": (11, 1, 1, 5)}
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2 and not any("open" in line for line in plan.splitlines() if "Window [" in line)
