"""Physical plans: filters reach the scan, no series is a window partition of its own, no Python in the plan."""

import io
import re
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from barspark.catalog import inputs as I
from barspark.operators.asof import as_of
from barspark.operators.features import bar_features
from barspark.operators.sequences import decision_index
from barspark.sources.scans import read_table, scan_bars
from barspark.sources.sinks import write_bars
from barspark.streaming.streams import work_dir


def plan(df, mode="formatted"):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def stored(spark, sf):
    path = work_dir(spark, "bars")
    write_bars(I.bars_5min(spark, sf), path)
    return spark.read.parquet(path)


def test_scan_prunes_and_pushes(spark, sf):
    text = plan(scan_bars(stored(spark, sf), symbol="000001.SZ", start="2024-01-03", end="2024-01-05", freq="5min", adjust="none").select("symbol", "close"))
    assert re.search(r"PartitionFilters: \[.*freq.*5min", text)
    assert re.search(r"PushedFilters: \[.*EqualTo\(symbol,000001.SZ\)", text) and "GreaterThanOrEqual(datetime" in text
    assert "ReadSchema: struct<symbol:string,datetime:timestamp_ntz,close:double>" in text


def window_partitions(text):
    """Partition columns of every window over intraday rows (chunk and block tables are small)."""
    return [re.findall(r"(\w+)#\d+", m) for m in re.findall(r"^\+?.*?Arguments: \[.*?\], \[(.*?)\], \[", text, re.M)]


def test_feature_windows_are_cut_into_blocks(spark, sf):
    for gaps in (False, True):
        text = plan(bar_features(read_table(spark, work_path(spark, sf), "bars"), gaps=gaps))
        groups = [g for g in window_partitions(text) if "symbol" in g]
        whole = [g for g in groups if not {"_blk", "_chunk"} & set(g)]
        # Only the chunk table is ordered per series, once for every time rows are numbered, and the table of blocks, four times in each scan over gaps.
        assert groups and len(whole) <= sum("_chunk" in g for g in groups) + (16 if gaps else 0)
        assert "Python" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def work_path(spark, sf):
    path = work_dir(spark, "bars")
    write_bars(I.bars_5min_pct(spark, sf), path)
    return path


def test_as_of_has_no_range_join(spark, sf):
    bars = stored(spark, sf).select("symbol", "datetime", "close")
    asked = bars.select("symbol", F.col("datetime").alias("t"))
    text = plan(as_of(asked, bars, ["symbol"], left_time="t", right_time="datetime", take=["close"], strict=True))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_index_has_no_nested_loop(spark, sf):
    from barspark.operators.decisions import decision_points
    from barspark.plans.dataset import stable_bars

    base = stored(spark, sf)
    text = plan(decision_index(decision_points(base), stable_bars(base, I.bars_daily(spark, sf), ("5min", "daily")), ("5min", "daily")))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_calendars_have_no_nested_loop(spark, sf):
    from barspark.operators import inventory as V
    from barspark.operators import quality as Q

    bars = stored(spark, sf)
    asked = bars.groupBy("symbol", "freq", "adjust").agg(F.to_date(F.min("datetime")).alias("start"), F.to_date(F.max("datetime")).alias("end"))
    for df in (Q.calendar_covered(asked, I.calendar(spark, sf)), Q.plan_gaps(asked, V.slice_catalog(bars), I.calendar(spark, sf), today="2024-01-26")):
        text = plan(df)
        assert "Cartesian" not in text and "NestedLoop" not in text.replace("BroadcastNestedLoopJoin Cross", "")


def test_pages_and_last_rows(spark):
    """Every page of a small table in two orders, and the last rows over days of different size."""
    import datetime as dt

    from barspark.operators.selection import last_rows, page

    data = [(s, "5min", "none", dt.datetime(2024, 1, 1) + dt.timedelta(days=d, minutes=m), d * 10 + m) for s in "ab" for d in (0, 1, 2, 40, 41) for m in range(d % 7 + 1)]
    df = spark.createDataFrame(data, "symbol string, freq string, adjust string, datetime timestamp_ntz, v int").repartition(3)
    for order in (["symbol", "datetime"], ["v", "symbol"]):
        want = sorted(data, key=lambda r: (r[0], r[3]) if order[0] == "symbol" else (r[4], r[0]))
        for offset in (0, 5, 17, len(data) - 3, len(data) + 5, None):
            got = page(df, order, offset=offset, limit=7).collect()
            at = max(len(data) - 7, 0) if offset is None else offset
            assert [(r["symbol"], r["v"]) for r in got] == [(r[0], r[4]) for r in want[at : at + 7]]
            assert all(r["total_rows"] == len(data) and r["page_offset"] == at for r in got)
    got = sorted((r["symbol"], r["from_end"], r["v"]) for r in last_rows(df, 9).collect())
    assert got == sorted((s, i + 1, r[4]) for s in "ab" for i, r in enumerate(sorted((x for x in data if x[0] == s), key=lambda x: x[3], reverse=True)[:9]))
