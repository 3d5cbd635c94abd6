"""Series for charts: the last bars with their indicators, and a summary of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import FeatureSpec, Indicator
from ..schema import SLICE
from .features import display_lines, feature_frame, finish_features
from .selection import last_rows


def indicator_window(bars: DataFrame, item: Indicator, *, rows: int, warmup: int | None = None, gaps: bool = True, one_per_day: bool = False) -> DataFrame:
    """Chart lines and clipped model fields of the last ``rows`` bars of each series.

    The whole history is used, so the values equal the stored features; with ``warmup`` only that many times the
    indicator's lookback of hidden earlier bars are. ``one_per_day``: see ``feature_frame``.
    """
    from dataclasses import replace

    spec = FeatureSpec(indicators=(replace(item, frequencies=tuple(FeatureSpec().windows)),))
    used = bars
    if warmup is not None:
        used = last_rows(bars, rows + max(20, item.lookback * warmup)).drop("from_end")
    frame = feature_frame(used, spec, gaps=gaps, one_per_day=one_per_day)
    lines = display_lines(frame, item)
    model = finish_features(frame.withColumns(lines), spec, *[n for n in lines if n not in item.fields], *["rn"] * one_per_day)
    from_end = F.count("*").over(Window.partitionBy(*SLICE)) - F.col("rn") + 1  # in a slice that one window holds
    shown = ["symbol", "datetime", "freq", "adjust", *item.fields, "history_coverage", *[n for n in lines if n not in item.fields]]
    if one_per_day:
        return model.withColumn("from_end", from_end).filter(F.col("from_end") <= rows).select(*shown, "from_end")
    return last_rows(model.select(*shown), rows)


def window_summary(bars: DataFrame, *, rows: int) -> DataFrame:
    """Latest close, change, high and low of the last ``rows`` bars of each series, and whether there are more."""
    tail = last_rows(bars, rows + 1)
    inside = F.col("from_end") <= rows
    out = tail.groupBy(*SLICE).agg(
        F.max("datetime").alias("latest"), F.max(F.when(F.col("from_end") == 1, F.col("close"))).alias("close"),
        F.max(F.when((F.col("from_end") == 2) & inside, F.col("close"))).alias("previous_close"),
        F.max(F.when(inside, F.col("high"))).alias("window_high"), F.min(F.when(inside, F.col("low"))).alias("window_low"),
        (F.max("from_end") > rows).alias("has_more_before"), F.count(F.when(inside, 1)).alias("rows"),
    )
    return out.select("symbol", "latest", "close", "previous_close",
                      (F.col("close") / F.nullif("previous_close", F.lit(0.0)) - 1.0).alias("change"),
                      "window_high", "window_low", "has_more_before", "rows")
