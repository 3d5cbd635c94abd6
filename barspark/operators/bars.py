"""Higher-frequency bars from base bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import period_start, range_filter, safe_div, usable
from ..schema import INTRADAY, MINUTES, ROWS_FROM_5MIN, ROWS_FROM_DAILY
from .series import running, time_chunk

AGGREGATED_COLUMNS = (
    "symbol", "freq", "adjust", "bar_start", "bar_end", "available_at", "source_start", "source_end",
    "source_rows", "expected_source_rows", "is_partial", "progress",
    "open", "high", "low", "close", "volume", "amount", "pctChg",
)
STORED_PAIRS = {("5min", "15min"), ("30min", "60min"), ("daily", "weekly"), ("daily", "monthly")}


def ohlcv(ts: str = "datetime") -> list[Column]:
    def known(name):
        return F.when(F.col(name).isNotNull(), F.col(ts))

    return [
        F.min_by("open", known("open")).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", known("close")).alias("close"),
        F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("amount"),
    ]


def bar_ordinal(bars: DataFrame, out: str = "bar_ordinal", *, keys=("symbol", "adjust")) -> DataFrame:
    """0-based position of each bar in its day; a day bounds the group."""
    w = Window.partitionBy(*keys, F.to_date("datetime")).orderBy("datetime")
    return bars.withColumn(out, F.row_number().over(w) - 1)


def refresh_pct_chg(bars: DataFrame, *, ts: str = "datetime", keys=("symbol", "freq", "adjust"), one_per_day: bool = False) -> DataFrame:
    """Close over the previous close of the slice minus one; without one, close over open minus one.

    ``one_per_day`` says that no slice has more than one bar a day, so that a slice is short enough for one window.
    """
    if one_per_day:
        previous = F.lag("close").over(Window.partitionBy(*keys).orderBy(ts))
        with_previous = bars.drop("pctChg").withColumn("_previous", previous)
    else:
        with_previous = running(
            bars.drop("pctChg"), keys, [ts], time_chunk(ts), {"_previous": ("last", "close")}, exclusive=True
        )
    change = safe_div("close", usable("_previous", "open")) - 1.0
    return with_previous.withColumn("pctChg", change).drop("_previous")


def visible(bars: DataFrame, decision_time=None) -> DataFrame:
    """Bars completed at a moment, given as text."""
    return bars if decision_time is None else bars.filter(range_filter("datetime", None, decision_time))


def aggregate_bars(bars: DataFrame, target: str, base: str = "5min", *, decision_time: str | None = None) -> DataFrame:
    """Bars of ``target`` frequency with their source range, completeness and pctChg.

    Intraday buckets go by position in the day, not by clock, so a missing bar moves later
    ones forward. Weeks start on Monday.
    """
    expected_by_base = ROWS_FROM_5MIN if base in INTRADAY else ROWS_FROM_DAILY
    if target not in expected_by_base:
        raise ValueError(f"{target} cannot be built from {base}")
    source = visible(bars, decision_time)
    if target == base:
        shaped = source.select(
            "symbol", "adjust", F.col("datetime").alias("bar_start"), F.col("datetime").alias("bar_end"),
            *[F.col(c) for c in ("open", "high", "low", "close", "volume", "amount")],
            F.lit(1).cast("bigint").alias("source_rows"), F.lit(1).alias("expected_source_rows"),
        )
    else:
        if target in INTRADAY:
            step, rest = divmod(MINUTES[target], MINUTES.get(base, 10**6))
            if step == 0 or rest:
                raise ValueError(f"{target} cannot be built from {base}")
            bucket = [F.to_date("datetime").alias("_day"), F.floor(F.col("_ordinal") / step).alias("_bucket")]
            expected, source = step, bar_ordinal(source, "_ordinal")
        else:
            bucket, expected = [period_start("datetime", target).alias("_bucket")], expected_by_base[target]
        shaped = source.groupBy("symbol", "adjust", *bucket).agg(
            F.min("datetime").alias("bar_start"), F.max("datetime").alias("bar_end"), *ohlcv(),
            F.count("datetime").alias("source_rows"),
        ).withColumn("expected_source_rows", F.lit(expected))
    full = shaped.withColumns({
        "freq": F.lit(target),
        "available_at": F.col("bar_end"),
        "source_start": F.col("bar_start"),
        "source_end": F.col("bar_end"),
        "is_partial": F.col("source_rows") < F.col("expected_source_rows"),
        "progress": F.least(F.col("source_rows") / F.col("expected_source_rows"), F.lit(1.0)),
    })
    return refresh_pct_chg(full, ts="bar_end", one_per_day=target not in INTRADAY and target != base).select(*AGGREGATED_COLUMNS)


def stored_bars(bars: DataFrame, target: str, base: str, *, source: str | None = None,
                start: str | None = None, end: str | None = None) -> DataFrame:
    """Derived bars in the storage shape, tagged with where they come from; only the stored pairs are allowed."""
    if (base, target) not in STORED_PAIRS:
        raise ValueError(f"{base} -> {target} is not a stored pair")
    out = aggregate_bars(bars, target, base).select(
        "symbol", F.col("bar_end").alias("datetime"), "open", "high", "low", "close", "volume", "amount",
        F.coalesce("pctChg", F.lit(0.0)).alias("pctChg"), F.lit(source or f"derived_from_{base}").alias("source"), "freq", "adjust",
    )
    return out.filter(range_filter("datetime", start, end))


def as_market_bars(aggregated: DataFrame) -> DataFrame:
    """Aggregated bars in the shape the feature step reads."""
    return aggregated.select(
        "symbol", F.col("bar_end").alias("datetime"), "freq", "adjust", "open", "high", "low", "close",
        "volume", "amount", "pctChg", F.lit(None).cast("double").alias("turn"), "progress",
    )


def bars_per_session(freq: str) -> int:
    return ROWS_FROM_5MIN["daily"] // ROWS_FROM_5MIN[freq]


