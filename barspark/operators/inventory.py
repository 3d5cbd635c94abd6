"""Counts, ranges and fingerprints of stored slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_bad_number, month_start, period_start, week_start
from ..schema import MINUTES, SLICE
from .series import time_chunk

HASHED = ("datetime", "open", "high", "low", "close", "volume", "amount")


def _range() -> list[Column]:
    return [F.count("*").alias("rows"), F.min("datetime").alias("first_datetime"), F.max("datetime").alias("last_datetime")]


def inventory(bars: DataFrame) -> DataFrame:
    return bars.groupBy(*SLICE, "source").agg(*_range())


def coverage(bars: DataFrame, symbol: str, freq: str, adjust: str) -> DataFrame:
    hit = bars.filter((F.col("symbol") == symbol) & (F.col("freq") == freq) & (F.col("adjust") == adjust))
    return hit.agg(*_range()).select(F.lit(symbol).alias("symbol"), F.lit(freq).alias("freq"), F.lit(adjust).alias("adjust"),
                                     "rows", "first_datetime", "last_datetime")


def slice_coverage(bars: DataFrame) -> DataFrame:
    return bars.groupBy(*SLICE).agg(*_range())


def inventory_rollup(bars: DataFrame) -> DataFrame:
    """Rows per symbol, rows and symbols per frequency, grand totals; the bars are read once."""
    cells = bars.groupBy("symbol", "freq").agg(F.count("*").alias("n"))
    daily = F.sum(F.when(F.col("freq") == "daily", F.col("n")).otherwise(0))
    grouped = cells.groupingSets([["symbol"], ["freq"], []], "symbol", "freq").agg(
        F.grouping_id().alias("_g"), F.sum("n").alias("rows"), daily.alias("daily_rows"),
        F.count_distinct("symbol").alias("symbols"),
    )
    level = F.when(F.col("_g") == 1, "symbol").when(F.col("_g") == 2, "freq").otherwise("total")
    return grouped.select(
        level.alias("level"), F.coalesce("symbol", "freq", F.lit("")).alias("name"), "rows", "daily_rows",
        F.when(F.col("_g") == 1, F.lit(1)).otherwise(F.col("symbols")).cast("bigint").alias("symbols"),
    )


def fingerprint() -> Column:
    """Order-insensitive hash of the bars in a group; pair it with the row count."""
    return F.bit_xor(F.xxhash64(*[F.col(c) for c in HASHED]))


def slice_catalog(bars: DataFrame, keys: Sequence[str] = SLICE) -> DataFrame:
    return bars.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.min("datetime").alias("start_datetime"), F.max("datetime").alias("end_datetime"),
        fingerprint().alias("data_hash"),
    )


def target_stats(bars: DataFrame, source: str) -> DataFrame:
    return bars.filter(F.col("source") == source).groupBy(*SLICE).agg(*_range())


def prefix_fingerprint(bars: DataFrame, manifest: DataFrame) -> DataFrame:
    """Count, last time and hash of each slice's rows up to the manifest's ``base_end``."""
    kept = bars.join(manifest, list(SLICE)).filter(F.col("datetime") <= F.col("base_end"))
    extra = [c for c in ("base_rows", "base_hash") if c in manifest.columns]
    return kept.groupBy(*SLICE, "base_end", *extra).agg(
        F.count("*").alias("rows"), F.max("datetime").alias("last_datetime"), fingerprint().alias("data_hash")
    )


def expected_target_coverage(bars: DataFrame, target: str, base: str) -> DataFrame:
    """What the target slice should hold, counted without building bars."""
    if target in MINUTES:
        from .bars import bar_ordinal

        k = MINUTES[target] // MINUTES[base]
        slots = bar_ordinal(bars, "_o").withColumns({"_p": F.to_date("datetime"), "_b": F.floor(F.col("_o") / k)})
    else:
        slots = bars.withColumns({"_p": period_start("datetime", target), "_b": F.lit(0)})
    periods = slots.groupBy("symbol", "adjust", "_p", "_b").agg(F.max("datetime").alias("datetime"))
    return periods.groupBy("symbol", "adjust").agg(*_range())


def bars_available(base: DataFrame, daily: DataFrame, *, before: str | None = None, trade_freq: str = "5min") -> DataFrame:
    """Bars per symbol and frequency, from session sizes and distinct weeks and months only."""
    if before is not None:
        cut = F.col("datetime") < F.lit(before).cast("timestamp_ntz")
        base, daily = base.filter(cut), daily.filter(cut)
    size = base.groupBy("symbol", "adjust", F.to_date("datetime").alias("d")).agg(F.count("*").alias("n"))
    steps = {f: m // MINUTES[trade_freq] for f, m in MINUTES.items() if m >= MINUTES[trade_freq]}
    short = size.groupBy("symbol").agg(*[F.sum(F.ceil(F.col("n") / k)).alias(f) for f, k in steps.items()])
    long = daily.groupBy("symbol").agg(
        F.count("*").alias("daily"), F.count_distinct(week_start("datetime")).alias("weekly"),
        F.count_distinct(month_start("datetime")).alias("monthly"),
    )
    def tall(df, names):
        return df.unpivot(["symbol"], list(names), "freq", "bars")

    return tall(short, steps).unionByName(tall(long, ("daily", "weekly", "monthly")))


def status_per_day(status: DataFrame) -> DataFrame:
    return status.groupBy(F.upper("symbol").alias("symbol"), F.to_date("date").alias("date")).agg(F.bool_or("is_st").alias("is_st"))


def bad_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, NULLs and non-finite values per column, from one pass."""
    def count(c):
        return F.coalesce(F.sum(c.cast("bigint")), F.lit(0))

    one = df.agg(F.count("*").alias("rows"), *[
        F.struct(count(F.col(c).isNull()).alias("nulls"),
                 count(F.coalesce(is_bad_number(c) & F.col(c).isNotNull(), F.lit(False))).alias("non_finite")).alias(f"_{c}")
        for c in columns
    ])
    tall = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{c}").alias("v")) for c in columns]))
    return one.select("rows", tall.alias("t")).select(
        F.col("t.column").alias("column"), "rows", F.col("t.v.nulls").alias("nulls"), F.col("t.v.non_finite").alias("non_finite")
    )


def canonical_text() -> Column:
    """A bar as text with 12 significant digits, NULL and NaN as 0."""
    numbers = [F.format_string("%.11e", F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))) for c in HASHED[1:]]
    return F.concat_ws(",", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss.SSSSSS"), *numbers)


def canonical_hash(bars: DataFrame) -> DataFrame:
    """Order-free sha256 of each slice, as a tree over time: of each time chunk's sorted rows (a day or a year), of a year's chunks, of 64 years, of those.

    Every node has a bounded number of children (a few hundred bars, 366 days, 64 years, 157 of these up to the year 9999), however long the slice is.
    """
    nodes = bars.groupBy(*SLICE, time_chunk().alias("_at")).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list(canonical_text())), "\n"), 256).alias("_h"), F.count("*").alias("n")
    )
    for level in (F.year("_at"), F.floor(F.col("_at") / 64), F.lit(0)):
        children = F.transform(F.sort_array(F.collect_list(F.struct("_at", "_h"))), lambda x: x["_h"])
        nodes = nodes.groupBy(*SLICE, level.alias("_up")).agg(F.sha2(F.array_join(children, "\n"), 256).alias("_h"), F.sum("n").alias("n")).withColumnRenamed("_up", "_at")
    return nodes.select(*SLICE, F.col("n").alias("rows"), F.col("_h").alias("sha256"))


def dataset_estimate(base: DataFrame, daily: DataFrame, windows: dict[str, int], *, bytes_per_row: int = 8 * 40) -> DataFrame:
    """Decisions, stored rows, rows if every sequence were expanded, index rows and megabytes."""
    sessions = base.groupBy("symbol", "adjust", F.to_date("datetime").alias("d")).agg(F.count("*").alias("n"))
    decisions = sessions.agg(F.sum(F.col("n") + 1).alias("decisions"))
    stored = bars_available(base, daily).filter(F.col("freq").isin(*windows)).agg(F.sum("bars").alias("unique_rows"))
    return decisions.crossJoin(stored).select(  # two one-row tables
        "decisions", "unique_rows", (F.col("decisions") * sum(windows.values())).alias("expanded_rows"),
        (F.col("decisions") * len(windows)).alias("index_rows"),
        (F.col("unique_rows") * bytes_per_row / 1048576.0).alias("megabytes"),
    )
