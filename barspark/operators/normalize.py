"""Raw provider rows to the stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clean_symbol, from_provider_symbol, to_provider_symbol, truthy
from ..schema import NUMERIC_COLUMNS

# Provider column names and ours.
BAR_RENAMES = {"code": "symbol", "pctchg": "pctChg", "pct_chg": "pctChg"}
CALENDAR_RENAMES = {"calendar_date": "date", "trade_date": "date", "is_open": "is_trading_day"}
FACT_RENAMES = {"code": "symbol", "trade_date": "date", "isST": "is_st"}
BAR_COLUMNS = ("symbol", "datetime", *NUMERIC_COLUMNS, "source", "freq", "adjust")


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Provider names to ours, where ours is not there already."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns and b not in df.columns})


def keep_last(df: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """The row with the highest ``sequence`` per key, as a partial aggregate rather than a sort."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(sequence)).alias("_r"))
        .select(*[F.col(k) if k in keys else F.col(f"_r.{k}").alias(k) for k in df.columns])
    )


def number(c: str) -> Column:
    value = F.trim(F.col(c).cast("string")).try_cast("double")
    return F.when(~F.isnan(value), value)


def build_datetime(df: DataFrame) -> Column:
    """From a 12-digit or longer ``time``, else ``datetime`` or ``date`` alone, else date and time together."""
    have = set(df.columns)
    base = F.col("datetime") if "datetime" in have else F.col("date") if "date" in have else F.lit(None)
    plain = base.cast("string").try_cast("timestamp_ntz")
    if "time" not in have:
        return plain
    time = F.trim(F.col("time").cast("string"))
    digits = F.when(
        time.rlike(r"^\d{12}"),
        F.concat(F.substring(time, 1, 4), F.lit("-"), F.substring(time, 5, 2), F.lit("-"), F.substring(time, 7, 2), F.lit(" "),
                 F.substring(time, 9, 2), F.lit(":"), F.substring(time, 11, 2), F.lit(":00")).try_cast("timestamp_ntz"),
    )
    both = F.lit(None).cast("timestamp_ntz")
    if "date" in have:
        clock = F.when(time.rlike(r"^\d{4}$"), F.concat_ws(":", F.substring(time, 1, 2), F.substring(time, 3, 2))).otherwise(time)
        both = F.concat_ws(" ", F.trim(F.col("date").cast("string")), clock).try_cast("timestamp_ntz")
    long_text = F.length(time) >= 12
    return F.when(long_text, F.coalesce(digits, both)).otherwise(F.coalesce(plain, both))


def normalize_bars(df: DataFrame, *, source: str, freq: str, adjust: str, symbol: str | None = None) -> DataFrame:
    """Bar rows of one frequency and adjustment; rows without a time or close are dropped."""
    raw = rename(df, BAR_RENAMES)
    when = build_datetime(raw)
    have = set(raw.columns)

    def numeric(name: str) -> Column:
        value = number(name) if name in have else F.lit(None).cast("double")
        return F.coalesce(value, F.lit(0.0)) if name == "volume" else value

    name = F.lit(symbol) if symbol is not None else F.col("symbol") if "symbol" in have else F.lit(None)
    extra = [c for c in raw.columns if c not in (*BAR_COLUMNS, "date", "time")]
    return raw.select(
        name.cast("string").alias("symbol"), when.alias("datetime"), *[numeric(c).alias(c) for c in NUMERIC_COLUMNS],
        F.lit(source).alias("source"), F.lit(freq).alias("freq"), F.lit(adjust).alias("adjust"), *extra,
    ).filter("datetime IS NOT NULL AND close IS NOT NULL")


def storage_bars(df: DataFrame) -> DataFrame:
    """Form used before writing: canonical symbol, complete key, defaults for the text columns."""
    defaults = {"source": "unknown", "freq": "daily", "adjust": "none"}
    have = set(df.columns)
    return df.withColumns({
        "symbol": clean_symbol("symbol"), "volume": F.coalesce("volume", F.lit(0.0)),
        **{c: F.coalesce(c, F.lit(v)) if c in have else F.lit(v) for c, v in defaults.items()},
    }).filter("symbol <> '' AND datetime IS NOT NULL AND close IS NOT NULL")


def normalize_calendar(df: DataFrame, *, source: str, exchange: str = "CN", sequence: str) -> DataFrame:
    raw = rename(df, CALENDAR_RENAMES)
    rows = raw.select(
        F.col("date").cast("string").try_cast("date").alias("date"), truthy("is_trading_day").alias("is_trading_day"),
        F.lit(exchange).alias("exchange"), F.lit(source).alias("source"), F.col(sequence).alias("_seq"),
    ).filter("date IS NOT NULL")
    return keep_last(rows, ["exchange", "date"], "_seq").drop("_seq")


def _fact(df: DataFrame, value: str, parse, source: str, sequence: str, required: bool) -> DataFrame:
    raw = rename(df, FACT_RENAMES)
    rows = raw.select(
        clean_symbol("symbol").alias("symbol"), F.col("date").cast("string").try_cast("date").alias("date"),
        parse.alias(value), F.lit(source).alias("source"), F.col(sequence).alias("_seq"),
    ).filter("symbol IS NOT NULL AND date IS NOT NULL")
    if required:
        rows = rows.filter(F.col(value).isNotNull())
    return keep_last(rows, ["symbol", "date"], "_seq").drop("_seq")


def normalize_liquidity(df: DataFrame, *, source: str, sequence: str) -> DataFrame:
    return _fact(df, "turn", number("turn"), source, sequence, required=False)


def normalize_status(df: DataFrame, *, source: str, sequence: str) -> DataFrame:
    name = "isST" if "isST" in df.columns else "is_st"
    flag = number("is_st").cast("int") != 0
    return _fact(df.withColumnRenamed(name, "is_st"), "is_st", flag, source, sequence, required=True)


def symbol_codes(df: DataFrame, column: str = "symbol") -> DataFrame:
    """Both symbol forms; ``symbol_error`` marks codes that have no provider form."""
    provider = to_provider_symbol(column)
    return df.withColumns({
        "provider_symbol": provider, "internal_symbol": from_provider_symbol(F.coalesce(provider, F.col(column))),
        "symbol_error": provider.isNull(),
    })


def trading_dates(calendar: DataFrame) -> DataFrame:
    return calendar.filter(truthy("is_trading_day")).select(F.to_date("date").alias("date")).distinct()


def daily_display(daily: DataFrame, liquidity: DataFrame, status: DataFrame) -> DataFrame:
    """Daily bars with turnover and status for display."""
    day = daily.withColumn("date", F.to_date("datetime"))
    return day.join(liquidity.select("symbol", "date", "turn"), ["symbol", "date"], "left").join(
        status.select("symbol", "date", "is_st"), ["symbol", "date"], "left"
    )


def split_facts(response: DataFrame, *, source: str, sequence: str) -> tuple[DataFrame, DataFrame]:
    """Turnover and status tables out of one provider response with both columns."""
    return (
        normalize_liquidity(response, source=source, sequence=sequence),
        normalize_status(response, source=source, sequence=sequence),
    )


def turnover_with_status(liquidity: DataFrame, status: DataFrame) -> DataFrame:
    return liquidity.select("symbol", "date", "turn").join(status.select("symbol", "date", "is_st"), ["symbol", "date"], "left")
