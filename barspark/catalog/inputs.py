"""Bars and dated facts derived from the given tables, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import at_midnight
from ..operators.bars import refresh_pct_chg

# One symbol per price-limit board for each event type.
EVENT_SYMBOLS = {
    "view": "000001.SZ", "click": "300001.SZ", "signup": "688001.SH", "purchase": "830001.BJ", "error": "600000.SH",
}
UNIVERSE = tuple(sorted(EVENT_SYMBOLS.values()))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _naive(c):
    return F.col(c).cast("timestamp_ntz")


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for p in EVENT_SYMBOLS.items() for x in p])
    return table(spark, sf, "events").select(
        names[F.col("event_type")].alias("symbol"), _naive("ts").alias("ts"), "value", "user_id", "event_id"
    )


def _bars(ticks_: DataFrame, end) -> DataFrame:
    return (
        ticks_.groupBy("symbol", end.alias("datetime"))
        .agg(
            F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
            F.max_by("value", "ts").alias("close"), F.count("*").cast("double").alias("volume"),
            F.sum("value").alias("amount"),
        )
        .withColumns({"source": F.lit("events"), "freq": F.lit("5min"), "adjust": F.lit("none")})
    )


def bars_5min(spark: SparkSession, sf: str) -> DataFrame:
    end = at_midnight("ts") + F.make_dt_interval(
        F.lit(0), F.hour("ts"), (F.floor(F.minute("ts") / 5) + 1).cast("int") * 5, F.lit(0)
    )
    return _bars(ticks(spark, sf), end)


def bars_5min_pct(spark: SparkSession, sf: str) -> DataFrame:
    return refresh_pct_chg(bars_5min(spark, sf))


def session_bars(spark: SparkSession, sf: str) -> DataFrame:
    """5-minute bars of all events: the day's 48 half hours are laid onto the trading session's 48 bars, in order."""
    half_hour = F.hour("ts") * 2 + F.floor(F.minute("ts") / 30).cast("int")
    minute = half_hour * 5 + F.when(half_hour < 24, 575).otherwise(665)
    return _bars(ticks(spark, sf), at_midnight("ts") + F.make_dt_interval(F.lit(0), F.lit(0), minute, F.lit(0)))


def bars_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars of the 5-minute bars."""
    return (
        bars_5min(spark, sf)
        .groupBy("symbol", F.to_date("datetime").cast("timestamp_ntz").alias("d"))
        .agg(
            F.min_by("open", "datetime").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", "datetime").alias("close"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount"),
        )
        .withColumnRenamed("d", "datetime")
        .withColumns({"source": F.lit("events"), "freq": F.lit("daily"), "adjust": F.lit("none")})
    )


def bars_daily_long(spark: SparkSession, sf: str) -> DataFrame:
    """Long daily histories from line items: one symbol per supplier."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    position = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    # Most groups have one line: the lines are brought together first, so they are sorted once and not before the shuffle too.
    return (
        table(spark, sf, "lineitem")
        .select("*", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), at_midnight("l_shipdate").alias("datetime"))
        .repartition("symbol", "datetime")
        .groupBy("symbol", "datetime")
        .agg(
            F.min_by(price, position).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
            F.max_by(price, position).alias("close"), F.sum("l_quantity").alias("volume"),
            F.sum("l_extendedprice").alias("amount"),
        )
        .withColumns({"source": F.lit("lineitem"), "freq": F.lit("daily"), "adjust": F.lit("none")})
    )


def liquidity(spark: SparkSession, sf: str) -> DataFrame:
    return (
        bars_5min(spark, sf)
        .groupBy("symbol", F.to_date("datetime").alias("date"))
        .agg((F.sum("volume") / 100.0).alias("turn"))
        .withColumn("source", F.lit("events"))
    )


def status(spark: SparkSession, sf: str) -> DataFrame:
    day = F.dayofmonth("date")
    lead = F.substring("symbol", 1, 1).cast("int")
    return (
        bars_5min(spark, sf)
        .select("symbol", F.to_date("datetime").alias("date")).distinct()
        .filter(day % 13 != 0)
        .withColumns({"is_st": (day * 7 + lead) % 10 == 0, "source": F.lit("events")})
    )


def calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Every date the events span, trading on weekdays."""
    span = table(spark, sf, "events").agg(
        F.to_date(F.min(F.trunc(F.to_date("ts"), "month"))).alias("a"), F.last_day(F.max(F.to_date("ts"))).alias("b")
    )
    return span.select(F.explode(F.sequence("a", "b")).alias("date")).select(
        "date", (F.weekday("date") < 5).alias("is_trading_day"), F.lit("CN").alias("exchange"), F.lit("events").alias("source")
    )


def nav(spark: SparkSession, sf: str) -> DataFrame:
    """A daily net asset value per order priority."""
    daily = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("strategy"), F.to_date("o_orderdate").alias("date"))
        .agg(((F.avg("o_totalprice") / 250000.0 - 1.0) * 0.02).alias("r"))
    )
    from ..operators.series import running

    grown = running(daily, ["strategy"], ["date"], F.trunc("date", "year"), {"_g": ("sum", F.log1p("r"))})
    return grown.select("strategy", "date", (F.exp("_g") * 1e6).alias("nav"))


_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_SYMBOLS.items()) + " END"

# DuckDB form of the same inputs, as named common table expressions.
SQL = {
    "bars": f"""bars AS (
  SELECT symbol, datetime, min_by(value, ts) AS open, max(value) AS high, min(value) AS low,
         max_by(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume, sum(value) AS amount,
         'events' AS source, '5min' AS freq, 'none' AS adjust
  FROM (SELECT {_CASE} AS symbol, ts, value,
               date_trunc('hour', ts) + CAST(floor(minute(ts) / 5) + 1 AS INTEGER) * INTERVAL 5 MINUTE AS datetime
        FROM events) GROUP BY 1, 2)""",
    "session": f"""session AS (
  SELECT symbol, datetime, min_by(value, ts) AS open, max(value) AS high, min(value) AS low,
         max_by(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume, sum(value) AS amount,
         'events' AS source, '5min' AS freq, 'none' AS adjust
  FROM (SELECT symbol, ts, value, date_trunc('day', ts) + (slot * 5 + CASE WHEN slot < 24 THEN 575 ELSE 665 END) * INTERVAL 1 MINUTE AS datetime
        FROM (SELECT {_CASE} AS symbol, ts, value, CAST(hour(ts) * 2 + minute(ts) // 30 AS INTEGER) AS slot FROM events)) GROUP BY 1, 2)""",
    "daily": """daily AS (
  SELECT symbol, date_trunc('day', datetime)::TIMESTAMP AS datetime, min_by(open, bars.datetime) AS open, max(high) AS high,
         min(low) AS low, max_by(close, bars.datetime) AS close, sum(volume) AS volume, sum(amount) AS amount,
         'events' AS source, 'daily' AS freq, 'none' AS adjust
  FROM bars GROUP BY symbol, date_trunc('day', datetime)::TIMESTAMP)""",
    "long": """long AS (
  SELECT 'S' || l_suppkey AS symbol, date_trunc('day', l_shipdate)::TIMESTAMP AS datetime,
         min_by(l_extendedprice / l_quantity, pos) AS open, max(l_extendedprice / l_quantity) AS high,
         min(l_extendedprice / l_quantity) AS low, max_by(l_extendedprice / l_quantity, pos) AS close,
         sum(l_quantity) AS volume, sum(l_extendedprice) AS amount, 'lineitem' AS source, 'daily' AS freq, 'none' AS adjust
  FROM (SELECT *, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos FROM lineitem)
  GROUP BY 1, 2)""",
    "liquidity": """liquidity AS (
  SELECT symbol, CAST(datetime AS DATE) AS date, sum(volume) / 100.0 AS turn FROM bars GROUP BY 1, 2)""",
    "status": """status AS (
  SELECT symbol, date, (day(date) * 7 + CAST(symbol[1] AS INTEGER)) % 10 = 0 AS is_st
  FROM (SELECT DISTINCT symbol, CAST(datetime AS DATE) AS date FROM bars) WHERE day(date) % 13 <> 0)""",
    "calendar": """calendar AS (
  SELECT CAST(d AS DATE) AS date, isodow(d) < 6 AS is_trading_day, 'CN' AS exchange
  FROM (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS d FROM (
    SELECT date_trunc('month', min(ts))::TIMESTAMP AS a, last_day(max(ts))::TIMESTAMP AS b FROM events)))""",
    "nav": """nav AS (
  SELECT strategy, date, 1e6 * exp(sum(ln(1 + r)) OVER (PARTITION BY strategy ORDER BY date)) AS nav
  FROM (SELECT o_orderpriority AS strategy, CAST(o_orderdate AS DATE) AS date,
               (avg(o_totalprice) / 250000.0 - 1) * 0.02 AS r FROM orders GROUP BY 1, 2))""",
}
_NEEDS = {"daily": ["bars"], "liquidity": ["bars"], "status": ["bars"]}


def with_inputs(*names: str, body: str) -> str:
    """SQL text with the named inputs in front of ``body`` (which may go on with more CTEs)."""
    order: list[str] = []
    for name in names:
        for n in [*_NEEDS.get(name, []), name]:
            if n not in order:
                order.append(n)
    ctes = ",\n".join(SQL[n] for n in order)
    body = body.strip()
    return f"WITH {ctes}{',' if body.startswith(',') else ''}\n{body.lstrip(',')}"
