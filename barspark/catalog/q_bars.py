"""Bar building and aggregation."""

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import inventory as V
from . import inputs as I
from .inputs import with_inputs
from .registry import query, rounded

# One bucket column per target, for the DuckDB side.
_META = """min(datetime) AS bar_start, max(datetime) AS bar_end, min_by(open, src.datetime) AS open, max(high) AS high,
  min(low) AS low, max_by(close, src.datetime) AS close, sum(volume) AS volume, sum(amount) AS amount, count(*) AS source_rows"""


def _agg_sql(inputs, source, freq, bucket, expected):
    return with_inputs(*inputs, body=f"""
, src AS (SELECT *, {bucket} FROM {source}),
agg AS (SELECT symbol, adjust, {_META} FROM src GROUP BY symbol, adjust, b1, b2),
prev AS (SELECT *, lag(close) OVER (PARTITION BY symbol, adjust ORDER BY bar_end) AS pc FROM agg)
SELECT symbol, '{freq}' AS freq, adjust, bar_start, bar_end, bar_end AS available_at, bar_start AS source_start,
  bar_end AS source_end, source_rows, CAST({expected} AS BIGINT) AS expected_source_rows,
  source_rows < {expected} AS is_partial, round(least(source_rows / {expected}.0, 1.0), 8) AS progress,
  round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close,
  round(volume, 8) AS volume, round(amount, 8) AS amount,
  round(close / coalesce(nullif(pc, 0), nullif(open, 0)) - 1, 8) + 0.0 AS pctChg FROM prev""")


def _ordinal(k):
    return (f"date_trunc('day', datetime) AS b1, (row_number() OVER (PARTITION BY symbol, adjust, date_trunc('day', datetime) "
            f"ORDER BY datetime) - 1) // {k} AS b2")


for _freq, _k in (("15min", 3), ("30min", 6), ("60min", 12)):
    @query(f"bars_{_freq}", "C1 C6", _agg_sql(["bars"], "bars", _freq, _ordinal(_k), _k))
    def _(spark, sf, freq=_freq):
        return rounded(B.aggregate_bars(I.bars_5min(spark, sf), freq), 8)

for _freq, _unit, _n in (("daily", "day", 48), ("weekly", "week", 240), ("monthly", "month", 1008)):
    @query(f"bars_{_freq}", {"daily": "C2", "weekly": "C3", "monthly": "C4"}[_freq] + " C6",
           _agg_sql(["bars"], "bars", _freq, f"date_trunc('{_unit}', datetime) AS b1, 0 AS b2", _n))
    def _(spark, sf, freq=_freq):
        return rounded(B.aggregate_bars(I.bars_5min(spark, sf), freq), 8)

for _freq, _unit, _n in (("weekly", "week", 5), ("monthly", "month", 21)):
    @query(f"bars_{_freq}_from_daily", "C3 C4 C6",
           _agg_sql(["long"], "long", _freq, f"date_trunc('{_unit}', datetime) AS b1, 0 AS b2", _n))
    def _(spark, sf, freq=_freq):
        return rounded(B.aggregate_bars(I.bars_daily_long(spark, sf), freq, "daily"), 8)


@query("bars_same_frequency", "C5 C6", with_inputs("bars", body="""
, prev AS (SELECT *, lag(close) OVER (PARTITION BY symbol, adjust ORDER BY datetime) AS pc FROM bars)
SELECT symbol, freq, adjust, datetime AS bar_start, datetime AS bar_end, datetime AS available_at, datetime AS source_start,
  datetime AS source_end, CAST(1 AS BIGINT) AS source_rows, CAST(1 AS BIGINT) AS expected_source_rows, false AS is_partial,
  1.0::DOUBLE AS progress, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close,
  round(volume, 8) AS volume, round(amount, 8) AS amount,
  round(close / coalesce(nullif(pc, 0), nullif(open, 0)) - 1, 8) + 0.0 AS pctChg FROM prev"""))
def _(spark, sf):
    return rounded(B.aggregate_bars(I.bars_5min(spark, sf), "5min"), 8)


@query("bars_visible_at_moment", "B13 C1", _agg_sql(
    ["bars"], "(SELECT * FROM bars WHERE datetime <= TIMESTAMP '2024-01-17 13:20:00')", "60min", _ordinal(12), 12))
def _(spark, sf):
    return rounded(B.aggregate_bars(I.bars_5min(spark, sf), "60min", decision_time="2024-01-17 13:20:00"), 8)


def _stored_sql(inputs, source, base, target, bucket, where=""):
    return with_inputs(*inputs, body=f"""
, src AS (SELECT *, {bucket} FROM {source}),
agg AS (SELECT symbol, adjust, {_META} FROM src GROUP BY symbol, adjust, b1, b2),
prev AS (SELECT *, lag(close) OVER (PARTITION BY symbol, adjust ORDER BY bar_end) AS pc FROM agg)
SELECT symbol, bar_end AS datetime, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low,
  round(close, 8) AS close, round(volume, 8) AS volume, round(amount, 8) AS amount,
  round(coalesce(close / coalesce(nullif(pc, 0), nullif(open, 0)) - 1, 0), 8) + 0.0 AS pctChg,
  'derived_from_{base}' AS source, '{target}' AS freq, adjust FROM prev {where}""")


@query("stored_bars_15min", "C7", _stored_sql(["bars"], "bars", "5min", "15min", _ordinal(3)))
def _(spark, sf):
    return rounded(B.stored_bars(I.bars_5min(spark, sf), "15min", "5min"), 8)


@query("stored_bars_weekly_range", "C7 C8 B10", _stored_sql(
    ["long"], "long", "daily", "weekly", "date_trunc('week', datetime) AS b1, 0 AS b2",
    "WHERE bar_end >= TIMESTAMP '1995-03-01' AND bar_end < TIMESTAMP '1996-07-01'"))
def _(spark, sf):
    return rounded(B.stored_bars(I.bars_daily_long(spark, sf), "weekly", "daily", start="1995-03-01", end="1996-06-30"), 8)


@query("bar_ordinal_in_day", "D16", with_inputs("bars", body="""
SELECT symbol, datetime, row_number() OVER (PARTITION BY symbol, adjust, date_trunc('day', datetime) ORDER BY datetime) - 1
  AS bar_ordinal FROM bars"""))
def _(spark, sf):
    return rounded(B.bar_ordinal(I.bars_5min(spark, sf)).select("symbol", "datetime", "bar_ordinal"), 8)


@query("pct_chg_refresh", "D1", with_inputs("bars", body="""
SELECT symbol, datetime, round(close / coalesce(nullif(lag(close) OVER (PARTITION BY symbol, freq, adjust ORDER BY datetime), 0),
  nullif(open, 0)) - 1, 8) + 0.0 AS pctChg FROM bars"""))
def _(spark, sf):
    return rounded(I.bars_5min_pct(spark, sf).select("symbol", "datetime", "pctChg"), 8)


# ---- inventory ---------------------------------------------------------------
_BOTH = ", all_bars AS (SELECT * FROM bars UNION ALL SELECT * FROM daily UNION ALL SELECT * FROM long)"


def _all(spark, sf):
    return I.bars_5min(spark, sf).unionByName(I.bars_daily(spark, sf)).unionByName(I.bars_daily_long(spark, sf))


@query("inventory_per_slice", "C9", with_inputs("bars", "daily", "long", body=_BOTH + """
SELECT symbol, freq, adjust, source, count(*) AS rows, min(datetime) AS first_datetime, max(datetime) AS last_datetime
FROM all_bars GROUP BY ALL"""))
def _(spark, sf):
    return rounded(V.inventory(_all(spark, sf)))


@query("coverage_of_slice", "C10", with_inputs("bars", body="""
SELECT '688001.SH' AS symbol, '5min' AS freq, 'none' AS adjust, count(*) AS rows, min(datetime) AS first_datetime,
  max(datetime) AS last_datetime FROM bars WHERE symbol = '688001.SH'"""))
def _(spark, sf):
    return rounded(V.coverage(I.bars_5min(spark, sf), "688001.SH", "5min", "none"))


@query("inventory_rollup", "C11", with_inputs("bars", "daily", "long", body=_BOTH + """
SELECT 'symbol' AS level, symbol AS name, count(*) AS rows, count(*) FILTER (freq = 'daily') AS daily_rows,
  CAST(1 AS BIGINT) AS symbols FROM all_bars GROUP BY symbol
UNION ALL SELECT 'freq', freq, count(*), count(*) FILTER (freq = 'daily'), count(DISTINCT symbol) FROM all_bars GROUP BY freq
UNION ALL SELECT 'total', '', count(*), count(*) FILTER (freq = 'daily'), count(DISTINCT symbol) FROM all_bars"""))
def _(spark, sf):
    return rounded(V.inventory_rollup(_all(spark, sf)))


_PERTURBED = """, changed AS (SELECT * REPLACE (CASE WHEN symbol = '600000.SH' AND datetime = (SELECT min(datetime) FROM bars
  WHERE symbol = '600000.SH') THEN close + 1 ELSE close END AS close) FROM bars)"""


@query("fingerprint_equality", "C12 C13", with_inputs("bars", body="""
SELECT symbol, count(*) AS rows, min(datetime) AS first_datetime, max(datetime) AS last_datetime,
  symbol <> '600000.SH' AS same_hash FROM bars GROUP BY symbol"""))
def _(spark, sf):
    """Fingerprints of the bars and of the same bars with one close changed in one slice."""
    bars = I.bars_5min(spark, sf)
    first = bars.filter("symbol = '600000.SH'").agg(F.min("datetime").alias("_first"))
    edge = bars.join(first, bars["datetime"] == first["_first"], "left").withColumn(
        "close", F.when((F.col("symbol") == "600000.SH") & F.col("_first").isNotNull(), F.col("close") + 1).otherwise(F.col("close")))
    a, b = V.slice_catalog(bars), V.slice_catalog(edge).select("symbol", F.col("data_hash").alias("other"))
    return rounded(a.join(b, "symbol").select("symbol", "rows", F.col("start_datetime").alias("first_datetime"),
                                              F.col("end_datetime").alias("last_datetime"), (F.col("data_hash") == F.col("other")).alias("same_hash")))


@query("canonical_hash_equality", "C14", with_inputs("bars", body="""
SELECT symbol, true AS order_free, symbol <> '600000.SH' AS same_after_change, CAST(64 AS BIGINT) AS digits FROM bars GROUP BY symbol"""))
def _(spark, sf):
    bars = I.bars_5min(spark, sf)
    shuffled = bars.repartition(5, "close")
    changed = bars.withColumn("volume", F.when(F.col("symbol") == "600000.SH", F.col("volume") + 1).otherwise(F.col("volume")))
    hashes = [V.canonical_hash(d).select("symbol", F.col("sha256").alias(f"h{i}")) for i, d in enumerate((bars, shuffled, changed))]
    return rounded(hashes[0].join(hashes[1], "symbol").join(hashes[2], "symbol").select(
        "symbol", (F.col("h0") == F.col("h1")).alias("order_free"), (F.col("h0") == F.col("h2")).alias("same_after_change"),
        F.length("h0").alias("digits")))


@query("target_stats_by_source", "C15", with_inputs("bars", "daily", "long", body=_BOTH + """
SELECT symbol, freq, adjust, count(*) AS rows, min(datetime) AS first_datetime, max(datetime) AS last_datetime
FROM all_bars WHERE source = 'lineitem' GROUP BY ALL"""))
def _(spark, sf):
    return rounded(V.target_stats(_all(spark, sf), "lineitem"))


@query("prefix_fingerprint", "C16", with_inputs("bars", body="""
SELECT symbol, count(*) FILTER (datetime <= TIMESTAMP '2024-01-20') AS rows, max(datetime) FILTER (datetime <= TIMESTAMP '2024-01-20')
  AS last_datetime, true AS unchanged FROM bars GROUP BY symbol"""))
def _(spark, sf):
    """The prefix of the full bars has the fingerprint recorded when only the prefix was there."""
    bars = I.bars_5min(spark, sf)
    early = bars.filter(F.col("datetime") <= F.lit("2024-01-20").cast("timestamp_ntz"))
    manifest = V.slice_catalog(early).select("symbol", "freq", "adjust", F.col("end_datetime").alias("base_end"),
                                             F.col("rows").alias("base_rows"), F.col("data_hash").alias("base_hash"))
    return rounded(V.prefix_fingerprint(bars, manifest).select(
        "symbol", "rows", "last_datetime", ((F.col("data_hash") == F.col("base_hash")) & (F.col("rows") == F.col("base_rows"))).alias("unchanged")))


@query("expected_target_coverage", "C17", with_inputs("bars", body="""
, slots AS (SELECT symbol, adjust, datetime, date_trunc('day', datetime) AS d, (row_number() OVER (PARTITION BY symbol, adjust,
  date_trunc('day', datetime) ORDER BY datetime) - 1) // 3 AS b FROM bars),
periods AS (SELECT symbol, adjust, d, b, max(datetime) AS bar_end FROM slots GROUP BY ALL)
SELECT symbol, adjust, count(*) AS rows, min(bar_end) AS first_datetime, max(bar_end) AS last_datetime FROM periods GROUP BY ALL"""))
def _(spark, sf):
    return rounded(V.expected_target_coverage(I.bars_5min(spark, sf), "15min", "5min"))


@query("bars_available_per_frequency", "C18", with_inputs("bars", "daily", body="""
, s AS (SELECT symbol, adjust, date_trunc('day', datetime) AS d, count(*) AS n FROM bars GROUP BY ALL)
SELECT symbol, '5min' AS freq, CAST(sum(n) AS BIGINT) AS bars FROM s GROUP BY symbol
UNION ALL SELECT symbol, '15min', CAST(sum((n + 2) // 3) AS BIGINT) FROM s GROUP BY symbol
UNION ALL SELECT symbol, '30min', CAST(sum((n + 5) // 6) AS BIGINT) FROM s GROUP BY symbol
UNION ALL SELECT symbol, '60min', CAST(sum((n + 11) // 12) AS BIGINT) FROM s GROUP BY symbol
UNION ALL SELECT symbol, 'daily', count(*) FROM daily GROUP BY symbol
UNION ALL SELECT symbol, 'weekly', count(DISTINCT date_trunc('week', datetime)) FROM daily GROUP BY symbol
UNION ALL SELECT symbol, 'monthly', count(DISTINCT date_trunc('month', datetime)) FROM daily GROUP BY symbol"""))
def _(spark, sf):
    return rounded(V.bars_available(I.bars_5min(spark, sf), I.bars_daily(spark, sf)))


@query("special_status_per_day", "C19", with_inputs("status", body="""
SELECT symbol, date::TIMESTAMP AS date, bool_or(is_st) AS is_st FROM status GROUP BY symbol, date"""))
def _(spark, sf):
    return rounded(V.status_per_day(I.status(spark, sf)))


@query("bad_number_counts", "C20 J7", with_inputs("bars", body="""
SELECT 'open' AS "column", count(*) AS rows, CAST(0 AS BIGINT) AS nulls, CAST(0 AS BIGINT) AS non_finite FROM bars
UNION ALL SELECT 'close', count(*), count(*) FILTER (hour(datetime) = 3), CAST(0 AS BIGINT) FROM bars
UNION ALL SELECT 'volume', count(*), CAST(0 AS BIGINT), count(*) FILTER (hour(datetime) = 4) FROM bars"""))
def _(spark, sf):
    dirty = I.bars_5min(spark, sf).withColumns({
        "close": F.when(F.hour("datetime") != 3, F.col("close")),
        "volume": F.when(F.hour("datetime") == 4, F.lit(float("nan"))).otherwise(F.col("volume"))})
    return rounded(V.bad_numbers(dirty, ["open", "close", "volume"]))
