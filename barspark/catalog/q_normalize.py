"""Normalisation, scalar functions, selection and set operations."""

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import inventory as V
from ..operators import normalize as N
from ..operators import selection as L
from ..operators.features import prepare_bars
from ..plans.dataset import metadata_values
from . import inputs as I
from .inputs import with_inputs
from .registry import query, rounded


def _status():
    return F.coalesce(F.col("is_st").cast("string"), F.lit("unknown")).alias("status")


def _raw(spark, sf):
    """The 5-minute bars as a provider would send them: text, odd names, some rubbish."""
    odd = F.minute("datetime")
    return I.bars_5min(spark, sf).select(
        F.concat_ws(".", F.lower(F.substring("symbol", 8, 2)), F.substring("symbol", 1, 6)).alias("code"),
        F.date_format("datetime", "yyyy-MM-dd").alias("date"),
        F.when(odd == 5, F.date_format("datetime", "HH:mm")).when(odd == 10, F.date_format("datetime", "HHmm"))
        .otherwise(F.concat(F.date_format("datetime", "yyyyMMddHHmm"), F.lit("00000"))).alias("time"),
        F.when(odd == 20, F.lit("n/a")).otherwise(F.col("open").cast("string")).alias("open"), F.col("high").cast("string").alias("high"),
        F.col("low").cast("string").alias("low"), F.when(odd == 15, F.lit("")).otherwise(F.col("close").cast("string")).alias("close"),
        F.when(odd != 25, F.col("volume").cast("string")).alias("volume"), F.lit("3").alias("adjustflag"),
    )


@query("normalized_bars", "B1 B2 B3", with_inputs("bars", body="""
SELECT lower(symbol[8:9]) || '.' || symbol[1:6] AS symbol,
  CASE WHEN minute(datetime) IN (5, 10) THEN date_trunc('day', datetime)::TIMESTAMP ELSE datetime END AS datetime,
  CASE WHEN minute(datetime) <> 20 THEN open END AS open, high, low, close,
  CASE WHEN minute(datetime) = 25 THEN 0.0 ELSE volume END AS volume, CAST(NULL AS DOUBLE) AS amount, CAST(NULL AS DOUBLE) AS "pctChg",
  'provider' AS source, '5min' AS freq, 'none' AS adjust FROM bars WHERE minute(datetime) <> 15"""))
def _(spark, sf):
    return rounded(N.normalize_bars(_raw(spark, sf), source="provider", freq="5min", adjust="none").drop("adjustflag"), 8)


@query("normalized_calendar", "B4 B5 B9 B19", with_inputs("calendar", body="""
SELECT date::TIMESTAMP AS date, is_trading_day, exchange, 'provider' AS source FROM calendar"""))
def _(spark, sf):
    """Two versions of every day; the later one is right."""
    day = I.calendar(spark, sf)
    wrong = day.select(F.col("date").alias("calendar_date"), F.lit("no").alias("is_open"), F.lit(1).alias("seq"))
    right = day.select(F.col("date").alias("calendar_date"), F.when(F.col("is_trading_day"), " Yes").otherwise("0").alias("is_open"), F.lit(2).alias("seq"))
    return rounded(N.normalize_calendar(wrong.unionByName(right), source="provider", sequence="seq"))


@query("trading_dates_of_calendar", "B19", with_inputs("calendar", body="SELECT date::TIMESTAMP AS date FROM calendar WHERE is_trading_day"))
def _(spark, sf):
    return rounded(N.trading_dates(I.calendar(spark, sf)))


@query("normalized_liquidity", "B4 B6 B9", with_inputs("liquidity", body="""
SELECT symbol, date::TIMESTAMP AS date, CASE WHEN day(date) <> 7 THEN round(turn, 6) END AS turn, 'provider' AS source FROM liquidity"""))
def _(spark, sf):
    rows = I.liquidity(spark, sf).withColumns({
        "code": F.concat(F.lit("﻿ "), F.lower("symbol"), F.lit(" ")), "turn": F.when(F.dayofmonth("date") == 7, "x").otherwise(F.col("turn").cast("string")),
        "seq": F.lit(2)}).drop("symbol", "source")
    old = rows.withColumns({"turn": F.lit("1"), "seq": F.lit(1)})
    return rounded(N.normalize_liquidity(rows.unionByName(old), source="provider", sequence="seq"))


@query("normalized_status", "B4 B9", with_inputs("status", body="""
SELECT symbol, date::TIMESTAMP AS date, is_st, 'provider' AS source FROM status"""))
def _(spark, sf):
    rows = I.status(spark, sf).select("symbol", "date", F.col("is_st").cast("int").cast("string").alias("isST"), F.lit(2).alias("seq"))
    old = rows.withColumns({"isST": F.lit("junk"), "seq": F.lit(3)})
    return rounded(N.normalize_status(rows.unionByName(old), source="provider", sequence="seq"))


@query("truthy_words", "B5", """
SELECT event_id, lower(trim(w)) IN ('1', 'true', 't', 'yes', 'y', 'open') AS flag FROM (
  SELECT event_id, CASE event_id % 7 WHEN 0 THEN ' TRUE ' WHEN 1 THEN 'n' WHEN 2 THEN 'Open' WHEN 3 THEN '1' WHEN 4 THEN 'closed'
  WHEN 5 THEN 'Y' ELSE '0' END AS w FROM events)""")
def _(spark, sf):
    words = F.array(*map(F.lit, (" TRUE ", "n", "Open", "1", "closed", "Y", "0")))
    return I.table(spark, sf, "events").select("event_id", X.truthy(words[(F.col("event_id") % 7).cast("int")]).alias("flag"))


@query("symbol_forms", "B6 B7", """
SELECT event_id, CASE k WHEN 0 THEN 'sz.' || d WHEN 1 THEN CASE WHEN d[1] IN ('6', '9') THEN 'sh.' ELSE 'sz.' END || d
  WHEN 2 THEN 'sh.' || d ELSE NULL END AS provider_symbol,
  CASE k WHEN 0 THEN d || '.SZ' WHEN 1 THEN d || CASE WHEN d[1] IN ('6', '9') THEN '.SH' ELSE '.SZ' END WHEN 2 THEN d || '.SH'
  ELSE d || '.NYSE' END AS internal_symbol, k = 3 AS symbol_error
FROM (SELECT event_id, event_id % 4 AS k, lpad(CAST(event_id * 7919 % 1000000 AS VARCHAR), 6, '0') AS d FROM events)""")
def _(spark, sf):
    d = F.lpad((F.col("event_id") * 7919 % 1000000).cast("string"), 6, "0")
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.concat(F.lit("﻿"), d, F.lit(".sz "))).when(k == 1, d).when(k == 2, F.concat(F.lit("SH."), d)).otherwise(F.concat(d, F.lit(".nyse")))
    rows = I.table(spark, sf, "events").select("event_id", text.alias("symbol"))
    return N.symbol_codes(rows).drop("symbol")


@query("frequency_aliases", "B8", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN '5min' WHEN 1 THEN 'daily' WHEN 2 THEN 'weekly' WHEN 3 THEN 'monthly' WHEN 4 THEN '60min' ELSE 'tick' END AS freq FROM events""")
def _(spark, sf):
    words = F.array(*map(F.lit, ("5", " 1D", "w", "1M", "60min", "Tick")))
    return I.table(spark, sf, "events").select("event_id", X.frequency_name(words[(F.col("event_id") % 6).cast("int")]).alias("freq"))


@query("keep_last_by_key", "B9", """
SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL""")
def _(spark, sf):
    rows = I.table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return N.keep_last(rows, ["user_id", "event_type"], "event_id")


@query("range_with_whole_last_day", "B10 B11 A1", with_inputs("bars", body="""
SELECT symbol, datetime, close FROM bars WHERE datetime >= TIMESTAMP '2024-01-10 09:00:00' AND datetime < TIMESTAMP '2024-01-13'"""))
def _(spark, sf):
    bars = I.bars_5min(spark, sf).withColumn("adjust", F.lit(None).cast("string"))
    return bars.filter(X.range_filter("datetime", "2024-01-10 09:00:00", "2024-01-12") & X.same_or_blank("adjust", "")).select("symbol", "datetime", "close")


@query("missing_columns_as_null", "B12 G1", with_inputs("bars", "daily", body="""
SELECT symbol, datetime, freq, close, volume FROM bars UNION ALL SELECT symbol, datetime, freq, NULL, NULL FROM daily"""))
def _(spark, sf):
    short = I.bars_daily(spark, sf).select("symbol", "datetime", "freq")
    return I.bars_5min(spark, sf).select("symbol", "datetime", "freq", "close", "volume").unionByName(short, allowMissingColumns=True)


@query("prepared_bars", "B14", with_inputs("bars", body="""
SELECT symbol, datetime, '60min' AS freq, adjust, open, high, low, close, CASE WHEN minute(datetime) = 5 THEN 0 ELSE volume END AS volume,
  0.0::DOUBLE AS amount, CAST(NULL AS DOUBLE) AS "pctChg", CAST(NULL AS DOUBLE) AS turn, 1.0::DOUBLE AS progress FROM bars WHERE hour(datetime) < 12"""))
def _(spark, sf):
    rows = I.bars_5min(spark, sf).withColumns({
        "freq": F.when(F.hour("datetime") < 12, "60").otherwise("d"),
        "volume": F.when(F.minute("datetime") != 5, F.col("volume"))}).drop("amount")
    return prepare_bars(rows, freq="60min", adjust="none")


@query("clipped_and_finite", "B15 B16", with_inputs("bars", body="""
SELECT symbol, datetime, CASE WHEN close > 0 THEN least(greatest(open / close - 1, -0.3), 0.3) ELSE 0 END + 0.0 AS ratio,
  CASE WHEN minute(datetime) = 0 THEN 0.0 ELSE least(greatest(volume, 0.0), 2.0) END AS volume FROM bars"""))
def _(spark, sf):
    ratio = X.finite_or(X.clip(X.safe_div("open", "close") - 1.0, -0.3, 0.3)) + 0.0
    volume = X.clip(F.when(F.minute("datetime") != 0, F.col("volume")), 0.0, 2.0)
    return I.bars_5min(spark, sf).select("symbol", "datetime", ratio.alias("ratio"), X.finite_or(volume).alias("volume"))


@query("row_ids", "B17", with_inputs("bars", body="""
SELECT symbol || '|5min|none|' || strftime(datetime, '%Y%m%d%H%M%S') AS market_row_id, close FROM bars"""))
def _(spark, sf):
    return I.bars_5min(spark, sf).select(X.row_id("symbol", "freq", "adjust", "datetime").alias("market_row_id"), "close")


@query("ids_of_decisions", "B17", with_inputs("bars", body="""
SELECT symbol || '|none|' || strftime(datetime, '%Y%m%d%H%M%S') || '|bar_close' AS decision_id FROM bars"""))
def _(spark, sf):
    return I.bars_5min(spark, sf).select(X.decision_id("symbol", "adjust", "datetime", F.lit("bar_close")).alias("decision_id"))


@query("trading_clock", "H1", """
SELECT event_id, CAST(CASE WHEN m <= 570 THEN 0 WHEN m <= 690 THEN m - 570 WHEN m < 780 THEN 120 WHEN m <= 900 THEN m - 660 ELSE 240 END AS BIGINT)
  AS elapsed FROM (SELECT event_id, hour(ts) * 60 + minute(ts) AS m FROM events)""")
def _(spark, sf):
    return I.table(spark, sf, "events").select("event_id", X.elapsed_minutes("ts").cast("bigint").alias("elapsed"))


@query("price_limits_and_boards", "H3 H5", """
SELECT event_id, CASE WHEN st THEN 0.05 WHEN s[1:3] IN ('688', '689', '300', '301') THEN 0.2 WHEN s[1] IN ('8', '4') OR s[1:3] = '920' THEN 0.3
  ELSE 0.1 END::DOUBLE AS limit_pct, CASE WHEN s[8:9] = 'BJ' THEN 'beijing' WHEN s[1:3] = '688' THEN 'star' WHEN s[1:3] IN ('300', '301')
  THEN 'chinext' ELSE lower(s[8:9]) END AS board
FROM (SELECT event_id, event_id % 11 = 0 AS st, CASE event_id % 8 WHEN 0 THEN '689009.SH' WHEN 1 THEN '301001.SZ' WHEN 2 THEN '430047.BJ'
  WHEN 3 THEN '920002.BJ' WHEN 4 THEN '600000.SH' WHEN 5 THEN '688001.SH' WHEN 6 THEN '000001.SZ' ELSE '830001.BJ' END AS s FROM events)""")
def _(spark, sf):
    names = F.array(*map(F.lit, ("689009.SH", "301001.SZ", "430047.BJ", "920002.BJ", "600000.SH", "688001.SH", "000001.SZ", "830001.BJ")))
    rows = I.table(spark, sf, "events").select("event_id", (F.col("event_id") % 11 == 0).alias("st"), names[(F.col("event_id") % 8).cast("int")].alias("s"))
    return rows.select("event_id", X.price_limit_pct("s", "st").alias("limit_pct"), X.board_group("s").alias("board"))


@query("period_starts", "H6", """
SELECT event_id, date_trunc('week', ts)::TIMESTAMP AS week, date_trunc('month', ts)::TIMESTAMP AS month, date_trunc('day', ts)::TIMESTAMP AS day FROM events""")
def _(spark, sf):
    return rounded(I.table(spark, sf, "events").select("event_id", X.week_start("ts").alias("week"), X.month_start("ts").alias("month"), X.period_start("ts", "daily").alias("day")))


@query("expected_rows_of_range", "H7", """
SELECT o_orderkey, greatest(1, CAST(floor(greatest((SELECT count(*) FROM range(0, 40) t(i) WHERE i <= o_orderkey % 40 AND
  isodow(o_orderdate::DATE + CAST(i AS INTEGER)) < 6), 1) * 48 * 0.75) AS BIGINT)) AS rows FROM orders""")
def _(spark, sf):
    return I.table(spark, sf, "orders").select(
        "o_orderkey", X.expected_minimum_rows(F.lit("5min"), F.to_date("o_orderdate"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 40).cast("int"))).alias("rows"))


@query("symbol_buckets", "H8", """
SELECT c_custkey, lpad(CAST(('0x' || sha1(upper(c_name))[1:8])::BIGINT % 1000 AS VARCHAR), 3, '0') AS bucket FROM customer""")
def _(spark, sf):
    return I.table(spark, sf, "customer").select("c_custkey", X.symbol_bucket("c_name").alias("bucket"))


@query("guarded_division", "H9", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(l_extendedprice / nullif(l_discount, 0), 4) AS quotient,
  CASE WHEN l_tax = 0 THEN 0.5 ELSE round(l_discount / l_tax, 4) END AS filled, coalesce(nullif(l_discount, 0), nullif(l_tax, 0), l_quantity) AS seeded FROM lineitem""")
def _(spark, sf):
    return rounded(I.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.round(X.safe_div("l_extendedprice", "l_discount"), 4).alias("quotient"),
        F.round(X.safe_div_fill("l_discount", "l_tax", 0.5), 4).alias("filled"), X.usable("l_discount", "l_tax", "l_quantity").alias("seeded")), 6)


@query("json_values", "H10 H14", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
  CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END AS iso, ts::TIMESTAMP AS again FROM events""")
def _(spark, sf):
    """Metadata values whose key says how they are typed, and times as text and back."""
    rows = I.table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp_ntz"))
    meta = metadata_values(rows.select(F.concat(F.lit("props_"), F.pmod("event_id", F.lit(2))).alias("key"), F.col("props").alias("value"), "event_id", "at"),
                           {"props_0": "k BIGINT", "props_1": "k BIGINT"}, "event_id", "at")
    k = F.coalesce(F.col("props_0.k"), F.col("props_1.k"))
    return meta.select("event_id", k.alias("k"), X.stamp_text("at").alias("stamp"), X.iso_text("at").alias("iso"), X.stamp_value(X.iso_text("at")).alias("again"))


@query("named_vectors", "H13", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount + coalesce(nullif(l_tax, 0.0), 0.0) * 10 AS weighted FROM lineitem""")
def _(spark, sf):
    """A vector with a missing value, read back by position and by name."""
    names = ["l_discount", "l_tax"]
    rows = I.table(spark, sf, "lineitem").withColumn("l_tax", F.nullif("l_tax", F.lit(0.0)))
    vector = F.array(*[F.coalesce(F.col(n), F.lit(0.0)) for n in names])
    table = F.map_from_arrays(F.array(*map(F.lit, names)), vector)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (vector[0] + table["l_tax"] * 10).alias("weighted"))


# ---- order, limit, sample ------------------------------------------------------
@query("first_bars", "F1 F2", with_inputs("bars", body="""
SELECT symbol, datetime, close FROM bars ORDER BY symbol, freq, adjust, datetime LIMIT 100"""))
def _(spark, sf):
    return L.first_n(I.bars_5min(spark, sf), ["symbol", "freq", "adjust", "datetime"], 100).select("symbol", "datetime", "close")


@query("last_rows_per_series", "F3", with_inputs("bars", body="""
SELECT symbol, datetime, from_end FROM (SELECT symbol, datetime, row_number() OVER (PARTITION BY symbol, freq, adjust ORDER BY datetime DESC)
  AS from_end FROM bars) WHERE from_end <= 96"""))
def _(spark, sf):
    return L.last_rows(I.bars_5min(spark, sf), 96).select("symbol", "datetime", "from_end")


_PAGE = """, ranked AS (SELECT symbol, datetime, close, count(*) OVER () AS total_rows, row_number() OVER (ORDER BY symbol, datetime) - 1 AS i FROM bars)
SELECT symbol, datetime, close, total_rows, {start} AS page_offset FROM ranked WHERE i >= {start} AND i < {start} + {size}"""


@query("page_of_bars", "A4", with_inputs("bars", body=_PAGE.format(start="CAST(120 AS BIGINT)", size=50)))
def _(spark, sf):
    return L.page(I.bars_5min(spark, sf).select("symbol", "datetime", "close"), ["symbol", "datetime"], offset=120, limit=50)


@query("last_page_of_bars", "A4 I22", with_inputs("bars", body=_PAGE.format(start="greatest(total_rows - 200, 0)", size=200)))
def _(spark, sf):
    return L.page(I.bars_5min(spark, sf).select("symbol", "datetime", "close"), ["symbol", "datetime"], limit=200, max_limit=200)


@query("preferred_adjustment", "F5", with_inputs("daily", body="""
SELECT symbol, datetime, CASE WHEN day(datetime) % 3 = 0 THEN 'pre' WHEN day(datetime) % 3 = 1 THEN 'none' ELSE 'post' END AS adjust FROM daily"""))
def _(spark, sf):
    """Days have different sets of adjustments."""
    d, k = I.bars_daily(spark, sf), F.dayofmonth("datetime") % 3
    rows = d.withColumn("adjust", F.explode(F.when(k == 0, F.array(F.lit("post"), F.lit("pre"), F.lit("none"))).when(k == 1, F.array(F.lit("post"), F.lit("none"))).otherwise(F.array(F.lit("post")))))
    return L.preferred_adjustment(rows).select("symbol", "datetime", "adjust")


@query("prefer_daily_slice", "F6", with_inputs("bars", "daily", "long", body=""", all_bars AS (SELECT * FROM bars UNION ALL SELECT * FROM daily WHERE symbol <> '600000.SH')
SELECT symbol, CASE WHEN bool_or(freq = 'daily') THEN 'daily' ELSE '5min' END AS freq, CASE WHEN bool_or(freq = 'daily') THEN count(*) FILTER (freq = 'daily')
  ELSE count(*) END AS rows FROM all_bars GROUP BY symbol"""))
def _(spark, sf):
    bars = I.bars_5min(spark, sf).unionByName(I.bars_daily(spark, sf).filter("symbol <> '600000.SH'"))
    return L.prefer_daily(V.inventory(bars)).select("symbol", "freq", "rows")


@query("seeded_symbol_sample", "F7", "SELECT CAST(7 AS BIGINT) AS sampled, true AS repeatable, true AS known")
def _(spark, sf):
    symbols = I.table(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("symbol"))
    a, b = L.sample_symbols(symbols, 7, 11), L.sample_symbols(symbols.repartition(3), 7, 11).withColumn("again", F.lit(1))
    hit = a.join(b, "symbol", "left").join(symbols.withColumn("is_known", F.lit(1)), "symbol", "left")
    return hit.agg(F.count("*").alias("sampled"), (F.count("again") == 7).alias("repeatable"), (F.count("is_known") == 7).alias("known"))


@query("board_round_robin_sample", "F8 H5", """
SELECT board, least(4, n) AS sampled FROM (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'beijing' WHEN 1 THEN 'chinext' ELSE 'sz' END AS board, count(*) AS n
  FROM supplier GROUP BY 1) WHERE (SELECT count(*) FROM supplier) >= 12 OR true""")
def _(spark, sf):
    """Twelve symbols from three boards: four each when every board has that many."""
    k = F.col("s_suppkey") % 3
    head = F.when(k == 0, "8").when(k == 1, "300").otherwise("002")
    tail = F.when(k == 0, ".BJ").otherwise(".SZ")
    symbols = I.table(spark, sf, "supplier").select(F.concat(head, F.lpad(F.col("s_suppkey").cast("string"), 4, "0"), tail).alias("symbol"))
    return L.sample_by_board(symbols, 12, 5).groupBy("board").agg(F.count("*").alias("sampled"))


@query("removed_keys", "G3", with_inputs("bars", "daily", body="""
SELECT DISTINCT symbol, date_trunc('day', datetime)::TIMESTAMP AS datetime FROM bars WHERE day(datetime) % 17 = 0"""))
def _(spark, sf):
    have = I.bars_daily(spark, sf)
    return L.difference(have, have.filter(F.dayofmonth("datetime") % 17 != 0), ["symbol", "datetime"])


@query("preview_across_parts", "G4", with_inputs("bars", "daily", body="""
SELECT symbol, datetime, freq FROM (SELECT symbol, datetime, freq FROM bars UNION ALL SELECT symbol, datetime, freq FROM daily)
ORDER BY symbol, datetime, freq LIMIT 20"""))
def _(spark, sf):
    cols = ["symbol", "datetime", "freq"]
    return L.preview([I.bars_5min(spark, sf).select(*cols), I.bars_daily(spark, sf).select(*cols)], cols, 20)


@query("daily_display", "E18", with_inputs("daily", "liquidity", "status", body="""
SELECT d.symbol, d.datetime, d.close, round(l.turn, 6) AS turn, coalesce(CAST(s.is_st AS VARCHAR), 'unknown') AS status FROM daily d
LEFT JOIN liquidity l ON l.symbol = d.symbol AND l.date = d.datetime::DATE LEFT JOIN status s ON s.symbol = d.symbol AND s.date = d.datetime::DATE"""))
def _(spark, sf):
    out = N.daily_display(I.bars_daily(spark, sf), I.liquidity(spark, sf), I.status(spark, sf))
    return rounded(out.select("symbol", "datetime", "close", "turn", _status()))


@query("turnover_with_status", "E19", with_inputs("liquidity", "status", body="""
SELECT l.symbol, l.date::TIMESTAMP AS date, round(l.turn, 6) AS turn, coalesce(CAST(s.is_st AS VARCHAR), 'unknown') AS status FROM liquidity l LEFT JOIN status s USING (symbol, date)"""))
def _(spark, sf):
    out = N.turnover_with_status(I.liquidity(spark, sf), I.status(spark, sf))
    return rounded(out.select("symbol", "date", "turn", _status()))


@query("daily_with_turnover", "E1", with_inputs("daily", "liquidity", body="""
SELECT d.symbol, d.datetime, round(l.turn, 6) AS turn FROM daily d LEFT JOIN liquidity l ON l.symbol = d.symbol AND l.date = d.datetime::DATE"""))
def _(spark, sf):
    from ..plans.dataset import with_turnover

    return rounded(with_turnover(I.bars_daily(spark, sf), I.liquidity(spark, sf)).select("symbol", "datetime", "turn"))
