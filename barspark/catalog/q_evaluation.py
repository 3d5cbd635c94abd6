"""Scores of NAV series, strategy sets, orders and replay events."""

from pyspark.sql import functions as F

from ..operators import decisions as D
from ..operators import evaluation as E
from . import inputs as I
from .inputs import with_inputs
from .q_decisions import decisions
from .q_decisions import sql as decision_sql
from .q_sources import _events
from .registry import query, rounded


@query("end_of_day_nav", "L1", """
SELECT user_id % 3 AS strategy, date_trunc('day', ts)::TIMESTAMP AS date, arg_max(value, event_id) AS nav FROM events GROUP BY 1, 2""")
def _(spark, sf):
    ev = I.ticks(spark, sf).select((F.col("user_id") % 3).alias("strategy"), F.col("ts").alias("time"), F.col("event_id").alias("seq"), F.col("value").alias("nav"))
    return rounded(E.end_of_day_nav(ev))


@query("nav_log_returns", "H15 L2", with_inputs("nav", body="""
SELECT strategy, date::TIMESTAMP AS date, coalesce(round(ln(nav / lag(nav) OVER w), 6), 0) + 0.0 AS log_ret FROM nav WINDOW w AS (PARTITION BY strategy ORDER BY date)"""))
def _(spark, sf):
    return rounded(E.nav_returns(I.nav(spark, sf)).select("strategy", "date", F.coalesce("log_ret", F.lit(0.0)).alias("log_ret")))


_METRICS = """, r AS (SELECT *, nav / lag(nav) OVER w - 1 AS r, nav / max(nav) OVER w - 1 AS dd FROM nav WINDOW w AS (PARTITION BY strategy ORDER BY date)),
m AS (SELECT strategy, min_by(nav, date) AS a, max_by(nav, date) AS z, count(r) AS n, avg(r) AS mean, stddev_samp(r) AS sd, stddev_samp(r) FILTER (r < 0) AS down, -min(dd) AS mdd,
  avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) FILTER (r IS NOT NULL) AS pos FROM r GROUP BY strategy)"""


@query("portfolio_metrics", "L2 D20", with_inputs("nav", body=_METRICS + """
SELECT strategy, round(z / a - 1, 6) + 0.0 AS total_return, round(pow(z / a, 252.0 / n) - 1, 6) + 0.0 AS annualized_return, round(sd * sqrt(252), 6) AS annualized_volatility,
  round(mean * sqrt(252) / sd, 6) + 0.0 AS sharpe, round(mean * sqrt(252) / down, 6) + 0.0 AS sortino, round(mdd, 6) AS maximum_drawdown, round((pow(z / a, 252.0 / n) - 1) / mdd, 6) + 0.0 AS calmar,
  round(pos, 6) AS positive_day_ratio, n AS return_observations FROM m"""))
def _(spark, sf):
    return rounded(E.portfolio_metrics(I.nav(spark, sf)).select("strategy", "total_return", "annualized_return", "annualized_volatility", "sharpe", "sortino", "maximum_drawdown",
                                                               "calmar", "positive_day_ratio", "return_observations"))


def _returns(spark, sf):
    return E.nav_returns(I.nav(spark, sf)).filter("ret IS NOT NULL")


# Normal distribution function in SQL: 0.5 + density * sum of x^(2k+1) / (1*3*...*(2k+1)).
_CDF = """0.5 + sign(x) * exp(-x * x / 2) / sqrt(2 * pi()) * (SELECT sum(exp((2 * k + 1) * ln(abs(x)) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1))) FROM range(0, 120) t(k))"""


@query("probabilistic_sharpe", "L3", with_inputs("nav", body=f"""
, r AS (SELECT strategy, nav / lag(nav) OVER (PARTITION BY strategy ORDER BY date) - 1 AS r FROM nav),
c AS (SELECT strategy, r, r - avg(r) OVER (PARTITION BY strategy) AS d FROM r WHERE r IS NOT NULL),
m AS (SELECT strategy, avg(r) / stddev_samp(r) AS s, count(*) AS n, avg(d * d * d) / pow(avg(d * d), 1.5) AS sk, avg(d * d * d * d) / pow(avg(d * d), 2) AS ku FROM c GROUP BY strategy),
z AS (SELECT strategy, (s - 0.01) * sqrt(n - 1) / sqrt(1 - sk * s + (ku - 1) / 4 * s * s) AS x FROM m)
SELECT strategy, round({_CDF}, 6) AS probability FROM z"""))
def _(spark, sf):
    m = E.sharpe_moments(_returns(spark, sf))
    p = E.probabilistic_sharpe(F.col("sharpe"), F.lit(0.01), F.col("observations"), F.col("skewness"), F.col("kurtosis"))
    return rounded(m.select("strategy", p.alias("probability")))


@query("deflated_sharpe", "L4")
def _(spark, sf):
    m = E.sharpe_moments(_returns(spark, sf))
    return rounded(E.deflated_sharpe(m, m).select("strategy", "trials", "benchmark", "deflated_probability"))


_SPLITS = """, r AS (SELECT strategy, date, nav / lag(nav) OVER (PARTITION BY strategy ORDER BY date) - 1 AS r FROM nav),
p AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM r WHERE r IS NOT NULL)),
b AS (SELECT date, CASE WHEN i < (n % 6) * (n // 6 + 1) THEN i // (n // 6 + 1) ELSE n % 6 + (i - (n % 6) * (n // 6 + 1)) // (n // 6) END AS blk FROM p),
m AS (SELECT m FROM range(0, 64) t(m) WHERE bit_count(m) = 3),
s AS (SELECT m.m, r.strategy, avg(r.r) FILTER ((m.m >> b.blk) & 1 = 1) / stddev_samp(r.r) FILTER ((m.m >> b.blk) & 1 = 1) AS ins, avg(r.r) FILTER ((m.m >> b.blk) & 1 = 0) / stddev_samp(r.r) FILTER ((m.m >> b.blk) & 1 = 0) AS outs
  FROM r JOIN b USING (date), m WHERE r.r IS NOT NULL GROUP BY m.m, r.strategy),
w AS (SELECT m, arg_max(strategy, ins) AS winner, max(ins) AS ins, arg_max(outs, ins) AS outs, count(*) AS k FROM s GROUP BY m),
q AS (SELECT w.m, w.winner, w.ins - w.outs AS degradation, ((SELECT count(*) FROM s WHERE s.m = w.m AND s.outs < w.outs) + 1) / (w.k + 1.0) AS rank FROM w)"""


@query("overfitting_splits", "L5", with_inputs("nav", body=_SPLITS + """
SELECT m AS mask, winner, round(ln(rank / (1 - rank)), 6) + 0.0 AS logit, round(degradation, 6) + 0.0 AS degradation FROM q"""))
def _(spark, sf):
    return rounded(E.overfitting_splits(_returns(spark, sf).withColumnRenamed("date", "period"), 6))


@query("overfitting_probability", "L5", with_inputs("nav", body=_SPLITS + """
SELECT round(avg(CASE WHEN ln(rank / (1 - rank)) <= 0 THEN 1.0 ELSE 0.0 END), 6) AS probability_of_overfitting, round(avg(degradation), 6) + 0.0 AS mean_oos_degradation, count(*) AS combinations FROM q"""))
def _(spark, sf):
    return rounded(E.overfitting_probability(_returns(spark, sf).withColumnRenamed("date", "period"), 6))


@query("buy_and_hold", "L6", with_inputs("long", body="""
SELECT symbol, round(max_by(close, datetime) / min_by(close, datetime) - 1, 8) + 0.0 AS buy_hold_return FROM long WHERE close > 0 GROUP BY symbol"""))
def _(spark, sf):
    return rounded(E.buy_and_hold(I.bars_daily_long(spark, sf)), 8)


_STEPS = """, st AS (SELECT *, day(datetime) % 4 AS k FROM daily)"""


@query("final_actions", "L8", with_inputs("daily", body=_STEPS + """
SELECT symbol, datetime AS time, k < 2 AS executed, k = 2 AS blocked, CASE WHEN k = 2 THEN 'market_buy_blocked' ELSE '' END AS blocked_reason,
  CASE k WHEN 0 THEN 'buy' WHEN 1 THEN 'sell' WHEN 2 THEN 'blocked_buy' ELSE 'hold' END AS final_action, CASE WHEN k = 3 THEN 0 ELSE volume END AS shares FROM st"""))
def _(spark, sf):
    out = E.final_actions(_events(spark, sf))
    return out.select("symbol", "time", "executed", "blocked", F.coalesce("blocked_reason", F.lit("")).alias("blocked_reason"), "final_action", "shares")


@query("trade_summary", "L7", with_inputs("daily", body=_STEPS + """
SELECT symbol, count(*) AS steps, count(*) FILTER (k < 3) AS total_actions, count(*) FILTER (k < 2) AS executed_trades, count(*) FILTER (k = 2) AS blocked_orders, count(*) FILTER (k = 2) AS blocked_buys,
  CAST(0 AS BIGINT) AS blocked_sells, 5.0 * count(*) FILTER (k < 2) AS total_fees, round(sum(volume * close) FILTER (k < 2), 4) AS turnover_value, round(count(*) FILTER (k = 2) / CAST(count(*) FILTER (k < 3) AS DOUBLE), 6) AS block_rate
FROM st GROUP BY symbol"""))
def _(spark, sf):
    return rounded(E.trade_summary(_events(spark, sf), ["symbol"]).withColumn("turnover_value", F.round("turnover_value", 4)))


@query("equity_curve", "L7 D20", with_inputs("daily", body="""
SELECT symbol, datetime AS time, round(close / first_value(close) OVER w - 1, 6) + 0.0 AS "return", round(1 - close / max(close) OVER w, 6) + 0.0 AS drawdown FROM daily
WINDOW w AS (PARTITION BY symbol ORDER BY datetime)"""))
def _(spark, sf):
    return rounded(E.equity_curve(_events(spark, sf), ["symbol"]).select("symbol", "time", "return", "drawdown"))


@query("results_across_symbols", "C23 L6", with_inputs("long", body="""
, b AS (SELECT symbol, max_by(close, datetime) / min_by(close, datetime) - 1 AS bh, max_by(close, datetime) / min_by(open, datetime) - 1 AS tr, count(*) AS n FROM long GROUP BY symbol)
SELECT count(*) AS symbols, round(avg(tr), 6) + 0.0 AS mean_return, round(median(tr), 6) + 0.0 AS median_return, round(avg(tr - bh), 6) + 0.0 AS mean_excess_return,
  round(avg(CASE WHEN tr - bh > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, CAST(sum(n) AS BIGINT) AS orders, CAST(0 AS BIGINT) AS blocked_orders, CAST(sum(n) AS BIGINT) AS steps FROM b"""))
def _(spark, sf):
    bars = I.bars_daily_long(spark, sf)
    own = bars.groupBy("symbol").agg((F.max_by("close", "datetime") / F.min_by("open", "datetime") - 1.0).alias("total_return"), F.count("*").alias("orders"))
    res = own.join(E.buy_and_hold(bars), ["symbol"]).withColumns({
        "excess_return": F.col("total_return") - F.col("buy_hold_return"), "blocked_orders": F.lit(0).cast("bigint"), "steps": F.col("orders")})
    return rounded(E.across_symbols(res))


@query("metric_means", "C23", with_inputs("long", body="""
, b AS (SELECT symbol, max_by(close, datetime) / min_by(close, datetime) - 1 AS bh, max_by(close, datetime) / min_by(open, datetime) - 1 AS tr, count(*) AS n FROM long GROUP BY symbol)
SELECT count(*) AS symbols, round(avg(tr), 6) + 0.0 AS total_return, round(avg(bh), 6) + 0.0 AS buy_hold_return, round(sum(CASE WHEN tr > 0 THEN tr ELSE 0 END) / count(*), 6) + 0.0 AS gain, CAST(sum(n) AS BIGINT) AS orders FROM b"""))
def _(spark, sf):
    bars = I.bars_daily_long(spark, sf)
    own = bars.groupBy("symbol").agg((F.max_by("close", "datetime") / F.min_by("open", "datetime") - 1.0).alias("total_return"), F.count("*").alias("orders"))
    res = own.join(E.buy_and_hold(bars).select("symbol", "buy_hold_return"), ["symbol"]).withColumn("gain", F.when(F.col("total_return") > 0, F.col("total_return")))
    return rounded(E.metric_means(res))


@query("portfolio_metrics_from_start", "L2", with_inputs("nav", body="""
, s AS (SELECT strategy, date, nav FROM nav UNION ALL SELECT strategy, min(date) - INTERVAL 1 DAY, 0.9 FROM nav GROUP BY strategy),
x AS (SELECT *, nav / lag(nav) OVER w - 1 AS r, nav / max(nav) OVER w - 1 AS dd FROM s WINDOW w AS (PARTITION BY strategy ORDER BY date))
SELECT strategy, 0.9 AS initial_nav, round(max_by(nav, date) / 0.9 - 1, 6) + 0.0 AS total_return, round(pow(max_by(nav, date) / 0.9, 252.0 / count(r)) - 1, 6) + 0.0 AS annualized_return,
  round(avg(r) * sqrt(252) / stddev_samp(r), 6) + 0.0 AS sharpe, round(-min(dd), 6) + 0.0 AS maximum_drawdown, count(r) AS return_observations FROM x GROUP BY strategy"""))
def _(spark, sf):
    """The first day counts as a return from a given starting value."""
    return rounded(E.portfolio_metrics(I.nav(spark, sf), initial_nav=0.9).select(
        "strategy", "initial_nav", "total_return", "annualized_return", "sharpe", "maximum_drawdown", "return_observations"))


@query("walk_forward_parts", "L9", """
WITH d AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders), n AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM d),
f AS (SELECT n.*, fold, n - 252 AS t, n - 252 - 20 - 1 - (3 - fold) * 146 AS ve FROM n, (VALUES (1), (2), (3)) v(fold))
SELECT CAST(fold AS BIGINT) AS fold, date::TIMESTAMP AS date, CASE WHEN i >= t THEN 'test' WHEN i >= t - 20 THEN 'embargo' WHEN i > ve THEN 'unused' WHEN i >= ve - 125 THEN 'validation' WHEN i >= ve - 145 THEN 'embargo' ELSE 'train' END AS part FROM f""")
def _(spark, sf):
    days = I.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"))
    return rounded(E.walk_forward(days))


# ---- orders --------------------------------------------------------------------------
_ORDERS = """, ord AS (SELECT d.decision_id, d.stage, CASE WHEN minute(d.decision_time) % 10 = 0 THEN 'buy' ELSE 'sell' END AS side, d.execution_price, coalesce(d.limit_reference_close, d.execution_price) AS limit_reference_close,
  d.limit_pct, d.is_tradeable, d.market_can_buy, d.market_can_sell, CASE WHEN d.stage = 'open_auction' THEN coalesce(p.amount, 0) ELSE coalesce(b.amount, 0) END AS liquidity_amount, d.execution_price * 100 AS gross_value
  FROM dec d LEFT JOIN session b ON b.symbol = d.symbol AND b.datetime = d.source_bar_end ASOF LEFT JOIN daily p ON p.symbol = d.symbol AND p.datetime < date_trunc('day', d.decision_time)::TIMESTAMP)"""


def _orders(spark, sf):
    rows = D.with_liquidity(decisions(spark, sf), I.session_bars(spark, sf), I.bars_daily(spark, sf))
    return rows.withColumns({
        "side": F.when(F.minute("decision_time") % 10 == 0, "buy").otherwise("sell"), "gross_value": F.col("execution_price") * 100.0,
        "limit_reference_close": F.coalesce("limit_reference_close", "execution_price")})


@query("order_costs", "L10", decision_sql(_ORDERS.lstrip() + """
SELECT decision_id, round(greatest(5.0, gross_value * 0.0003), 6) AS commission, round(CASE WHEN side = 'sell' THEN gross_value * 0.0005 ELSE 0 END, 6) AS stamp_duty, round(gross_value * 0.00001, 6) AS transfer_fee FROM ord""", "daily"))
def _(spark, sf):
    return rounded(E.order_costs(_orders(spark, sf)).select("decision_id", "commission", "stamp_duty", "transfer_fee"))


@query("order_prices", "L11", decision_sql(_ORDERS.lstrip() + """
, s AS (SELECT *, least(0.005, 0.0002 + sqrt(greatest(0.0, gross_value / greatest(liquidity_amount, 1e-12))) * 0.001) AS slip FROM ord),
r AS (SELECT *, least(greatest(execution_price * CASE WHEN side = 'buy' THEN 1 + slip ELSE 1 - slip END, limit_reference_close * (1 - limit_pct)), limit_reference_close * (1 + limit_pct)) AS bounded FROM s)
SELECT decision_id, round(slip, 6) AS slippage, round(CASE WHEN side = 'buy' THEN ceil(bounded * 100) ELSE floor(bounded * 100) END / 100, 6) AS fill_price FROM r""", "daily"))
def _(spark, sf):
    return rounded(E.order_prices(_orders(spark, sf)).select("decision_id", "slippage", "fill_price"))


@query("order_liquidity", "L12", decision_sql(_ORDERS.lstrip() + """
SELECT decision_id, round(liquidity_amount * CASE stage WHEN 'open_auction' THEN 0.02 ELSE 0.1 END, 6) AS liquidity_cap,
  CAST(floor(liquidity_amount * 40000 * CASE stage WHEN 'open_auction' THEN 0.02 ELSE 0.1 END / execution_price / 100) * 100 AS BIGINT) AS liquidity_shares FROM ord""", "daily"))
def _(spark, sf):
    big = E.liquidity_limits(_orders(spark, sf).withColumn("liquidity_amount", F.col("liquidity_amount") * 40000.0))
    return rounded(big.select("decision_id", (F.col("liquidity_cap") / 40000.0).alias("liquidity_cap"), "liquidity_shares"))


@query("order_blocks", "L13", decision_sql(_ORDERS.lstrip() + """
SELECT decision_id, CASE WHEN NOT is_tradeable THEN 'not_tradeable' WHEN side = 'buy' AND NOT market_can_buy THEN 'market_buy_blocked' WHEN side = 'sell' AND NOT market_can_sell THEN 'market_sell_blocked' ELSE '' END AS blocked_reason FROM ord""", "daily"))
def _(spark, sf):
    return E.blocked_reason(_orders(spark, sf)).select("decision_id", F.coalesce("blocked_reason", F.lit("")).alias("blocked_reason"))
