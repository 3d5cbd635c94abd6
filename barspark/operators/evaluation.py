"""Scores of net-asset-value series, strategy sets, orders and replay events."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normal import normal_cdf, normal_ppf
from ..functions.scalars import log_return, safe_div
from ..schema import OPEN_AUCTION
from .series import number_rows, running

YEAR = 252.0
EULER_GAMMA = 0.5772156649015329


def _year(c: str = "date") -> Column:
    return F.trunc(F.to_date(c), "year")


def end_of_day_nav(events: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """The last value of each day from step events."""
    return events.groupBy(*keys, F.to_date("time").alias("date")).agg(F.max_by("nav", "seq").alias("nav"))


def nav_returns(nav: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """NAV rows with the previous value, simple and log return (NULL on the first)."""
    df = running(nav, keys, ["date"], _year(), {"previous": ("last", "nav")}, exclusive=True)
    return df.withColumns({
        "ret": F.col("nav") / F.col("previous") - 1.0,
        "log_ret": F.when(F.col("previous").isNotNull(), log_return("nav", "previous")),
    })


def drawdown(nav: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    df = running(nav, keys, ["date"], _year(), {"peak": ("max", "nav")})
    return df.withColumn("drawdown", F.col("nav") / F.col("peak") - 1.0)


def portfolio_metrics(nav: DataFrame, keys: Sequence[str] = ("strategy",), costs: DataFrame | None = None,
                      initial_nav: float | DataFrame | None = None) -> DataFrame:
    """Return, risk and drawdown figures per strategy; ``costs`` may add ``turnover_value`` and ``total_fees``.

    ``initial_nav`` is the value before the first day, one for all or a frame of keys and ``initial_nav``; it is one more value of the series."""
    keys = list(keys)
    good = nav.filter("nav > 0")
    if initial_nav is not None:
        first = good.groupBy(*keys).agg(F.date_sub(F.to_date(F.min("date")), 1).cast(good.schema["date"].dataType).alias("date"))
        if isinstance(initial_nav, DataFrame):
            first = first.join(initial_nav.select(*keys, F.col("initial_nav").cast("double").alias("nav")), keys)
        else:
            first = first.withColumn("nav", F.lit(float(initial_nav)))
        good = good.select(*keys, "date", "nav").unionByName(first.filter("nav > 0"))
    r = running(good, keys, ["date"], _year(), {"previous": ("last", "nav")}, exclusive=True)
    r = r.withColumn("r", F.col("nav") / F.col("previous") - 1.0)
    flow = r.groupBy(*keys).agg(
        F.min_by("nav", "date").alias("initial_nav"), F.max_by("nav", "date").alias("final_nav"), F.avg("nav").alias("_avg"),
        F.count("r").alias("_n"), F.avg("r").alias("_mean"), F.stddev_samp("r").alias("_std"),
        F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))).alias("_down"),
        F.avg((F.col("r") > 0).cast("double")).alias("positive_day_ratio"),
    )
    worst = drawdown(good, keys).groupBy(*keys).agg((-F.min("drawdown")).alias("maximum_drawdown"))
    df = flow.filter("_n >= 1").join(worst, keys)
    if costs is not None:
        df = df.join(costs, keys, "left")
    else:
        df = df.withColumns({"turnover_value": F.lit(0.0), "total_fees": F.lit(0.0)})
    growth, root = F.col("final_nav") / F.col("initial_nav"), math.sqrt(YEAR)

    def ratio(value, base) -> Column:
        return F.when(F.col(base) > 0, value / F.col(base)).otherwise(0.0)

    df = df.withColumns({
        "total_return": growth - 1.0,
        "annualized_return": F.pow(growth, F.lit(YEAR) / F.col("_n")) - 1.0,
        "annualized_volatility": F.coalesce(F.col("_std") * root, F.lit(0.0)),
        "sharpe": ratio(F.col("_mean") * root, "_std"),
        "sortino": ratio(F.col("_mean") * root, "_down"),
        "turnover_ratio": F.coalesce(ratio(F.col("turnover_value"), "_avg"), F.lit(0.0)),
        "total_fees": F.coalesce("total_fees", F.lit(0.0)), "return_observations": F.col("_n"),
    })
    return df.withColumn("calmar", ratio(F.col("annualized_return"), "maximum_drawdown")).select(
        *keys, "initial_nav", "final_nav", "total_return", "annualized_return", "annualized_volatility", "sharpe", "sortino",
        "maximum_drawdown", "calmar", "positive_day_ratio", "return_observations", "turnover_ratio", "total_fees",
    )


# ---- selection bias ------------------------------------------------------------
def probabilistic_sharpe(estimate: Column, benchmark: Column, observations: Column, skew: Column, kurtosis: Column) -> Column:
    """Probability that the true ratio exceeds the benchmark; NULL where it is undefined."""
    spread = F.lit(1.0) - skew * estimate + (kurtosis - 1.0) / 4.0 * estimate * estimate
    z = (estimate - benchmark) * F.sqrt(observations - 1.0) / F.sqrt(spread)
    return F.when((observations >= 2) & (spread > 0), normal_cdf(z))


def sharpe_moments(returns: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """Per-period ratio, observations, skewness and (plain) kurtosis of a return table."""
    return returns.groupBy(*keys).agg(
        safe_div(F.avg("ret"), F.stddev_samp("ret")).alias("sharpe"), F.count("ret").cast("double").alias("observations"),
        F.skewness("ret").alias("skewness"), (F.kurtosis("ret") + 3.0).alias("kurtosis"),
    )


def deflated_sharpe(candidates: DataFrame, trials: DataFrame) -> DataFrame:
    """Candidates judged against the best ratio expected among the trials by chance."""
    one = trials.filter("sharpe IS NOT NULL AND NOT isnan(sharpe)").agg(
        F.count("*").cast("double").alias("trials"), F.avg("sharpe").alias("_mean"), F.stddev_samp("sharpe").alias("_dev")
    )
    lift = (1.0 - EULER_GAMMA) * normal_ppf(1.0 - 1.0 / F.col("trials")) + EULER_GAMMA * normal_ppf(
        1.0 - 1.0 / (F.col("trials") * math.e)
    )
    single = (F.col("trials") == 1) | (F.coalesce("_dev", F.lit(0.0)) == 0)
    one = one.filter("trials > 0").select("trials", F.when(single, F.col("_mean")).otherwise(F.col("_mean") + F.col("_dev") * lift).alias("benchmark"))
    df = candidates.crossJoin(F.broadcast(one))  # one row
    return df.withColumn("deflated_probability", probabilistic_sharpe(
        F.col("sharpe"), F.col("benchmark"), F.col("observations"), F.col("skewness"), F.col("kurtosis")
    ))


SPLITS_AT_ONCE = 4096


def split_mask(rank: Column, partitions: int) -> Column:
    """The ``rank``-th (from 0) set of half the partitions as bits: from the top, a partition is in it if so many sets lie below those that hold it."""
    half = partitions // 2
    below = F.array(*[F.lit(math.comb(n, k)) for n in range(partitions) for k in range(1, half + 1)])  # sets of k of the n lowest
    start = F.struct(rank.cast("bigint").alias("rank"), F.lit(half).alias("left"), F.lit(0).cast("bigint").alias("mask"))

    def step(a: Column, n: Column) -> Column:
        sets = F.when(a["left"] > 0, F.get(below, n * half + a["left"] - 1))
        taken = F.coalesce(a["rank"] >= sets, F.lit(False))
        return F.struct(
            F.when(taken, a["rank"] - sets).otherwise(a["rank"]).alias("rank"), (a["left"] - taken.cast("int")).alias("left"),
            F.when(taken, a["mask"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), n))).otherwise(a["mask"]).alias("mask"))

    return F.aggregate(F.sequence(F.lit(partitions - 1), F.lit(0), F.lit(-1)), start, step, lambda a: a["mask"])


def overfitting_splits(returns: DataFrame, partitions: int = 10) -> DataFrame:
    """One row per way of halving the blocks of periods: the in-sample winner's out-of-sample rank and loss.

    ``returns`` is (period, strategy, ret). Each strategy is reduced to ``partitions`` block sums first;
    a split only adds those up. Splits are made from their ranks, a few thousand in an array, so any even number of partitions below 63 runs (the
    number of splits, and so the work, is what the measure asks for).
    """
    if partitions < 2 or partitions % 2 or partitions > 62:
        raise ValueError("partitions must be an even number from 2 to 62")
    periods = returns.select("period").distinct().withColumn("_all", F.lit(1))
    numbered = number_rows(periods, ["_all"], ["period"], _year("period"))
    n = periods.agg(F.count("*").alias("_n"))
    at, size, extra = F.col("rn") - 1, F.floor(F.col("_n") / partitions), F.col("_n") % partitions
    block = F.when(at < extra * (size + 1), F.floor(at / (size + 1))).otherwise(extra + F.floor((at - extra * (size + 1)) / size))
    placed = numbered.crossJoin(F.broadcast(n)).select("period", block.cast("int").alias("block"), "_n")  # one row
    sums = returns.join(placed, ["period"]).filter("_n >= %d" % partitions).groupBy("strategy", "block").agg(
        F.count("ret").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q")
    )
    per_strategy = sums.groupBy("strategy").agg(F.collect_list(F.struct("block", "n", "s", "q")).alias("blocks"))  # <= partitions
    splits = math.comb(partitions, partitions // 2)
    # Both halves of every way to choose are produced, as the definition asks.
    ranges = per_strategy.select("strategy", "blocks", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit((splits - 1) // SPLITS_AT_ONCE).cast("bigint"))).alias("range"))
    if splits > SPLITS_AT_ONCE:
        ranges = ranges.repartition("strategy", "range")
    first = F.col("range") * SPLITS_AT_ONCE
    split = ranges.select("strategy", "blocks", F.explode(F.sequence(first, F.least(first + SPLITS_AT_ONCE, F.lit(splits).cast("bigint")) - 1)).alias("rank"))
    split = split.select("strategy", "blocks", split_mask(F.col("rank"), partitions).alias("mask"))

    def total(field: str, inside: bool) -> Column:
        return F.expr(f"aggregate(blocks, 0D, (a, b) -> a + IF((shiftright(mask, b.block) & 1) = {int(inside)}, b.{field}, 0D))")

    def ratio(inside: bool) -> Column:
        n, s, q = (total(f, inside) for f in ("n", "s", "q"))
        var = (q - s * s / n) / (n - 1.0)
        return F.when((n > 1) & (var > 0), s / n / F.sqrt(var)).otherwise(0.0)

    scored = split.select("mask", "strategy", ratio(True).alias("ins"), ratio(False).alias("out"))
    best = scored.groupBy("mask").agg(
        F.max("ins").alias("best_in"), F.count("*").alias("strategies"),
    )
    winner = scored.join(best, ["mask"]).filter("ins = best_in").groupBy("mask", "best_in", "strategies").agg(
        F.min_by("out", "strategy").alias("best_out"), F.min("strategy").alias("winner")
    )
    ranked = scored.join(winner, ["mask"]).groupBy("mask", "winner", "best_in", "best_out", "strategies").agg(
        F.sum((F.col("out") < F.col("best_out")).cast("bigint")).alias("below")
    )
    share = (F.col("below") + 1.0) / (F.col("strategies") + 1.0)
    share = F.least(F.greatest(share, F.lit(1e-12)), F.lit(1.0 - 1e-12))
    return ranked.select("mask", "winner", F.log(share / (1.0 - share)).alias("logit"), (F.col("best_in") - F.col("best_out")).alias("degradation"))


def overfitting_probability(returns: DataFrame, partitions: int = 10) -> DataFrame:
    return overfitting_splits(returns, partitions).agg(
        F.avg((F.col("logit") <= 0).cast("double")).alias("probability_of_overfitting"),
        F.avg("degradation").alias("mean_oos_degradation"), F.count("*").alias("combinations"),
    )


# ---- replay events ---------------------------------------------------------------
def buy_and_hold(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Last over first positive close minus one; NULL below two prices."""
    good = bars.filter("close > 0").groupBy(*keys).agg(
        F.min_by("close", "datetime").alias("a"), F.max_by("close", "datetime").alias("b"), F.count("*").alias("n")
    )
    return good.select(*keys, F.when(F.col("n") >= 2, F.col("b") / F.col("a") - 1.0).alias("buy_hold_return"))


def final_actions(events: DataFrame) -> DataFrame:
    """What came of each step: the first filled order's side, ``hold``, or ``blocked_<raw action>``."""
    def first(status):
        return F.get(F.filter("fills", lambda f: f["status"] == status), F.lit(0))

    filled, blocked = first("filled"), first("blocked")
    main = F.coalesce(filled, blocked)
    return events.withColumns({
        "executed": filled.isNotNull(), "blocked": blocked.isNotNull(), "blocked_reason": blocked["reason"],
        "final_action": F.when(filled.isNotNull(), filled["side"]).when(F.col("raw_action") == "hold", "hold")
        .otherwise(F.concat(F.lit("blocked_"), "raw_action")),
        "shares": F.coalesce(main["shares"], F.lit(0.0)), "fee": F.coalesce(main["fee"], F.lit(0.0)),
    })


def trade_summary(events: DataFrame, keys: Sequence[str] = ("run",)) -> DataFrame:
    """Counts of executed and blocked orders, fees and turnover per run."""
    def sides(status, side=None):
        return F.size(F.filter("fills", lambda f: (f["status"] == status) & ((f["side"] == side) if side else F.lit(True))))

    money = F.expr("aggregate(filter(fills, f -> f.status = 'filled'), 0D, (a, f) -> a + f.shares * f.price)")
    fees = F.expr("aggregate(filter(fills, f -> f.status = 'filled'), 0D, (a, f) -> a + f.fee)")
    out = events.groupBy(*keys).agg(
        F.count("*").alias("steps"), F.sum((F.col("raw_action") != "hold").cast("bigint")).alias("total_actions"),
        F.sum(sides("filled")).cast("bigint").alias("executed_trades"), F.sum(sides("blocked")).cast("bigint").alias("blocked_orders"),
        F.sum(sides("blocked", "buy")).cast("bigint").alias("blocked_buys"),
        F.sum(sides("blocked", "sell")).cast("bigint").alias("blocked_sells"),
        F.sum(fees).alias("total_fees"), F.sum(money).alias("turnover_value"),
    )
    return out.withColumn("block_rate", F.when(F.col("total_actions") > 0, F.col("blocked_orders") / F.col("total_actions")).otherwise(0.0))


def equity_curve(events: DataFrame, keys: Sequence[str] = ("run",)) -> DataFrame:
    """Return and drawdown of every step against the first value and the running peak."""
    df = running(events, keys, ["seq"], F.floor(F.col("seq") / 4096), {"peak": ("max", "nav"), "first_nav": ("first", "nav")})
    return df.select(*keys, "seq", "time", "nav", (F.col("nav") / F.col("first_nav") - 1.0).alias("return"),
                     (1.0 - F.col("nav") / F.col("peak")).alias("drawdown"))


def across_symbols(results: DataFrame) -> DataFrame:
    """Means and medians over symbols of total and excess return, the share that beat buy-and-hold, sums of counts."""
    return results.agg(
        F.count("*").alias("symbols"), F.avg("total_return").alias("mean_return"), F.median("total_return").alias("median_return"),
        F.avg("excess_return").alias("mean_excess_return"), F.avg((F.col("excess_return") > 0).cast("double")).alias("win_rate"),
        F.sum("orders").alias("orders"), F.sum("blocked_orders").alias("blocked_orders"), F.sum("steps").alias("steps"),
    )


def metric_means(results: DataFrame, keys: Sequence[str] = ("symbol",), sums: Sequence[str] = ("orders", "blocked_orders", "steps")) -> DataFrame:
    """The mean over symbols of every numeric column (a missing value counts as 0), sums of the counts, and the number of symbols."""
    numeric = [n for n, t in results.dtypes if n not in (*keys, *sums) and (t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal"))]
    return results.agg(
        F.count("*").alias("symbols"), *[F.avg(F.coalesce(F.col(n).cast("double"), F.lit(0.0))).alias(n) for n in numeric],
        *[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in sums if n in results.columns])


def walk_forward(dates: DataFrame, *, validation: int = 126, test: int = 252, embargo: int = 20, folds: int = 3) -> DataFrame:
    """Every trading date labelled train, validation, embargo, unused or test for every fold."""
    if validation <= 0 or test <= 0 or embargo < 0 or folds <= 0:
        raise ValueError("lengths and fold count must be positive")
    days = dates.select("date").distinct().withColumn("_all", F.lit(1))
    numbered = number_rows(days, ["_all"], ["date"], _year())
    total = days.agg(F.count("*").alias("_n"))
    needed = test + embargo + folds * (validation + embargo) + 1
    checked = total.withColumn("_n", F.when(F.col("_n") >= needed, F.col("_n")).otherwise(
        F.raise_error(F.concat(F.lit(f"needs {needed} trading days, got "), F.col("_n").cast("string"))).cast("bigint")))
    df = numbered.crossJoin(F.broadcast(checked))  # one row
    df = df.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    at, test_from = F.col("rn") - 1, F.col("_n") - test
    val_end = test_from - embargo - 1 - (folds - F.col("fold")) * (validation + embargo)
    val_from = val_end - validation + 1
    label = (
        F.when(at >= test_from, "test").when(at >= test_from - embargo, "embargo").when(at > val_end, "unused")
        .when(at >= val_from, "validation").when(at >= val_from - embargo, "embargo").otherwise("train")
    )
    return df.select("fold", "date", label.alias("part"))


# ---- orders ------------------------------------------------------------------------
@dataclass(frozen=True)
class TradingCosts:
    """The default market cost and liquidity parameters."""

    lot_size: int = 100
    bar_participation: float = 0.10
    auction_participation: float = 0.02
    commission_rate: float = 0.0003
    minimum_commission: float = 5.0
    stamp_duty_rate: float = 0.0005
    transfer_fee_rate: float = 0.00001
    base_slippage: float = 0.0002
    impact: float = 0.001
    maximum_slippage: float = 0.005


def order_costs(orders: DataFrame, c: TradingCosts = TradingCosts()) -> DataFrame:
    gross = F.col("gross_value")
    return orders.withColumns({
        "commission": F.greatest(F.lit(c.minimum_commission), gross * c.commission_rate),
        "stamp_duty": F.when(F.col("side") == "sell", gross * c.stamp_duty_rate).otherwise(0.0),
        "transfer_fee": gross * c.transfer_fee_rate,
    })


def order_prices(orders: DataFrame, c: TradingCosts = TradingCosts()) -> DataFrame:
    """Price after slippage, kept inside the day's limits, rounded to a cent against the trader."""
    part = F.greatest(F.lit(0.0), F.col("gross_value") / F.greatest("liquidity_amount", F.lit(1e-12)))
    slip = F.least(F.lit(c.maximum_slippage), F.lit(c.base_slippage) + F.sqrt(part) * c.impact)
    buy = F.col("side") == "buy"
    raw = F.col("execution_price") * F.when(buy, 1.0 + slip).otherwise(1.0 - slip)
    low = F.col("limit_reference_close") * (1.0 - F.col("limit_pct"))
    high = F.col("limit_reference_close") * (1.0 + F.col("limit_pct"))
    bounded = F.least(F.greatest(raw, low), high)
    cents = F.when(buy, F.ceil(bounded * 100.0)).otherwise(F.floor(bounded * 100.0))
    return orders.withColumns({"slippage": slip, "fill_price": cents / 100.0})


def liquidity_limits(orders: DataFrame, c: TradingCosts = TradingCosts()) -> DataFrame:
    rate = F.when(F.col("stage") == OPEN_AUCTION, c.auction_participation).otherwise(c.bar_participation)
    cap = F.greatest(F.lit(0.0), F.col("liquidity_amount")) * rate
    shares = F.when(F.col("execution_price") > 0, F.floor(cap / F.col("execution_price") / c.lot_size) * c.lot_size).otherwise(0)
    return orders.withColumns({"liquidity_cap": cap, "liquidity_shares": shares.cast("bigint")})


def blocked_reason(orders: DataFrame) -> DataFrame:
    """Why an order cannot trade; NULL when it can. ``active`` may be absent."""
    active = F.col("active") if "active" in orders.columns else F.lit(True)
    reason = (
        F.when(~active, "inactive_symbol").when(~F.col("is_tradeable"), "not_tradeable")
        .when((F.col("side") == "buy") & ~F.col("market_can_buy"), "market_buy_blocked")
        .when((F.col("side") == "sell") & ~F.col("market_can_sell"), "market_sell_blocked")
    )
    return orders.withColumn("blocked_reason", reason)
