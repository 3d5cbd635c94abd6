"""One row per decision moment, with dated market rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import at_midnight, decision_id, elapsed_minutes, minutes, price_limit_pct
from ..schema import BAR_CLOSE, CONSTRAINT_FIELDS, DECISION_COLUMNS, MINUTES, OPEN_AUCTION
from .asof import as_of

LIMIT_TOLERANCE = 1e-4


def sessions(bars: DataFrame) -> DataFrame:
    """One row per symbol-day, with the close and last bar time of the session before."""
    w = Window.partitionBy("symbol", "adjust").orderBy("session")
    return (
        bars.groupBy("symbol", "adjust", F.to_date("datetime").alias("session"))
        .agg(
            F.min("datetime").alias("first_bar"), F.max("datetime").alias("last_bar"),
            F.min_by("open", "datetime").alias("first_open"), F.max_by("close", "datetime").alias("last_close"),
            F.count("*").alias("bars"),
        )
        .withColumns({
            "previous_close": F.lag("last_close").over(w),
            "previous_bar": F.lag("last_bar").over(w),
            "session_rank": F.row_number().over(w),
        })
    )


def decision_points(
    bars: DataFrame,
    status: DataFrame | None = None,
    *,
    trade_freq: str = "5min",
    include_open_auction: bool = True,
    require_limit_reference: bool = False,
) -> DataFrame:
    """Open-auction and bar-close decisions of every session.

    ``status`` has one row per symbol and date; without it every status is known and not special.
    """
    if trade_freq not in MINUTES:
        raise ValueError(f"decisions need an intraday frequency, not {trade_freq}")
    clean = bars.filter("datetime IS NOT NULL AND open IS NOT NULL AND close IS NOT NULL").select(
        "symbol", "adjust", "datetime", "open", "close", F.coalesce("volume", F.lit(0.0)).alias("volume"),
        F.to_date("datetime").alias("session"),
    )
    day = sessions(clean)
    if require_limit_reference:
        day = day.filter("previous_close > 0")
    if status is not None:
        facts = status.filter("is_st IS NOT NULL").select(
            F.upper("symbol").alias("symbol"), F.to_date("date").alias("session"), "is_st"
        )
        day = day.join(facts.withColumnRenamed("symbol", "_s"),
                       (F.upper("symbol") == F.col("_s")) & (day["session"] == facts["session"]), "left").drop(facts["session"], "_s")
    else:
        day = day.withColumn("is_st", F.lit(False))
    day = day.withColumns({
        "status_known": F.col("is_st").isNotNull(), "is_st": F.coalesce("is_st", F.lit(False)),
        "limit_reference_close": F.col("previous_close"),
    })

    facts_of_day = ["symbol", "adjust", "session", "is_st", "status_known", "limit_reference_close"]
    closes = clean.join(day.select(*facts_of_day), ["symbol", "adjust", "session"]).select(
        *[c for c in facts_of_day if c != "session"],
        F.col("datetime").alias("decision_time"), F.lit(BAR_CLOSE).alias("stage"), F.col("close").alias("execution_price"),
        F.col("datetime").alias("visible_bar_end"), F.col("datetime").alias("source_bar_end"),
        (F.col("volume") <= 0).alias("is_zero_volume"),
    )
    if not include_open_auction:
        return market_rules(closes)
    auctions = day.select(
        *[c for c in facts_of_day if c != "session"],
        (F.col("first_bar") - minutes(MINUTES[trade_freq])).alias("decision_time"), F.lit(OPEN_AUCTION).alias("stage"),
        F.col("first_open").alias("execution_price"), F.col("previous_bar").alias("visible_bar_end"),
        F.lit(None).cast("timestamp_ntz").alias("source_bar_end"), F.lit(False).alias("is_zero_volume"),
    )
    return market_rules(closes.unionByName(auctions))


def limit_flags(price, reference, pct) -> tuple[Column, Column]:
    known = F.coalesce(F.col(reference) > 0, F.lit(False))
    up = F.col(price) >= F.col(reference) * (F.lit(1.0) + F.col(pct) - LIMIT_TOLERANCE)
    down = F.col(price) <= F.col(reference) * (F.lit(1.0) - F.col(pct) + LIMIT_TOLERANCE)
    return F.when(known, up).otherwise(False), F.when(known, down).otherwise(False)


def market_rules(rows: DataFrame) -> DataFrame:
    """Price-limit, status and volume rules of decision rows."""
    df = rows.withColumns({
        "has_limit_reference": F.coalesce(F.col("limit_reference_close") > 0, F.lit(False)),
        "limit_pct": price_limit_pct("symbol", "is_st"),
        "is_tradeable": ~F.col("is_zero_volume"),
    })
    up, down = limit_flags("execution_price", "limit_reference_close", "limit_pct")
    df = df.withColumns({"is_limit_up": up, "is_limit_down": down})
    ready = F.col("status_known") & F.col("has_limit_reference") & F.col("is_tradeable")
    return df.withColumns({
        "market_can_buy": ready & ~F.col("is_st") & ~F.col("is_limit_up"),
        "market_can_sell": ready & ~F.col("is_limit_down"),
        "decision_id": decision_id("symbol", "adjust", "decision_time", "stage"),
    }).select(*DECISION_COLUMNS)


def decision_context(decisions: DataFrame) -> DataFrame:
    """Time-of-day context of each decision."""
    gone = elapsed_minutes("decision_time").cast("double")
    clock = F.hour("decision_time") * 60 + F.minute("decision_time")
    return decisions.select(
        "decision_id", "symbol", "decision_time", "stage",
        (F.least(F.ceil(gone / 5.0), F.lit(48)) / 48.0).alias("bar_slot_norm"),
        (gone / 240.0).alias("day_progress"),
        clock.between(570, 690).cast("double").alias("is_morning_session"),
        clock.between(780, 900).cast("double").alias("is_afternoon_session"),
        ((240.0 - gone) / 240.0).alias("minutes_to_close_norm"),
        (F.col("stage") == OPEN_AUCTION).cast("double").alias("is_open_auction"),
    )


def constraints(decisions: DataFrame) -> DataFrame:
    return decisions.select("decision_id", *[F.col(c).cast("double").alias(c) for c in CONSTRAINT_FIELDS])


def context_with_constraints(context: DataFrame, limits: DataFrame) -> DataFrame:
    return context.join(limits, ["decision_id"], "left")


def decision_rows(decisions: DataFrame, context: DataFrame, limits: DataFrame) -> DataFrame:
    """Every decision with its context and its constraints (NULL where one is absent); a column that decisions have is not taken twice."""
    extra = context_with_constraints(context, limits)
    taken = [c for c in extra.columns if c == "decision_id" or c not in decisions.columns]
    return decisions.join(extra.select(*taken), ["decision_id"], "left")


def eligible_bars(bars: DataFrame, *, least_rank: int = 2) -> DataFrame:
    """Bars of sessions that have at least ``least_rank`` - 1 sessions of their symbol before them."""
    dated = bars.withColumn("session", F.to_date("datetime"))
    good = sessions(dated).filter(F.col("session_rank") >= least_rank).select("symbol", "adjust", "session")
    return dated.join(good, ["symbol", "adjust", "session"], "left_semi").select(*bars.columns)


def pick_decisions(decisions: DataFrame, *, symbols=None, start: str | None = None, end: str | None = None,
                   stages=None) -> DataFrame:
    """Decisions of a symbol list and time range; an end at midnight means the whole day."""
    from ..functions.scalars import range_filter

    if stages is not None:
        unknown = set(stages) - {OPEN_AUCTION, BAR_CLOSE}
        if unknown:
            raise ValueError(f"unknown stages: {sorted(unknown)}")
        decisions = decisions.filter(F.col("stage").isin(*stages))
    if end is not None and end.strip().endswith("00:00:00"):
        end = end.strip()[:10]
    decisions = decisions.filter(range_filter("decision_time", start, end))
    if symbols is None:
        return decisions
    if isinstance(symbols, DataFrame):
        return decisions.join(symbols.select("symbol").distinct(), ["symbol"], "left_semi")
    return decisions.filter(F.col("symbol").isin(*symbols))


def ordered(decisions: DataFrame) -> DataFrame:
    """Time, open auction first, then symbol."""
    return decisions.orderBy("decision_time", F.when(F.col("stage") == OPEN_AUCTION, 0).otherwise(1), "symbol")


def with_liquidity(decisions: DataFrame, base: DataFrame, daily: DataFrame) -> DataFrame:
    """Bar-close decisions take the source bar's volume and amount, auctions the previous daily bar's."""
    closing = decisions.filter(F.col("stage") != OPEN_AUCTION).join(
        base.select("symbol", "adjust", F.col("datetime").alias("source_bar_end"), "volume", "amount"),
        ["symbol", "adjust", "source_bar_end"], "left",
    )
    opening = as_of(
        decisions.filter(F.col("stage") == OPEN_AUCTION).withColumn("_day", at_midnight("decision_time")),
        daily.select("symbol", "adjust", "datetime", "volume", "amount"), ["symbol", "adjust"],
        left_time="_day", right_time="datetime", take=["volume", "amount"], strict=True,
    ).drop("_day")
    return closing.unionByName(opening).withColumns({
        "liquidity_volume": F.coalesce("volume", F.lit(0.0)), "liquidity_amount": F.coalesce("amount", F.lit(0.0)),
    }).drop("volume", "amount")


def replay_bars(decisions: DataFrame, base: DataFrame) -> DataFrame:
    """Decisions with the bar they close on."""
    bars = base.select("symbol", "adjust", F.col("datetime").alias("source_bar_end"),
                       "open", "high", "low", "close", "volume", "amount")
    return decisions.join(bars, ["symbol", "adjust", "source_bar_end"])


def timeline(decisions: DataFrame) -> DataFrame:
    """Active symbols per decision time and stage."""
    return decisions.groupBy("decision_time", "stage").agg(F.count_distinct("symbol").alias("active_symbols"))


def trading_dates(decisions: DataFrame) -> DataFrame:
    return decisions.select(F.to_date("decision_time").alias("date")).distinct()


def first_and_last(decisions: DataFrame) -> DataFrame:
    """The first and the last decision, two rows."""
    key = ["decision_time", F.when(F.col("stage") == OPEN_AUCTION, 0).otherwise(1), "symbol"]
    backwards = [F.col("decision_time").desc(), key[1].desc(), F.col("symbol").desc()]
    return decisions.orderBy(*key).limit(1).withColumn("edge", F.lit("first")).unionByName(
        decisions.orderBy(*backwards).limit(1).withColumn("edge", F.lit("last"))
    )


def episode_index(decisions: DataFrame) -> DataFrame:
    """First and last decision, count and row offset per symbol, in symbol order."""
    per_symbol = decisions.groupBy("symbol").agg(
        F.min("decision_time").alias("first_decision"), F.max("decision_time").alias("last_decision"),
        F.count("*").alias("decisions"),
    )
    # One row per symbol; the symbol's first letter splits the running total.
    from .series import running

    letter = F.substring("symbol", 1, 3)
    return running(
        per_symbol.withColumn("_all", F.lit(1)), ["_all"], ["symbol"], letter, {"_end": ("sum", "decisions")}
    ).select("symbol", "first_decision", "last_decision", "decisions", (F.col("_end") - F.col("decisions")).alias("offset"))
