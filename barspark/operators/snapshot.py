"""The partial bar of the running period at every decision, and its features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import at_midnight, clip, period_start, safe_div, safe_div_fill, usable
from ..plans.registry import DEFAULT_SPEC, FeatureSpec, Indicator
from ..schema import INTRADAY, MINUTES, OPEN_AUCTION, ROWS_FROM_5MIN, ROWS_FROM_DAILY
from .ema import gap_step, span
from .features import RETURNS, active_at, availability, feature_frame, indicator_emas, indicator_fields, model_fields, price_ratios

PARTIAL_COLUMNS = ("open", "high", "low", "close", "volume", "amount", "pctChg", "turn", "progress")
LONG_PERIODS = ("weekly", "monthly")


def _cumulative(w) -> dict[str, Column]:
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return {
        "open": F.first("open").over(so_far), "high": F.max("high").over(so_far), "low": F.min("low").over(so_far),
        "close": F.col("close"), "volume": F.sum("volume").over(so_far), "amount": F.sum("amount").over(so_far),
    }


def _row(values: dict[str, Column], pct: Column, progress: Column) -> Column:
    return F.struct(
        *[values[c].alias(c) for c in ("open", "high", "low", "close", "volume", "amount")],
        pct.alias("pctChg"), F.lit(None).cast("double").alias("turn"), progress.alias("progress"),
    )


def running_day(base: DataFrame, freqs=("15min", "30min", "60min"), *, trade_freq: str = "5min") -> DataFrame:
    """For every base bar the partial bars of its day: ``p_<freq>`` (NULL when complete) and ``p_daily``.

    All groups lie inside one symbol-day.
    """
    day = ["symbol", "adjust", "session"]
    w = Window.partitionBy(*day).orderBy("datetime")
    df = base.select("symbol", "adjust", "datetime", "open", "high", "low", "close",
                     F.coalesce("volume", F.lit(0.0)).alias("volume"), F.coalesce("amount", F.lit(0.0)).alias("amount"),
                     F.to_date("datetime").alias("session"))
    df = df.withColumns({"_o": F.row_number().over(w) - 1, "_before": F.lag("close").over(w)})
    out: dict[str, Column] = {}
    for freq in freqs:
        k = MINUTES[freq] // MINUTES[trade_freq]
        bucket = Window.partitionBy(*day, F.floor(F.col("_o") / k)).orderBy("datetime")
        values = _cumulative(bucket)
        earlier = F.first("_before").over(bucket.rowsBetween(Window.unboundedPreceding, 0))
        rows = F.col("_o") % k + 1
        pct = safe_div("close", usable(earlier, values["open"])) - 1.0
        out[f"p_{freq}"] = F.when(rows < k, _row(values, pct, rows / float(k)))
    values = _cumulative(w)
    full = float(ROWS_FROM_5MIN["daily"] * MINUTES["5min"] // MINUTES[trade_freq])
    out["p_daily"] = _row(values, safe_div("close", values["open"]) - 1.0,
                          F.least((F.col("_o") + 1) / full, F.lit(1.0)))
    return df.withColumns(out).select("symbol", "adjust", "datetime", "session", *out)


def period_before(days: DataFrame, daily: DataFrame, freq: str) -> DataFrame:
    """For each symbol-day the completed daily bars of its week or month so far, as ``before_<freq>``."""
    facts = daily.select("symbol", "adjust", F.to_date("datetime").alias("session"),
                         "open", "high", "low", "volume", "amount", F.lit(1).alias("_d"))
    all_days = days.join(facts, ["symbol", "adjust", "session"], "full_outer")
    w = Window.partitionBy("symbol", "adjust", period_start("session", freq)).orderBy("session").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = F.struct(
        F.first("open", ignorenulls=True).over(w).alias("open"), F.max("high").over(w).alias("high"),
        F.min("low").over(w).alias("low"), F.sum("volume").over(w).alias("volume"),
        F.sum("amount").over(w).alias("amount"), F.count("_d").over(w).alias("days"),
    )
    return all_days.withColumn(f"before_{freq}", before).select("symbol", "adjust", "session", f"before_{freq}")


def _extend(freq: str) -> Column:
    """A week or month so far: completed days and the partial day."""
    b, d = F.col(f"before_{freq}"), F.col("p_daily")
    open_ = F.coalesce(b["open"], d["open"])
    values = {
        "open": open_, "high": F.greatest(b["high"], d["high"]), "low": F.least(b["low"], d["low"]), "close": d["close"],
        "volume": F.coalesce(b["volume"], F.lit(0.0)) + d["volume"],
        "amount": F.coalesce(b["amount"], F.lit(0.0)) + d["amount"],
    }
    share = (F.coalesce(b["days"], F.lit(0)) + 1) / float(ROWS_FROM_DAILY[freq])
    return F.when(d.isNotNull(), _row(values, F.coalesce(safe_div(d["close"], open_) - 1.0, F.lit(0.0)),
                                      F.least(share, F.lit(1.0))))


def decision_snapshots(decisions: DataFrame, base: DataFrame, daily: DataFrame, freqs, *, trade_freq: str = "5min") -> DataFrame:
    """One row per decision and frequency that has a partial bar, in raw bar columns."""
    short = [f for f in freqs if f in INTRADAY and f != trade_freq]
    long = [f for f in freqs if f in LONG_PERIODS]
    partial = running_day(base, short, trade_freq=trade_freq)
    keep = ["decision_id", "symbol", "adjust", "decision_time", "stage"]

    closing = decisions.filter(F.col("stage") != OPEN_AUCTION).select(*keep, F.col("visible_bar_end").alias("datetime")).join(
        partial, ["symbol", "adjust", "datetime"]
    ).drop("datetime")
    price = F.col("execution_price")
    flat = _row({**dict.fromkeys(("open", "high", "low", "close"), price), "volume": F.lit(0.0), "amount": F.lit(0.0)},
                F.lit(0.0), F.lit(0.0))
    opening = decisions.filter(F.col("stage") == OPEN_AUCTION).select(
        *keep, F.to_date("decision_time").alias("session"), flat.alias("p_daily")
    )
    rows = closing.unionByName(opening, allowMissingColumns=True)
    for freq in long:
        days = decisions.select("symbol", "adjust", F.to_date("decision_time").alias("session")).distinct()
        rows = rows.join(period_before(days, daily, freq), ["symbol", "adjust", "session"], "left")
        rows = rows.withColumn(f"p_{freq}", _extend(freq)).drop(f"before_{freq}")
    parts = F.array(*[
        F.struct(F.lit(f).alias("freq"), F.col(f"p_{f}").alias("bar")) for f in [*short, "daily", *long] if f in freqs
    ])
    shown = rows.select(*keep, F.explode(F.filter(parts, lambda p: p["bar"].isNotNull())).alias("p"))
    stamp = F.when(F.col("p.freq").isin(*INTRADAY), F.col("decision_time")).otherwise(at_midnight("decision_time"))
    return shown.select(
        F.concat_ws("|", "decision_id", "p.freq").alias("snapshot_id"), *keep, F.col("p.freq").alias("freq"),
        stamp.alias("bar_datetime"), F.col("p.bar.*"),
    )


# ---- features of the partial bar -------------------------------------------
def feature_states(bars: DataFrame, spec: FeatureSpec = DEFAULT_SPEC, **kw) -> DataFrame:
    """Per completed bar the rolling and averaging state a following partial bar continues from."""
    frame = feature_frame(bars, spec, states=True, **kw).filter("_core")
    averages = [f"{i.id}__{p}" for i in spec.active for p in _state_parts(i)]
    averages += sorted({f"{e.x}__since" for i in spec.active for e in indicator_emas(i)})
    names = [c for c in frame.columns if c.startswith("st_")] + averages
    return frame.select(
        "symbol", "freq", "adjust", "datetime", F.col("rn").alias("st_rn"), F.col("first_close").alias("st_first_close"),
        F.col("close").alias("st_close"), F.col("turn").alias("st_turn"),
        *[F.col(n).alias(n if n.startswith("st_") else f"st_{n}") for n in names],
    )


def _state_parts(i: Indicator) -> tuple[str, ...]:
    return {
        "macd": ("fast", "slow", "dea"), "kd": ("k", "d", "low", "high"), "efi": ("2", "13", "absforce"),
        "ema_channel": ("fast", "slow"),
    }[i.kind]


def snapshot_features(snapshots: DataFrame, states: DataFrame, spec: FeatureSpec = DEFAULT_SPEC) -> DataFrame:
    """Model features of partial bars.

    ``snapshots`` carries ``stable_end_datetime``; the state of that bar is advanced by one step.
    """
    linked = snapshots.join(
        states.withColumnRenamed("datetime", "stable_end_datetime"),
        ["symbol", "freq", "adjust", "stable_end_datetime"], "left",
    )
    df = linked.withColumn("ref", usable("st_close", "open", "close"))
    seeded = safe_div("close", "ref") - 1.0
    supplied = F.coalesce("pctChg", safe_div("close", "st_close") - 1.0)
    df = df.withColumns({
        "pct": F.when(F.coalesce("st_close", F.lit(0.0)) != 0, supplied).otherwise(seeded), **price_ratios(spec),
    })
    out: dict[str, Column] = {
        "pctChg": F.col("pct"),
        **{f"ret_{n}": safe_div("close", usable(F.col(f"st_close_{n}"), "st_first_close", "close")) - 1.0 for n in RETURNS},
        "volatility_5": _deviation("st_pct_4", "pct"), "volatility_20": _deviation("st_pct_19", "pct"),
        "range_mean_20": _mean("st_range_19", "high_low_range"),
        "volume_ratio_20": safe_div("volume", usable("st_volume_mean", "volume")),
        "amount_ratio_20": safe_div("amount", usable("st_amount_mean", "amount")),
        "turn_lag1": F.col("st_turn"), "turn_ma20": F.col("st_turn_mean"),
        "turn_z20": safe_div(F.col("st_turn") - F.col("st_turn_mean"), "st_turn_std"),
        **availability(F.coalesce("st_rn", F.lit(0)) + 1, spec),
    }
    df = df.withColumns(out)
    for item in spec.active:
        df = df.withColumns(_advance(item))
        if item.kind == "kd":
            df = df.withColumn(f"{item.id}__d", _step(f"st_{item.id}__d", None, F.col(f"{item.id}__k"), 1.0 / item.params["smooth_d"]))
        if item.kind == "macd":
            dif = F.col(f"{item.id}__fast") - F.col(f"{item.id}__slow")
            df = df.withColumn(f"{item.id}__dea", _step(f"st_{item.id}__dea", None, dif, span(item.params["signal"])))
        base = F.col(f"st_{item.id}__absforce") if item.kind == "efi" else None
        mid = (F.col(f"st_{item.id}__fast") + F.col(f"st_{item.id}__slow")) / 2.0 if item.kind == "ema_channel" else None
        df = df.withColumns({n: active_at(item, c) for n, c in indicator_fields(item, base, mid).items()})
    return model_fields(df, spec, "snapshot_id", "decision_id", "symbol", "freq", "adjust", "bar_datetime")


def _step(state: str, since: str | None, x: Column, alpha: float) -> Column:
    """One step of an average; without ``since`` its input is an average itself, which is never missing once it has begun."""
    rows = F.coalesce(F.col(f"st_{since}__since"), F.lit(0)) if since else F.lit(0)
    return gap_step(F.col(state), rows, x, alpha)


def _advance(i: Indicator) -> dict[str, Column]:
    p = i.params
    if i.kind == "kd":
        low, high = F.least("low", f"st_{i.id}__low"), F.greatest("high", f"st_{i.id}__high")
        rsv = clip(safe_div_fill(F.col("close") - low, high - low, 0.5), 0.0, 1.0)
        return {f"{i.id}__k": _step(f"st_{i.id}__k", f"{i.id}__rsv", rsv, 1.0 / p["smooth_k"])}
    if i.kind == "efi":
        first = F.col("st_rn").isNull() & F.col("close").isNotNull()
        force = F.when(first, F.lit(0.0)).otherwise((F.col("close") - usable("st_close", "close")) * F.col("volume"))
        return {f"{i.id}__{n}": _step(f"st_{i.id}__{n}", f"{i.id}__force", force, span(p[part])) for n, part in (("2", "fast"), ("13", "slow"))}
    return {f"{i.id}__{part}": _step(f"st_{i.id}__{part}", "close", F.col("close"), span(p[part])) for part in ("fast", "slow")}


def _joined(tail: str, current: str) -> str:
    return f"filter(concat(coalesce({tail}, array()), array({current})), x -> x IS NOT NULL)"


def _mean(tail: str, current: str) -> Column:
    a = _joined(tail, current)
    return F.expr(f"aggregate({a}, 0D, (s, x) -> s + x) / nullif(size({a}), 0)")


def _deviation(tail: str, current: str) -> Column:
    """Sample deviation of a short array and the current value, NULL below two values."""
    a = _joined(tail, current)
    mean = f"(aggregate({a}, 0D, (s, x) -> s + x) / size({a}))"
    return F.expr(
        f"CASE WHEN size({a}) >= 2 THEN "
        f"sqrt(aggregate(transform({a}, x -> (x - {mean}) * (x - {mean})), 0D, (s, x) -> s + x) / (size({a}) - 1)) END"
    )
