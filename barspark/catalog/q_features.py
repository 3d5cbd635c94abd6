"""Window features and indicators."""

from pyspark.sql import functions as F

from ..operators.asof import as_of
from ..operators.features import bar_features, display_lines, feature_frame
from ..operators.snapshot import feature_states, snapshot_features
from ..operators import charts as G
from ..plans.dataset import with_turnover
from ..plans.registry import DEFAULT_INDICATORS, DEFAULT_SPEC, compile_blueprint, spec_from_config
from . import inputs as I
from .inputs import with_inputs
from .registry import query, rounded

_EMAS = {"f12": ("close", "2.0/13"), "s26": ("close", "2.0/27"), "k": ("rsv", "1.0/3"), "e2": ("force", "2.0/3"), "e13": ("force", "2.0/14"),
         "f13": ("close", "2.0/14"), "s21": ("close", "2.0/22"), "f144": ("close", "2.0/145"), "s169": ("close", "2.0/170")}


def feature_ctes(source: str, window: int) -> str:
    """Features of ``source`` (symbol, datetime, OHLCV, pct, turn) in SQL; the averages by recursion over row numbers."""
    steps = ", ".join(f"r.{n} + CAST({a} AS DOUBLE) * (x.{c} - r.{n}) AS {n}" for n, (c, a) in _EMAS.items())
    nxt = {n: f"(r.{n} + CAST({a} AS DOUBLE) * (x.{c} - r.{n}))" for n, (c, a) in _EMAS.items()}
    first = ", ".join(f"{c} AS {n}" for n, (c, _) in _EMAS.items())
    seq = "OVER (PARTITION BY symbol ORDER BY datetime{})"
    w, t20, p20 = seq.format(""), seq.format(" ROWS 19 PRECEDING"), seq.format(" ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING")
    t5, t9 = seq.format(" ROWS 4 PRECEDING"), seq.format(" ROWS 8 PRECEDING")
    channels = ""
    for name, f, s in (("13_21", "f13", "s21"), ("144_169", "f144", "s169")):
        hi, lo, mid = f"greatest({f}, {s})", f"least({f}, {s})", f"(({f} + {s}) / 2)"
        width = f"(CASE WHEN {hi} - {lo} > abs({mid}) * 1e-12 THEN {hi} - {lo} ELSE 0.0 END)"
        prev = f"lag({mid}) {w}"
        channels += f"""
  CASE WHEN {width} = 0 THEN 0.5 ELSE (close - {lo}) / {width} END AS ema_channel_{name}_position,
  close / nullif({mid}, 0) - 1 AS ema_channel_{name}_gap, coalesce({width} / nullif({mid}, 0), 0) AS ema_channel_{name}_width,
  coalesce({mid} / nullif({prev}, 0), 1.0) - 1 AS ema_channel_{name}_slope,"""
    return f""", x0 AS (SELECT *, row_number() {w} AS rn, lag(close) {w} AS pc, first_value(close) {w} AS fc FROM {source}),
x1 AS (SELECT *, coalesce(nullif(pc, 0), nullif(open, 0), close) AS ref, (close - coalesce(nullif(pc, 0), close)) * volume AS force,
  min(low) {t9} AS l9, max(high) {t9} AS h9 FROM x0),
x AS MATERIALIZED (SELECT *, CASE WHEN coalesce(pc, 0) <> 0 THEN coalesce(pct, close / nullif(pc, 0) - 1) ELSE close / nullif(ref, 0) - 1 END AS p,
  (high - low) / nullif(ref, 0) AS hl, CASE WHEN h9 = l9 THEN 0.5 ELSE least(greatest((close - l9) / (h9 - l9), 0), 1) END AS rsv FROM x1),
r AS (SELECT * FROM (WITH RECURSIVE r AS (
  SELECT symbol, rn, {first}, 0.0::DOUBLE AS dea, rsv AS d FROM x WHERE rn = 1
  UNION ALL SELECT x.symbol, x.rn, {steps}, r.dea + 0.2::DOUBLE * ({nxt['f12']} - {nxt['s26']} - r.dea) AS dea,
    r.d + CAST(1.0/3 AS DOUBLE) * ({nxt['k']} - r.d) AS d
  FROM r JOIN x ON x.symbol = r.symbol AND x.rn = r.rn + 1) SELECT * FROM r)),
feat AS (SELECT symbol, datetime, freq, adjust, f12, s26, dea, k, d, e2, e13, f13, s21, f144, s169,
  p AS "pctChg", ln(close / nullif(ref, 0)) AS log_ret, close / nullif(open, 0) - 1 AS open_close_ret, open / nullif(ref, 0) - 1 AS gap_ret,
  hl AS high_low_range, abs(close - open) / nullif(ref, 0) AS body_range,
  CASE WHEN high = low THEN 0.5 ELSE (close - low) / (high - low) END AS close_position,
  (high - greatest(open, close)) / nullif(ref, 0) AS upper_shadow, (least(open, close) - low) / nullif(ref, 0) AS lower_shadow,
  {", ".join(f"close / coalesce(nullif(lag(close, {n}) {w}, 0), fc) - 1 AS ret_{n}" for n in (3, 5, 10, 20))},
  stddev_samp(p) {t5} AS volatility_5, stddev_samp(p) {t20} AS volatility_20, avg(hl) {t20} AS range_mean_20,
  volume / nullif(coalesce(nullif(avg(volume) {p20}, 0), volume), 0) AS volume_ratio_20,
  amount / nullif(coalesce(nullif(avg(amount) {p20}, 0), amount), 0) AS amount_ratio_20,
  lag(turn) {w} AS turn_lag1, avg(turn) {p20} AS turn_ma20,
  (lag(turn) {w} - avg(turn) {p20}) / nullif(stddev_samp(turn) {p20}, 0) AS turn_z20,
  (f12 - s26) / nullif(close, 0) AS macd_dif_pct, dea / nullif(close, 0) AS macd_dea_pct, (f12 - s26 - dea) / nullif(close, 0) AS macd_hist_pct,
  k AS kd_k_norm, d AS kd_d_norm, k - d AS kd_diff_norm,
  e2 / nullif(avg(abs(force)) {p20}, 0) AS efi2_norm, e13 / nullif(avg(abs(force)) {p20}, 0) AS efi13_norm,{channels}
  least(rn / 169.0, 1.0) AS history_coverage, least(rn / {window}.0, 1.0) AS sequence_valid_ratio, 1.0 AS progress
  FROM x JOIN r USING (symbol, rn))"""


def feature_sql(inputs: list[str], source: str, window: int, body: str = "") -> str:
    cols = ",\n  ".join(
        f'round(least(greatest(CAST(coalesce("{n}", 0) AS DOUBLE), {lo}), {hi}), 6) + 0.0 AS "{n}"' for n, (lo, hi) in DEFAULT_SPEC.market_clip.items()
    )
    return with_inputs(*inputs, body=f"{body}{feature_ctes(source, window)}\nSELECT symbol, datetime, freq, adjust, {cols} FROM feat")


_PLAIN = ", src AS (SELECT *, CAST(NULL AS DOUBLE) AS pct, CAST(NULL AS DOUBLE) AS turn FROM {})"
_TURN = """, src AS (SELECT d.*, CAST(NULL AS DOUBLE) AS pct, l.turn FROM daily d LEFT JOIN liquidity l ON l.symbol = d.symbol
  AND l.date = d.datetime::DATE)"""


@query("bar_features_5min", "B14 B15 B16 D2 D3 D4 D5 D6 D8 D9 D10 D11 D12 D13 D14 D15", feature_sql(["bars"], "src", 96, _PLAIN.format("bars")))
def _(spark, sf):
    return rounded(bar_features(I.bars_5min(spark, sf), gaps=False))


@query("bar_features_daily_history", "D2 D3 D4 D5 D6 D8 D9 D10 D11 D12 D13 D14 D15", feature_sql(["long"], "src", 60, _PLAIN.format("long")))
def _(spark, sf):
    return rounded(bar_features(I.bars_daily_long(spark, sf), gaps=False, one_per_day=True))


@query("bar_features_with_turnover", "D7 D15 E1", feature_sql(["daily", "liquidity"], "src", 60, _TURN))
def _(spark, sf):
    return rounded(bar_features(with_turnover(I.bars_daily(spark, sf), I.liquidity(spark, sf)), gaps=False))


def _lines(spark, bars, *ids, gaps=False, one_per_day=False):
    spec = spec_from_config([{"id": i.id, "kind": i.kind, "params": dict(i.params), "frequencies": ["5min", "daily"]} for i in DEFAULT_INDICATORS if i.id in ids])
    frame = feature_frame(bars, spec, gaps=gaps, one_per_day=one_per_day).filter("_core")
    return frame.select("symbol", "datetime", *[c.alias(n) for i in spec.active for n, c in display_lines(frame, i).items()])


@query("average_lines", "D8 D12", with_inputs("bars", body=_PLAIN.format("bars") + feature_ctes("src", 96) + """
SELECT symbol, datetime, round(f13, 6) AS "13_21_fast", round(s21, 6) AS "13_21_slow", round(f144, 6) AS "144_169_fast",
  round(s169, 6) AS "144_169_slow" FROM feat"""))
def _(spark, sf):
    return rounded(_lines(spark, I.bars_5min(spark, sf), "13_21", "144_169"))


_HOLES = "day(datetime) % 5 = 2 OR minute(datetime) % 35 = 0"
_AVERAGES = {"13_21_fast": 13, "13_21_slow": 21, "144_169_fast": 144, "144_169_slow": 169}
_GAP_STEPS = ", ".join(f"CASE WHEN x.c IS NULL THEN r.e{n} WHEN r.e{n} IS NULL THEN x.c ELSE (pow(1 - 2.0::DOUBLE / {n + 1}, r.k + 1) * r.e{n} + 2.0::DOUBLE / {n + 1} * x.c) / (pow(1 - 2.0::DOUBLE / {n + 1}, r.k + 1) + 2.0::DOUBLE / {n + 1}) END AS e{n}" for n in _AVERAGES.values())


@query("average_lines_over_missing_prices", "D8 D12", with_inputs("bars", body=f"""
, x AS MATERIALIZED (SELECT symbol, datetime, CASE WHEN {_HOLES} THEN NULL ELSE close END AS c, row_number() OVER (PARTITION BY symbol ORDER BY datetime) AS rn FROM bars),
r AS (SELECT * FROM (WITH RECURSIVE r AS (SELECT symbol, rn, 0::BIGINT AS k, {", ".join(f"c AS e{n}" for n in _AVERAGES.values())} FROM x WHERE rn = 1
  UNION ALL SELECT x.symbol, x.rn, CASE WHEN x.c IS NULL THEN r.k + 1 ELSE 0 END, {_GAP_STEPS} FROM r JOIN x ON x.symbol = r.symbol AND x.rn = r.rn + 1) SELECT * FROM r))
SELECT symbol, datetime, round(e13, 6) AS "13_21_fast", round(e21, 6) AS "13_21_slow", round(e144, 6) AS "144_169_fast", round(e169, 6) AS "144_169_slow" FROM x JOIN r USING (symbol, rn)"""))
def _(spark, sf):
    """Single prices and whole days are missing; averages hold and step over them."""
    hole = (F.dayofmonth("datetime") % 5 == 2) | (F.minute("datetime") % 35 == 0)
    bars = I.bars_5min(spark, sf)
    return rounded(_lines(spark, bars.withColumn("close", F.when(~hole, F.col("close"))), "13_21", "144_169", gaps=True))


@query("partial_bar_features", "D21 I10", feature_sql(["bars"], "src", 96, _PLAIN.format("bars")))
def _(spark, sf):
    """Every bar as the partial bar after the one before it: its features are those of the completed bar."""
    bars = I.bars_5min(spark, sf)
    known = I.bars_5min(spark, sf).select("symbol", "datetime")
    snaps = as_of(bars, known.select("symbol", "datetime", F.col("datetime").alias("stable_end_datetime")), ["symbol"], left_time="datetime", right_time="datetime", take=["stable_end_datetime"], strict=True)
    snaps = snaps.withColumnRenamed("datetime", "bar_datetime").withColumns({
        "pctChg": F.lit(None).cast("double"), "turn": F.lit(None).cast("double"), "progress": F.lit(1.0), "snapshot_id": F.lit(""), "decision_id": F.lit("")})
    out = snapshot_features(snaps, feature_states(bars, gaps=False)).withColumnRenamed("bar_datetime", "datetime")
    return rounded(out.select("symbol", "datetime", "freq", "adjust", *DEFAULT_SPEC.market_fields))


@query("macd_lines", "D9", with_inputs("long", body=_PLAIN.format("long") + feature_ctes("src", 60) + """
SELECT symbol, datetime, round(macd_dif_pct, 6) + 0.0 AS macd_dif_pct, round(macd_dea_pct, 6) + 0.0 AS macd_dea_pct,
  round(macd_hist_pct, 6) + 0.0 AS macd_hist_pct FROM feat"""))
def _(spark, sf):
    return rounded(_lines(spark, I.bars_daily_long(spark, sf), "macd", one_per_day=True))


@query("kd_lines", "D10", with_inputs("long", body=_PLAIN.format("long") + feature_ctes("src", 60) + """
SELECT symbol, datetime, round(k, 6) AS kd_k_norm, round(d, 6) AS kd_d_norm, round(k - d, 6) + 0.0 AS kd_diff_norm FROM feat"""))
def _(spark, sf):
    return rounded(_lines(spark, I.bars_daily_long(spark, sf), "kd", one_per_day=True))


@query("force_lines", "D11", with_inputs("bars", body=_PLAIN.format("bars") + feature_ctes("src", 96) + """
SELECT symbol, datetime, round(e2, 6) + 0.0 AS efi2, round(e13, 6) + 0.0 AS efi13 FROM feat"""))
def _(spark, sf):
    return rounded(_lines(spark, I.bars_5min(spark, sf), "efi"))


@query("running_peak_and_drawdown", "D20", with_inputs("nav", body="""
SELECT strategy, date::TIMESTAMP AS date, round(max(nav) OVER w / 1e6, 6) AS peak, round(nav / max(nav) OVER w - 1, 6) + 0.0 AS drawdown FROM nav
WINDOW w AS (PARTITION BY strategy ORDER BY date)"""))
def _(spark, sf):
    from ..operators.evaluation import drawdown

    out = drawdown(I.nav(spark, sf)).select("strategy", "date", (F.col("peak") / 1e6).alias("peak"), "drawdown")
    return rounded(out)


@query("gaps_between_bars", "D19", with_inputs("long", body="""
SELECT symbol, count(*) AS gaps, max(g) AS widest FROM (SELECT symbol, date_diff('day', lag(datetime) OVER (PARTITION BY symbol, freq, adjust
  ORDER BY datetime), datetime) AS g FROM long) WHERE g > 5 GROUP BY symbol"""))
def _(spark, sf):
    from ..operators.quality import calendar_gaps

    gaps = calendar_gaps(I.bars_daily_long(spark, sf), 5)
    return gaps.groupBy("symbol").agg(F.count("*").alias("gaps"), F.max("gap_days").cast("bigint").alias("widest"))


@query("custom_indicator_set", "I19", with_inputs("bars", body=_PLAIN.format("bars") + feature_ctes("src", 96) + """
SELECT symbol, datetime, round(least(greatest(ema_channel_13_21_gap, -0.5), 0.5), 6) + 0.0 AS ema_channel_short_gap, round(least(rn / 21.0, 1.0), 6) AS history_coverage,
  0.0::DOUBLE AS my_k_norm FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY datetime) AS rn FROM feat)"""))
def _(spark, sf):
    """Another registry: one channel at 5 minutes, an oscillator that is off at this frequency."""
    spec = spec_from_config([
        {"id": "short", "kind": "ema_channel", "params": {"fast": 13, "slow": 21}, "frequencies": ["5min"]},
        {"id": "my", "kind": "kd", "params": {"lookback": 9, "smooth_k": 3, "smooth_d": 3}, "frequencies": ["daily"]},
        {"id": "off", "kind": "macd", "params": {"fast": 3, "slow": 6, "signal": 2}, "frequencies": ["5min"], "enabled": False},
    ])
    out = bar_features(I.bars_5min(spark, sf), spec, gaps=False)
    return rounded(out.select("symbol", "datetime", "ema_channel_short_gap", "history_coverage", "my_k_norm"))


@query("blueprint_channels", "I20 H13", with_inputs("bars", body=_PLAIN.format("bars") + feature_ctes("src", 96) + """
SELECT symbol, datetime, round(CAST(CAST(least(greatest(ret_3, -0.5), 0.5) AS FLOAT) AS DOUBLE), 5) + 0.0 AS c0,
  round(CAST(CAST(k AS FLOAT) AS DOUBLE), 5) + 0.0 AS c1 FROM feat"""))
def _(spark, sf):
    """A two-channel blueprint applied as an ordered array."""
    model = compile_blueprint([
        {"type": "comment", "text": "two channels"},
        {"name": "ret_3", "stream": "market_sequence", "frequencies": ["5min"]},
        {"name": "kd_k_norm", "stream": "market_sequence", "frequencies": ["5min"]},
        {"name": "ret_5", "stream": "market_sequence", "frequencies": ["5min"], "enabled": False},
    ])
    out = bar_features(I.bars_5min(spark, sf), gaps=False).select("symbol", "datetime", model.channel_array("5min").alias("v"))
    return rounded(out.select("symbol", "datetime", F.col("v")[0].cast("double").alias("c0"), F.col("v")[1].cast("double").alias("c1")), 5)


@query("indicator_chart_window", "F9 I21", with_inputs("long", body=_PLAIN.format("long") + feature_ctes("src", 60) + """
, tail AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY datetime DESC) AS back FROM feat)
SELECT symbol, datetime, round(f13, 6) AS "13_21_fast", round(s21, 6) AS "13_21_slow",
  round(least(greatest(ema_channel_13_21_gap, -0.5), 0.5), 6) + 0.0 AS ema_channel_13_21_gap FROM tail WHERE back <= 40"""))
def _(spark, sf):
    """The last 40 bars per symbol, computed with warm-up rows before them that are then cut off."""
    item = next(i for i in DEFAULT_INDICATORS if i.id == "13_21")
    out = G.indicator_window(I.bars_daily_long(spark, sf), item, rows=40, warmup=None, gaps=False, one_per_day=True)
    return rounded(out.select("symbol", "datetime", "13_21_fast", "13_21_slow", "ema_channel_13_21_gap"))


@query("bar_window_summary", "I22", with_inputs("long", body="""
, tail AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY datetime DESC) AS back, count(*) OVER (PARTITION BY symbol) AS n FROM long)
SELECT symbol, max(datetime) AS latest, round(max(close) FILTER (back = 1), 8) AS close, round(max(close) FILTER (back = 2), 8) AS previous_close,
  round(max(close) FILTER (back = 1) / nullif(max(close) FILTER (back = 2), 0) - 1, 8) + 0.0 AS change,
  round(max(high), 8) AS window_high, round(min(low), 8) AS window_low, max(n) > 60 AS has_more_before, count(*) AS rows
FROM tail WHERE back <= 60 GROUP BY symbol"""))
def _(spark, sf):
    return rounded(G.window_summary(I.bars_daily_long(spark, sf), rows=60), 8)
