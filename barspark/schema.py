"""Table schemas and the fixed values of the data model.

Timestamps are naive exchange-local times (``TIMESTAMP_NTZ``); a missing value
is always NULL, never NaN.
"""

from __future__ import annotations

SLICE = ("symbol", "freq", "adjust")
BAR_KEY = ("symbol", "datetime", "freq", "adjust")
PRICE_COLUMNS = ("open", "high", "low", "close")
NUMERIC_COLUMNS = ("open", "high", "low", "close", "volume", "amount", "pctChg")


# Schemas are DDL text, which readers and createDataFrame take as they are.
BARS = (
    "symbol STRING, datetime TIMESTAMP_NTZ, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, "
    "volume DOUBLE, amount DOUBLE, pctChg DOUBLE, source STRING, freq STRING, adjust STRING"
)
CALENDAR = ("date DATE, is_trading_day BOOLEAN, exchange STRING, source STRING")
LIQUIDITY = ("symbol STRING, date DATE, turn DOUBLE, source STRING")
STATUS = ("symbol STRING, date DATE, is_st BOOLEAN, source STRING")
DERIVED_MANIFEST = (
    "symbol STRING, base_freq STRING, target_freq STRING, adjust STRING, source STRING, "
    "base_start TIMESTAMP_NTZ, base_end TIMESTAMP_NTZ, base_rows BIGINT, base_hash BIGINT, "
    "target_rows BIGINT, generated_at TIMESTAMP_NTZ"
)
COVERAGE_MANIFEST = (
    "id STRING, symbol STRING, freq STRING, adjust STRING, source STRING, "
    "requested_start TIMESTAMP_NTZ, requested_end TIMESTAMP_NTZ, actual_start TIMESTAMP_NTZ, "
    "actual_end TIMESTAMP_NTZ, rows BIGINT, data_hash BIGINT, status STRING, downloaded_at TIMESTAMP_NTZ"
)
REPLAY_EVENTS = (
    "seq BIGINT, kind STRING, time TIMESTAMP_NTZ, stage STRING, symbol STRING, "
    "bar STRUCT<open: DOUBLE, high: DOUBLE, low: DOUBLE, close: DOUBLE, volume: DOUBLE, amount: DOUBLE>, "
    "fills ARRAY<STRUCT<side: STRING, status: STRING, reason: STRING, shares: DOUBLE, price: DOUBLE, fee: DOUBLE>>, "
    "nav DOUBLE"
)

# Base rows in one full period.
ROWS_FROM_5MIN = {"5min": 1, "15min": 3, "30min": 6, "60min": 12, "daily": 48, "weekly": 240, "monthly": 1008}
ROWS_FROM_DAILY = {"daily": 1, "weekly": 5, "monthly": 21}
MINUTES = {"5min": 5, "15min": 15, "30min": 30, "60min": 60}
FREQUENCIES = ("5min", "15min", "30min", "60min", "daily", "weekly", "monthly")
INTRADAY = tuple(MINUTES)

# Bars per model sequence.
SEQUENCE_WINDOWS = {"5min": 96, "15min": 64, "30min": 48, "60min": 32, "daily": 60, "weekly": 26, "monthly": 12}

# Field name -> clip bounds, in channel order.
MARKET_CLIP = {
    "pctChg": (-0.3, 0.3),
    "log_ret": (-0.3, 0.3),
    "open_close_ret": (-0.3, 0.3),
    "gap_ret": (-0.3, 0.3),
    "high_low_range": (0.0, 0.5),
    "body_range": (0.0, 0.5),
    "close_position": (-1.0, 2.0),
    "upper_shadow": (0.0, 0.5),
    "lower_shadow": (0.0, 0.5),
    "ret_3": (-0.5, 0.5),
    "ret_5": (-0.5, 0.5),
    "ret_10": (-0.8, 0.8),
    "ret_20": (-1.0, 1.0),
    "volatility_5": (0.0, 0.3),
    "volatility_20": (0.0, 0.3),
    "range_mean_20": (0.0, 0.5),
    "volume_ratio_20": (0.0, 20.0),
    "amount_ratio_20": (0.0, 20.0),
    "turn_lag1": (0.0, 100.0),
    "turn_ma20": (0.0, 100.0),
    "turn_z20": (-5.0, 5.0),
}
# Clip bounds of the fields an indicator of each kind produces.
INDICATOR_CLIP = {
    "macd": {"dif_pct": (-0.3, 0.3), "dea_pct": (-0.3, 0.3), "hist_pct": (-0.3, 0.3)},
    "kd": {"k_norm": (0.0, 1.0), "d_norm": (0.0, 1.0), "diff_norm": (-1.0, 1.0)},
    "efi": {"2_norm": (-10.0, 10.0), "13_norm": (-10.0, 10.0)},
    "ema_channel": {"position": (-5.0, 5.0), "gap": (-0.5, 0.5), "width": (0.0, 1.0), "slope": (-0.3, 0.3)},
}
AVAILABILITY_CLIP = {"history_coverage": (0.0, 1.0), "sequence_valid_ratio": (0.0, 1.0), "progress": (0.0, 1.0)}
CONTEXT_FIELDS = (
    "bar_slot_norm", "day_progress", "is_morning_session", "is_afternoon_session",
    "minutes_to_close_norm", "is_open_auction",
)
CONSTRAINT_FIELDS = (
    "market_can_buy", "market_can_sell", "is_tradeable", "is_limit_up", "is_limit_down", "is_zero_volume",
)
DECISION_COLUMNS = (
    "decision_id", "symbol", "adjust", "decision_time", "stage", "execution_price", "limit_reference_close",
    "visible_bar_end", "source_bar_end", "is_st", "status_known", "has_limit_reference", "limit_pct",
    "market_can_buy", "market_can_sell", "is_tradeable", "is_limit_up", "is_limit_down", "is_zero_volume",
)
OPEN_AUCTION, BAR_CLOSE = "open_auction", "bar_close"
