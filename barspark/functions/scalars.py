"""Column functions: arithmetic guards, codes, session clock, price limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import INTRADAY


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- arithmetic -----------------------------------------------------------
def safe_div(num, den) -> Column:
    """Quotient, NULL on a zero or missing denominator."""
    return col(num) / F.nullif(col(den), F.lit(0.0))


def safe_div_fill(num, den, fill: float) -> Column:
    """Quotient, ``fill`` on a zero or missing denominator (a missing numerator stays NULL)."""
    d = F.nullif(col(den), F.lit(0.0))
    return F.when(d.isNull(), F.lit(float(fill))).otherwise(col(num) / d)


def usable(value, *fallbacks) -> Column:
    """First of the values that is neither NULL nor zero; the last one is taken as it is."""
    parts = [col(value), *map(col, fallbacks)]
    return F.coalesce(*[F.nullif(p, F.lit(0.0)) for p in parts[:-1]], parts[-1])


def clip(c, low: float, high: float) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


def finite_or(c, default: float = 0.0) -> Column:
    """The value, or ``default`` where it is NULL, NaN or infinite."""
    c = col(c)
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.lit(float(default))).otherwise(c)


def is_bad_number(c) -> Column:
    c = col(c)
    return c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))


def log_return(value, previous) -> Column:
    v, p = col(value), col(previous)
    return F.when((v > 0) & (p > 0), F.log(v / p)).otherwise(F.lit(0.0))


# ---- time -----------------------------------------------------------------
def at_midnight(c) -> Column:
    return F.to_date(col(c)).cast("timestamp_ntz")


def week_start(c) -> Column:
    return F.trunc(F.to_date(col(c)), "week")


def month_start(c) -> Column:
    return F.trunc(F.to_date(col(c)), "month")


def period_start(c, freq: str) -> Column:
    """First day of the period a timestamp falls into, as a date."""
    return {"weekly": week_start, "monthly": month_start}.get(freq, lambda x: F.to_date(col(x)))(c)


def minutes(n) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(n) if isinstance(n, int) else n, F.lit(0))


def naive_micros(c) -> Column:
    """Microseconds since 1970 of a naive timestamp, whatever the session time zone is."""
    c = col(c)
    of_day = F.hour(c) * 3600 + F.minute(c) * 60
    second = (F.extract(F.lit("SECOND"), c) * 1000000).cast("bigint")
    return F.unix_date(F.to_date(c)).cast("bigint") * 86400000000 + of_day.cast("bigint") * 1000000 + second


def range_filter(c, start: str | None = None, end: str | None = None) -> Column:
    """Inclusive range; a 10-character end date includes the whole day."""
    c, cond = col(c), F.lit(True)
    if start is not None:
        cond = cond & (c >= F.lit(start).cast("timestamp_ntz"))
    if end is not None and len(end.strip()) <= 10:
        cond = cond & (c < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    elif end is not None:
        cond = cond & (c <= F.lit(end).cast("timestamp_ntz"))
    return cond


def same_or_blank(c, value: str | None) -> Column:
    """Equality in which NULL and the empty string are the same."""
    return F.coalesce(col(c), F.lit("")) == F.lit(value or "")


def elapsed_minutes(c) -> Column:
    """Trading minutes since 09:30 with the lunch break taken out, 0 to 240."""
    m = F.hour(col(c)) * 60 + F.minute(col(c))
    return (
        F.when(m <= 570, 0).when(m <= 690, m - 570).when(m < 780, 120).when(m <= 900, m - 780 + 120).otherwise(240)
    )


# ---- codes ----------------------------------------------------------------
# Spellings read as true.
TRUE_WORDS = ("1", "true", "t", "yes", "y", "open")
# Short frequency names.
FREQ_ALIASES = {
    "5": "5min", "15": "15min", "30": "30min", "60": "60min",
    "d": "daily", "1d": "daily", "w": "weekly", "1w": "weekly", "m": "monthly", "1m": "monthly",
}


def truthy(c) -> Column:
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def clean_symbol(c) -> Column:
    return F.upper(F.trim(F.translate(col(c), "﻿", "")))


def frequency_name(c) -> Column:
    key = F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    table = F.create_map(*[F.lit(x) for pair in FREQ_ALIASES.items() for x in pair])
    return F.coalesce(table[key], key)


# Exchange spellings accepted after the code.
EXCHANGE_WORDS = {"SH": "sh", "SSE": "sh", "SZ": "sz", "SZSE": "sz"}


def to_provider_symbol(c) -> Column:
    """``000001.SZ`` -> ``sz.000001``; bare six digits take their exchange from the first digit; invalid -> NULL."""
    s = clean_symbol(c)
    names = F.create_map(*[F.lit(x) for pair in EXCHANGE_WORDS.items() for x in pair])
    bare = F.regexp_extract(s, r"^(\d{6})$", 1)
    prefixed = F.regexp_extract(s, r"^(?:SH|SZ)\.(\d{6})$", 1)
    suffixed = F.regexp_extract(s, r"^(\d{6})\.([A-Z]+)$", 1)
    exchange = names[F.regexp_extract(s, r"^(\d{6})\.([A-Z]+)$", 2)]
    return (
        F.when(prefixed != "", F.lower(s))
        .when((suffixed != "") & exchange.isNotNull(), F.concat_ws(".", exchange, suffixed))
        .when(bare != "", F.concat_ws(".", F.when(bare.rlike("^[69]"), "sh").otherwise("sz"), bare))
    )


def from_provider_symbol(c) -> Column:
    """``sz.000001`` -> ``000001.SZ``; anything else is only cleaned."""
    s = clean_symbol(c)
    market = F.regexp_extract(s, r"^(SH|SZ)\.", 1)
    return F.when(market != "", F.concat_ws(".", F.substring(s, 4, 100), market)).otherwise(s)


def symbol_bucket(c, buckets: int = 1000) -> Column:
    """Stable zero-padded bucket from the first eight hex digits of sha1."""
    head = F.conv(F.substring(F.sha1(F.upper(F.trim(col(c)))), 1, 8), 16, 10).cast("bigint")
    return F.lpad((head % buckets).cast("string"), len(str(buckets - 1)), "0")


def price_limit_pct(symbol, is_st) -> Column:
    """Daily price limit by board prefix; special-treatment names are at 5%."""
    code = F.substring_index(F.upper(F.coalesce(col(symbol), F.lit(""))), ".", 1)
    return (
        F.when(col(is_st), 0.05)
        .when(code.rlike("^(688|689|300|301)"), 0.20)
        .when(code.rlike("^(8|4|920)"), 0.30)
        .otherwise(0.10)
    )


def board_group(symbol) -> Column:
    s = col(symbol)
    market = F.when(F.instr(s, ".") > 0, F.element_at(F.split(s, r"\."), -1)).otherwise("")
    return (
        F.when(market == "BJ", "beijing")
        .when(s.startswith("688"), "star")
        .when(s.rlike("^(300|301)"), "chinext")
        .when(market == "", "other")
        .otherwise(F.lower(market))
    )


def row_id(symbol, freq, adjust, ts) -> Column:
    return F.concat_ws("|", col(symbol), col(freq), col(adjust), F.date_format(col(ts), "yyyyMMddHHmmss"))


def decision_id(symbol, adjust, ts, stage) -> Column:
    return F.concat_ws("|", col(symbol), col(adjust), F.date_format(col(ts), "yyyyMMddHHmmss"), col(stage))


def is_intraday(freq) -> Column:
    return col(freq).isin(*INTRADAY)


# Bars per business day, and days a slice may start late or end early.
BARS_PER_DAY = {"5min": 48.0, "15min": 16.0, "30min": 8.0, "60min": 4.0, "daily": 1.0, "weekly": 1 / 5, "monthly": 1 / 21}
BOUNDARY_DAYS = {"weekly": 10, "monthly": 31}


def lookup(table: dict, key, default) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(pairs[col(key)], F.lit(default))


def expected_minimum_rows(freq, start, end, share: float = 0.75) -> Column:
    """Rows a slice should at least hold: business days times bars per day times ``share``, never below one."""
    days = F.greatest(business_days(start, end), F.lit(1))
    rows = F.floor(days * lookup(BARS_PER_DAY, freq, 1.0) * share).cast("bigint")
    return F.when(col(end) < col(start), F.lit(1)).otherwise(F.greatest(F.lit(1), rows)).cast("bigint")


def business_days(start, end) -> Column:
    """Weekdays in the inclusive date range, in closed form."""
    s, e = F.to_date(col(start)), F.to_date(col(end))

    def until(d):  # weekdays from a Monday epoch up to and including d
        n = F.datediff(d, F.lit("1970-01-05").cast("date")) + 1
        weeks = F.floor(n / 7)
        return weeks * 5 + F.least(n - weeks * 7, F.lit(5))

    return F.greatest(until(e) - until(F.date_sub(s, 1)), F.lit(0)).cast("bigint")


def stamp_text(ts) -> Column:
    """A time as yyyy-MM-dd HH:mm:ss."""
    return F.date_format(col(ts), "yyyy-MM-dd HH:mm:ss")


def iso_text(ts) -> Column:
    """A time as ISO text; fractions only where there are any."""
    micros = F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.regexp_replace(micros, r"\.000000$", "")


def stamp_value(text) -> Column:
    """The time in a text of either form; NULL where it is none."""
    return F.try_to_timestamp(F.regexp_replace(col(text), "T", " ")).cast("timestamp_ntz")
