"""Reading bars, calendars, facts, lists and events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clean_symbol, range_filter, same_or_blank
from ..operators.normalize import keep_last, normalize_bars
from ..schema import BARS, CALENDAR, LIQUIDITY, REPLAY_EVENTS, STATUS

SCHEMAS = {"bars": BARS, "calendar": CALENDAR, "liquidity": LIQUIDITY, "status": STATUS}


def read_table(spark: SparkSession, path: str | Sequence[str], kind: str) -> DataFrame:
    """A stored table with its full schema: missing columns are NULL, files removed meanwhile are skipped.

    The schema is given, so no file is opened to infer it.
    """
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.schema(SCHEMAS[kind]).option("ignoreMissingFiles", "true").parquet(*paths)


def scan_bars(bars: DataFrame, *, symbol: str | None = None, symbols=None, start: str | None = None, end: str | None = None,
              freq: str | None = None, adjust: str | None = None) -> DataFrame:
    """Bars by any of the predicates; all of them reach the Parquet scan or prune partitions.

    ``symbols`` is a list or a DataFrame with a ``symbol`` column.
    """
    cond: list[Column] = []
    if symbol is not None:
        cond.append(F.col("symbol") == symbol.strip().upper())
    if freq is not None:
        cond.append(F.col("freq") == freq if freq else same_or_blank("freq", freq))
    if adjust is not None:
        cond.append(F.col("adjust") == adjust if adjust else same_or_blank("adjust", adjust))
    if start is not None or end is not None:
        cond.append(range_filter("datetime", start, end))
    out = bars
    for c in cond:
        out = out.filter(c)
    if symbols is None:
        return out
    if isinstance(symbols, DataFrame):
        return out.join(symbols.select(clean_symbol("symbol").alias("symbol")).distinct(), ["symbol"], "left_semi")
    return out.filter(F.col("symbol").isin(*[s.strip().upper() for s in symbols]))


def scan_slices(bars: DataFrame, catalog: DataFrame, *, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of the catalog's slices only; the join prunes partitions at run time."""
    keys = ["symbol", "freq", "adjust"]
    return bars.filter(range_filter("datetime", start, end)).join(catalog.select(*keys).distinct(), keys, "left_semi")


def scan_calendar(calendar: DataFrame, *, start: str | None = None, end: str | None = None, exchange: str | None = None) -> DataFrame:
    out = calendar
    if start:
        out = out.filter(F.col("date") >= F.lit(start[:10]).cast("date"))
    if end:
        out = out.filter(F.col("date") <= F.lit(end[:10]).cast("date"))
    return out if exchange is None else out.filter(F.col("exchange") == exchange)


def scan_facts(facts: DataFrame, *, symbols=None, start: str | None = None, end: str | None = None) -> DataFrame:
    out = scan_calendar(facts, start=start, end=end)
    return out if symbols is None else scan_bars(out, symbols=symbols)


def read_bar_csv(spark: SparkSession, path: str, *, source: str, freq: str, adjust: str, symbol: str | None = None) -> DataFrame:
    """A CSV file or directory with a header, normalised; every column is read as text, so nothing is inferred."""
    return normalize_bars(spark.read.csv(path, header=True), source=source, freq=freq, adjust=adjust, symbol=symbol)


def read_parts(spark: SparkSession, paths: Sequence[str], kind: str = "bars") -> DataFrame:
    """Several Parquet locations as one table; those that do not exist are left out."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def there(p: str) -> bool:
        target = jvm.org.apache.hadoop.fs.Path(p)
        return target.getFileSystem(conf).globStatus(target) is not None and target.getFileSystem(conf).exists(target)

    found = [p for p in paths if there(p)]
    if not found:
        return spark.createDataFrame([], SCHEMAS[kind])
    return read_table(spark, found, kind)


def read_symbol_list(spark: SparkSession, path: str) -> DataFrame:
    """One symbol per line; blank lines and ``#`` comments are dropped."""
    line = clean_symbol(F.substring_index("value", "#", 1))
    return spark.read.text(path).select(line.alias("symbol")).filter("symbol <> ''")


def read_events(spark: SparkSession, path: str, *, after: int = 0, limit: int | None = None, schema: str = REPLAY_EVENTS) -> DataFrame:
    """Replay events in order; lines that do not parse are skipped. ``limit`` pages through them."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).filter(F.col("seq") > after)
    return rows if limit is None else rows.orderBy("seq").limit(limit)


def latest_rows(df: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    return keep_last(df, keys, sequence)
