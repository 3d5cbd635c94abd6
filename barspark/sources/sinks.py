"""Writing: upserts, deletes, exports, reports.

An upsert is an anti join and a union. On files it writes the months that it changes beside the table and then swaps the table's
version (``store``), so losing an executor or the driver leaves either the old or the new rows.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import safe_div, usable
from ..operators.bars import refresh_pct_chg
from ..operators.normalize import keep_last, storage_bars
from ..operators.series import running, time_chunk
from ..plans.staging import staged
from ..schema import BAR_KEY, SLICE
from .store import Change, Store, batch_done, batch_note

BAR_PARTITIONS = ("freq", "adjust", "month")


def upsert(base: DataFrame, incoming: DataFrame, keys: Sequence[str], *, sequence: str | None = None) -> DataFrame:
    """``base`` with ``incoming`` rows added or put in place of those with the same key.

    With ``sequence`` repeated incoming keys keep the row with the highest value.
    """
    new = keep_last(incoming, keys, sequence).drop(sequence) if sequence else incoming
    return base.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_bars(base: DataFrame, incoming: DataFrame, *, sequence: str, replace_symbols: bool = False) -> DataFrame:
    """Bars after an upsert, with pctChg recomputed over every slice it touches.

    ``replace_symbols`` first drops all rows of the incoming symbols.
    """
    new = keep_last(storage_bars(incoming), list(BAR_KEY), sequence).drop(sequence)
    old = base.join(new.select("symbol").distinct(), ["symbol"], "left_anti") if replace_symbols else base
    merged = upsert(old, new, BAR_KEY)
    touched = new.select(*SLICE).distinct()
    fresh = refresh_pct_chg(merged.join(touched, list(SLICE), "left_semi"))
    return merged.join(touched, list(SLICE), "left_anti").unionByName(fresh.select(*merged.columns))


def with_month(bars: DataFrame) -> DataFrame:
    return bars.withColumn("month", F.date_format("datetime", "yyyy-MM"))


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Bars partitioned by frequency, adjustment and month, sorted so that symbol filters skip row groups."""
    order = [*BAR_PARTITIONS, "symbol", "datetime"]  # ranges of rows, so a symbol with most bars is many tasks
    with_month(bars).repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy(*BAR_PARTITIONS).parquet(path)


def create_bars(store: Store, bars: DataFrame) -> None:
    """A new table of bars, or all of it anew."""
    store.commit({"bars": Change(with_month(bars), BAR_PARTITIONS, order=("symbol", "datetime"))})


def read_bars(store: Store) -> DataFrame:
    return store.read("bars").drop("month")


def save_bars(store: Store, incoming: DataFrame, *, sequence: str, batch: tuple[str, int] | None = None) -> bool:
    """Upsert into stored bars; False if this ``batch`` (stream, number) is in the table already.

    Read are the months from the earliest incoming bar on, and of what lies before only each slice's last close. Written are the months that hold an
    incoming bar or the bar right after one, whose pctChg changes.
    """
    if batch_done(store, batch):
        return False
    new = with_month(keep_last(storage_bars(incoming), list(BAR_KEY), sequence).drop(sequence))
    new = staged(new.withColumn("_new", F.lit(1)), "incoming")
    first = new.agg(F.min("month")).first()[0]
    if first is None:
        store.commit({}, batch_note(batch))
        return True
    base = store.read("bars") if store.has("bars") else new.drop("_new").limit(0)
    start = new.groupBy(*SLICE).agg(F.min("month").alias("_from"))
    old = base.join(start, list(SLICE))
    before = old.filter("month < _from").groupBy(*SLICE).agg(F.max("datetime").alias("datetime"), F.max_by("close", "datetime").alias("close"))
    later = old.filter((F.col("month") >= first) & (F.col("month") >= F.col("_from"))).drop("_from")
    merged = upsert(later, new, BAR_KEY).unionByName(before.withColumn("_carried", F.lit(1)), allowMissingColumns=True)
    linked = running(merged, SLICE, ["datetime"], time_chunk(), {"_p": ("last", F.struct("close", "_new"))}, exclusive=True).filter("_carried IS NULL")
    fresh = staged(linked.withColumns({
        "pctChg": safe_div("close", usable(F.col("_p.close"), "open")) - 1.0,
        "_changed": F.col("_new").isNotNull() | F.coalesce(F.col("_p._new").isNotNull(), F.lit(False)),
    }).drop("_new", "_p", "_carried"), "slices")
    months = fresh.filter("_changed").select(*BAR_PARTITIONS).distinct()
    others = base.filter(F.col("month") >= first).join(months, list(BAR_PARTITIONS), "left_semi").join(
        fresh.select(*SLICE, "month").distinct(), [*SLICE, "month"], "left_anti")
    rows = others.unionByName(fresh.drop("_changed").join(months, list(BAR_PARTITIONS), "left_semi"), allowMissingColumns=True)
    store.commit({"bars": Change(rows, BAR_PARTITIONS, touched=months, order=("symbol", "datetime"))}, batch_note(batch))
    return True


def save_facts(store: Store, name: str, incoming: DataFrame, keys: Sequence[str], *, sequence: str, batch: tuple[str, int] | None = None) -> bool:
    """Upsert dated facts (with a column ``date``) into the table ``name``, keep-last on ``keys``; only months with an incoming row are read and written."""
    if batch_done(store, batch):
        return False
    new = staged(keep_last(incoming, list(keys), sequence).drop(sequence).withColumn("month", F.date_format("date", "yyyy-MM")), "incoming")
    months = new.select("month").distinct()
    rows = upsert(store.read(name).join(months, ["month"], "left_semi"), new, keys) if store.has(name) else new
    store.commit({name: Change(rows, ("month",), touched=months, order=tuple(keys))}, batch_note(batch))
    return True


def delete_slices(bars: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining bars, deleted counts per request); a NULL freq or adjust in a request means any.

    ``requests`` is (symbol, freq, adjust).
    """
    asked = requests.select(F.upper("symbol").alias("symbol"), F.col("freq").alias("_f"), F.col("adjust").alias("_a")).distinct()
    hit = (F.col("_f").isNull() | (F.coalesce("b.freq", F.lit("")) == F.col("_f"))) & (
        F.col("_a").isNull() | (F.coalesce("b.adjust", F.lit("")) == F.col("_a")))
    on = (F.col("b.symbol") == F.col("r.symbol")) & hit
    b, r = bars.alias("b"), asked.alias("r")
    counts = b.join(r, on).groupBy("r.symbol", "_f", "_a").agg(F.count("*").alias("deleted")).select(
        "symbol", F.col("_f").alias("freq"), F.col("_a").alias("adjust"), "deleted")
    return b.join(r, on, "left_anti"), counts


def delete_facts(facts: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dated facts without the symbols deleted whole, and how many rows went."""
    whole = requests.filter("freq IS NULL AND adjust IS NULL").select(F.upper("symbol").alias("symbol")).distinct()
    counts = facts.join(whole, ["symbol"], "left_semi").groupBy("symbol").agg(F.count("*").alias("deleted"))
    return facts.join(whole, ["symbol"], "left_anti"), counts


def export_market(bars: DataFrame, path: str, *, end: str | None = None, adjust: str | None = None, symbols: DataFrame | None = None,
                  facts: dict[str, DataFrame] | None = None, force: bool = False) -> bool:
    """Bars up to ``end`` as freq / adjust / symbol-bucket partitions, and dated ``facts`` (by name) as bucket partitions; False if nothing was to do.

    An export is kept only if it was made for the same request and the same rows, which the version's note tells: a count and an order-free hash of what
    was selected of each table. Data and note are swapped together. An export without rows carries its schema. Tasks are ranges of rows, so a
    symbol with most bars is many. ``read_export`` reads it.
    """
    from ..functions.scalars import range_filter, symbol_bucket

    store = Store(bars.sparkSession, path)

    def chosen(df: DataFrame, time: str) -> DataFrame:
        df = df.filter(range_filter(time, None, end))
        if symbols is not None:
            df = df.join(symbols.select("symbol").distinct(), ["symbol"], "left_semi")
        return df.withColumn("bucket", symbol_bucket("symbol", 100))

    tables = {"bars": chosen(bars if adjust is None else bars.filter(F.col("adjust") == adjust), "datetime")}
    tables |= {name: chosen(df, "date") for name, df in sorted((facts or {}).items())}
    prints = {n: list(df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(*sorted(df.columns))), F.lit(0)), F.coalesce(F.sum(F.xxhash64(*sorted(df.columns), F.lit(1)).cast("decimal(38,0)")), F.lit(0)).cast("string")).first())
              for n, df in tables.items()}
    asked = json.dumps({"end": end, "adjust": adjust, "some": symbols is not None, "rows": prints}, sort_keys=True)
    if not force and store.note("request") == asked:
        return False
    by = {n: ("freq", "adjust", "bucket") if n == "bars" else ("bucket",) for n in tables}
    store.commit({n: Change(df, by[n], order=("symbol", "datetime" if n == "bars" else "date")) for n, df in tables.items()}, {"request": asked})
    return True


def read_export(spark: SparkSession, path: str, name: str = "bars") -> DataFrame:
    return Store(spark, path).read(name).drop("bucket")


def write_symbol_list(symbols: DataFrame, path: str) -> None:
    """Distinct symbols in order, one per line."""
    symbols.select("symbol").distinct().orderBy("symbol").write.mode("overwrite").text(path)


def write_events(events: DataFrame, path: str) -> None:
    """Replay events as JSON lines, one nested record per step."""
    events.write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str, kind: str = "csv") -> None:
    """A report as CSV with a header or as JSON lines; nested columns become JSON text in CSV."""
    if kind == "json":
        report.write.mode("overwrite").json(path)
        return
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in report.dtypes]
    report.select(*flat).write.mode("overwrite").csv(path, header=True)


def coverage_rows(bars: DataFrame, *, requested_start: str, requested_end: str, status: str = "completed") -> DataFrame:
    """Coverage-manifest rows for what is stored: requested and actual range, rows, hash."""
    from ..operators import inventory as V

    return V.slice_catalog(bars).select(
        F.sha1(F.concat_ws("|", *SLICE, F.lit(requested_start), F.lit(requested_end))).alias("id"), *SLICE,
        F.lit(requested_start).cast("timestamp_ntz").alias("requested_start"), F.lit(requested_end).cast("timestamp_ntz").alias("requested_end"),
        F.col("start_datetime").alias("actual_start"), F.col("end_datetime").alias("actual_end"), "rows", "data_hash",
        F.lit(status).alias("status"), F.localtimestamp().alias("downloaded_at"),
    )


def append_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def delete_manifest(manifest: DataFrame, requests: DataFrame) -> DataFrame:
    """Manifest without the rows of the given slices (NULL freq or adjust: any)."""
    return delete_slices(manifest, requests)[0]
