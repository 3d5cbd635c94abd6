"""Streaming counterparts of the incremental work: partial bars, upserts, ordered tails.

Streams use event time in UTC, because watermarks need zoned timestamps; results are naive again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.normalize import keep_last
from ..plans.staging import staged, work_dir  # noqa: F401  (where streams keep their files)
from ..schema import MINUTES
from ..sources.sinks import save_bars, save_facts
from ..sources.store import Change, Store, batch_done, batch_note


def tick_stream(spark: SparkSession, path: str, schema, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def live_bars(ticks: DataFrame, freq: str = "15min", *, late: str = "10 minutes") -> DataFrame:
    """The bar of the running clock period per symbol, emitted anew whenever it changes (update mode).

    Buckets go by the clock, so they equal position buckets only on sessions without gaps.
    Expects (symbol, ts, price, volume). State is one row per symbol and open period.
    """
    length = f"{MINUTES[freq]} minutes" if freq in MINUTES else "1 day"
    zoned = ticks.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", late)
    bars = zoned.groupBy("symbol", F.window("event_time", length).alias("w")).agg(
        F.min_by("price", "event_time").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "event_time").alias("close"), F.sum("volume").alias("volume"),
        F.sum(F.col("price") * F.col("volume")).alias("amount"), F.count("*").alias("ticks"),
    )
    return bars.select(
        "symbol", F.col("w.start").cast("timestamp_ntz").alias("bar_start"), F.col("w.end").cast("timestamp_ntz").alias("bar_end"),
        F.lit(freq).alias("freq"), "open", "high", "low", "close", "volume", "amount", "ticks",
    )


def split_late(rows: DataFrame, high_water: DataFrame, late_seconds: int) -> tuple[DataFrame, DataFrame]:
    """Rows within the allowed lateness of their symbol's newest stored time, and those behind it.

    The second part goes to a table that the batch plan rebuilds from; nothing is dropped.
    """
    marked = rows.join(high_water.select("symbol", "newest"), ["symbol"], "left")
    behind = F.coalesce(F.col("ts") < F.col("newest") - F.make_dt_interval(secs=F.lit(late_seconds)), F.lit(False))
    return marked.filter(~behind).drop("newest"), marked.filter(behind).drop("newest")


_BAR = "symbol string, bar_start timestamp_ntz, open struct<t: timestamp_ntz, v: double>, high double, low double, close struct<t: timestamp_ntz, v: double>, volume double, amount double, ticks bigint, day string"
_TICK = "symbol string, ts timestamp_ntz, price double, volume double, day string"


def partial_bars(ticks: DataFrame, freq: str) -> DataFrame:
    """Bars of the clock periods of ticks (symbol, ts, price, volume), with the times of their first and last tick, so that ``merged_bars`` can join two parts."""
    length = f"{MINUTES[freq]} minutes" if freq in MINUTES else "1 day"
    at = F.struct(F.col("ts").alias("t"), F.col("price").alias("v"))
    bars = ticks.groupBy("symbol", F.window(F.col("ts").cast("timestamp"), length)["start"].cast("timestamp_ntz").alias("bar_start")).agg(
        F.min(at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max(at).alias("close"), F.sum("volume").alias("volume"),
        F.sum(F.col("price") * F.col("volume")).alias("amount"), F.count("*").alias("ticks"))
    return bars.withColumn("day", F.date_format("bar_start", "yyyy-MM-dd"))


def merged_bars(parts: DataFrame) -> DataFrame:
    """One bar for each symbol and period from the parts of it."""
    return parts.groupBy("symbol", "bar_start", "day").agg(
        F.min("open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("close").alias("close"), F.sum("volume").alias("volume"),
        F.sum("amount").alias("amount"), F.sum("ticks").alias("ticks"))


def shown_bars(parts: DataFrame, freq: str) -> DataFrame:
    """The columns of ``live_bars`` from bars that can be merged."""
    length = F.make_dt_interval(mins=F.lit(MINUTES[freq])) if freq in MINUTES else F.make_dt_interval(days=F.lit(1))
    return parts.select("symbol", "bar_start", (F.col("bar_start") + length).alias("bar_end"), F.lit(freq).alias("freq"), F.col("open.v").alias("open"), "high", "low",
                        F.col("close.v").alias("close"), "volume", "amount", "ticks")


def save_ticks(store: Store, ticks: DataFrame, freq: str, late_seconds: int, *, batch: tuple[str, int] | None = None) -> bool:
    """A micro-batch of ticks into the tables ``live`` (bars so far), ``late`` (ticks too far behind) and ``marks`` (newest time of each symbol).

    A tick is late if its symbol's stored newest time is more than ``late_seconds`` after it. Late ticks change no live bar, but none is lost:
    ``live`` merged with the bars of ``late`` is what a batch over all ticks gives. All three tables and the batch's number change together; the days
    that the batch touches are rewritten.
    """
    if batch_done(store, batch):
        return False
    spark = store.spark
    marks = store.read("marks") if store.has("marks") else spark.createDataFrame([], "symbol string, newest timestamp_ntz")
    live = store.read("live") if store.has("live") else spark.createDataFrame([], _BAR)
    late = store.read("late") if store.has("late") else spark.createDataFrame([], _TICK)
    rows = staged(ticks.select("symbol", "ts", F.col("price").cast("double").alias("price"), F.col("volume").cast("double").alias("volume")), "ticks")
    ok, behind = split_late(rows, marks, late_seconds)
    new = staged(partial_bars(ok, freq), "bars")
    days = new.select("day").distinct()
    behind = staged(behind.withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "late")
    late_days = behind.select("day").distinct()
    seen = marks.unionByName(rows.select("symbol", F.col("ts").alias("newest"))).groupBy("symbol").agg(F.max("newest").alias("newest"))
    store.commit({
        "live": Change(merged_bars(live.join(days, ["day"], "left_semi").unionByName(new)), ("day",), touched=days, order=("symbol", "bar_start")),
        "late": Change(late.join(late_days, ["day"], "left_semi").unionByName(behind), ("day",), touched=late_days, order=("symbol", "ts")),
        "marks": Change(seen),
    }, batch_note(batch))
    return True


def live_with_late(store: Store, freq: str) -> DataFrame:
    """The live bars with the late ticks counted in."""
    return shown_bars(merged_bars(store.read("live").unionByName(partial_bars(store.read("late").drop("day"), freq))), freq)


def _each_batch(stream: DataFrame, save: Callable[[DataFrame, int], object], checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def tick_sink(ticks: DataFrame, store: Store, checkpoint: str, freq: str, *, late_seconds: int, name: str = "ticks", available_now: bool = True) -> StreamingQuery:
    """Live bars of a stream of ticks, with late ticks kept apart (``save_ticks``)."""
    return _each_batch(ticks, lambda batch, n: save_ticks(store, batch, freq, late_seconds, batch=(name, n)), checkpoint, available_now)


def bar_sink(bars: DataFrame, store: Store, checkpoint: str, *, sequence: str, name: str = "bars", available_now: bool = True) -> StreamingQuery:
    """Upsert a stream of bars into the bar table: months that change, pctChg after it, each batch once (``save_bars``)."""
    return _each_batch(bars, lambda batch, n: save_bars(store, batch, sequence=sequence, batch=(name, n)), checkpoint, available_now)


def fact_sink(facts: DataFrame, store: Store, checkpoint: str, table: str, keys: Sequence[str], *, sequence: str, name: str = "facts", available_now: bool = True) -> StreamingQuery:
    """Upsert a stream of dated facts into ``table``, each batch once (``save_facts``)."""
    return _each_batch(facts, lambda batch, n: save_facts(store, table, batch, keys, sequence=sequence, batch=(name, n)), checkpoint, available_now)


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, *, keys: Sequence[str], sequence: str,
                  prepare: Callable[[DataFrame], DataFrame] | None = None, available_now: bool = True) -> StreamingQuery:
    """Append each batch's last row per key under its batch id; ``read_upserted`` shows the newest.

    A batch that is run again after a failure overwrites its own folder, so it counts once.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        keep_last(rows, list(keys), sequence).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_upserted(spark: SparkSession, path: str, keys: Sequence[str], sequence: str) -> DataFrame:
    """The row with the highest ``sequence`` per key over all batches, later batches first among equals."""
    rows = spark.read.option("recursiveFileLookup", "false").parquet(path)
    ranked = rows.withColumn("_order", F.struct(sequence, "batch"))
    return keep_last(ranked, list(keys), "_order").drop("_order", "batch")


def compact(spark: SparkSession, path: str, target: str, keys: Sequence[str], sequence: str) -> None:
    """The upserted rows as one plain table."""
    read_upserted(spark, path, keys, sequence).write.mode("overwrite").parquet(target)


def publish(stream: DataFrame, path: str, checkpoint: str, *, mode: str = "update") -> StreamingQuery:
    """Write each batch of changed rows under its batch id (for update-mode aggregations)."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest published version of every key."""
    return keep_last(spark.read.parquet(path), list(keys), "batch").drop("batch")


def event_tail(spark: SparkSession, path: str, schema: str, *, after: int = 0) -> DataFrame:
    """A stream of JSON events past ``after``; the checkpoint remembers how far it got."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path).filter(F.col("seq") > after)
