"""Streams run to the end of the given data, then read back."""

from pyspark.sql import functions as F

from ..sources import sinks as K
from ..sources.store import Store
from ..streaming import streams as S
from . import inputs as I
from .inputs import with_inputs
from .registry import query, rounded


def _stream(spark, sf):
    """The events as a stream of ticks."""
    raw = S.tick_stream(spark, sf, I.table(spark, sf, "events").schema, "events.parquet")
    names = F.create_map(*[F.lit(x) for p in I.EVENT_SYMBOLS.items() for x in p])
    return raw.select(names[F.col("event_type")].alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("volume"), "event_id")


@query("live_partial_bars", "K8", with_inputs("bars", body="""
SELECT symbol, time_bucket(INTERVAL 15 MINUTE, ts) AS bar_start, time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE AS bar_end, '15min' AS freq, min_by(value, ts) AS open, max(value) AS high, min(value) AS low,
  max_by(value, ts) AS close, count(*)::DOUBLE AS volume, round(sum(value), 6) AS amount, count(*) AS ticks FROM (SELECT ts, value, """ + I._CASE + """ AS symbol FROM events) GROUP BY ALL"""))
def _(spark, sf):
    path = S.work_dir(spark, "live")
    S.publish(S.live_bars(_stream(spark, sf), "15min", late="40 days"), f"{path}/out", f"{path}/log").awaitTermination()
    return rounded(S.read_latest(spark, f"{path}/out", ["symbol", "bar_start"]))


@query("stream_upsert", "K9 A12 B9", """SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL""")
def _(spark, sf):
    path = S.work_dir(spark, "upsert")
    events = I.table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "ts")
    events.repartition(4, "event_id").write.parquet(f"{path}/in")
    stream = S.tick_stream(spark, f"{path}/in", events.schema, files_per_batch=1)
    S.upsert_stream(stream, f"{path}/out", f"{path}/log", keys=["user_id", "event_type"], sequence="event_id").awaitTermination()
    return S.read_upserted(spark, f"{path}/out", ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query("live_bars_with_late_ticks", "K8 K7", with_inputs("bars", body="""
SELECT symbol, time_bucket(INTERVAL 15 MINUTE, ts) AS bar_start, time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE AS bar_end, '15min' AS freq, min_by(value, ts) AS open, max(value) AS high, min(value) AS low,
  max_by(value, ts) AS close, count(*)::DOUBLE AS volume, round(sum(value), 6) AS amount, count(*) AS ticks FROM (SELECT ts, value, """ + I._CASE + """ AS symbol FROM events) GROUP BY ALL"""))
def _(spark, sf):
    """Ticks in no order and a lateness of an hour: most are late, and live bars with the late ticks still are those of a batch."""
    path = S.work_dir(spark, "live")
    events = I.table(spark, sf, "events")
    events.repartition(3, "event_id").write.parquet(f"{path}/in")
    names = F.create_map(*[F.lit(x) for p in I.EVENT_SYMBOLS.items() for x in p])
    ticks = S.tick_stream(spark, f"{path}/in", events.schema, files_per_batch=1).select(
        names[F.col("event_type")].alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("volume"))
    store = Store(spark, f"{path}/bars")
    S.tick_sink(ticks, store, f"{path}/log", "15min", late_seconds=3600).awaitTermination()
    return rounded(S.live_with_late(store, "15min"))


@query("stream_into_bar_table", "K9 A12 A14", with_inputs("bars", body="""
, merged AS (SELECT * REPLACE (CASE WHEN day(datetime) = 10 THEN close + 1 ELSE close END AS close) FROM bars)
SELECT symbol, datetime, round(close, 6) AS close, round(close / coalesce(nullif(lag(close) OVER (PARTITION BY symbol ORDER BY datetime), 0), nullif(open, 0)) - 1, 6) + 0.0 AS "pctChg" FROM merged"""))
def _(spark, sf):
    """Bars of three days streamed into the table that has the rest, wrong ones first; a batch is delivered twice."""
    path = S.work_dir(spark, "bars")
    all_bars = I.bars_5min_pct(spark, sf)
    store = Store(spark, f"{path}/table")
    day = F.dayofmonth("datetime")
    K.create_bars(store, all_bars.filter(day != 12))
    bars = all_bars.drop("pctChg")
    right = bars.filter(day.isin(10, 11, 12)).withColumns({"close": F.when(day == 10, F.col("close") + 1).otherwise(F.col("close")), "seq": F.lit(2)})
    wrong = bars.filter(day == 10).withColumns({"close": F.lit(0.5), "seq": F.lit(1)})
    for n, batch in enumerate((wrong, right)):
        batch.coalesce(1).write.mode("append").parquet(f"{path}/in{n}")
        stream = S.tick_stream(spark, f"{path}/in{n}", batch.schema, files_per_batch=1)
        S.bar_sink(stream, store, f"{path}/log{n}", sequence="seq", name=f"source{n}").awaitTermination()
    K.save_bars(store, wrong, sequence="seq", batch=("source1", 0))
    store.retire()
    return rounded(K.read_bars(store).select("symbol", "datetime", "close", "pctChg"))


@query("ordered_event_tail", "K10 A10", "SELECT event_id AS seq, event_type, value FROM events WHERE event_id > 250")
def _(spark, sf):
    path = S.work_dir(spark, "tail")
    events = I.table(spark, sf, "events").select(F.col("event_id").alias("seq"), "event_type", "value")
    K.write_events(events, f"{path}/in")
    stream = S.event_tail(spark, f"{path}/in", "seq BIGINT, event_type STRING, value DOUBLE", after=250)
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("late_rows_kept_apart", "K7", with_inputs("bars", body="""
, n AS (SELECT symbol, max(datetime) AS newest FROM bars WHERE day(datetime) < 20 GROUP BY symbol)
SELECT b.symbol, count(*) FILTER (b.datetime >= n.newest - INTERVAL 1 DAY) AS in_time, count(*) FILTER (b.datetime < n.newest - INTERVAL 1 DAY) AS late FROM bars b JOIN n USING (symbol) GROUP BY b.symbol"""))
def _(spark, sf):
    bars = I.bars_5min(spark, sf).withColumn("ts", F.col("datetime"))
    newest = bars.filter(F.dayofmonth("datetime") < 20).groupBy("symbol").agg(F.max("datetime").alias("newest"))
    ok, late = S.split_late(bars, newest, 86400)
    both = ok.withColumn("side", F.lit("in_time")).unionByName(late.withColumn("side", F.lit("late")))
    return both.groupBy("symbol").agg(F.count(F.when(F.col("side") == "in_time", 1)).alias("in_time"), F.count(F.when(F.col("side") == "late", 1)).alias("late"))
