"""Versioned tables: what a lost driver, a repeated batch, a late tick or a second request leave behind."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barspark.catalog import inputs as I
from barspark.operators.bars import refresh_pct_chg, stored_bars
from barspark.plans import incremental as N
from barspark.sources import sinks as K
from barspark.sources.store import Change, Store
from barspark.streaming import streams as S
from barspark.streaming.streams import work_dir

KEY = ["symbol", "datetime", "close"]


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


@pytest.fixture
def store(spark):
    return Store(spark, work_dir(spark, "store"))


class Lost(Exception):
    pass


def lose_driver(monkeypatch):
    def lost(self, now):
        raise Lost

    monkeypatch.setattr(Store, "_point", lost)


def bars_of(spark, closes, symbol="A"):
    """Daily bars of one symbol by (year, month, day)."""
    data = [(symbol, dt.datetime(*day), c) for day, c in closes.items()]
    out = spark.createDataFrame(data, "symbol string, datetime timestamp_ntz, close double")
    price = F.col("close")
    return out.select("symbol", "datetime", *[price.alias(c) for c in ("open", "high", "low")], "close", F.lit(1.0).alias("volume"), F.lit(1.0).alias("amount"),
                      F.lit("x").alias("source"), F.lit("daily").alias("freq"), F.lit("none").alias("adjust"))


def test_commit_read_partitions_and_earlier_versions(spark, store):
    assert store.version().number == 0 and not store.has("t") and store.note("n") is None
    a = spark.createDataFrame([("p", 1), ("q", 2), (None, 3)], "k string, v int")
    store.commit({"t": Change(a, ("k",))}, {"n": "1"})
    b = spark.createDataFrame([("q", 20)], "k string, v int")
    gone = spark.createDataFrame([("p",)], "k string")
    store.commit({"t": Change(b, ("k",), touched=gone), "u": Change(b.limit(0))})
    assert rows(store.read("t"), "v") == [(3,), (20,)] and store.note("n") == "1"
    assert store.read("u").count() == 0 and store.read("u").columns == ["k", "v"]
    assert rows(store.read("t", 1), "v") == [(1,), (2,), (3,)]
    store.commit({"t": Change(b)})  # all of it, without partitions
    assert store.retire() == 2  # the first two folders of t
    assert rows(store.read("t"), "k", "v") == [("q", 20)] and store.version().number == 3 and store.retire() >= 0


def test_lost_driver_leaves_the_old_table(spark, store, monkeypatch):
    K.create_bars(store, refresh_pct_chg(bars_of(spark, {(2024, 1, 2): 1.0, (2024, 2, 5): 2.0})))
    before = rows(K.read_bars(store), *KEY)
    new = bars_of(spark, {(2024, 2, 5): 5.0, (2024, 2, 6): 6.0}).withColumn("seq", F.lit(1))
    with monkeypatch.context() as m, pytest.raises(Lost):
        lose_driver(m)
        K.save_bars(store, new, sequence="seq", batch=("s", 0))
    assert rows(K.read_bars(store), *KEY) == before and store.version().number == 1
    assert K.save_bars(store, new, sequence="seq", batch=("s", 0)) and [r[2] for r in rows(K.read_bars(store), *KEY)] == [1.0, 5.0, 6.0]
    assert not K.save_bars(store, new.withColumn("close", F.lit(9.0)), sequence="seq", batch=("s", 0))
    assert [r[2] for r in rows(K.read_bars(store), *KEY)] == [1.0, 5.0, 6.0]


def test_upsert_touches_months_of_new_bars_and_of_the_bar_after(spark, store):
    """The bar after a corrected one lies two months later; a slice that begins later keeps its earlier rows in a rewritten month."""
    a = {(2023, 12, 29): 8.0, (2024, 1, 31): 10.0, (2024, 3, 4): 12.0, (2024, 4, 1): 15.0}
    b = {(2024, 1, 15): 3.0, (2024, 3, 5): 4.0}
    K.create_bars(store, refresh_pct_chg(bars_of(spark, a).unionByName(bars_of(spark, b, "B"))))
    new = bars_of(spark, {(2024, 1, 31): 16.0}).unionByName(bars_of(spark, {(2024, 3, 6): 8.0}, "B")).withColumn("seq", F.lit(1))
    K.save_bars(store, new, sequence="seq")
    want = refresh_pct_chg(bars_of(spark, a | {(2024, 1, 31): 16.0}).unionByName(bars_of(spark, b | {(2024, 3, 6): 8.0}, "B")))
    assert rows(K.read_bars(store), *KEY, "pctChg") == rows(want, *KEY, "pctChg")
    folders = {part: path for _, part, path in store.version().parts}
    assert sorted(m.split('"month":"')[1][:7] for m, path in folders.items() if "/run=2-" in path) == ["2024-01", "2024-03"]
    assert K.save_bars(store, new.limit(0), sequence="seq", batch=("s", 4)) and store.note("batch:s") == "4"


def test_facts_keep_the_last_row_of_a_key(spark, store):
    day = dt.date(2024, 1, 3)
    first = spark.createDataFrame([("a", day, 1.0, 1), ("a", day, 2.0, 2), ("b", dt.date(2024, 2, 1), 3.0, 1)], "symbol string, date date, turn double, seq int")
    assert K.save_facts(store, "turnover", first, ["symbol", "date"], sequence="seq", batch=("f", 0))
    again = spark.createDataFrame([("a", day, 7.0, 1)], first.schema)
    assert K.save_facts(store, "turnover", again, ["symbol", "date"], sequence="seq", batch=("f", 1))
    assert not K.save_facts(store, "turnover", first, ["symbol", "date"], sequence="seq", batch=("f", 1))
    assert rows(store.read("turnover"), "symbol", "turn") == [("a", 7.0), ("b", 3.0)]


def test_materialised_bars_and_manifest_change_together(spark, sf, store, monkeypatch):
    bars = I.bars_5min(spark, sf)
    N.materialize_store(bars.filter(F.dayofmonth("datetime") < 12), store, base_freq="5min", target_freq="15min")
    assert {r["action"] for r in N.plan_rebuild(bars, K.read_bars(store), store.read("manifest"), base_freq="5min", target_freq="15min").collect()} == {"append"}
    before = rows(K.read_bars(store), *KEY)
    with monkeypatch.context() as m, pytest.raises(Lost):
        lose_driver(m)
        N.materialize_store(bars, store, base_freq="5min", target_freq="15min")
    assert rows(K.read_bars(store), *KEY) == before
    N.materialize_store(bars, store, base_freq="5min", target_freq="15min")
    assert rows(K.read_bars(store), *KEY) == rows(stored_bars(bars, "15min", "5min"), *KEY)
    assert {r["status"] for r in N.materialize_store(bars, store, base_freq="5min", target_freq="15min").collect() if r["symbol"] != "__TOTAL__"} == {"skipped"}


def test_export_after_new_bars_and_after_a_lost_driver(spark, monkeypatch):
    path = work_dir(spark, "export")
    old, more = bars_of(spark, {(2024, 1, 2): 1.0}), bars_of(spark, {(2024, 1, 2): 1.0, (2024, 1, 3): 2.0})
    assert K.export_market(old, path, end="2024-01-31") and not K.export_market(old, path, end="2024-01-31")
    assert K.export_market(more, path, end="2024-01-31") and K.read_export(spark, path).count() == 2
    with monkeypatch.context() as m, pytest.raises(Lost):
        lose_driver(m)
        K.export_market(more, path, end="2024-01-02")
    assert K.read_export(spark, path).count() == 2 and not K.export_market(more, path, end="2024-01-31")
    facts = {"turnover": spark.createDataFrame([("a", dt.date(2024, 1, 2), 1.0), ("a", dt.date(2024, 2, 2), 2.0)], "symbol string, date date, turn double")}
    assert K.export_market(more, path, end="2024-01-31", facts=facts) and not K.export_market(more, path, end="2024-01-31", facts=facts)
    assert rows(K.read_export(spark, path, "turnover"), "turn") == [(1.0,)]
    assert K.export_market(more, path, end="2023-01-01") and K.read_export(spark, path).columns == more.columns and K.read_export(spark, path).count() == 0
    assert K.export_market(more, path, end="2023-01-01", force=True)


def test_late_ticks_are_kept_and_counted(spark, store):
    base = dt.datetime(2024, 1, 2, 10)

    def ticks(*at):
        return spark.createDataFrame([(s, base + dt.timedelta(minutes=m), float(p), 2.0) for s, m, p in at], "symbol string, ts timestamp_ntz, price double, volume double")

    first, second = ticks(("a", 0, 5), ("a", 61, 6)), ticks(("a", 2, 9), ("a", 50, 1), ("a", 75, 7), ("b", 3, 4))
    assert S.save_ticks(store, first, "15min", 1800, batch=("t", 0)) and S.save_ticks(store, second, "15min", 1800, batch=("t", 1))
    assert not S.save_ticks(store, first, "15min", 1800, batch=("t", 0))
    assert [r[0] for r in rows(store.read("late"), "price")] == [9.0]
    live = S.shown_bars(store.read("live"), "15min")
    assert rows(live.filter("symbol = 'a'"), "open", "close", "ticks") == [(1.0, 1.0, 1), (5.0, 5.0, 1), (6.0, 6.0, 1), (7.0, 7.0, 1)]
    names = ["symbol", "bar_start", "bar_end", "open", "high", "low", "close", "volume", "amount", "ticks"]
    batch = S.shown_bars(S.partial_bars(first.unionByName(second), "15min"), "15min")
    assert rows(S.live_with_late(store, "15min"), *names) == rows(batch, *names)
