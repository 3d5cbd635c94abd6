"""Incremental maintenance of derived bars and features."""

from pyspark.sql import functions as F

from ..operators import inventory as V
from ..operators.bars import stored_bars
from ..plans import incremental as N
from ..plans.staging import staged, work_dir
from ..sources import sinks as K
from ..sources.store import Change, Store
from . import inputs as I
from .inputs import with_inputs
from .q_bars import _ordinal, _stored_sql
from .registry import query, rounded

_CUT = "2024-01-20"


def _state(spark, sf):
    """What was stored when only the bars before the cut were there, with one series each in a special state.

    300001.SZ: no manifest, target complete. 688001.SH: an early bar has been corrected since.
    830001.BJ: nothing new. 600000.SH: no manifest, no target. 000001.SZ: only new bars.
    """
    now = I.bars_5min(spark, sf)
    early = now.filter((F.col("datetime") < F.lit(_CUT).cast("timestamp_ntz")) | F.col("symbol").isin("830001.BJ", "300001.SZ"))
    old = early.withColumn("close", F.when((F.col("symbol") == "688001.SH") & (F.dayofmonth("datetime") == 5), F.col("close") + 1).otherwise(F.col("close")))
    now, old = staged(now, "bars"), staged(old, "bars")
    target = staged(stored_bars(old, "15min", "5min").filter("symbol <> '600000.SH'"), "target")
    empty = spark.createDataFrame([], "symbol STRING, base_freq STRING, target_freq STRING, adjust STRING, source STRING, base_start TIMESTAMP_NTZ, base_end TIMESTAMP_NTZ, "
                                      "base_rows BIGINT, base_hash BIGINT, target_rows BIGINT, generated_at TIMESTAMP_NTZ")
    first = N.plan_rebuild(old, target, empty, base_freq="5min", target_freq="15min")
    manifest = N.next_manifest(empty, first, target, base_freq="5min", target_freq="15min").filter("symbol NOT IN ('300001.SZ', '600000.SH')")
    return now, target, staged(manifest, "manifest")


def _stored(spark, sf):
    """The same state as tables of a store."""
    now, target, manifest = _state(spark, sf)
    store = Store(spark, work_dir(spark, "bars"))
    store.commit({"bars": Change(K.with_month(target), K.BAR_PARTITIONS, order=("symbol", "datetime")), "manifest": Change(manifest)})
    return now, store


def _buckets(name: str, source: str) -> str:
    return f"""{name} AS (SELECT symbol, count(*) AS rows, min(e) AS a, max(e) AS z FROM (SELECT symbol, max(datetime) AS e FROM (SELECT symbol, datetime, date_trunc('day', datetime) AS d,
  (row_number() OVER (PARTITION BY symbol, date_trunc('day', datetime) ORDER BY datetime) - 1) // 3 AS k FROM {source}) GROUP BY symbol, d, k) GROUP BY symbol)"""


# The state of ``_state`` and what it says about every series: rows and ends then and now, how much of the known prefix is unchanged, buckets then and now.
_PLANNED = f"""
, old AS (SELECT * REPLACE (CASE WHEN symbol = '688001.SH' AND day(datetime) = 5 THEN close + 1 ELSE close END AS close) FROM bars WHERE datetime < TIMESTAMP '{_CUT}' OR symbol IN ('830001.BJ', '300001.SZ')),
m AS (SELECT symbol, count(*) AS rows, min(datetime) AS a, max(datetime) AS z FROM old WHERE symbol NOT IN ('300001.SZ', '600000.SH') GROUP BY symbol),
n AS (SELECT symbol, count(*) AS rows, min(datetime) AS a, max(datetime) AS z FROM bars GROUP BY symbol),
pre AS (SELECT b.symbol, count(*) AS rows, count(o.symbol) AS same FROM bars b JOIN m ON m.symbol = b.symbol AND b.datetime <= m.z LEFT JOIN old o ON o.symbol = b.symbol AND o.datetime = b.datetime
  AND o.open = b.open AND o.high = b.high AND o.low = b.low AND o.close = b.close AND o.volume = b.volume GROUP BY b.symbol),
{_buckets("t", "old WHERE symbol <> '600000.SH'")}, {_buckets("want", "bars")},
planned AS (SELECT n.symbol, CASE WHEN m.rows IS NULL THEN CASE WHEN t.rows = want.rows AND t.a = want.a AND t.z = want.z THEN 'adopt' ELSE 'full' END WHEN n.rows = m.rows AND pre.same = m.rows AND n.z = m.z THEN 'skip'
  WHEN n.a = m.a AND pre.rows = m.rows AND pre.same = m.rows AND n.z > m.z THEN 'append' ELSE 'full' END AS action, m.z, n.rows = m.rows AND pre.same = m.rows AND n.z = m.z AS matches
  FROM n LEFT JOIN m USING (symbol) LEFT JOIN pre USING (symbol) LEFT JOIN t USING (symbol) LEFT JOIN want USING (symbol))"""


@query("rebuild_plan", "K1 K2 K7 C15 C16 C17", with_inputs("bars", body=_PLANNED + """
SELECT symbol, action, CASE WHEN action = 'append' THEN date_trunc('day', z)::TIMESTAMP END AS rebuild_start FROM planned"""))
def _(spark, sf):
    now, target, manifest = _state(spark, sf)
    return N.plan_rebuild(now, target, manifest, base_freq="5min", target_freq="15min").select("symbol", "action", "rebuild_start")


@query("materialized_bars", "K3 K4 A12", _stored_sql(["bars"], "bars", "5min", "15min", _ordinal(3)))
def _(spark, sf):
    """Bringing the stored target up to date equals building it anew; read through the table's version."""
    now, store = _stored(spark, sf)
    N.materialize_store(now, store, base_freq="5min", target_freq="15min")
    return rounded(K.read_bars(store), 8)


@query("materialize_summary", "K4", with_inputs("bars", body=f"""
, o AS (SELECT symbol, datetime, date_trunc('day', datetime) AS d, (row_number() OVER (PARTITION BY symbol, date_trunc('day', datetime) ORDER BY datetime) - 1) // 3 AS b FROM bars),
t AS (SELECT symbol, d, b FROM o GROUP BY ALL), cut AS (SELECT date_trunc('day', max(datetime)) AS d FROM bars WHERE symbol = '000001.SZ' AND datetime < TIMESTAMP '{_CUT}'),
s AS (SELECT symbol, '15min' AS target_freq, (SELECT count(*) FROM bars b WHERE b.symbol = t.symbol) AS base_rows, CASE WHEN symbol IN ('300001.SZ', '830001.BJ') THEN 0
  WHEN symbol = '000001.SZ' THEN count(*) FILTER (t.d >= (SELECT d FROM cut)) ELSE count(*) END AS saved_rows, CASE WHEN symbol IN ('300001.SZ', '830001.BJ') THEN 'skipped' ELSE 'ok' END AS status FROM t GROUP BY symbol)
SELECT * FROM s UNION ALL SELECT '__TOTAL__', '15min', CAST(sum(base_rows) AS BIGINT), CAST(sum(saved_rows) AS BIGINT), 'ok' FROM s"""))
def _(spark, sf):
    now, target, manifest = _state(spark, sf)
    _, _, summary = N.materialize(now, target, manifest, base_freq="5min", target_freq="15min")
    return summary


@query("second_run_skips", "K1 K3", with_inputs("bars", body="SELECT DISTINCT symbol, 'skip' AS action FROM bars"))
def _(spark, sf):
    now, store = _stored(spark, sf)
    N.materialize_store(now, store, base_freq="5min", target_freq="15min")
    return N.plan_rebuild(now, K.read_bars(store), store.read("manifest"), base_freq="5min", target_freq="15min").select("symbol", "action")


@query("manifest_matches", "K5", with_inputs("bars", body=_PLANNED + "\nSELECT symbol, matches FROM planned WHERE z IS NOT NULL"))
def _(spark, sf):
    now, target, manifest = _state(spark, sf)
    return N.manifest_matches(manifest, V.slice_catalog(now), V.slice_catalog(target), base_freq="5min", target_freq="15min").select("symbol", "matches")


@query("feature_reuse_plan", "K6", with_inputs("liquidity", body="""
, now AS (SELECT DISTINCT symbol FROM bars), stored AS (SELECT DISTINCT CASE symbol WHEN '600000.SH' THEN 'GONE' ELSE symbol END AS symbol FROM bars),
changed AS (SELECT DISTINCT symbol FROM liquidity WHERE symbol = '000001.SZ' AND day(date) = 4 AND turn <> 0)
SELECT symbol, CASE WHEN now.symbol IS NULL THEN 'drop' WHEN stored.symbol IS NULL OR symbol IN (FROM changed) THEN 'rebuild' ELSE 'reuse' END AS action FROM now FULL JOIN stored USING (symbol)"""))
def _(spark, sf):
    """Fingerprints stored before: one symbol new, one with changed turnover, one no longer wanted."""
    sources = {"bars": I.bars_5min(spark, sf), "liquidity": I.liquidity(spark, sf)}
    was = dict(sources, liquidity=sources["liquidity"].withColumn("turn", F.when((F.col("symbol") == "000001.SZ") & (F.dayofmonth("date") == 4), 0.0).otherwise(F.col("turn"))))
    sign = N.build_signature({"windows": 96, "adjust": "none"})
    stored = N.symbol_fingerprints(was, sign).withColumn("symbol", F.when(F.col("symbol") == "600000.SH", "GONE").otherwise(F.col("symbol")))
    return N.plan_features(N.symbol_fingerprints(sources, sign), stored).select("symbol", "action")


@query("bounded_rebuild", "K4 C8", _stored_sql(
    ["long"], "(SELECT * FROM long WHERE datetime >= TIMESTAMP '1996-03-01' AND datetime < TIMESTAMP '1997-01-16')", "daily", "monthly", "date_trunc('month', datetime) AS b1, 0 AS b2"))
def _(spark, sf):
    return rounded(N.bounded_rebuild(I.bars_daily_long(spark, sf), base_freq="daily", target_freq="monthly", start="1996-03-12", end="1997-01-15"), 8)
