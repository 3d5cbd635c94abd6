import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspark.catalog import inputs
from barspark.operators import decisions as D
from barspark.operators import sequences as S
from barspark.operators.bars import aggregate_bars, as_market_bars
from barspark.operators.features import bar_features
from barspark.operators.snapshot import decision_snapshots
from barspark.plans.dataset import (
    build_dataset, build_summary, dataset_inputs, dataset_sequences, merge_datasets, read_dataset, snapshot_feature_rows, write_dataset,
)
from barspark.plans.registry import DEFAULT_SPEC, compile_blueprint


@pytest.fixture(scope="module")
def stored(spark, sf, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("ds"))
    ds = build_dataset(
        inputs.session_bars(spark, sf), inputs.bars_daily(spark, sf),
        status=inputs.status(spark, sf), liquidity=inputs.liquidity(spark, sf), gaps=False,
    )
    write_dataset(ds, root)
    return read_dataset(spark, root)


def test_counts_agree(stored):
    n = stored.decisions.count()
    assert n > 0 and stored.constraints.count() == n and stored.decision_context.count() == n
    assert stored.decision_index.count() == n * 7
    assert S.missing_index(stored.decisions, stored.decision_index, ["5min", "daily"]).count() == 0
    rows = {(r["table"], r["freq"]): r["rows"] for r in build_summary(stored).collect()}
    assert rows[("decisions", "")] == n and rows[("decision_index", "daily")] == n
    assert merge_datasets([stored, stored]).dataset_metadata.count() == stored.dataset_metadata.count()


def test_partial_bar_features_equal_features_of_history_plus_partial_bar(spark, stored):
    """Appending the partial bar to the completed ones and building features gives the same last row."""
    got = snapshot_feature_rows(stored).toPandas().set_index("snapshot_id")
    assert len(got) > 0
    snaps = stored.decision_snapshots.toPandas()
    ends = stored.decision_index.select("snapshot_id", "stable_end_datetime").dropna(subset=["snapshot_id"]).toPandas()
    bars = stored.market_bars.toPandas()
    merged = snaps.merge(ends, on="snapshot_id")
    chosen = merged.groupby("freq", group_keys=False).apply(lambda g: g.sample(min(6, len(g)), random_state=3))
    chosen = merged.loc[chosen.index]
    frames = []
    for i, row in enumerate(chosen.itertuples()):
        hist = bars[(bars.symbol == row.symbol) & (bars.freq == row.freq)]
        hist = hist[hist.bar_datetime <= row.stable_end_datetime] if pd.notna(row.stable_end_datetime) else hist.iloc[:0]
        last = pd.DataFrame([{c: getattr(row, c) for c in ("open", "high", "low", "close", "volume", "amount", "pctChg", "turn", "progress")}])
        last["bar_datetime"] = row.bar_datetime if pd.isna(row.stable_end_datetime) else max(row.bar_datetime, row.stable_end_datetime + pd.Timedelta("1us"))
        f = pd.concat([hist[[*last.columns]], last], ignore_index=True)
        f["symbol"], f["freq"], f["adjust"] = f"x{i}", row.freq, "none"
        frames.append(f.rename(columns={"bar_datetime": "datetime"}))
    allf = pd.concat(frames, ignore_index=True)
    sdf = spark.createDataFrame(allf.astype({"turn": float})).withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))
    want = bar_features(sdf).toPandas().sort_values("datetime").groupby("symbol").tail(1).set_index("symbol")
    for i, row in enumerate(chosen.itertuples()):
        for name in DEFAULT_SPEC.market_fields:
            assert np.isclose(got.loc[row.snapshot_id, name], want.loc[f"x{i}", name], rtol=1e-7, atol=1e-9), (row.snapshot_id, name)


def test_sequences_against_plain_lookup(stored):
    model = compile_blueprint()
    seqs = dataset_sequences(stored, model, gaps=False).filter(F.col("freq").isin("15min", "daily")).toPandas()
    feats = stored.market_features.toPandas()
    snaps = snapshot_feature_rows(stored, gaps=False).toPandas().set_index("snapshot_id")
    idx = stored.decision_index.toPandas().set_index(["decision_id", "freq"])
    for row in seqs.sample(25, random_state=1).itertuples():
        ix = idx.loc[(row.decision_id, row.freq)]
        names = list(model.channels[row.freq])
        hist = feats[(feats.symbol == row.symbol) & (feats.freq == row.freq) & (feats.bar_datetime <= ix.stable_end_datetime)]
        hist = hist.sort_values("bar_datetime")[names].tail(ix.sequence_window - int(ix.snapshot_required))
        rows = hist.to_numpy(dtype=np.float32)
        if ix.snapshot_required:
            rows = np.vstack([rows, snaps.loc[f"{row.decision_id}|{row.freq}", names].to_numpy(dtype=np.float32)])
        assert len(rows) == row.rows == ix.valid_rows and sum(row.mask) == len(rows)
        values = np.array([list(v) for v in row.values], dtype=np.float32) if hasattr(row, "values") else None
        values = np.array([np.asarray(v) for v in row.values])
        ratio = names.index("sequence_valid_ratio")
        rows[:, ratio] = len(rows) / ix.sequence_window
        assert values.shape == (ix.sequence_window, len(names))
        np.testing.assert_allclose(values[-len(rows):], rows, rtol=1e-6)
        assert not values[: -len(rows)].any()


def test_inputs_and_steps(stored):
    model = compile_blueprint()
    one = dataset_inputs(stored, model, gaps=False).limit(3).toPandas().iloc[0]
    assert set(one["sequences"]) == set(model.channels) and len(one["decision_context"]) == 12
    rows = D.with_liquidity(stored.decisions, stored.market_bars.filter("freq='5min'").withColumnRenamed("bar_datetime", "datetime"),
                            stored.market_bars.filter("freq='daily'").withColumnRenamed("bar_datetime", "datetime"))
    steps = S.step_rows(S.market_steps(rows, inputs.UNIVERSE)).toPandas()
    assert (steps.groupby(["decision_time", "stage"]).size() == len(inputs.UNIVERSE)).all()
    assert steps["active"].sum() == stored.decisions.count()
    assert steps.loc[~steps["active"], "is_zero_volume"].all()


def test_no_lookahead(spark, sf):
    """Later bars never change an earlier decision, index row or partial bar."""
    cut = dt.datetime(2024, 1, 15, 11, 0)
    base, daily = inputs.session_bars(spark, sf), inputs.bars_daily(spark, sf)
    facts = dict(status=inputs.status(spark, sf))
    full = build_dataset(base, daily, **facts)
    short = build_dataset(base.filter(F.col("datetime") <= cut), daily.filter(F.col("datetime") < dt.datetime(2024, 1, 15)), **facts)
    for name, time in (("decisions", "decision_time"), ("decision_index", "decision_time"), ("decision_snapshots", "decision_time")):
        a = getattr(full, name).filter(F.col(time) <= cut)
        b = getattr(short, name).filter(F.col(time) <= cut)
        if name != "decisions":
            a, b = a.filter(F.col("freq").isin("15min", "60min", "daily", "weekly")), b.filter(F.col("freq").isin("15min", "60min", "daily", "weekly"))
        assert a.count() == b.count() > 0
        assert a.exceptAll(b).count() == 0, name


def test_as_of_strict_and_count(spark):
    from barspark.operators.asof import as_of

    left = spark.sql("SELECT 'a' k, timestamp_ntz'2024-01-02 10:00:00' t UNION ALL SELECT 'a', timestamp_ntz'2024-03-01 00:00:00' UNION ALL SELECT 'b', timestamp_ntz'2024-01-01 00:00:00'")
    right = spark.sql("SELECT 'a' k, timestamp_ntz'2024-01-02 10:00:00' r, 1 v UNION ALL SELECT 'a', timestamp_ntz'2024-01-01 00:00:00', 2 UNION ALL SELECT 'b', timestamp_ntz'2024-01-02 00:00:00', 3")
    loose = {(r.k, str(r.t)): (r.v, r.n) for r in as_of(left, right, ["k"], left_time="t", right_time="r", take=["r", "v"], count="n").collect()}
    strict = {(r.k, str(r.t)): (r.v, r.n) for r in as_of(left, right, ["k"], left_time="t", right_time="r", take=["v"], strict=True, count="n").collect()}
    assert loose == {("a", "2024-01-02 10:00:00"): (1, 2), ("a", "2024-03-01 00:00:00"): (1, 2), ("b", "2024-01-01 00:00:00"): (None, 0)}
    assert strict == {("a", "2024-01-02 10:00:00"): (2, 1), ("a", "2024-03-01 00:00:00"): (1, 2), ("b", "2024-01-01 00:00:00"): (None, 0)}


def test_partial_bars_after_missing_prices(spark, sf):
    """Every bar as the partial bar after the one before it: its features are those of the whole history, also after missing prices."""
    from barspark.operators.snapshot import feature_states, snapshot_features
    from pyspark.sql import Window

    bars = inputs.bars_5min(spark, sf).filter("symbol IN ('000001.SZ', '830001.BJ')")
    w = Window.partitionBy("symbol").orderBy("datetime")
    bars = bars.withColumn("n", F.row_number().over(w))
    hole = F.col("n").isin(1, 5, 9, 10, 11, 30) | F.col("n").between(50, 70)
    bars = bars.withColumns({"close": F.when(~hole, F.col("close")), "freq": F.lit("daily"), "before": F.lag("datetime").over(w)}).drop("n")
    snaps = bars.select("symbol", "freq", "adjust", F.col("datetime").alias("bar_datetime"), F.col("before").alias("stable_end_datetime"), "open", "high", "low", "close", "volume", "amount",
                        F.lit(None).cast("double").alias("pctChg"), F.lit(None).cast("double").alias("turn"), F.lit(1.0).alias("progress"),
                        F.concat_ws("|", "symbol", "datetime").alias("snapshot_id"), F.lit("d").alias("decision_id"))
    bars = bars.drop("before")
    got = snapshot_features(snaps, feature_states(bars)).toPandas().set_index(["symbol", "bar_datetime"]).sort_index()
    want = bar_features(bars).toPandas().set_index(["symbol", "datetime"]).sort_index()
    assert len(got) == len(want) > 100
    for name in DEFAULT_SPEC.market_fields:
        np.testing.assert_allclose(got[name].to_numpy(), want[name].to_numpy(), rtol=1e-7, atol=1e-9, err_msg=name)
