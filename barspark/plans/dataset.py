"""The compact feature dataset: eight linked tables, as lazy DataFrames."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decisions as D
from ..operators import sequences as S
from ..operators.bars import aggregate_bars, as_market_bars
from ..operators.features import META, RAW, bar_features, prepare_bars
from ..operators.snapshot import decision_snapshots, feature_states, snapshot_features
from ..schema import FREQUENCIES, INTRADAY
from .registry import DEFAULT_SPEC, FeatureSpec, ModelInput, compile_blueprint, needed_spec
from .staging import staged


@dataclass
class FeatureDataset:
    decisions: DataFrame
    decision_context: DataFrame
    constraints: DataFrame
    market_bars: DataFrame
    market_features: DataFrame
    decision_index: DataFrame
    decision_snapshots: DataFrame
    dataset_metadata: DataFrame

    @property
    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def for_symbols(self, symbols: Sequence[str]) -> "FeatureDataset":
        def keep(df: DataFrame) -> DataFrame:
            if "symbol" in df.columns:
                return df.filter(F.col("symbol").isin(*symbols))
            if "decision_id" in df.columns:
                return df.filter(F.substring_index("decision_id", "|", 1).isin(*symbols))
            return df

        return FeatureDataset(**{n: keep(t) for n, t in self.tables.items()})

    def register_views(self, prefix: str = "") -> None:
        for name, df in self.tables.items():
            df.createOrReplaceTempView(prefix + name)


def with_turnover(daily: DataFrame, liquidity: DataFrame) -> DataFrame:
    """Daily bars with the day's turnover."""
    facts = liquidity.select(F.upper("symbol").alias("symbol"), F.to_date("date").alias("_date"), "turn")
    return (
        daily.drop("turn").withColumns({"symbol": F.upper("symbol"), "_date": F.to_date("datetime")})
        .join(facts, ["symbol", "_date"], "left").drop("_date")
    )


def stable_bars(base: DataFrame, daily: DataFrame, freqs: Sequence[str] = FREQUENCIES, *,
                stored: dict[str, DataFrame] | None = None, trade_freq: str = "5min") -> DataFrame:
    """Completed bars of every frequency in one frame; stored ones are used where given."""
    parts = []
    for freq in freqs:
        if freq == trade_freq:
            part = base
        elif freq == "daily":
            part = daily
        elif stored and freq in stored:
            part = stored[freq]
        elif freq in INTRADAY:
            part = as_market_bars(aggregate_bars(base, freq, trade_freq))
        else:
            part = as_market_bars(aggregate_bars(daily, freq, "daily"))
        parts.append(prepare_bars(part.withColumn("freq", F.lit(freq))).select(*META, *RAW))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def build_dataset(base: DataFrame, daily: DataFrame, *, status: DataFrame | None = None, liquidity: DataFrame | None = None,
                  freqs: Sequence[str] = FREQUENCIES, spec: FeatureSpec = DEFAULT_SPEC, model: ModelInput | None = None,
                  start: str | None = None, end: str | None = None, trade_freq: str = "5min", stage: bool = False, gaps: bool = True) -> FeatureDataset:
    """The eight tables. With ``stage`` the inputs, decisions and completed bars, which several tables
    start from, are written to the shared folder first instead of being derived again for each. ``gaps=False``: no bar lacks a price.
    """
    cut = staged if stage else lambda df, name: df
    model = model or compile_blueprint(None, spec)
    base, daily = cut(base, "base"), cut(daily if liquidity is None else with_turnover(daily, liquidity), "daily")
    decisions = cut(D.pick_decisions(
        D.decision_points(base, status, trade_freq=trade_freq, require_limit_reference=True), start=start, end=end
    ), "decisions")
    stable = cut(stable_bars(base, daily, freqs, trade_freq=trade_freq), "stable")
    index = S.decision_index(decisions, stable, freqs, spec=spec, trade_freq=trade_freq)
    snapshots = decision_snapshots(decisions, base, daily, [f for f in freqs if f != trade_freq], trade_freq=trade_freq)
    meta = {
        "schema_hash": model.schema_hash, "frequencies": json.dumps(list(freqs)), "trade_frequency": trade_freq,
        "sequence_windows": json.dumps(dict(spec.windows)),
    }
    spark = base.sparkSession
    return FeatureDataset(
        decisions=decisions, decision_context=D.decision_context(decisions), constraints=D.constraints(decisions),
        market_bars=S.with_row_ids(stable).withColumnRenamed("datetime", "bar_datetime"),
        market_features=S.with_row_ids(bar_features(stable, spec, gaps=gaps)).withColumnRenamed("datetime", "bar_datetime"),
        decision_index=index, decision_snapshots=snapshots,
        dataset_metadata=spark.createDataFrame(sorted(meta.items()), "key STRING, value STRING"),
    )


def snapshot_feature_rows(ds: FeatureDataset, spec: FeatureSpec = DEFAULT_SPEC, *, gaps: bool = True) -> DataFrame:
    """Features of every required partial bar of a dataset."""
    ends = ds.decision_index.filter("snapshot_required").select("snapshot_id", "stable_end_datetime")
    states = feature_states(ds.market_bars.withColumnRenamed("bar_datetime", "datetime"), spec, gaps=gaps)
    return snapshot_features(ds.decision_snapshots.join(ends, ["snapshot_id"]), states, spec)


def dataset_sequences(ds: FeatureDataset, model: ModelInput, spec: FeatureSpec = DEFAULT_SPEC, *, gaps: bool = True) -> DataFrame:
    features = ds.market_features.withColumnRenamed("bar_datetime", "datetime")
    partial = snapshot_feature_rows(ds, needed_spec(spec, model), gaps=gaps)
    return S.model_sequences(ds.decision_index, features, partial, model, spec)


def dataset_inputs(ds: FeatureDataset, model: ModelInput, spec: FeatureSpec = DEFAULT_SPEC, *, gaps: bool = True) -> DataFrame:
    context = D.context_with_constraints(ds.decision_context, ds.constraints)
    return S.model_inputs(dataset_sequences(ds, model, spec, gaps=gaps), context, model)


PARTITIONS = {"market_bars": ["freq"], "market_features": ["freq"], "decision_index": ["freq"], "decision_snapshots": ["freq"]}


def write_dataset(ds: FeatureDataset, root: str, mode: str = "overwrite") -> None:
    """Eight Parquet tables. Tasks are ranges of symbol and time, so symbol filters skip row groups and no symbol is one task."""
    for name, df in ds.tables.items():
        time = next((c for c in ("bar_datetime", "decision_time") if c in df.columns), None)
        if time and "symbol" in df.columns:
            order = [*PARTITIONS.get(name, []), "symbol", time]
            df = df.repartitionByRange(*order).sortWithinPartitions(*order)
        writer = df.write.mode(mode)
        if name in PARTITIONS:
            writer = writer.partitionBy(*PARTITIONS[name])
        writer.parquet(f"{root}/{name}")


def read_dataset(spark: SparkSession, root: str, symbols: Sequence[str] | None = None) -> FeatureDataset:
    ds = FeatureDataset(**{f.name: spark.read.parquet(f"{root}/{f.name}") for f in fields(FeatureDataset)})
    return ds if symbols is None else ds.for_symbols(symbols)


def merge_datasets(parts: Sequence[FeatureDataset]) -> FeatureDataset:
    """One dataset from several; metadata is taken once per key."""
    def union(name: str) -> DataFrame:
        out = getattr(parts[0], name)
        for p in parts[1:]:
            out = out.unionByName(getattr(p, name), allowMissingColumns=True)
        return out.dropDuplicates(["key"]) if name == "dataset_metadata" else out

    return FeatureDataset(**{f.name: union(f.name) for f in fields(FeatureDataset)})


def build_summary(ds: FeatureDataset) -> DataFrame:
    """Row counts per table and frequency."""
    parts = [
        df.groupBy("freq").agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "freq", "rows")
        if "freq" in df.columns else df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), F.lit("").alias("freq"), "rows")
        for n, df in ds.tables.items() if n != "dataset_metadata"
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def metadata_values(metadata: DataFrame, schema: dict[str, str], *keep: str) -> DataFrame:
    """Metadata values parsed as JSON where a type is known for the key, else left as text; ``keep`` names more columns."""
    parsed = F.col("value")
    cols = {"text": parsed}
    for key, ddl in schema.items():
        cols[key] = F.when(F.col("key") == key, F.from_json("value", ddl))
    return metadata.select("key", *keep, *[c.alias(n) for n, c in cols.items()])
