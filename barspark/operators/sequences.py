"""Decision index, padded sequences, market steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import period_start, row_id
from ..plans.registry import DEFAULT_SPEC, FeatureSpec, ModelInput, named_vector
from ..schema import FREQUENCIES, INTRADAY, OPEN_AUCTION, SLICE
from .asof import as_of
from .series import BLOCK_ROWS, block_window, blocks, core_rows, number_rows, time_chunk

INDEX_COLUMNS = (
    "decision_id", "symbol", "adjust", "decision_time", "freq", "sequence_window", "stable_end_datetime",
    "snapshot_id", "snapshot_required", "valid_rows", "sequence_valid_ratio",
)


def cutoff(freq: Column) -> Column:
    """Latest bar time a decision may see as completed: strictly before its day, week or month for the long ones."""
    micro = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0.000001))
    seen = F.coalesce("visible_bar_end", "decision_time")
    out = F.when(freq.isin(*INTRADAY), seen)
    for name in ("daily", "weekly", "monthly"):
        out = out.when(freq == name, period_start("decision_time", name).cast("timestamp_ntz") - micro)
    return out


def decision_index(decisions: DataFrame, stable: DataFrame, freqs: Sequence[str] = FREQUENCIES, *,
                   spec: FeatureSpec = DEFAULT_SPEC, trade_freq: str = "5min") -> DataFrame:
    """For each decision and frequency: last completed bar, whether a partial bar follows, valid rows.

    ``stable`` holds the completed bars of all frequencies.
    """
    windows = F.array(*[F.struct(F.lit(f).alias("freq"), F.lit(max(1, spec.windows[f])).alias("w")) for f in freqs])
    asked = decisions.select(
        "decision_id", "symbol", "adjust", "decision_time", "stage", "visible_bar_end", F.explode(windows).alias("_f")
    )
    asked = asked.withColumns({"freq": F.col("_f.freq"), "sequence_window": F.col("_f.w")}).drop("_f")
    asked = asked.withColumns({
        "_cutoff": cutoff(F.col("freq")), "_seen": F.coalesce("visible_bar_end", "decision_time"),
    })
    bars = stable.select("symbol", "adjust", "freq", F.col("datetime").alias("stable_end_datetime"))
    found = as_of(asked, bars, ["symbol", "adjust", "freq"], left_time="_cutoff", right_time="stable_end_datetime",
                  take=["stable_end_datetime"], count="_stable")
    lagging = F.col("stable_end_datetime").isNull() | (F.col("stable_end_datetime") < F.col("_seen"))
    required = (
        F.when(F.col("freq") == trade_freq, F.lit(False))
        .when(F.col("freq").isin(*INTRADAY), (F.col("stage") != OPEN_AUCTION) & lagging)
        .otherwise(F.lit(True))
    )
    found = found.withColumn("snapshot_required", required)
    rows = F.least(F.col("sequence_window"), (F.col("_stable") + F.col("snapshot_required").cast("int"))).cast("int")
    return found.withColumns({
        "snapshot_id": F.when(F.col("snapshot_required"), F.concat_ws("|", "decision_id", "freq")),
        "valid_rows": rows, "sequence_valid_ratio": rows / F.col("sequence_window"),
    }).select(*INDEX_COLUMNS)


def tails(features: DataFrame, channels: dict[str, tuple[str, ...]], spec: FeatureSpec = DEFAULT_SPEC, *,
          ends: DataFrame | None = None, size: int = BLOCK_ROWS) -> DataFrame:
    """For every completed bar the channel arrays of the last N bars up to it, oldest first.

    With ``ends`` (slice and datetime) arrays are built for those bars only, and blocks without one are dropped first.
    """
    parts = []
    for freq, names in channels.items():
        window = max(1, spec.windows[freq])
        rows = features.filter(F.col("freq") == freq).select(*SLICE, "datetime", named_vector(names).alias("_v"))
        numbered = number_rows(rows, SLICE, ["datetime"], time_chunk())
        if ends is not None:
            asked = ends.filter(F.col("freq") == freq).select(*SLICE, "datetime").distinct().withColumn("_asked", F.lit(1))
            numbered = numbered.join(asked, [*SLICE, "datetime"], "left")
        cut = blocks(numbered, size=size, halo=window - 1)
        if ends is not None:
            used = F.max(F.when(F.col("_core"), F.col("_asked"))).over(Window.partitionBy(*SLICE, "_blk"))
            cut = cut.withColumn("_used", used).filter("_used = 1")
        last = F.collect_list("_v").over(block_window(SLICE).rowsBetween(-(window - 1), 0))
        out = cut.withColumn("stable_rows", last)
        parts.append(core_rows(out if ends is None else out.filter("_asked = 1"), "_v", "rn", "_asked", "_used"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pad_left(rows: Column, window: Column, width: int) -> Column:
    """Zero rows in front until there are ``window`` rows."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), width)
    return F.concat(F.array_repeat(zero, (window - F.size(rows)).cast("int")), rows)


def pad_mask(count: Column, window: Column) -> Column:
    """0/1 floats marking the real rows of a padded sequence."""
    return F.concat(
        F.array_repeat(F.lit(0.0).cast("float"), (window - count).cast("int")),
        F.array_repeat(F.lit(1.0).cast("float"), count.cast("int")),
    )


def model_sequences(index: DataFrame, features: DataFrame, snapshot_rows: DataFrame, model: ModelInput,
                    spec: FeatureSpec = DEFAULT_SPEC) -> DataFrame:
    """Padded array, mask and valid ratio per decision and frequency.

    Joins are equi joins on the last completed bar; nothing compares time ranges.
    """
    freqs = list(model.channels)
    wanted = index.filter(F.col("freq").isin(*freqs))
    ends = wanted.select(*SLICE, F.col("stable_end_datetime").alias("datetime")).filter("datetime IS NOT NULL")
    history = tails(features, model.channels, spec, ends=ends).withColumnRenamed("datetime", "stable_end_datetime")
    partial = snapshot_vectors(snapshot_rows, model)
    joined = wanted.join(history, ["symbol", "adjust", "freq", "stable_end_datetime"], "left").join(
        partial, ["decision_id", "freq"], "left"
    )
    empty = F.array().cast("array<array<float>>")
    keep = F.col("sequence_window") - F.col("snapshot_required").cast("int")
    old = F.coalesce("stable_rows", empty)
    kept = F.when(F.size(old) > keep, F.slice(old, F.size(old) - keep + 1, keep)).otherwise(old)
    rows = F.concat(kept, F.when(F.col("_partial").isNotNull(), F.array("_partial")).otherwise(empty))
    out = joined.withColumn("_rows", rows).withColumn("rows", F.size("_rows"))
    out = out.withColumn("valid_ratio", F.least(F.col("rows") / F.col("sequence_window"), F.lit(1.0)))
    values = F.lit(None)
    for freq in freqs:
        names = model.channels[freq]
        seq = F.col("_rows")
        if "sequence_valid_ratio" in names:
            seq = _overwrite(seq, names.index("sequence_valid_ratio"), F.col("valid_ratio").cast("float"), len(names))
        values = F.when(F.col("freq") == freq, pad_left(seq, F.col("sequence_window"), len(names))).otherwise(values)
    return out.select(
        "decision_id", "symbol", "adjust", "decision_time", "freq", "sequence_window", "rows", "valid_ratio",
        values.alias("values"), pad_mask(F.col("rows"), F.col("sequence_window")).alias("mask"),
    )


def snapshot_vectors(snapshot_rows: DataFrame, model: ModelInput) -> DataFrame:
    vector = F.lit(None)
    for freq, names in model.channels.items():
        vector = F.when(F.col("freq") == freq, named_vector(names)).otherwise(vector)
    return snapshot_rows.select("decision_id", "freq", vector.alias("_partial"))


def _overwrite(rows: Column, at: int, value: Column, width: int) -> Column:
    return F.transform(rows, lambda r: F.concat(
        F.slice(r, 1, at) if at else F.array().cast("array<float>"), F.array(value),
        F.slice(r, at + 2, width - at - 1) if at + 1 < width else F.array().cast("array<float>"),
    ))


def model_inputs(sequences: DataFrame, context: DataFrame, model: ModelInput) -> DataFrame:
    """One row per decision: sequences, masks and ratios by frequency, and the context vector."""
    per_decision = sequences.groupBy("decision_id", "symbol", "adjust", "decision_time").agg(
        *[F.map_from_entries(F.collect_list(F.struct("freq", c))).alias(name)
          for c, name in (("values", "sequences"), ("mask", "masks"), ("valid_ratio", "valid_ratios"))]
    )  # at most one row per frequency in a group
    vector = context.select("decision_id", model.context_array().alias("decision_context"))
    return per_decision.join(vector, ["decision_id"], "left").withColumn("schema_hash", F.lit(model.schema_hash))


def expanded(sequences: DataFrame, channels: Sequence[str]) -> DataFrame:
    """One row per decision, frequency and place in the sequence (real rows only)."""
    skip = F.col("sequence_window") - F.col("rows")
    return sequences.select(
        "decision_id", "freq", F.posexplode("values").alias("_p", "_v"), skip.alias("_skip")
    ).filter("_p >= _skip").select(
        "decision_id", "freq", (F.col("_p") - F.col("_skip")).alias("sequence_index"),
        *[F.col("_v")[i].alias(n) for i, n in enumerate(channels)],
    )


def missing_index(decisions: DataFrame, index: DataFrame, freqs: Sequence[str]) -> DataFrame:
    """Decision and frequency pairs without an index row."""
    wanted = decisions.select("decision_id", F.explode(F.array(*map(F.lit, freqs))).alias("freq"))
    return wanted.join(index, ["decision_id", "freq"], "left_anti")


def assert_complete_index(decisions: DataFrame, index: DataFrame, freqs: Sequence[str]) -> None:
    gone = [r["decision_id"] for r in missing_index(decisions, index, freqs).select("decision_id").distinct().limit(20).collect()]
    if gone:
        raise ValueError("decision index is incomplete: " + ", ".join(sorted(gone)))


# ---- market steps -----------------------------------------------------------
# What an absent symbol shows in a step.
ABSENT = {"is_zero_volume": True, "liquidity_volume": 0.0, "liquidity_amount": 0.0}
STEP_FLAGS = ("is_st", "market_can_buy", "market_can_sell", "is_tradeable", "is_limit_up", "is_limit_down", "is_zero_volume")
STEP_NUMBERS = ("execution_price", "limit_reference_close", "limit_pct", "liquidity_volume", "liquidity_amount")


def universe_slots(universe: DataFrame) -> DataFrame:
    """Symbols (``symbol``, and ``slot`` if the order is given) numbered from 0; without ``slot`` in order of the symbol."""
    if "slot" in universe.columns:
        return universe.select("symbol", F.col("slot").cast("int").alias("slot")).distinct()
    # One row per symbol of the universe, whatever the number of bars.
    return universe.select("symbol").distinct().withColumn("slot", F.row_number().over(Window.orderBy("symbol")) - 1)


def market_steps(rows: DataFrame, universe: DataFrame | Sequence[str]) -> DataFrame:
    """One row per decision time, stage and (where rows have it) adjustment: an array over the universe in its order.

    ``universe`` is a frame for ``universe_slots``, or symbols in the wanted order. Symbols without a decision are inactive with fixed
    defaults. A step's group holds at most one row per universe symbol, no product of steps and symbols is formed, and the plan does not grow with
    the universe: its symbols are one array in one row.
    """
    if not isinstance(universe, DataFrame):
        universe = rows.sparkSession.createDataFrame([(s, k) for k, s in enumerate(universe)], "symbol string, slot int")
    slots = universe_slots(universe)
    keys = ["decision_time", "stage", *[c for c in ("adjust",) if c in rows.columns]]
    fields = ["decision_id", *STEP_NUMBERS, *STEP_FLAGS]
    entry = F.struct(*[F.col(c) for c in fields], F.lit(True).alias("active"))
    steps = rows.join(slots, "symbol").groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("slot", entry))).alias("_by_slot"), F.count("*").alias("active_symbols"))

    def default(name: str) -> Column:
        kind = "string" if name == "decision_id" else "double" if name in STEP_NUMBERS else "boolean"
        fallback = ABSENT.get(name, False if name in STEP_FLAGS else None)
        return F.lit(fallback).cast(kind).alias(name)

    absent = F.struct(*[default(n) for n in fields], F.lit(False).alias("active"))
    order = slots.agg(F.array_sort(F.collect_list(F.struct("slot", "symbol"))).alias("_universe"))
    filled = F.transform("_universe", lambda u: F.struct(
        u["symbol"].alias("symbol"), F.coalesce(F.try_element_at("_by_slot", u["slot"]), absent).alias("state")))
    return steps.crossJoin(F.broadcast(order)).select(*keys, "active_symbols", filled.alias("slots"))  # one row


def step_rows(steps: DataFrame) -> DataFrame:
    """Market steps as one row per universe slot."""
    keys = [c for c in ("decision_time", "stage", "adjust") if c in steps.columns]
    return steps.select(*keys, F.posexplode("slots").alias("slot", "s")).select(*keys, "slot", F.col("s.symbol").alias("symbol"), F.col("s.state.*"))


def flat_training_rows(inputs: DataFrame, model: ModelInput) -> DataFrame:
    """Model inputs with each sequence flattened to one float array per frequency."""
    return inputs.select(
        "decision_id", "symbol", "adjust", "decision_time", "decision_context", "schema_hash",
        *[F.flatten(F.col("sequences")[f]).alias(f"sequence_{f}") for f in model.channels],
        *[F.col("masks")[f].alias(f"mask_{f}") for f in model.channels],
    )


def with_row_ids(frame: DataFrame, ts: str = "datetime") -> DataFrame:
    return frame.withColumn("market_row_id", row_id("symbol", "freq", "adjust", ts))


def features_with_bars(features: DataFrame, bars: DataFrame) -> DataFrame:
    """Feature rows and the raw bar of the same row id."""
    raw = bars.drop("symbol", "freq", "adjust", "bar_datetime", "datetime")
    renamed = raw.withColumnsRenamed({c: f"raw_{c}" for c in raw.columns if c != "market_row_id"})
    return features.join(renamed, ["market_row_id"])
