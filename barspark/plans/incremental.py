"""Keeping derived tables up to date from fingerprints: plan, apply, summarise."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import period_start, range_filter
from ..operators import inventory as V
from ..operators.bars import stored_bars
from ..schema import INTRADAY
from ..sources.sinks import BAR_PARTITIONS, with_month
from ..sources.store import Change, Store
from .staging import staged

KEY = ["symbol", "adjust"]
SKIP, APPEND, FULL, ADOPT = "skip", "append", "full", "adopt"


def _stats(bars: DataFrame, prefix: str) -> DataFrame:
    return bars.groupBy(*KEY).agg(
        F.count("*").alias(f"{prefix}_rows"), F.min("datetime").alias(f"{prefix}_start"), F.max("datetime").alias(f"{prefix}_end"),
        V.fingerprint().alias(f"{prefix}_hash"),
    )


def plan_rebuild(base: DataFrame, target: DataFrame, manifest: DataFrame, *, base_freq: str, target_freq: str,
                 source: str | None = None) -> DataFrame:
    """What each series needs: skip, adopt (no manifest but a complete target), append from a period start, or full.

    ``base`` and ``target`` hold one frequency each. A changed row anywhere in the known prefix means full.
    """
    tag = source or f"derived_from_{base_freq}"
    have = _stats(target.filter(F.col("source") == tag), "target")
    known = manifest.filter((F.col("base_freq") == base_freq) & (F.col("target_freq") == target_freq)).select(
        *KEY, *[F.col(c).alias(f"m_{c}") for c in ("base_start", "base_end", "base_rows", "base_hash", "target_rows")]
    )
    # One pass over the base gives the whole and the prefix that the manifest knows.
    old = F.col("datetime") <= F.col("_known_end")
    now = base.join(known.select(*KEY, F.col("m_base_end").alias("_known_end")), KEY, "left").withColumn("_x", F.xxhash64(*V.HASHED)).groupBy(*KEY).agg(
        F.count("*").alias("now_rows"), F.min("datetime").alias("now_start"), F.max("datetime").alias("now_end"), F.bit_xor("_x").alias("now_hash"),
        F.count(F.when(old, 1)).alias("prefix_rows"), F.bit_xor(F.when(old, F.col("_x"))).alias("prefix_hash"))
    want = V.expected_target_coverage(base.join(known, KEY, "left_anti"), target_freq, base_freq).select(
        *KEY, F.col("rows").alias("want_rows"), F.col("first_datetime").alias("want_start"), F.col("last_datetime").alias("want_end")
    )
    df = now.join(known, KEY, "left").join(have, KEY, "left").join(want, KEY, "left")

    def same(*pairs: tuple[str, str]) -> Column:
        out = F.lit(True)
        for a, b in pairs:
            out = out & F.coalesce(F.col(a) == F.col(b), F.lit(False))
        return out

    intact = same(("target_rows", "m_target_rows"), ("target_end", "m_base_end"))
    unchanged = same(("now_rows", "m_base_rows"), ("now_hash", "m_base_hash"), ("now_start", "m_base_start"), ("now_end", "m_base_end"))
    complete = same(("target_rows", "want_rows"), ("target_start", "want_start"), ("target_end", "want_end"))
    grown = intact & same(("now_start", "m_base_start"), ("prefix_rows", "m_base_rows"), ("prefix_hash", "m_base_hash")) & (F.col("now_end") > F.col("m_base_end"))
    action = (
        F.when(F.col("m_base_rows").isNull(), F.when(complete, ADOPT).otherwise(FULL))
        .when(unchanged & intact, SKIP).when(grown, APPEND).otherwise(FULL)
    )
    from_day = period_start("m_base_end", target_freq if target_freq not in INTRADAY else "daily").cast("timestamp_ntz")
    return df.withColumn("action", action).select(
        *KEY, "action", F.when(F.col("action") == APPEND, from_day).alias("rebuild_start"),
        F.col("now_start").alias("base_start"), F.col("now_end").alias("base_end"), F.col("now_rows").alias("base_rows"),
        F.col("now_hash").alias("base_hash"), F.coalesce("target_rows", F.lit(0)).alias("old_target_rows"),
    )


def generate(base: DataFrame, plan: DataFrame, *, base_freq: str, target_freq: str, source: str | None = None) -> DataFrame:
    """Target rows for the planned series; appended ones take their first pctChg from the last stored period."""
    todo = plan.filter(F.col("action").isin(APPEND, FULL)).select(*KEY, "rebuild_start")
    # One period of lead-in gives the previous close; its rows are cut off after aggregation.
    lead = base.join(todo, KEY).filter("rebuild_start IS NULL OR datetime < rebuild_start")
    anchor = lead.filter("rebuild_start IS NOT NULL").groupBy(*KEY).agg(
        F.max(period_start("datetime", target_freq if target_freq not in INTRADAY else "daily")).cast("timestamp_ntz").alias("lead_start")
    )
    rows = base.join(todo, KEY).join(anchor, KEY, "left").filter("rebuild_start IS NULL OR datetime >= coalesce(lead_start, rebuild_start)")
    built = stored_bars(rows.drop("rebuild_start", "lead_start"), target_freq, base_freq, source=source)
    return built.join(todo, KEY).filter("rebuild_start IS NULL OR datetime >= rebuild_start").drop("rebuild_start")


def apply_plan(target: DataFrame, generated: DataFrame, plan: DataFrame) -> DataFrame:
    """The target after the plan: planned series lose what is rebuilt and gain the generated rows."""
    cut = plan.filter(F.col("action").isin(APPEND, FULL)).select(*KEY, "action", "rebuild_start")
    kept = target.join(cut, KEY, "left").filter(
        F.col("action").isNull() | ((F.col("action") == APPEND) & (F.col("datetime") < F.col("rebuild_start")))
    ).drop("action", "rebuild_start")
    return kept.unionByName(generated, allowMissingColumns=True)


def next_manifest(manifest: DataFrame, plan: DataFrame, new_target: DataFrame, *, base_freq: str, target_freq: str,
                  source: str | None = None) -> DataFrame:
    """Manifest with the rows of all series that were built or adopted replaced."""
    tag = source or f"derived_from_{base_freq}"
    counts = new_target.filter(F.col("source") == tag).groupBy(*KEY).agg(F.count("*").alias("target_rows"))
    fresh = plan.filter(F.col("action") != SKIP).join(counts, KEY, "left").select(
        "symbol", F.lit(base_freq).alias("base_freq"), F.lit(target_freq).alias("target_freq"), "adjust", F.lit(tag).alias("source"),
        "base_start", "base_end", "base_rows", "base_hash", F.coalesce("target_rows", F.lit(0)).alias("target_rows"),
        F.localtimestamp().alias("generated_at"),
    )
    key = ["symbol", "base_freq", "target_freq", "adjust"]
    return manifest.join(fresh.select(*key), key, "left_anti").unionByName(fresh)


def materialize(base: DataFrame, target: DataFrame, manifest: DataFrame, *, base_freq: str, target_freq: str,
                source: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(target, manifest, summary) after bringing every series up to date.

    The plan (one row per series) and the generated rows are each needed several times, so both are
    written to the shared folder once instead of being computed again.
    """
    plan = staged(plan_rebuild(base, target, manifest, base_freq=base_freq, target_freq=target_freq, source=source), "plan")
    made = staged(generate(base, plan, base_freq=base_freq, target_freq=target_freq, source=source), "generated")
    new = apply_plan(target, made, plan)
    return new, next_manifest(manifest, plan, new, base_freq=base_freq, target_freq=target_freq, source=source), summary(plan, made, target_freq)


MANIFEST = ("symbol STRING, base_freq STRING, target_freq STRING, adjust STRING, source STRING, base_start TIMESTAMP_NTZ, base_end TIMESTAMP_NTZ, "
            "base_rows BIGINT, base_hash BIGINT, target_rows BIGINT, generated_at TIMESTAMP_NTZ")


def materialize_store(base: DataFrame, store: Store, *, base_freq: str, target_freq: str, source: str | None = None) -> DataFrame:
    """Bring the stored bars of ``target_freq`` up to date and return the summary.

    Only months that lose or gain rows are written. They and the manifest rows are swapped in one version, so a lost driver leaves the old bars with
    the old manifest, and the next run does the work again.
    """
    spark = base.sparkSession
    empty = stored_bars(base.limit(0), target_freq, base_freq, source=source)
    old = store.read("bars") if store.has("bars") else with_month(empty)
    manifest = store.read("manifest") if store.has("manifest") else spark.createDataFrame([], MANIFEST)
    target = old.filter(F.col("freq") == target_freq)
    plan = staged(plan_rebuild(base, target.drop("month"), manifest, base_freq=base_freq, target_freq=target_freq, source=source), "plan")
    made = staged(with_month(generate(base, plan, base_freq=base_freq, target_freq=target_freq, source=source)), "generated")
    todo = plan.filter(F.col("action").isin(APPEND, FULL)).select(*KEY, F.date_format("rebuild_start", "yyyy-MM").alias("_from"))
    lost = target.select(*KEY, *BAR_PARTITIONS[:1], "month").distinct().join(todo, KEY).filter("_from IS NULL OR month >= _from")
    months = staged(lost.select(*BAR_PARTITIONS).unionByName(made.select(*BAR_PARTITIONS)).distinct(), "months")
    rows = apply_plan(target.join(months, list(BAR_PARTITIONS), "left_semi"), made, plan)
    counts = apply_plan(target.select(*KEY, "datetime", "source"), made.select(*KEY, "datetime", "source"), plan)
    listed = next_manifest(manifest, plan, counts, base_freq=base_freq, target_freq=target_freq, source=source)
    store.commit({"bars": Change(rows.select(*old.columns), BAR_PARTITIONS, touched=months, order=("symbol", "datetime")), "manifest": Change(listed)})
    return summary(plan, made, target_freq)


def summary(plan: DataFrame, generated: DataFrame, target_freq: str, requested: DataFrame | None = None) -> DataFrame:
    """Saved and base rows with a status per symbol, and a total row."""
    saved = generated.groupBy("symbol").agg(F.count("*").alias("saved_rows"))
    done = plan.groupBy("symbol").agg(F.sum("base_rows").alias("base_rows"), F.max(F.col("action").isin(APPEND, FULL).cast("int")).alias("_b"))
    if requested is not None:
        done = requested.select("symbol").distinct().join(done, ["symbol"], "left")
    rows = done.join(saved, ["symbol"], "left").select(
        "symbol", F.lit(target_freq).alias("target_freq"), F.coalesce("base_rows", F.lit(0)).alias("base_rows"),
        F.coalesce("saved_rows", F.lit(0)).alias("saved_rows"),
        F.when(F.col("base_rows").isNull(), "missing_base").when(F.col("_b") == 0, "skipped").otherwise("ok").alias("status"),
    )
    total = rows.agg(
        F.lit("__TOTAL__").alias("symbol"), F.lit(target_freq).alias("target_freq"), F.sum("base_rows").alias("base_rows"),
        F.sum("saved_rows").alias("saved_rows"), F.lit("ok").alias("status"),
    )
    return rows.unionByName(total)


def manifest_matches(manifest: DataFrame, base_catalog: DataFrame, target_catalog: DataFrame, *, base_freq: str, target_freq: str) -> DataFrame:
    """Whether each manifest row still describes both catalog entries."""
    b = base_catalog.filter(F.col("freq") == base_freq).select(*KEY, F.col("rows").alias("b_rows"), F.col("data_hash").alias("b_hash"),
                                                               F.col("end_datetime").alias("b_end"))
    t = target_catalog.filter(F.col("freq") == target_freq).select(*KEY, F.col("rows").alias("t_rows"))
    df = manifest.filter((F.col("base_freq") == base_freq) & (F.col("target_freq") == target_freq)).join(b, KEY, "left").join(t, KEY, "left")
    ok = (F.col("b_rows") == F.col("base_rows")) & (F.col("b_hash") == F.col("base_hash")) & (F.col("b_end") == F.col("base_end")) & (F.col("t_rows") == F.col("target_rows"))
    return df.select(*KEY, F.coalesce(ok, F.lit(False)).alias("matches"))


# ---- features per symbol -----------------------------------------------------------
def build_signature(settings: dict) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def symbol_fingerprints(sources: dict[str, DataFrame], signature: str) -> DataFrame:
    """One fingerprint per symbol over the build settings and every source table's slice catalog."""
    parts = None
    for name, df in sorted(sources.items()):
        hashed = [c for c in df.columns if c != "symbol"]
        one = df.groupBy("symbol").agg(
            F.struct(F.lit(name).alias("table"), F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*hashed)).alias("hash")).alias("s")
        )
        parts = one if parts is None else parts.unionByName(one)
    # One entry per source table and symbol.
    return parts.groupBy("symbol").agg(
        F.sha2(F.concat(F.lit(signature), F.to_json(F.sort_array(F.collect_list("s")))), 256).alias("fingerprint")
    )


def plan_features(current: DataFrame, stored: DataFrame) -> DataFrame:
    """reuse, rebuild or drop per symbol."""
    old = stored.select("symbol", F.col("fingerprint").alias("old"))
    return current.join(old, ["symbol"], "full_outer").select(
        "symbol", F.when(F.col("fingerprint").isNull(), "drop").when(F.col("fingerprint").eqNullSafe(F.col("old")), "reuse").otherwise("rebuild").alias("action"),
        "fingerprint",
    )


def bounded_rebuild(base: DataFrame, *, base_freq: str, target_freq: str, start: str | None, end: str | None) -> DataFrame:
    """Target rows of a requested range, built from the period start so the first period is whole."""
    rows = base
    if start is not None:
        first = period_start(F.lit(start).cast("timestamp_ntz"), target_freq if target_freq not in INTRADAY else "daily").cast("timestamp_ntz")
        rows = rows.filter(F.col("datetime") >= first)
    return stored_bars(rows.filter(range_filter("datetime", None, end)), target_freq, base_freq)
