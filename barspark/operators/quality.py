"""Validation, coverage and comparison reports as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import BOUNDARY_DAYS, business_days, expected_minimum_rows, is_bad_number, lookup
from ..plans.registry import DEFAULT_SPEC, FeatureSpec
from ..schema import BAR_KEY, FREQUENCIES, PRICE_COLUMNS, SEQUENCE_WINDOWS, SLICE
from . import inventory as V
from .asof import as_of
from .series import running, time_chunk

REQUIRED = ("symbol", "datetime", "open", "high", "low", "close", "volume")
# Allowed difference per compared column.
TOLERANCE = {"open": 1e-6, "high": 1e-6, "low": 1e-6, "close": 1e-6, "volume": 1e-6, "amount": 1e-2}


def count_if(c: Column) -> Column:
    return F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("bigint")), F.lit(0))


def _texts(df: DataFrame) -> set[str]:
    return {name for name, kind in df.dtypes if kind == "string"}


def _value(df: DataFrame, name: str) -> Column:
    """A numeric column, with text that is no number as NULL."""
    c = F.col(name).try_cast("double") if name in _texts(df) else F.col(name).cast("double")
    return F.when(~F.isnan(c), c)


def validate_bars(df: DataFrame) -> DataFrame:
    """One row per check: name, severity (error or warning), count of offending rows."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        return df.sparkSession.createDataFrame([(f"missing_column_{c}", "error", 1) for c in missing], "check STRING, severity STRING, count BIGINT")
    time = F.col("datetime").try_cast("timestamp_ntz") if "datetime" in _texts(df) else F.col("datetime")
    o, h, l, c = (_value(df, x) for x in PRICE_COLUMNS)
    whole = o.isNotNull() & h.isNotNull() & l.isNotNull() & c.isNotNull()
    checks: list[tuple[str, str, Column]] = [("invalid_datetime", "error", count_if(time.isNull()))]
    checks += [(f"invalid_{x}", "error", count_if(_value(df, x).isNull())) for x in PRICE_COLUMNS]
    checks.append(("invalid_volume", "warning", count_if(_value(df, "volume").isNull())))
    checks += [(f"invalid_{x}", "warning", count_if(F.col(x).isNotNull() & _value(df, x).isNull())) for x in ("amount", "pctChg") if x in df.columns]
    checks.append(("price_relation", "warning", count_if(
        whole & ((h < o) | (h < c) | (h < l) | (l > o) | (l > c)))))
    checks += [(f"negative_{x}", "warning", count_if(_value(df, x) < 0)) for x in (*PRICE_COLUMNS, "volume", "amount") if x in df.columns]
    one = df.agg((F.count("*") == 0).cast("bigint").alias("empty"), *[e.alias(f"{n}:{s}") for n, s, e in checks])
    table = one.select(F.explode(F.array(
        F.struct(F.lit("empty").alias("check"), F.lit("warning").alias("severity"), F.col("empty").alias("count")),
        *[F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"), F.col(f"`{n}:{s}`").alias("count")) for n, s, _ in checks],
    )).alias("r")).select("r.*")
    if not set(BAR_KEY) <= set(df.columns):
        return table
    repeats = df.groupBy(*BAR_KEY).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"))
    return table.unionByName(repeats.select(F.lit("duplicate_key").alias("check"), F.lit("warning").alias("severity"), "count"))


def assert_valid_bars(df: DataFrame) -> None:
    bad = validate_bars(df).filter("severity = 'error' AND count > 0").collect()  # a handful of checks
    if bad:
        raise ValueError("invalid bars: " + ", ".join(f"{r['check']}={r['count']}" for r in bad))


def calendar_gaps(bars: DataFrame, max_days: int = 14) -> DataFrame:
    """Bars that come more than ``max_days`` whole days after the one before."""
    df = running(bars, SLICE, ["datetime"], time_chunk(), {"previous": ("last", "datetime")}, exclusive=True)
    days = F.extract(F.lit("DAY"), F.col("datetime") - F.col("previous"))
    return df.withColumn("gap_days", days).filter(F.col("gap_days") > max_days)


def consistency_report(bars: DataFrame, *, max_gap_days: int = 14) -> DataFrame:
    """Issues and warnings per symbol; rows with an unreadable time only count as such."""
    o, h, l, c = (F.col(x) for x in PRICE_COLUMNS)
    known = F.col("datetime").isNotNull()
    counts = {
        "rows": known, "bad_datetime": ~known,
        **{f"bad_{x}": known & is_bad_number(x) for x in (*PRICE_COLUMNS, "volume")},
        "high_below_low": known & (h < l), "high_below_open": known & (h < o),
        "high_below_close": known & (h < c), "low_above_open": known & (l > o),
        "low_above_close": known & (l > c),
        "negative_price": known & ((o < 0) | (h < 0) | (l < 0) | (c < 0)),
        "negative_volume": known & (F.col("volume") < 0),
    }
    base = bars.groupBy("symbol").agg(*[count_if(x).alias(n) for n, x in counts.items()])
    # Inside so many days no gap is too long, so the first and last times of each such span tell all long gaps.
    span = F.floor(F.unix_date(F.to_date("datetime")) / (max_gap_days + 1))
    inside = Window.partitionBy("symbol", "_span").orderBy("datetime")
    times = bars.filter(known).select("symbol", "datetime", span.alias("_span"))
    times = times.withColumn("_again", F.lag("datetime").over(inside) == F.col("datetime"))
    spans = times.groupBy("symbol", "_span").agg(
        count_if(F.col("_again")).alias("_repeats"), F.min("datetime").alias("_first"), F.max("datetime").alias("_last"))
    previous = F.lag("_last").over(Window.partitionBy("symbol").orderBy("_span"))
    spans = spans.withColumn("_gap", F.extract(F.lit("DAY"), F.col("_first") - previous) > max_gap_days)
    found = spans.groupBy("symbol").agg(F.sum("_repeats").alias("duplicates"), count_if(F.col("_gap")).alias("large_gaps"))
    df = base.join(found, ["symbol"], "left").na.fill(0, ["duplicates", "large_gaps"])

    def named(cols: Sequence[str]) -> Column:
        return F.array_compact(F.array(*[F.when(F.col(x) > 0, F.lit(x)) for x in cols]))

    first = ["bad_datetime", "duplicates", *[f"bad_{x}" for x in (*PRICE_COLUMNS, "volume")]]
    later = ["high_below_low", "negative_price", "negative_volume"]
    broken = F.size(named(first)) > 0  # these stop the other checks
    issues = F.when(broken, named(first)).otherwise(named(later))
    warnings = F.when(broken, F.array().cast("array<string>")).otherwise(
        named(["high_below_open", "high_below_close", "low_above_open", "low_above_close", "large_gaps"]))
    return df.withColumns({"issues": issues, "warnings": warnings}).withColumn("ok", F.size("issues") == 0)


def quality_report(bars: DataFrame) -> DataFrame:
    """Rows, range, NULL counts, repeated keys and validity per symbol."""
    cols = [c for c in bars.columns if c != "symbol"]
    bad = F.lit(False)
    for c in ("datetime", *PRICE_COLUMNS):
        bad = bad | F.col(c).isNull()
    base = bars.groupBy("symbol").agg(
        F.count("*").alias("rows"), F.min("datetime").alias("start_datetime"), F.max("datetime").alias("end_datetime"),
        *[count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols], (count_if(bad) == 0).alias("validation_ok"),
    )
    repeats = bars.groupBy("symbol", "datetime").agg((F.count("*") - 1).alias("n")).groupBy("symbol").agg(F.sum("n").alias("duplicate_count"))
    return base.join(repeats, ["symbol"])


def availability_report(bars: DataFrame, *, symbols: DataFrame | None = None, min_rows: int = 200,
                        required_start: str | None = None, required_end: str | None = None) -> DataFrame:
    """Whether each symbol has enough rows in the required range, judged on its daily slice if it has one."""
    from .selection import prefer_daily

    slices = bars.groupBy(*SLICE).agg(F.count("*").alias("rows"), F.min("datetime").alias("start_datetime"), F.max("datetime").alias("end_datetime"))
    best = prefer_daily(slices)
    if symbols is not None:
        best = symbols.select("symbol").distinct().join(best, ["symbol"], "left")
    start = F.lit(required_start).cast("timestamp_ntz")
    end = F.lit(required_end).cast("timestamp_ntz")
    issues = F.array_compact(F.array(
        F.when(F.col("rows").isNull(), "not_found"), F.when(F.col("rows") < min_rows, "too_few_rows"),
        F.when(F.col("start_datetime") > start, "starts_late"), F.when(F.col("end_datetime") < end, "ends_early"),
    ))
    return best.select(
        "symbol", (F.size(issues) == 0).alias("available"), F.coalesce("rows", F.lit(0)).alias("rows"),
        F.to_date("start_datetime").alias("start_date"), F.to_date("end_datetime").alias("end_date"), issues.alias("issues"),
    )


def available_universe(bars: DataFrame, candidates: DataFrame, **kw) -> DataFrame:
    return availability_report(bars, symbols=candidates, **kw).filter("available").select("symbol")


# ---- two sets of the same bars -----------------------------------------------------
def _matched(generated: DataFrame, direct: DataFrame, key: Column, tolerance: Mapping[str, float]) -> DataFrame:
    ids = ["symbol", "adjust", "compare_key"]
    g = generated.select("symbol", "adjust", key.alias("compare_key"), F.struct(*tolerance).alias("g"))
    d = direct.select("symbol", "adjust", key.alias("compare_key"), F.struct(*tolerance).alias("d"))
    both = g.join(d, ids, "full_outer")
    for c in tolerance:
        diff = F.abs(F.col(f"g.{c}") - F.col(f"d.{c}"))
        off = (F.col(f"g.{c}").isNull() != F.col(f"d.{c}").isNull()) | (F.coalesce(diff, F.lit(0.0)) > tolerance[c])
        both = both.withColumns({f"diff_{c}": diff, f"off_{c}": F.col("g").isNotNull() & F.col("d").isNotNull() & off})
    return both


def compare_bars(generated: DataFrame, direct: DataFrame, *, daily_or_longer: bool = True,
                 tolerance: Mapping[str, float] = TOLERANCE) -> DataFrame:
    """Generated against directly stored bars per symbol: matched, missing on either side, mismatches, largest difference per column."""
    key = F.to_date("datetime").cast("timestamp_ntz") if daily_or_longer else F.col("datetime")
    both = _matched(generated, direct, key, tolerance)
    matched = F.col("g").isNotNull() & F.col("d").isNotNull()
    any_off = F.lit(False)
    for c in tolerance:
        any_off = any_off | F.col(f"off_{c}")
    out = both.groupBy("symbol", "adjust").agg(
        count_if(matched).alias("matched_rows"), count_if(F.col("g").isNull()).alias("missing_generated"),
        count_if(F.col("d").isNull()).alias("missing_direct"), count_if(any_off).alias("mismatch_rows"),
        *[F.coalesce(F.max(F.when(matched, F.col(f"diff_{c}"))), F.lit(0.0)).alias(f"max_diff_{c}") for c in tolerance],
        *[count_if(F.col(f"off_{c}")).alias(f"mismatch_{c}") for c in tolerance],
    )
    ok = (F.col("matched_rows") > 0) & (F.col("mismatch_rows") + F.col("missing_generated") + F.col("missing_direct") == 0)
    return out.withColumn("ok", ok)


def mismatch_samples(generated: DataFrame, direct: DataFrame, n: int = 20, *, daily_or_longer: bool = True,
                     tolerance: Mapping[str, float] = TOLERANCE) -> DataFrame:
    """The first differing or one-sided keys (a report, so limited)."""
    key = F.to_date("datetime").cast("timestamp_ntz") if daily_or_longer else F.col("datetime")
    both = _matched(generated, direct, key, tolerance)
    kind = F.when(F.col("g").isNull(), "missing_generated").when(F.col("d").isNull(), "missing_direct")
    for c in tolerance:
        kind = kind.when(F.col(f"off_{c}"), F.lit("mismatch"))
    return both.withColumn("kind", kind).filter("kind IS NOT NULL").orderBy("symbol", "adjust", "compare_key").limit(n).select(
        "symbol", "adjust", "compare_key", "kind")


def frame_quality(df: DataFrame, clips: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Per numeric column: NULL or NaN values, infinities, values at a clip bound."""
    cols = [n for n, kind in df.dtypes if kind in ("double", "float", "int", "bigint")]

    def at_bound(c: str) -> Column:
        return F.col(c).isin(*clips[c]) if c in clips else F.lit(False)

    one = df.agg(F.count("*").alias("rows"), *[F.struct(
        count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias("missing"),
        count_if(F.abs(F.col(c).cast("double")) == float("inf")).alias("infinite"), count_if(at_bound(c)).alias("at_bound"),
    ).alias(f"_{c}") for c in cols])
    return one.select("rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{c}").alias("v")) for c in cols])).alias("t")).select(
        F.col("t.column").alias("column"), "rows", "t.v.missing", "t.v.infinite", "t.v.at_bound")


# ---- coverage -----------------------------------------------------------------------
def session_days(bars: DataFrame) -> DataFrame:
    return bars.select(F.upper("symbol").alias("symbol"), F.to_date("datetime").alias("date")).distinct()


def missing_status_days(bars: DataFrame, status: DataFrame) -> DataFrame:
    known = status.filter("is_st IS NOT NULL").select(F.upper("symbol").alias("symbol"), F.to_date("date").alias("date"))
    return session_days(bars).join(known, ["symbol", "date"], "left_anti")


def status_coverage(bars: DataFrame, status: DataFrame) -> DataFrame:
    """Symbol-days that need a status, have one, lack one, and are special, per symbol."""
    joined = session_days(bars).join(V.status_per_day(status.filter("is_st IS NOT NULL")), ["symbol", "date"], "left")
    return joined.groupBy("symbol").agg(
        F.count("*").alias("required_days"), F.count("is_st").alias("covered_days"),
        (F.count("*") - F.count("is_st")).alias("missing_days"), count_if(F.col("is_st")).alias("st_days"),
    )


def require_status(bars: DataFrame, status: DataFrame) -> DataFrame:
    """The bars, or an error that lists the first symbol-days without a status."""
    gone = missing_status_days(bars, status).orderBy("symbol", "date").limit(20).collect()
    if gone:
        raise ValueError("no status for " + ", ".join(f"{r['symbol']} {r['date']}" for r in gone))
    return bars


def required_warmup(spec: FeatureSpec, freq: str) -> int:
    return spec.longest_lookback(freq)


def warmup_report(base: DataFrame, daily: DataFrame, *, start: str | None, spec: FeatureSpec = DEFAULT_SPEC,
                  freqs: Sequence[str] = FREQUENCIES) -> DataFrame:
    """Bars before the start against what the features need, per symbol and frequency."""
    have = V.bars_available(base, daily, before=start)
    asked = base.select("symbol").distinct().select("symbol", F.explode(F.array(*map(F.lit, freqs))).alias("freq"))
    need = lookup({f: required_warmup(spec, f) for f in freqs}, "freq", 20)
    return asked.join(have, ["symbol", "freq"], "left").select(
        "symbol", "freq", F.coalesce("bars", F.lit(0)).alias("available_bars"), need.cast("bigint").alias("required_bars"),
    ).withColumn("short", F.col("available_bars") < F.col("required_bars"))


def reference_coverage(base: DataFrame) -> DataFrame:
    """Sessions with and without a previous close, and the bars of those that have one."""
    from .decisions import sessions

    s = sessions(base)
    later = F.col("session_rank") > 1
    return s.agg(F.count("*").alias("decision_sessions"), count_if(later).alias("eligible_sessions"), count_if(~later).alias("missing_sessions"),
                 F.coalesce(F.sum(F.when(later, F.col("bars"))), F.lit(0)).alias("eligible_bars"))


def preflight(base: DataFrame, daily: DataFrame, status: DataFrame, *, start: str | None = None, spec: FeatureSpec = DEFAULT_SPEC,
              freqs: Sequence[str] = FREQUENCIES) -> DataFrame:
    """Every check before a build: name, pass / warn / error and its figure; ``overall`` is the worst."""
    def row(df: DataFrame, name: Column | str, value: Column, level: Column) -> DataFrame:
        return df.select((F.lit(name) if isinstance(name, str) else name).alias("check"), level.alias("status"), value.cast("double").alias("value"))

    def judge(bad: Column, level: str) -> Column:
        return F.when(bad, level).otherwise("pass")

    n = F.col("n")
    checks = [
        row(base.agg(F.count("*").alias("n")), "base_rows", n, judge(n == 0, "error")),
        row(daily.agg(F.count("*").alias("n")), "daily_rows", n, judge(n == 0, "warn")),
        row(reference_coverage(base), "limit_reference_coverage", F.col("missing_sessions"), F.lit("pass")),
        row(missing_status_days(base, status).agg(F.count("*").alias("n")), "status_coverage", n, judge(n > 0, "error")),
        row(warmup_report(base, daily, start=start, spec=spec, freqs=freqs).groupBy("freq").agg(count_if(F.col("short")).alias("n"), F.sum("available_bars").alias("a")),
            F.concat(F.lit("warmup_"), F.col("freq")), n, judge(n > 0, "warn")),
        row(V.bad_numbers(base, ["open", "high", "low", "close", "volume", "amount"]).agg(F.sum(F.col("nulls") + F.col("non_finite")).alias("n")), "number_scan", n, judge(n > 0, "warn")),
        row(reference_coverage(base).withColumn("n", F.col("eligible_bars") + F.col("eligible_sessions")), "decision_points", n, judge(n == 0, "error")),
        row(V.dataset_estimate(base, daily, {f: SEQUENCE_WINDOWS[f] for f in freqs}), "size_estimate", F.col("unique_rows"), F.lit("pass")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    worst = out.agg(F.max(F.when(F.col("status") == "error", 2).when(F.col("status") == "warn", 1).otherwise(0)).alias("w"))
    overall = worst.select(F.lit("overall").alias("check"), F.when(F.col("w") == 2, "error").when(F.col("w") == 1, "warn").otherwise("pass").alias("status"),
                           F.col("w").cast("double").alias("value"))
    return out.unionByName(overall)


def rule_audit(decisions: DataFrame) -> DataFrame:
    return decisions.agg(
        F.count("*").alias("decisions"), count_if(F.col("is_st")).alias("st_decisions"),
        count_if(~F.col("status_known")).alias("unknown_status"), count_if(~F.col("has_limit_reference")).alias("missing_limit_reference"),
    )


def short_sequences(index: DataFrame) -> DataFrame:
    return index.groupBy("freq").agg(count_if(F.col("valid_rows") < F.col("sequence_window")).alias("short"), F.count("*").alias("rows"))


def dataset_checks(ds, *, expected_hash: str | None = None) -> DataFrame:
    """Invariants of a feature dataset: schema, aligned rows, full index, known rules, rows at every frequency."""
    def n(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias(name))

    freqs = ds.decision_index.agg(F.count_distinct("freq").alias("freqs"), F.count("*").alias("index_rows"))
    rules = rule_audit(ds.decisions)
    features = ds.market_features.agg(F.count_distinct("freq").alias("feature_freqs"))
    schema = ds.dataset_metadata.filter("key = 'schema_hash'").agg(F.max("value").alias("hash"))
    one = rules
    for part in (freqs, n(ds.decision_context, "contexts"), n(ds.constraints, "limits"), features, schema):
        one = one.crossJoin(part)  # one row each
    right_hash = F.col("hash").isNotNull() if expected_hash is None else F.coalesce(F.col("hash") == expected_hash, F.lit(False))
    tests = {
        "model_schema": right_hash,
        "decision_alignment": (F.col("decisions") > 0) & (F.col("contexts") == F.col("decisions")) & (F.col("limits") == F.col("decisions")),
        "decision_index": (F.col("freqs") > 0) & (F.col("index_rows") == F.col("decisions") * F.col("freqs")),
        "market_rules": (F.col("unknown_status") == 0) & (F.col("missing_limit_reference") == 0),
        "market_rows": F.col("feature_freqs") >= F.col("freqs"),
    }
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.when(t, "pass").otherwise("error").alias("status")) for k, t in tests.items()])).alias("r")).select("r.*")


def sequence_checks(sequences: DataFrame, widths: Mapping[str, int]) -> DataFrame:
    """Sequences whose shape or values are wrong, per frequency (all are checked, none sampled)."""
    width = lookup(dict(widths), "freq", -1)
    shaped = (F.size("values") == F.col("sequence_window")) & F.forall("values", lambda r: F.size(r) == width) & (F.size("mask") == F.col("sequence_window"))
    good = F.forall("values", lambda r: F.forall(r, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return sequences.groupBy("freq").agg(F.count("*").alias("rows"), count_if(~shaped).alias("wrong_shape"), count_if(~good).alias("not_finite"))


def _weekdays(start: Column, end: Column, share: float) -> Column:
    return F.greatest(F.lit(1), F.floor(business_days(start, end) * share)).cast("bigint")


def neighbours(asked: DataFrame, days: DataFrame) -> DataFrame:
    """For every different ``date`` of ``asked`` the nearest of ``days`` (date, n) at or before it (le), before it (lt), at or after (ge), after (gt), and
    the sums of n up to it and before it. A row for each different date at most, so a few ten thousand are ordered."""
    marked = asked.select(F.col("date").cast("date").alias("date"), F.lit(None).cast("bigint").alias("n")).unionByName(days.select("date", F.col("n").cast("bigint").alias("n")))
    one = marked.filter("date IS NOT NULL").groupBy("date").agg(F.sum("n").alias("n")).withColumn("_all", F.lit(1))
    w = Window.partitionBy("_all").orderBy("date")
    here = F.when(F.col("n").isNotNull(), F.col("date"))
    first, last, now = Window.unboundedPreceding, Window.unboundedFollowing, Window.currentRow
    return one.select(
        "date", F.last(here, ignorenulls=True).over(w.rowsBetween(first, now)).alias("le"), F.last(here, ignorenulls=True).over(w.rowsBetween(first, -1)).alias("lt"),
        F.first(here, ignorenulls=True).over(w.rowsBetween(now, last)).alias("ge"), F.first(here, ignorenulls=True).over(w.rowsBetween(1, last)).alias("gt"),
        F.coalesce(F.sum("n").over(w.rowsBetween(first, now)), F.lit(0)).alias("n_le"), F.coalesce(F.sum("n").over(w.rowsBetween(first, -1)), F.lit(0)).alias("n_lt"))


def _near(df: DataFrame, table: DataFrame, name: str, *take: str) -> DataFrame:
    """``df`` with columns of ``neighbours`` for its date ``name``, as ``<name>_<column>``."""
    side = table.select(F.col("date").alias("_k"), *[F.col(c).alias(f"{name}_{c}") for c in take])
    return df.join(side, F.col(name).cast("date") == F.col("_k"), "left").drop("_k")


def calendar_covered(requests: DataFrame, calendar: DataFrame, share: float = 0.75) -> DataFrame:
    """Requests (start, end) whose range the calendar bounds and fills to ``share`` of its days."""
    have = calendar.groupBy(F.col("date").cast("date").alias("date")).agg(F.count("*").alias("n"))
    ranges = requests.select("start", "end").distinct()
    table = neighbours(ranges.select(F.explode(F.array(F.col("start").cast("date"), F.col("end").cast("date"))).alias("date")), have)
    df = _near(_near(ranges, table, "start", "ge", "n_lt"), table, "end", "le", "n_le")
    inside = F.coalesce(F.col("start_ge") <= F.col("end"), F.lit(False))
    df = df.select("start", "end", F.when(inside, F.col("start_ge")).alias("first"), F.when(inside, F.col("end_le")).alias("last"),
                   F.when(inside, F.col("end_n_le") - F.col("start_n_lt")).otherwise(0).alias("days"))
    need = F.greatest(F.lit(1), F.floor((F.datediff("end", "start") + 1) * share))
    ok = (F.col("end") >= F.col("start")) & (F.col("first") <= F.col("start")) & (F.col("last") >= F.col("end")) & (F.col("days") >= need)
    return df.withColumn("covered", F.coalesce(ok, F.lit(False)))


def facts_covered(requests: DataFrame, facts: DataFrame, value: str, *, share: float = 0.6, tolerance_days: int = 4) -> DataFrame:
    """Requests (symbol, start, end) covered by dated facts: edges within a few days, enough weekdays."""
    have = facts.filter(F.col(value).isNotNull()).select("symbol", F.to_date("date").alias("date"))
    joined = requests.join(have, ["symbol"], "left")
    hit = F.col("date").between(F.col("start"), F.col("end"))
    out = joined.groupBy("symbol", "start", "end").agg(
        F.min(F.when(hit, F.col("date"))).alias("first"), F.max(F.when(hit, F.col("date"))).alias("last"), F.count_distinct(F.when(hit, F.col("date"))).alias("days"))
    ok = (F.col("first") <= F.date_add("start", tolerance_days)) & (F.col("last") >= F.date_sub("end", tolerance_days)) & (
        F.col("days") >= _weekdays(F.col("start"), F.col("end"), share))
    return out.withColumn("covered", F.coalesce(ok, F.lit(False)))


def bars_covered(requests: DataFrame, bars: DataFrame, share: float = 0.75) -> DataFrame:
    """Requests (symbol, freq, adjust, start, end) the stored slice is complete enough for."""
    have = V.slice_coverage(bars)
    joined = requests.join(have, list(SLICE), "left")
    slack = lookup(BOUNDARY_DAYS, "freq", 4)
    first, last = F.to_date("first_datetime"), F.to_date("last_datetime")
    ok = (first <= F.date_add("start", slack)) & (last >= F.date_sub("end", slack)) & (F.col("rows") >= expected_minimum_rows("freq", "start", "end", share))
    return joined.withColumn("covered", F.coalesce(ok, F.lit(False)))


def plan_gaps(requests: DataFrame, catalog: DataFrame, calendar: DataFrame, *, today: str) -> DataFrame:
    """Date ranges still missing per slice: before and after what is stored, on trading days, up to ``today``.

    ``requests`` is (symbol, freq, adjust, start, end). A stored slice that misses neither end but does not
    cover the request is asked for whole. Requests without a trading day give no rows.
    """
    days = calendar.filter("is_trading_day").select(F.to_date("date").alias("_d")).distinct()
    asked = requests.withColumn("end", F.least("end", F.lit(today).cast("date")))
    stored = catalog.select(*SLICE, F.to_date("start_datetime").alias("_s"), F.to_date("end_datetime").alias("_e"), "rows")
    joined = asked.join(stored, list(SLICE), "left")
    dates = joined.select(F.explode(F.array("start", "end", "_s", "_e")).alias("date"))
    table = neighbours(dates, days.select(F.col("_d").alias("date"), F.lit(1).alias("n")))
    df = _near(_near(_near(_near(joined, table, "start", "ge"), table, "end", "le"), table, "_s", "lt"), table, "_e", "gt")
    lower, upper = F.col("start_ge"), F.col("end_le")  # the first and last trading day of the range, if there are any
    some = F.coalesce(lower <= F.col("end"), F.lit(False))
    pre_b = F.when(F.col("_s").isNotNull() & F.col("_s_lt").isNotNull(), F.least(upper, F.col("_s_lt")))
    post_a = F.when(F.col("_e").isNotNull() & F.col("_e_gt").isNotNull(), F.greatest(lower, F.col("_e_gt")))
    df = df.withColumns({
        "first": F.when(some, lower), "last": F.when(some, upper),
        "pre_a": F.when(some & (lower < F.col("_s")), lower), "pre_b": F.when(some & (pre_b >= lower), pre_b),
        "post_a": F.when(some & (post_a <= upper), post_a), "post_b": F.when(some & (upper > F.col("_e")), upper)})

    def span(a, b, kind):
        return F.struct(F.col(a).alias("from_date"), F.col(b).alias("to_date"), F.lit(kind).alias("kind"))

    usable = F.coalesce(F.col("rows") > 0, F.lit(False))
    covered = usable & (F.col("_s") <= F.col("first")) & (F.col("_e") >= F.col("last"))
    sides = F.array_compact(F.array(F.when(F.col("pre_a").isNotNull(), span("pre_a", "pre_b", "before")), F.when(F.col("post_a").isNotNull(), span("post_a", "post_b", "after"))))
    whole = F.array(span("first", "last", "whole"))
    ranges = F.when(F.col("first").isNull() | covered, F.slice(whole, 1, 0)).when(~usable, whole).when(F.size(sides) == 0, whole).otherwise(sides)
    return df.select(*SLICE, F.explode(ranges).alias("r")).select(*SLICE, "r.*")


def verify_manifest(manifest: DataFrame, bars: DataFrame) -> DataFrame:
    """Completed coverage rows against what is stored now, with the first reason that fails."""
    kept = manifest.filter("status = 'completed'")
    # Counts and hashes up to every bar: a range is the difference of its two ends, however many ranges of a slice are listed.
    upto = running(bars.withColumn("_x", F.xxhash64(*V.HASHED)), SLICE, ["datetime"], time_chunk(), {"_c": ("count", None), "_f": ("xor", "_x")})
    upto = upto.select(*SLICE, F.col("datetime").alias("_at"), "_c", "_f")
    ends = as_of(kept, upto.select(*SLICE, "_at", F.col("_at").alias("_end"), F.col("_c").alias("_c1"), F.col("_f").alias("_f1")), SLICE,
                 left_time="actual_end", right_time="_at", take=["_end", "_c1", "_f1"])
    both = as_of(ends, upto.select(*SLICE, "_at", F.col("_c").alias("_c0"), F.col("_f").alias("_f0")), SLICE, left_time="actual_start", right_time="_at", take=["_c0", "_f0"], strict=True)
    first = upto.select(*SLICE, F.col("_c").alias("_next"), F.col("_at").alias("_start"))
    df = both.withColumns({"_rows": F.coalesce("_c1", F.lit(0)) - F.coalesce("_c0", F.lit(0)), "_next": F.coalesce("_c0", F.lit(0)) + 1,
                           "_hash": F.coalesce("_f1", F.lit(0)).bitwiseXOR(F.coalesce("_f0", F.lit(0)))}).join(first, [*SLICE, "_next"], "left")
    reason = (
        F.when(F.col("data_hash").isNull(), "no_hash").when(F.coalesce("_rows", F.lit(0)) != F.col("rows"), "rows_differ")
        .when(F.col("_start") != F.col("actual_start"), "start_differs").when(F.col("_end") != F.col("actual_end"), "end_differs")
        .when(F.col("_hash") != F.col("data_hash"), "hash_differs")
    )
    return df.select("id", *SLICE, reason.isNull().alias("verified"), F.coalesce(reason, F.lit("")).alias("reason"))


def ingest_report(results: DataFrame) -> DataFrame:
    """Result rows (symbol, freq, adjust, ok, rows, error) with their status, and totals per status."""
    status = (
        F.when(F.col("error").startswith("Skipped:"), "skipped").when(F.col("error").startswith("Warning:"), "warning")
        .when(F.col("ok"), "success").otherwise("failed")
    )
    return results.withColumn("status", status).groupBy("status").agg(F.count("*").alias("slices"), F.sum("rows").alias("saved_rows"))
