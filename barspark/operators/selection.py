"""Ordering, top-k, sampling, pages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import board_group
from ..schema import SLICE
from .series import running


def canonical_order(bars: DataFrame) -> DataFrame:
    return bars.orderBy("symbol", "freq", "adjust", "datetime")


def page(rows: DataFrame, order: Sequence[str], *, offset: int | None = None, limit: int = 500, max_limit: int | None = None) -> DataFrame:
    """One page with the total count; ``offset=None`` is the last page. A ``limit`` above ``max_limit`` is an error.

    Rows are counted in groups that follow the order: the columns before the last, and the month of the last if it is a time. Sums of these counts tell
    the few groups in which the page lies, and only their rows are numbered, however deep the page is. ``order`` should leave no ties.
    """
    if max_limit is not None and limit > max_limit:
        raise ValueError(f"a page has at most {max_limit} rows, asked for {limit}")
    size, kinds = max(1, limit), dict(rows.dtypes)
    groups = {f"_g{i}": F.col(c) for i, c in enumerate(order[:-1] or order)}
    if len(order) > 1 and kinds[order[-1]].startswith(("timestamp", "date")):
        groups[f"_g{len(groups)}"] = F.trunc(F.col(order[-1]).cast("date"), "month")
    marked = rows.withColumns(groups)
    counts = marked.groupBy(*groups).agg(F.count("*").alias("_n")).withColumn("_all", F.lit(1))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("total_rows"))
    start = F.greatest(F.col("total_rows") - size, F.lit(0)) if offset is None else F.lit(max(0, offset)).cast("bigint")
    upto = running(counts, ["_all"], list(groups), F.col("_g0"), {"_upto": ("sum", "_n")}).crossJoin(F.broadcast(total)).withColumn("page_offset", start)  # one row
    hit = upto.filter((F.col("_upto") > F.col("page_offset")) & (F.col("_upto") - F.col("_n") < F.col("page_offset") + size))
    hit = hit.select(*[F.col(g).alias(f"{g}k") for g in groups], (F.col("_upto") - F.col("_n")).alias("_before"), "total_rows", "page_offset")
    same = [F.col(g).eqNullSafe(F.col(f"{g}k")) for g in groups]
    inside = marked.join(hit, reduce(lambda a, c: a & c, same))
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*groups).orderBy(*order)) - 1
    shown = inside.withColumn("_at", place).filter((F.col("_at") >= F.col("page_offset")) & (F.col("_at") < F.col("page_offset") + size))
    return shown.select(*rows.columns, "total_rows", "page_offset").orderBy(*order)


def first_n(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def best_by(rows: DataFrame, keys: Sequence[str], rank: Column, *tie: str) -> DataFrame:
    """The row with the lowest rank per key, by partial aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(rank, *tie)).alias("_r")).select(*keys, "_r.*")


def preferred_adjustment(daily: DataFrame) -> DataFrame:
    """One bar per symbol and day: pre-adjusted, else unadjusted, else any."""
    rank = F.when(F.col("adjust") == "pre", 0).when(F.col("adjust") == "none", 1).otherwise(2)
    return best_by(daily.withColumn("date", F.to_date("datetime")), ["symbol", "date"], rank, "adjust", "datetime")


def prefer_daily(inventory: DataFrame) -> DataFrame:
    """One inventory row per symbol: a daily slice if there is one."""
    return best_by(inventory, ["symbol"], F.when(F.lower("freq") == "daily", 0).otherwise(1), "freq", "adjust")


def latest_covering(manifest: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request the newest completed manifest row whose range covers it."""
    key = ["symbol", "freq", "adjust"]
    hits = requests.join(manifest.filter("status = 'completed'"), key).filter(
        "requested_start <= start AND requested_end >= end"
    )
    return hits.groupBy(*key, "start", "end").agg(
        F.max("downloaded_at").alias("downloaded_at"), F.max_by("rows", "downloaded_at").alias("rows"),
        F.count("*").alias("matches"),
    )


def seeded_order(symbol: str, seed: int) -> Column:
    return F.xxhash64(F.col(symbol), F.lit(seed))


def sample_symbols(symbols: DataFrame, n: int, seed: int) -> DataFrame:
    """A reproducible uniform sample of ``n`` distinct symbols."""
    return symbols.select("symbol").distinct().orderBy(seeded_order("symbol", seed), "symbol").limit(n)


def sample_by_board(symbols: DataFrame, n: int, seed: int) -> DataFrame:
    """A reproducible sample taken in turn from each board group."""
    listed = symbols.select("symbol").distinct().withColumns({"board": board_group("symbol"), "_h": seeded_order("symbol", seed)})
    # Turn numbers per board; the hash's top bits split each board into chunks.
    turns = running(listed, ["board"], ["_h", "symbol"], F.shiftright("_h", 58), {"turn": ("count", None)})
    return turns.orderBy("turn", "board").limit(n).select("symbol", "board")


def preview(parts: Sequence[DataFrame], order: Sequence[str], n: int) -> DataFrame:
    """First rows of each part, so no part is read whole, then the first rows overall."""
    out = parts[0].orderBy(*order).limit(n)
    for p in parts[1:]:
        out = out.unionByName(p.orderBy(*order).limit(n), allowMissingColumns=True)
    return out.orderBy(*order).limit(n)


def last_rows(bars: DataFrame, n: int, keys: Sequence[str] = SLICE) -> DataFrame:
    """The last ``n`` rows of each series, numbered from the end.

    Days are counted first; only the newest ones that hold ``n`` rows together reach the numbering, which is done day by day."""
    dated = bars.withColumn("_day", F.to_date("datetime"))
    days = dated.groupBy(*keys, "_day").agg(F.count("*").alias("_n"))
    newer = Window.partitionBy(*keys).orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    newest = days.withColumn("_newer", F.coalesce(F.sum("_n").over(newer), F.lit(0))).filter(F.col("_newer") < n).drop("_n")
    inside = Window.partitionBy(*keys, "_day").orderBy(F.desc("datetime"))
    numbered = dated.join(newest, [*keys, "_day"]).withColumn("from_end", (F.col("_newer") + F.row_number().over(inside)).cast("bigint"))
    return numbered.filter(F.col("from_end") <= n).select(*bars.columns, "from_end")


def difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_anti")
