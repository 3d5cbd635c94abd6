"""As-of joins: for every left row the latest right row at or before (or strictly before) it.

Both sides are put in one time-ordered series and the last right row is carried forward, so
there is no range condition in any join and no group longer than one time chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import running


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    *,
    left_time: str,
    right_time: str,
    take: Sequence[str],
    strict: bool = False,
    count: str | None = None,
    chunk: Column | None = None,
) -> DataFrame:
    """``left`` plus the ``take`` columns of the latest visible right row (NULL without one).

    ``count`` names a column that receives how many right rows are visible.
    """
    payload = [c for c in left.columns if c not in keys]
    l = left.select(
        *keys, F.col(left_time).alias("_ts"), F.lit(0 if strict else 1).alias("_side"),
        F.struct(*payload).alias("_left"),
    )
    r = right.select(
        *keys, F.col(right_time).alias("_ts"), F.lit(1 if strict else 0).alias("_side"),
        F.struct(*take).alias("_hit"),
    )
    both = l.unionByName(r, allowMissingColumns=True)
    specs: dict = {"_seen": ("last_valid", "_hit")}
    if count:
        specs["_n"] = ("count", F.col("_hit").isNotNull())
    out = running(both, keys, ["_ts", "_side"], F.to_date("_ts") if chunk is None else chunk, specs)
    return out.filter(F.col("_left").isNotNull()).select(
        *keys, *[F.col(f"_left.{c}").alias(c) for c in payload], *[F.col(f"_seen.{c}").alias(c) for c in take],
        *([F.col("_n").alias(count)] if count else []),
    )


def last_close_before(bars: DataFrame, bounds: DataFrame, bound: str, *, keys=("symbol", "adjust")) -> DataFrame:
    """Per key the last close strictly before its own bound; keys without one are absent."""
    return (
        bars.join(bounds, list(keys)).filter(F.col("datetime") < F.col(bound))
        .groupBy(*keys).agg(F.max_by("close", "datetime").alias("previous_close"))
    )


def from_bound(bars: DataFrame, bounds: DataFrame, bound: str, *, keys=("symbol", "adjust")) -> DataFrame:
    """Bars at or after their key's lower bound."""
    return bars.join(bounds, list(keys)).filter(F.col("datetime") >= F.col(bound)).drop(bound)
