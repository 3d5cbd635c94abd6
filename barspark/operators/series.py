"""Windows over long series without long groups.

A series (one symbol, frequency, adjustment) can hold a large share of all rows,
so nothing here sorts a whole series in one task:

* ``running`` splits every series into time chunks, aggregates each chunk once,
  carries the prefix of the small chunk table forward and finishes inside chunks;
* ``blocks`` cuts numbered rows into blocks of a fixed row count, each with copies
  of the rows just before it (the halo), so that bounded frames are computed per
  block and are still exact at block edges.

Only tables with one row per chunk or block are ever ordered per series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import col, is_intraday

BLOCK_ROWS = 512


def time_chunk(ts="datetime", freq="freq") -> Column:
    """Day for intraday series, year for the others: at most a few hundred bars each."""
    day = F.to_date(col(ts))
    return F.when(is_intraday(freq), day).otherwise(F.trunc(day, "year"))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    specs: dict[str, tuple[str, str | Column | None]],
    *,
    exclusive: bool = False,
) -> DataFrame:
    """Add running aggregates from the start of each series.

    ``specs`` maps an output name to ``(kind, column)`` with kind ``count``, ``sum``, ``xor``,
    ``max``, ``min``, ``first`` / ``last`` (by position, NULLs included) or
    ``first_valid`` / ``last_valid``. ``chunk`` must not decrease along ``order``.
    With ``exclusive`` the current row is left out.
    """
    keys, order = list(keys), list(order)
    values = {f"_v_{name}": _boxed(kind, c) for name, (kind, c) in specs.items()}
    data = df.withColumns({"_chunk": chunk, **values})
    position = F.struct(*[F.col(c) for c in order])

    totals = data.groupBy(*keys, "_chunk").agg(
        *[_total(kind, F.col(f"_v_{name}"), position).alias(f"_c_{name}") for name, (kind, _) in specs.items()]
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(
        *keys, "_chunk",
        *[_over(kind, F.col(f"_c_{name}"), before, merged=True).alias(f"_c_{name}") for name, (kind, _) in specs.items()],
    )
    inside = (
        Window.partitionBy(*keys, "_chunk").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    )
    joined = data.join(carries, [*keys, "_chunk"])
    result = {
        name: _combine(kind, F.col(f"_c_{name}"), _over(kind, F.col(f"_v_{name}"), inside))
        for name, (kind, _) in specs.items()
    }
    return joined.withColumns(result).drop("_chunk", *values, *[f"_c_{n}" for n in specs])


def _boxed(kind: str, c) -> Column:
    if kind == "count":
        return F.lit(1) if c is None else F.when(col(c), 1).otherwise(0)
    if kind in ("first", "last"):
        return F.struct(col(c).alias("v"))
    if kind in ("first_valid", "last_valid"):
        return F.when(col(c).isNotNull(), F.struct(col(c).alias("v")))
    return col(c)


def _total(kind: str, c: Column, position: Column) -> Column:
    if kind in ("count", "sum"):
        return F.sum(c)
    if kind == "xor":
        return F.bit_xor(c)
    if kind in ("max", "min"):
        return F.max(c) if kind == "max" else F.min(c)
    pick = F.max_by if kind.startswith("last") else F.min_by
    return pick(c, F.when(c.isNotNull(), position))


def _over(kind: str, c: Column, w, merged: bool = False) -> Column:
    if kind in ("count", "sum"):
        return F.sum(c).over(w)
    if kind == "xor":
        return F.bit_xor(c).over(w)
    if kind in ("max", "min"):
        return (F.max(c) if kind == "max" else F.min(c)).over(w)
    pick = F.last if kind.startswith("last") else F.first
    return pick(c, ignorenulls=merged or kind.endswith("_valid")).over(w)


def _combine(kind: str, carry: Column, here: Column) -> Column:
    if kind == "count":
        return (F.coalesce(carry, F.lit(0)) + F.coalesce(here, F.lit(0))).cast("bigint")
    if kind == "sum":
        return F.when(carry.isNull(), here).when(here.isNull(), carry).otherwise(carry + here)
    if kind == "xor":
        return F.coalesce(carry, F.lit(0)).bitwiseXOR(F.coalesce(here, F.lit(0)))
    if kind == "max":
        return F.greatest(carry, here)
    if kind == "min":
        return F.least(carry, here)
    return (F.coalesce(here, carry) if kind.startswith("last") else F.coalesce(carry, here))["v"]


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, out: str = "rn") -> DataFrame:
    """1-based position of every row in its series."""
    return running(df, keys, order, chunk, {out: ("count", None)})


def blocks(df: DataFrame, *, rn: str = "rn", size: int = BLOCK_ROWS, halo: int = 0) -> DataFrame:
    """Add ``_blk`` and ``_core``; rows are repeated into the blocks whose first rows look back at them."""
    own = F.floor((F.col(rn) - 1) / size)
    if halo == 0:
        return df.withColumns({"_blk": own, "_core": F.lit(True)})
    reach = F.floor((F.col(rn) - 1 + halo) / size)
    return df.withColumn("_blk", F.explode(F.sequence(own, reach))).withColumn("_core", F.col("_blk") == own)


def block_window(keys: Sequence[str], order: str = "rn"):
    return Window.partitionBy(*keys, "_blk").orderBy(order)


def core_rows(df: DataFrame, *extra: str) -> DataFrame:
    return df.filter("_core").drop("_blk", "_core", *extra)
