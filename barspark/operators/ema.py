"""Exponential averages as a two-level scan over fixed-size blocks.

With decay ``p = 1 - alpha`` the average is ``s_n = sum p^(n-i) b_i`` where ``b_0 = x_0``
and ``b_i = alpha * x_i``. Inside a block the sum is a window over ``b_i * p^-i``; across
blocks only each block's end value matters, weighted by powers of ``p^block``. Powers that
underflow a double contribute nothing, so the fold over earlier blocks is of bounded length
and still exact.

An average of an average needs no second pass: for different decays it is a fixed
combination of two plain averages of the input, for equal decays it needs the sum weighted
by distance as well.

That holds for inputs without NULLs. ``with_gap_emas`` is for the others: after k rows since the last value the old average
weighs ``p^k / (p^k + alpha)``, a NULL keeps it, and leading NULLs have none.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import BLOCK_ROWS, blocks

UNDERFLOW = 762.0  # ln of 2^1100: beyond this a weight leaves the range of a double
SUPER_BLOCK = 4096
SCAN_FAN = 256  # steps that are composed in one list
SEGMENT = 600.0  # ln of the largest power in a segment of ``with_window_emas``


def span(n: float) -> float:
    return 2.0 / (n + 1.0)


@dataclass(frozen=True)
class Ema:
    """``out`` = average of ``x``; with ``then`` the average of that average."""

    out: str
    x: str
    alpha: float
    then: float | None = None


@dataclass(frozen=True)
class _Sum:
    x: str
    alpha: float
    gain: float
    moment: bool = False

    @property
    def id(self) -> str:
        return f"{self.x}_{self.alpha!r}_{self.gain!r}_{int(self.moment)}".replace(".", "d").replace("-", "m")


def _parts(e: Ema) -> list[_Sum]:
    a, c = e.alpha, e.then
    if a == 1.0 or c == 1.0:
        a, c = (a if c == 1.0 or c is None else c), None
    if c is None:
        return [] if a == 1.0 else [_Sum(e.x, a, a)]
    if a != c:
        return [_Sum(e.x, a, a), _Sum(e.x, c, c)]
    return [_Sum(e.x, a, a, True), _Sum(e.x, a, a * a)]


def _assemble(e: Ema, value) -> Column:
    parts = _parts(e)
    if not parts:
        return F.col(e.x)
    if len(parts) == 1:
        return value(parts[0])
    a, c = e.alpha, e.then
    if a != c:
        return (value(parts[0]) * (c * (1 - a)) - value(parts[1]) * (a * (1 - c))) / (c - a)
    return value(parts[0]) * a + value(parts[1])


def with_emas(df: DataFrame, keys: Sequence[str], emas: Iterable[Ema], *, rn: str = "rn", size: int = BLOCK_ROWS) -> DataFrame:
    """Add averages to a frame from ``blocks``; halo rows get NULL."""
    emas, keys = list(emas), list(keys)
    sums = {s.id: s for e in emas for s in _parts(e)}
    if not sums:
        return df.withColumns({e.out: F.col(e.x) for e in emas})
    for s in sums.values():
        if size * -math.log1p(-s.alpha) > 600:
            raise ValueError(f"block of {size} rows is too long for alpha {s.alpha}")

    # Built as SQL text: one parse per column instead of many calls into the JVM. The decay to a row's
    # place in its block is computed once per alpha; every other power follows from it.
    decay = {s.alpha: f"_p{i}" for i, s in enumerate({s.alpha: s for s in sums.values()}.values())}
    df = df.withColumn("_at", F.expr(f"pmod({rn} - 1, {size})"))
    df = df.withColumns({name: F.expr(f"exp(_at * {math.log1p(-a)!r}D)") for a, name in decay.items()})

    def weight(s: _Sum) -> str:
        return f"(CASE WHEN _core THEN IF({rn} = 1, `{s.x}`, `{s.x}` * {s.gain!r}D) END / {decay[s.alpha]})"

    def full(s: _Sum) -> float:  # decay over a whole block, from its first row to its last
        return math.exp((size - 1) * math.log1p(-s.alpha))

    ends = df.groupBy(*keys, "_blk").agg(
        *[F.expr(f"sum({weight(s)}) * {full(s)!r}D AS z_{s.id}") for s in sums.values()],
        *[F.expr(f"sum({weight(s)} * ({size - 1} - _at)) * {full(s)!r}D AS g_{s.id}") for s in sums.values() if s.moment],
    )
    carries = _carries(ends, keys, sums.values(), size)
    inside = Window.partitionBy(*keys, "_blk").orderBy(rn).rowsBetween(Window.unboundedPreceding, 0)
    windows = {f"s_{s.id}": F.sum(F.expr(weight(s))).over(inside) for s in sums.values()}
    windows |= {f"m_{s.id}": F.sum(F.expr(f"{weight(s)} * _at")).over(inside) for s in sums.values() if s.moment}
    joined = df.join(carries, [*keys, "_blk"]).withColumns(windows)

    def value(s: _Sum) -> Column:
        p, q = decay[s.alpha], 1.0 - s.alpha
        if not s.moment:
            return F.expr(f"(s_{s.id} + cz_{s.id} * {q!r}D) * {p}")
        return F.expr(f"(s_{s.id} * _at - m_{s.id} + (cz_{s.id} * (_at + 1) + cg_{s.id}) * {q!r}D) * {p}")

    helpers = ["_at", *decay.values(), *windows, *[c for c in carries.columns if c.startswith(("cz_", "cg_"))]]
    return joined.withColumns({e.out: F.when(F.col("_core"), _assemble(e, value)) for e in emas}).drop(*helpers)


def with_window_emas(df: DataFrame, keys: Sequence[str], emas: Iterable[Ema], *, rn: str = "rn") -> DataFrame:
    """Add averages to numbered rows of series that are short enough for one window each: nothing is joined, and no row is shuffled again.

    Sums run over segments as long as the powers of the fastest average allow; averages up to ten times slower share them. A segment starts from the end of
    the one before it. What lies before that would weigh less than e^-60 of it, and is left out as powers that underflow are.
    """
    emas, keys = list(emas), list(keys)
    sums = {s.id: s for e in emas for s in _parts(e)}
    groups: list[list[_Sum]] = []
    for s in sorted(sums.values(), key=lambda s: -s.alpha):
        if not groups or math.log1p(-groups[-1][0].alpha) / math.log1p(-s.alpha) > 10:
            groups.append([])
        groups[-1].append(s)
    helpers, values = [], {}
    for k, group in enumerate(groups):
        size = int(SEGMENT / -math.log1p(-group[0].alpha))
        seg, at = f"_seg{k}", f"_at{k}"
        decay = {a: f"_p{k}_{i}" for i, a in enumerate(dict.fromkeys(s.alpha for s in group))}
        df = df.withColumns({seg: F.floor((F.col(rn) - 1) / size), at: F.expr(f"pmod({rn} - 1, {size})")})
        df = df.withColumns({name: F.expr(f"exp({at} * {math.log1p(-a)!r}D)") for a, name in decay.items()})

        def weight(s: _Sum, decay=decay) -> str:
            return f"(IF({rn} = 1, `{s.x}`, `{s.x}` * {s.gain!r}D) / {decay[s.alpha]})"

        inside = Window.partitionBy(*keys, seg).orderBy(rn).rowsBetween(Window.unboundedPreceding, 0)
        own = {f"s_{s.id}": F.sum(F.expr(weight(s))).over(inside) for s in group}
        own |= {f"m_{s.id}": F.sum(F.expr(f"{weight(s)} * {at}")).over(inside) for s in group if s.moment}
        before = Window.partitionBy(*keys).orderBy(seg, rn).rowsBetween(Window.unboundedPreceding, -1)  # in the order of ``inside``
        end = lambda x, before=before, at=at, size=size: F.coalesce(F.last(F.expr(f"IF({at} = {size - 1}, {x}, NULL)"), ignorenulls=True).over(before), F.lit(0.0))
        carried = {f"cz_{s.id}": end(f"s_{s.id} * {decay[s.alpha]}") for s in group}
        carried |= {f"cg_{s.id}": end(f"(s_{s.id} * {at} - m_{s.id}) * {decay[s.alpha]}") for s in group if s.moment}
        df = df.withColumns(own).withColumns(carried)
        for s in group:
            p, q = decay[s.alpha], 1.0 - s.alpha
            values[s.id] = F.expr(f"(s_{s.id} * {at} - m_{s.id} + (cz_{s.id} * ({at} + 1) + cg_{s.id}) * {q!r}D) * {p}" if s.moment
                                  else f"(s_{s.id} + cz_{s.id} * {q!r}D) * {p}")
        helpers += [seg, at, *decay.values(), *own, *carried]
    return df.withColumns({e.out: _assemble(e, lambda s: values[s.id]) for e in emas}).drop(*helpers)


def _carries(ends: DataFrame, keys: list[str], sums: Iterable[_Sum], size: int) -> DataFrame:
    """State at the start of every block, folded from the end values of the blocks before it."""
    sums = list(sums)
    reach = {s.id: max(1, math.ceil(UNDERFLOW / (size * -math.log1p(-s.alpha)))) for s in sums}
    table = ends.withColumnRenamed("_blk", "_b").withColumn("_rn", F.col("_b") + 1)
    table = blocks(table, rn="_rn", size=SUPER_BLOCK, halo=max(reach.values()))
    w = Window.partitionBy(*keys, "_blk").orderBy("_rn")

    def end(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0))

    out = {}
    for s in sums:
        frame = w.rowsBetween(-reach[s.id], -1)
        q = math.exp(size * math.log1p(-s.alpha))
        if s.moment:
            ends_before = F.collect_list(F.struct(end(f"z_{s.id}").alias("z"), end(f"g_{s.id}").alias("g"))).over(frame)
            folded = _fold_pairs(ends_before, q, float(size))
            out[f"cz_{s.id}"], out[f"cg_{s.id}"] = folded["z"], folded["g"]
        else:
            out[f"cz_{s.id}"] = _fold(F.collect_list(end(f"z_{s.id}")).over(frame), q)
    return table.withColumns(out).filter("_core").select(*keys, F.col("_b").alias("_blk"), *out)


def _fold(values: Column, q: float) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc * q + x)


def _fold_pairs(pairs: Column, q: float, size: float) -> Column:
    start = F.struct(F.lit(0.0).alias("z"), F.lit(0.0).alias("g"))
    return F.aggregate(
        pairs, start,
        lambda acc, x: F.struct(
            (acc["z"] * q + x["z"]).alias("z"), ((acc["g"] + acc["z"] * size) * q + x["g"]).alias("g")
        ),
    )


def with_gap_emas(df: DataFrame, keys: Sequence[str], emas: Iterable[Ema], *, rn: str = "rn", size: int = BLOCK_ROWS) -> DataFrame:
    """``with_emas`` for inputs with NULLs; ``<out>__before`` is the average one row earlier, ``<x>__since`` how many rows ago the
    input ``x`` was last there (0: on this row).

    Every row is an affine step of the average, so a block is one too, and its two numbers are carried over any number of later blocks.
    An average of an average is a second scan over the first one's result."""
    emas, keys = list(emas), list(keys)
    if not emas:
        return df
    firsts = {(e.x, e.alpha) for e in emas}
    names = {(x, a): f"_g{i}" for i, (x, a) in enumerate(sorted(firsts))}
    df = _gap_scan(df, keys, names, rn, size)
    seconds = {(names[e.x, e.alpha], e.then) for e in emas if e.then is not None}
    more = {(x, a): f"_h{i}" for i, (x, a) in enumerate(sorted(seconds))}
    if more:
        df = _gap_scan(df, keys, more, rn, size).drop(*[f"{x}__since" for x, _ in more])
    final = {e.out: names[e.x, e.alpha] if e.then is None else more[names[e.x, e.alpha], e.then] for e in emas}
    df = df.withColumns({f"{out}{part}": F.col(f"{name}{part}") for out, name in final.items() for part in ("", "__before")})
    return df.drop(*[f"{n}{part}" for n in (*names.values(), *more.values()) for part in ("", "__before")])


def gap_step(state: Column, since: Column, x: Column, alpha: float) -> Column:
    """The average after one more row ``x``, when the last value before it came ``since`` + 1 rows earlier; a missing ``x`` keeps it."""
    old = F.exp((since + 1) * math.log1p(-alpha)) if alpha < 1 else F.lit(0.0)
    return F.coalesce((state * old + x * alpha) / (old + alpha), x, state)


def _gap_scan(df: DataFrame, keys: list[str], outs: dict[tuple[str, float], str], rn: str, size: int) -> DataFrame:
    """Plain averages over NULLs. Inside a block everything is relative to its first value, whose distance to the value before it is only known in
    the table of blocks; so one aggregate per block and one join are enough."""
    for _, a in outs:
        if a < 1 and size * -math.log1p(-a) > 600:
            raise ValueError(f"block of {size} rows is too long for alpha {a}")
    place = {x: i for i, x in enumerate(sorted({x for x, _ in outs}))}
    inside = Window.partitionBy(*keys, "_blk").orderBy(rn)
    upto, earlier = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)

    def own(x: str) -> str:
        return f"(_core AND `{x}` IS NOT NULL)"

    def old(a: float, rows: str) -> str:  # the weight of an average that many rows later
        return f"exp(({rows}) * {math.log1p(-a)!r}D)" if a < 1 else "0D"

    df = df.withColumns({f"_last{i}": F.last(F.expr(f"IF({own(x)}, {rn}, NULL)"), ignorenulls=True).over(earlier) for x, i in place.items()})
    step = {o: (f"{own(x)} AND _last{place[x]} IS NOT NULL", old(a, f"{rn} - _last{place[x]}")) for (x, a), o in outs.items()}
    # The log of what an old average is divided by; beyond e^60 it is not seen in a double.
    df = df.withColumns({f"{o}_d": F.sum(F.expr(f"IF({step[o][0]}, least(ln({step[o][1]} + {a!r}D) - coalesce(ln({step[o][1]}), -1000D), 60D), 0D)")).over(upto) for (_, a), o in outs.items()})
    df = df.withColumns({f"{o}_s": F.sum(F.expr(f"IF({step[o][0]}, `{x}` * {a!r}D / ({step[o][1]} + {a!r}D) * exp({o}_d), 0D)")).over(upto) for (x, a), o in outs.items()})
    block = df.groupBy(*keys, "_blk").agg(
        *[F.expr(e) for x, i in place.items() for e in (
            f"min(IF({own(x)}, {rn}, NULL)) AS _first{i}", f"min_by(`{x}`, IF({own(x)}, {rn}, NULL)) AS _x{i}", f"max(IF({own(x)}, {rn}, NULL)) AS _end{i}")],
        *[F.expr(f"max_by(struct({o}_d AS d, {o}_s AS s), IF(_core, {rn}, NULL)) AS {o}_e") for o in outs.values()])
    sofar = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    block = block.withColumns({f"_prev{i}": F.max(f"_end{i}").over(sofar) for i in place.values()})
    enter, steps = {}, {}
    for (x, a), o in outs.items():
        i, before = place[x], old(a, f"_first{place[x]} - _prev{place[x]}")
        enter[o] = f"coalesce({before} / ({before} + {a!r}D), 0D)", f"IF(_prev{i} IS NULL, _x{i}, _x{i} * {a!r}D / ({before} + {a!r}D))"
        steps[o] = F.expr(f"IF(_first{i} IS NULL, NULL, struct({enter[o][0]} * exp(-{o}_e.d) AS r, ({enter[o][1]} + {o}_e.s) * exp(-{o}_e.d) AS z))")
    carried = affine_carries(block.withColumns(steps), keys, "_blk", list(outs.values()))
    carried = carried.select(*keys, "_blk", *[f"_prev{i}" for i in place.values()], *[F.expr(e) for (x, _), o in outs.items() for e in (
        f"IF(_prev{place[x]} IS NULL, NULL, {o}_c) AS {o}_c", f"{enter[o][0]} * {o}_c + {enter[o][1]} AS {o}_f")])
    df = df.join(carried, [*keys, "_blk"])
    df = df.withColumns({
        **{f"{x}__since": F.expr(f"{rn} - coalesce(IF({own(x)}, {rn}, NULL), _last{i}, _prev{i})") for x, i in place.items()},
        **{o: F.expr(f"IF(_core, IF({own(x)} OR _last{place[x]} IS NOT NULL, ({o}_f + {o}_s) * exp(-{o}_d), {o}_c), NULL)") for (x, _), o in outs.items()}})
    df = df.withColumns({f"{o}__before": F.when(F.col("_core"), F.coalesce(F.lag(o).over(inside), f"{o}_c")) for o in outs.values()})
    return df.drop(*[f"{o}_{k}" for o in outs.values() for k in "dscf"], *[f"_{n}{i}" for i in place.values() for n in ("last", "prev")])


def affine_carries(table: DataFrame, keys: list[str], at: str, outs: list[str], *, fan: int = SCAN_FAN, levels: int = 3) -> DataFrame:
    """``table`` with what the steps before each row make of 0, as ``<out>_c``; ``out`` holds a row's step s -> r * s + z as a struct (r, z), NULL for none.

    ``at`` numbers the rows of a series from 0. Steps are composed inside chunks of ``fan`` rows; the last row of a chunk stands for it in the next
    level, ``levels`` deep. So a value is held for any length, while no row looks at more than ``fan`` others on a level: three levels reach
    8.6e9 bars of one series, and more than that raise."""
    none = F.struct(F.lit(1.0).alias("r"), F.lit(0.0).alias("z"))
    df = table.withColumn("_whole", F.struct(*[F.coalesce(o, none).alias(o) for o in outs])).withColumn("_before", F.struct(*[none.alias(o) for o in outs]))
    for level in range(levels):
        chunk = Window.partitionBy(*keys, F.floor(F.col(at) / fan ** (level + 1))).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        ends = F.when(F.pmod(F.col(at) + 1, F.lit(fan**level)) == 0, F.col("_whole"))
        df = df.withColumn("_list", F.collect_list(ends).over(chunk))
        df = df.withColumn("_sofar", F.struct(*[F.aggregate("_list", none, _composed(o)).alias(o) for o in outs]))
        df = df.withColumns({c: F.struct(*[_composed(o)(F.col("_sofar")[o], F.col(c)).alias(o) for o in outs]) for c in ("_whole", "_before")})
    fits = F.col(at) < fan**levels
    carry = {f"{o}_c": F.when(fits, F.col("_before")[o]["z"]).otherwise(F.raise_error(F.lit("series is too long for the levels of its scan")).cast("double")) for o in outs}
    return df.withColumns(carry).drop("_whole", "_before", "_list", "_sofar")


def _composed(out: str):
    """The step ``out`` of a row after the steps before it."""
    return lambda before, row: F.struct((before["r"] * row[out]["r"]).alias("r"), (before["z"] * row[out]["r"] + row[out]["z"]).alias("z"))
