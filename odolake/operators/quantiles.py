"""Exact order statistics per key by histogram narrowing.

The built-in exact percentile keeps every distinct value of a group in one
task. Here a group is first counted per magnitude class (map-side combined), and
the classes that hold a wanted rank are counted again per linear slice, as often
as it takes until no slice with different values is large; only the rows of the
last cells are ranked. Each pass is a narrow scan plus a small shuffle; no pass
sorts or gathers a whole group, and copies of one value collapse before they are
shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite, magnitude_class
from .chunks import CHUNK, spread
from .keep import keep

SLICES = 1024
# Rows of a cell that one task may rank; copies of one value count as one.
ROWS_RANKED_AT_ONCE = 100_000


@dataclass(frozen=True)
class Stat:
    """``share`` gives the linear-interpolated quantile, or, with ``upper``,
    the element at position n // 2 of the sorted group."""

    name: str
    share: float = 0.5
    upper: bool = False

    @property
    def position(self) -> str:
        if self.upper:
            return "cast(floor(total / 2) as double)"
        return f"(cast({self.share!r} as double) * (total - 1))"


def _narrow(hist: DataFrame, by: list[str], cell: str) -> DataFrame:
    """Cells that contain a wanted rank, with the number of rows before them."""
    over = f"over (partition by {', '.join(by)} order by {cell} rows unbounded preceding)"
    return (
        hist.selectExpr("*", f"sum(n) {over} + base as upto")
        .selectExpr("*", "filter(want, r -> r >= upto - n and r < upto) as ranks")
        .where("size(ranks) > 0")
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, stats: Sequence[Stat],
    weight: str | None = None, *, ranked_at_once: int | None = None,
) -> DataFrame:
    """One row per key with a column per ``Stat``, the count ``n`` included.

    ``weight`` counts a row that many times without expanding it.
    """
    keys = list(keys)
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    rows = df.where(finite(value)).select(*keys, F.col(value).cast("double").alias("v"), w.alias("w"))
    rows = rows.withColumn("c", magnitude_class(F.col("v")))

    ranks = ", ".join(f"floor({s.position}), ceil({s.position})" for s in stats)
    classes = (
        rows.groupBy(*keys, "c")
        .agg(F.expr("sum(w) as n"), F.expr("min(v) as lo"), F.expr("max(v) as hi"))
        .selectExpr("*", f"sum(n) over (partition by {', '.join(keys)}) as total")
        .selectExpr("*", "0L as base", f"array_distinct(array({ranks})) as want")
    )
    hit = keep(
        _narrow(classes, keys, "c").selectExpr(
            *keys, "c", "n", "total", "lo", "hi", "upto - n as base", "ranks as want"
        )
    )
    same = [F.expr(f"first({c}) as {c}") for c in ("total", "base", "want")]
    cell = [*keys, "c"]
    inside = rows.join(hit.drop("n"), cell)
    most = ROWS_RANKED_AT_ONCE if ranked_at_once is None else ranked_at_once
    while True:
        # Between its least and largest value every cell falls apart into SLICES + 1.
        inside = inside.withColumn("s", F.expr(f"if(hi > lo, cast(floor((v - lo) / (hi - lo) * {SLICES}) as bigint), 0L)"))
        slices = inside.groupBy(*cell, "s").agg(
            F.expr("sum(w) as n"), F.expr("min(v) as l"), F.expr("max(v) as h"), *same
        )
        hit = keep(
            _narrow(slices, cell, "s").selectExpr(
                *cell, "s", "n", "total", "l as lo", "h as hi", "upto - n as base", "ranks as want"
            )
        )
        number = f"s{len(cell)}"
        inside = inside.drop("total", "base", "want", "lo", "hi").join(hit.drop("n"), [*cell, "s"]).withColumnRenamed("s", number)
        cell = [*cell, number]
        if (hit.where("hi > lo").agg(F.max("n")).first()[0] or 0) <= most:
            break
    values = inside.groupBy(*cell, "v").agg(F.expr("sum(w) as n"), *same)
    found = _narrow(values, cell, "v").selectExpr(
        *keys, "total", "v", "explode(ranks) as rank"
    )
    outs = []
    for s in stats:
        low, high = (f"max(case when rank = {f}({s.position}) then v end)" for f in ("floor", "ceil"))
        share = f"first({s.position} - floor({s.position}))"
        outs.append(F.expr(f"{low} + {share} * ({high} - {low}) as {s.name}"))
    return found.groupBy(*keys).agg(F.expr("first(total) as n"), *outs)


def melt(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns as rows ``(keys, metric, value)``, so one pass serves them all."""
    pairs = ", ".join(f"struct('{c}' as metric, cast({c} as double) as value)" for c in columns)
    return df.selectExpr(*keys, f"inline(array({pairs}))")


def column_quantiles(
    df: DataFrame, keys: Sequence[str], wanted: dict[str, Sequence[Stat]]
) -> DataFrame:
    """Quantiles of several columns in the same passes, one row per key."""
    every = list({(s.share, s.upper): s for stats in wanted.values() for s in stats})
    stats = [Stat(f"q{k}", share, upper) for k, (share, upper) in enumerate(every)]
    rows = exact_quantiles(melt(df, keys, list(wanted)), [*keys, "metric"], "value", stats)
    outs = []
    for c, asked in wanted.items():
        for s in asked:
            q = stats[every.index((s.share, s.upper))].name
            outs.append(F.expr(f"max(case when metric = '{c}' then {q} end) as {s.name}"))
    return rows.groupBy(*keys).agg(*outs)


def robust_thresholds(
    df: DataFrame,
    keys: Sequence[str],
    floors: dict[str, tuple[str, float]],
    *,
    multiplier: float = 10.0,
    scale: float = 1.4826,
) -> DataFrame:
    """max(floor, median + 10 * 1.4826 * MAD) of the finite values per key.

    ``floors`` maps a column to (result name, floor); all columns share the
    passes. Keys without a finite value keep the floor.
    """
    keys = list(keys)
    cols = list(floors)
    med = keep(column_quantiles(df, keys, {c: [Stat(f"med_{c}")] for c in cols}))
    base = spread(df.select(*keys, CHUNK, *cols), med, keys, keys)
    dev = base.selectExpr(*keys, *(f"abs({c} - med_{c}) as {c}" for c in cols))
    mad = column_quantiles(dev, keys, {c: [Stat(f"mad_{c}")] for c in cols})
    found = med.join(mad, keys).selectExpr(
        *keys,
        *(
            f"greatest({float(low)!r}D, med_{c} + {multiplier!r}D * {scale!r}D * mad_{c}) as {name}"
            for c, (name, low) in floors.items()
        ),
    )
    out = df.select(*keys).distinct().join(found, keys, "left")
    return out.na.fill({name: float(low) for name, low in floors.values()})
