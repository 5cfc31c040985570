"""Ordered operators that never put a whole track into one task.

A track may hold a third of all rows, so a plain window over the track key is
not an option. Every track is cut into chunks of even size, monotone in its order.
The window runs inside (track, chunk); what crosses a border is carried through
a table with one row per (track, chunk), which is small, and joined back on the
same (track, chunk) key the rows are already partitioned by. The same join
spreads per-track values to rows, so no large side is ever shuffled by track.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keep import keep

CHUNK = "chunk"
ROWS_PER_CHUNK = 250_000
# Arrival numbers are dense, so a fixed width bounds the rows of a chunk.
SEQ_PER_CHUNK = 262_144


def with_chunk(df: DataFrame, keys: Sequence[str], *order: str, rows: int = ROWS_PER_CHUNK) -> DataFrame:
    """Chunks of about ``rows`` rows each, in the order of ``keys`` and ``order``.

    The rows are range-partitioned by that order and a chunk is a partition, so
    chunks are even in rows whatever the times are: a burst, a far stamp or many
    equal stamps (if ``order`` goes on behind the stamp) change nothing. Ranges are
    sampled, hence the result is written once; a table of one chunk stays a plan.
    """
    n = -(-df.count() // rows)
    if n <= 1:
        return df.withColumn(CHUNK, F.lit(0).cast("bigint"))
    cut = df.repartitionByRange(n, *keys, *order)
    return keep(cut.withColumn(CHUNK, F.spark_partition_id().cast("bigint")), "chunks")


def with_seq_chunk(df: DataFrame, seq: str, per_chunk: int = SEQ_PER_CHUNK) -> DataFrame:
    return df.withColumn(CHUNK, F.floor(F.col(seq) / F.lit(per_chunk)).cast("bigint"))


def _inside(keys, order):
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def _across(keys, descending=False):
    c = F.col(CHUNK).desc() if descending else F.col(CHUNK).asc()
    return Window.partitionBy(*keys).orderBy(c)


def _rank_key(order: Sequence[str]) -> Column:
    return F.struct(*order) if len(order) > 1 else F.col(order[0])


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    name: str = "p",
    *,
    following: bool = False,
) -> DataFrame:
    """The previous (or following) row of the track as struct ``name``."""
    keys, order = list(keys), list(order)
    row = F.struct(*cols)
    shift = F.lead if following else F.lag
    pick = F.min_by if following else F.max_by
    edges = df.groupBy(*keys, CHUNK).agg(pick(row, _rank_key(order)).alias("__edge"))
    carry = edges.select(
        *keys, CHUNK, shift("__edge").over(_across(keys)).alias("__carry")
    )
    local = df.withColumn("__local", shift(row).over(_inside(keys, order)))
    return (
        local.join(carry, [*keys, CHUNK], "left")
        .withColumn(name, F.coalesce("__local", "__carry"))
        .drop("__local", "__carry")
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    *,
    source: DataFrame | None = None,
) -> DataFrame:
    """Inclusive running sums and maxima along the track.

    ``source`` has the same rows with what the sums and maxima need, where it is
    cheaper to read than ``df``.
    """
    keys = list(keys)
    parts: list[tuple[str, Column, Callable]] = [
        *((n, c, F.sum) for n, c in (sums or {}).items()),
        *((n, c, F.max) for n, c in (maxima or {}).items()),
    ]
    totals = (df if source is None else source).groupBy(*keys, CHUNK).agg(*(f(c).alias(f"__t_{n}") for n, c, f in parts))
    before = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, CHUNK, *(f(f"__t_{n}").over(before).alias(f"__c_{n}") for n, _, f in parts)
    )
    upto = _inside(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.select("*", *(f(c).over(upto).alias(f"__l_{n}") for n, c, f in parts))
    out = out.join(carry, [*keys, CHUNK], "left")
    for n, _, f in parts:
        local, came = F.col(f"__l_{n}"), F.col(f"__c_{n}")
        if f is F.sum:
            value = F.coalesce(came + local, local, came)
        else:
            value = F.greatest(local, came)
        out = out.withColumn(n, value)
    return out.drop(*(f"__{k}_{n}" for n, _, _ in parts for k in ("l", "c")))


def spread(
    df: DataFrame, values: DataFrame, on: Sequence[str], keys: Sequence[str], how="inner", *, source: DataFrame | None = None
) -> DataFrame:
    """Give every row its per-key values without shuffling the rows by key.

    ``values`` has one row per ``on``. It is first widened to one row per
    (keys, chunk) and joined on that, so a hot key stays spread out. That table
    is written, so the planner knows its size and the rows stay where they are
    as long as it is small. ``source`` has the same chunks, where it is cheaper to read.
    """
    chunks = (df if source is None else source).select(*keys, CHUNK).distinct()
    wide = keep(chunks.join(values, list(on), how), "spread")
    return df.join(wide, [*keys, CHUNK], how)


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], changed: Column, name: str) -> DataFrame:
    """Number the runs that start where ``changed`` is true."""
    return running(df, keys, order, sums={name: changed.cast("bigint")})
