"""As-of, nearest and interval lookups by one ordered fill.

Queries and samples are laid on one time line per key, cut into chunks, and
every query reads the sample just before and just after it. Nothing is
exploded, so gaps of any length cost nothing, and a hot key is spread over its
chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import CHUNK, ROWS_PER_CHUNK, with_chunk


def bracket(
    queries: DataFrame,
    samples: DataFrame,
    keys: Sequence[str],
    *,
    t: str,
    sample_t: str,
    order: Sequence[str] = (),
    payload: Sequence[str],
    exact: str = "after",
    sides: Sequence[str] = ("before", "after"),
    rows: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Add structs ``before`` and ``after`` (the neighbouring samples) to queries.

    ``exact`` says on which side a sample at exactly the query time falls.
    ``order`` breaks ties between samples of one time, in sample order.
    """
    keys = list(keys)
    q_cols = [c for c in queries.columns if c not in keys]
    left = queries.select(
        *keys, F.struct(*q_cols).alias("__q"), F.col(t).cast("double").alias("__t")
    )
    key = [F.col(c).cast("bigint").alias(f"o{i}") for i, c in enumerate(order)]
    right = samples.select(
        *keys,
        F.struct(F.col(sample_t).cast("double").alias("t"), *(c for c in payload if c != "t")).alias("__s"),
        F.col(sample_t).cast("double").alias("__t"),
        (F.struct(*key) if key else F.struct(F.lit(0).cast("bigint").alias("o0"))).alias("__o"),
    ).where(F.col("__t").isNotNull())
    rank = 0 if exact == "before" else 1
    line = left.withColumn("__side", F.lit(1 - rank)).unionByName(
        right.withColumn("__side", F.lit(rank)), allowMissingColumns=True
    )
    line = with_chunk(line, keys, "__t", "__side", "__o", rows=rows)

    edge_key = F.when(F.col("__s").isNotNull(), F.struct("__t", "__o"))
    edges = line.groupBy(*keys, CHUNK).agg(
        F.max_by("__s", edge_key).alias("__last"), F.min_by("__s", edge_key).alias("__first")
    )
    by_chunk = Window.partitionBy(*keys).orderBy(CHUNK)
    by_chunk_desc = Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc())
    past = (Window.unboundedPreceding, -1)
    carry = edges.select(
        *keys,
        CHUNK,
        F.last("__last", ignorenulls=True).over(by_chunk.rowsBetween(*past)).alias("__cb"),
        F.last("__first", ignorenulls=True).over(by_chunk_desc.rowsBetween(*past)).alias("__ca"),
    )
    inside = Window.partitionBy(*keys, CHUNK)
    upto = (Window.unboundedPreceding, Window.currentRow)
    if "before" in sides:
        w = inside.orderBy("__t", "__side", "__o").rowsBetween(*upto)
        line = line.withColumn("__b", F.last("__s", ignorenulls=True).over(w))
    if "after" in sides:
        w = inside.orderBy(
            F.col("__t").desc(), F.col("__side").desc(), F.col("__o").desc()
        ).rowsBetween(*upto)
        line = line.withColumn("__a", F.last("__s", ignorenulls=True).over(w))
    out = line.where(F.col("__q").isNotNull()).join(carry, [*keys, CHUNK], "left")
    picks, timed = [], F.col("__t").isNotNull()  # a query without a time has no neighbour
    if "before" in sides:
        picks.append(F.when(timed, F.coalesce("__b", "__cb")).alias("before"))
    if "after" in sides:
        picks.append(F.when(timed, F.coalesce("__a", "__ca")).alias("after"))
    return out.select(*keys, "__q.*", *picks)


def nearest(
    queries: DataFrame,
    samples: DataFrame,
    keys: Sequence[str],
    *,
    t: str,
    sample_t: str,
    order: Sequence[str] = (),
    payload: Sequence[str],
    tie: str = "later",
    max_age: float | None = None,
    name: str = "hit",
    rows: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """The closest sample in time as struct ``name`` and its distance ``age_s``.

    On equal distance ``tie`` decides. With ``max_age`` a sample further away
    (beyond a slack of 1e-12) yields null.
    """
    out = bracket(
        queries, samples, keys, t=t, sample_t=sample_t, order=order, payload=payload,
        exact="after", rows=rows,
    )
    back = F.abs(F.col("before.t") - F.col(t))
    ahead = F.abs(F.col("after.t") - F.col(t))
    closer = (ahead <= back) if tie == "later" else (ahead < back)
    hit = (
        F.when(F.col("before").isNull(), F.col("after"))
        .when(F.col("after").isNull(), F.col("before"))
        .when(closer, F.col("after"))
        .otherwise(F.col("before"))
    )
    out = out.withColumn(name, hit).drop("before", "after")
    age = F.abs(F.col(f"{name}.t") - F.col(t))
    if max_age is not None:
        out = out.withColumn(name, F.when(age <= F.lit(max_age + 1e-12), F.col(name)))
    return out.withColumn("age_s", F.abs(F.col(f"{name}.t") - F.col(t)))


def covering(
    queries: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    *,
    t: str,
    start: str,
    end: str,
    payload: Sequence[str],
    slack: float = 0.0,
    closed: Column | None = None,
    name: str = "cover",
    rows: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """The interval that contains the query time, for disjoint intervals.

    ``closed`` is an expression over the interval's payload (as ``cover.*``)
    saying whether its end belongs to it; without it both ends do.
    """
    moved = queries.withColumn("__qt", F.col(t) + F.lit(slack))
    fields = list(dict.fromkeys([*payload, end]))
    out = bracket(
        moved, intervals, keys, t="__qt", sample_t=start, payload=fields,
        exact="before", sides=("before",), rows=rows,
    ).withColumnRenamed("before", name)
    stop = F.col(f"{name}.{end}") + F.lit(slack)
    inside = F.col(t) <= stop
    if closed is not None:
        inside = (F.col(t) < stop) | (closed & (F.col(t) <= stop))
    return out.withColumn(name, F.when(inside, F.col(name))).drop("__qt")
