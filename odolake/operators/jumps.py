"""Jump events, robust thresholds and review windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import covering
from .chunks import CHUNK, islands, neighbour, running, spread
from .quantiles import Stat, column_quantiles, robust_thresholds
from .tracks import METRIC_CLASS, TRACK

POSITION_FLOOR_M = 0.5
YAW_FLOOR_DEG = 10.0
WINDOW_GAP_S = 1.0
WINDOW_CONTEXT_S = 0.5


def thresholds(steps: DataFrame, position_floor=POSITION_FLOOR_M, yaw_floor=YAW_FLOOR_DEG) -> DataFrame:
    """One row per track with both jump thresholds."""
    return robust_thresholds(
        steps,
        TRACK,
        {
            "position_step_m": ("position_threshold_m", position_floor),
            "yaw_step_deg": ("yaw_threshold_deg", yaw_floor),
        },
    )


def flagged_steps(steps: DataFrame, limits: DataFrame) -> DataFrame:
    """Steps with their thresholds, jump flags and ';'-joined anomaly types."""
    return spread(steps, limits, TRACK, TRACK).selectExpr(
        "*",
        "position_step_m > position_threshold_m as position_jump",
        "yaw_step_deg > yaw_threshold_deg as yaw_jump",
        "concat_ws(';', if(position_step_m > position_threshold_m, 'position_jump', null),"
        " if(yaw_step_deg > yaw_threshold_deg, 'yaw_jump', null)) as anomaly_types",
    )


def jump_events(flagged: DataFrame, time: str = "timestamp_s") -> DataFrame:
    """One row per exceeded threshold; a step may give two."""
    kinds = (
        "filter(array("
        "struct('position_jump' as type, position_threshold_m as threshold, position_jump as hit),"
        "struct('yaw_jump' as type, yaw_threshold_deg as threshold, yaw_jump as hit)), k -> k.hit)"
    )
    return (
        flagged.where("position_jump or yaw_jump")
        .selectExpr("*", f"explode({kinds}) as k")
        .selectExpr(
            *TRACK,
            CHUNK,
            f"{time} as event_s",
            *(["timestamp_s"] if time != "timestamp_s" else ["timestamp_s"]),
            "k.type as type",
            "k.threshold as threshold",
            "position_step_m",
            "yaw_step_deg",
            "speed_mps",
            "yaw_rate_deg_s",
            "x_m",
            "y_m",
            "z_m",
            "if(k.type = 'yaw_jump', yaw_step_deg, position_step_m) / greatest(k.threshold, 1e-12D) as severity",
        )
    )


def jump_summary(flagged: DataFrame) -> DataFrame:
    """Thresholds, counts, maxima and 99th percentiles of the steps per track."""
    base = flagged.groupBy(*TRACK).agg(
        F.expr("count(*) as samples"),
        F.expr("first(position_threshold_m) as position_threshold_m"),
        F.expr("first(yaw_threshold_deg) as yaw_threshold_deg"),
        F.expr("count_if(position_jump) as position_jump_count"),
        F.expr("count_if(yaw_jump) as yaw_jump_count"),
        F.expr("count_if(position_jump) + count_if(yaw_jump) as event_count"),
        F.expr("max(position_step_m) as max_position_step_m"),
        F.expr("max(yaw_step_deg) as max_yaw_step_deg"),
    )
    high = column_quantiles(
        flagged,
        TRACK,
        {c: [Stat(f"p99_{c}", 0.99)] for c in ("position_step_m", "yaw_step_deg")},
    )
    return base.join(high, TRACK, "left").withColumn("metric_class", F.lit(METRIC_CLASS))


def top_events(events: DataFrame, n: int = 30) -> DataFrame:
    return events.orderBy(F.desc("severity"), "algorithm", "event_s", "type").limit(n)


def cluster_events(events: DataFrame, gap_s: float = WINDOW_GAP_S) -> DataFrame:
    """Events with the number of their window: a gap above ``gap_s`` starts one."""
    order = ["event_s", "type"]
    out = neighbour(events, TRACK, order, ["event_s"], "p")
    fresh = F.expr(f"p is null or event_s - p.event_s > {gap_s!r}D + 1e-12D")
    out = islands(out, TRACK, order, fresh, "window_no").drop("p")
    return out.withColumn("window_id", F.format_string("%s:window_%04d", "algorithm", "window_no"))


def anomaly_windows(clustered: DataFrame, context_s: float = WINDOW_CONTEXT_S) -> DataFrame:
    """One row per window. Its events stay rows of ``clustered`` (same
    ``window_id``), so a window of any size is never gathered into one value."""
    return (
        clustered.groupBy(*TRACK, "window_id", "window_no")
        .agg(
            F.expr("min(event_s) as start_s"),
            F.expr("max(event_s) as end_s"),
            F.expr("count(*) as event_count"),
            F.expr("max(severity) as severity"),
            F.expr("max(position_step_m) as peak_position_step_m"),
            F.expr("max(yaw_step_deg) as peak_yaw_step_deg"),
            F.expr("array_sort(collect_set(type)) as types"),
            F.expr(f"min({CHUNK}) as {CHUNK}"),
        )
        .selectExpr(
            "*",
            "0.5D * (start_s + end_s) as center_s",
            f"greatest(0.0D, start_s - {context_s!r}D) as view_start_s",
            f"end_s + {context_s!r}D as view_end_s",
            "greatest(0.0D, end_s - start_s) as duration_s",
        )
    )


def tag_windows(rows: DataFrame, windows: DataFrame, time: str = "bag_time_s") -> DataFrame:
    """Rows with the id and types of the window they fall in ('' outside)."""
    src = windows.selectExpr(
        *TRACK, "window_id", "start_s", "end_s", "array_join(types, ';') as types"
    )
    out = covering(
        rows, src, TRACK, t=time, start="start_s", end="end_s",
        payload=["window_id", "types"], slack=1e-9,
    )
    return out.selectExpr(
        *rows.columns,
        "coalesce(cover.window_id, '') as anomaly_window_ids",
        "coalesce(cover.types, '') as anomaly_types",
    )


def tag_all_windows(rows: DataFrame, windows: DataFrame, time: str, bucket_s: float = 60.0, slack: float = 1e-9) -> DataFrame:
    """Rows with the ids of all windows they fall in, as a ``;`` list in order of start ('' outside).

    Windows may overlap. Each is laid into the buckets of ``bucket_s`` seconds it
    touches and meets the rows of those buckets only.
    """
    b = f"{float(bucket_s)!r}D"
    spread_out = windows.selectExpr(
        *TRACK, "window_id", "start_s", "end_s",
        f"explode(sequence(cast(floor((start_s - {slack}D) / {b}) as bigint), cast(floor((end_s + {slack}D) / {b}) as bigint))) as bucket",
    )
    key = [*TRACK, time]
    at = rows.select(*key).distinct().withColumn("bucket", F.expr(f"cast(floor({time} / {b}) as bigint)"))
    hits = at.join(spread_out, [*TRACK, "bucket"]).where(f"{time} between start_s - {slack}D and end_s + {slack}D")
    lists = hits.groupBy(*key).agg(F.expr("array_sort(collect_list(struct(start_s, window_id))) as w"))
    lists = lists.selectExpr(*key, "array_join(transform(w, x -> x.window_id), ';') as anomaly_window_ids")
    return rows.join(lists, key, "left").na.fill("", ["anomaly_window_ids"])


def representative_windows(windows: DataFrame, unhealthy: DataFrame, limit: int = 6) -> DataFrame:
    """Up to ``limit`` windows per run: the best position jump, the best other
    yaw jump, the best of each unhealthy algorithm, then the best of the rest.

    Only windows that can be chosen are kept before the final ordering: the top
    ``limit`` overall plus the top one per type and per algorithm, each found
    with a map-side group limit.
    """
    rank = "-severity, algorithm, start_s, window_id"
    once = windows.selectExpr(
        "*", f"row_number() over (partition by run_id, window_id order by {rank}) as copy"
    ).where("copy = 1 and window_id <> '' and algorithm <> ''").drop("copy")
    top = f"row_number() over (partition by run_id{{}} order by {rank}) as k"
    cols = once.columns

    def best(df: DataFrame, by: str, n: int) -> DataFrame:
        return df.selectExpr("*", top.format(by)).where(f"k <= {n}").select(*cols)

    sick = once.join(unhealthy.select(*TRACK).distinct(), TRACK, "left_semi")
    pool = (
        best(once, "", limit)
        .unionByName(best(once.where("array_contains(types, 'position_jump')"), "", 1))
        .unionByName(best(once.where("array_contains(types, 'yaw_jump')"), "", 2))
        .unionByName(best(sick, ", algorithm", 1))
        .dropDuplicates(["run_id", "window_id"])
    )
    flags = pool.join(
        best(sick, ", algorithm", 1).select("run_id", "window_id").withColumn("sick", F.lit(True)),
        ["run_id", "window_id"],
        "left",
    )
    # The pool of a run holds at most limit + 3 + (number of algorithms) rows.
    place = "row_number() over (partition by run_id, {} order by " + rank + ")"
    flags = flags.selectExpr(
        "*",
        "array_contains(types, 'position_jump') as has_pos",
        "array_contains(types, 'yaw_jump') as has_yaw",
    ).selectExpr("*", f"has_pos and {place.format('has_pos')} = 1 as pick_pos")
    flags = flags.selectExpr(
        "*", f"has_yaw and not pick_pos and {place.format('has_yaw and not pick_pos')} = 1 as pick_yaw"
    )
    ordered = flags.selectExpr(
        "*",
        "case when pick_pos then 0 when pick_yaw then 1 when sick then 2 else 3 end as tier",
    ).selectExpr("*", f"row_number() over (partition by run_id order by tier, {rank}) as seat")
    return (
        ordered.where(f"seat <= {int(limit)}")
        .selectExpr(*cols, f"row_number() over (partition by run_id order by {rank}) as rank")
    )


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(*TRACK).agg(
        F.expr("count(*) as event_count"),
        F.expr("count_if(type = 'position_jump') as position_jump_count"),
        F.expr("count_if(type = 'yaw_jump') as yaw_jump_count"),
    )
