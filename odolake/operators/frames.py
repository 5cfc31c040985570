"""Frame lookup and selection for windows and cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import nearest

RUN = ["run_id"]


def nearest_frame(queries: DataFrame, frames: DataFrame, t: str, rows: int | None = None) -> DataFrame:
    """Closest frame, clamped at the ends; the earlier one on a tie."""
    out = nearest(
        queries, frames, RUN, t=t, sample_t="bag_time_s", order=["message_id"], payload=["message_id"],
        tie="earlier", **({"rows": rows} if rows else {}),
    )
    return out.selectExpr(
        *queries.columns, "hit.message_id as message_id", "hit.t as frame_bag_time_s"
    )


def select_frames(frames: DataFrame, windows: DataFrame, period_s: float) -> DataFrame:
    """Frames nearest to a regular grid and to each window's start, middle, end."""
    targets = windows.selectExpr(
        "run_id", "explode(array(start_s, 0.5D * (start_s + end_s), end_s)) as target_s"
    )
    if period_s > 0:
        ends = frames.groupBy("run_id").agg(
            F.expr("min(bag_time_s) as a"), F.expr("max(bag_time_s) as b")
        )
        p = f"{float(period_s)!r}D"
        grid = ends.selectExpr(
            "run_id", f"explode(sequence(0L, cast(floor((b + 1e-9D - a) / {p}) as bigint))) as k", "a", "b"
        ).selectExpr("run_id", f"a + k * {p} as target_s")
        targets = targets.unionByName(grid).unionByName(ends.selectExpr("run_id", "b as target_s"))
    hit = nearest_frame(targets.distinct(), frames, "target_s")
    return hit.groupBy("run_id", "message_id").agg(F.expr("min(frame_bag_time_s) as bag_time_s"))


def frames_of_cases(cases: DataFrame) -> DataFrame:
    """The different frames that cases need, each with the number of its cases."""
    return cases.where("message_id is not null").groupBy("run_id", "message_id").agg(F.expr("count(*) as cases"))


def case_frames(windows: DataFrame, frames: DataFrame) -> DataFrame:
    """The frame of each case: nearest to its center, else mid view, else middle."""
    target = (
        "coalesce(center_s, 0.5D * (view_start_s + view_end_s),"
        " 0.5D * (coalesce(start_s, 0.0D) + coalesce(end_s, start_s, 0.0D)))"
    )
    return nearest_frame(windows.withColumn("target_s", F.expr(target)), frames, "target_s")


def lookup(messages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Messages by (run, topic, id)."""
    return messages.join(wanted.select("run_id", "topic", "message_id").distinct(), ["run_id", "topic", "message_id"], "left_semi")


def window_midpoints(windows: DataFrame) -> DataFrame:
    """Middle of each window in nanoseconds; reversed or non-finite ranges are named."""
    bad = (
        "start_s is null or end_s is null or isnan(start_s) or isnan(end_s)"
        " or abs(start_s) = double('inf') or abs(end_s) = double('inf') or end_s < start_s"
    )
    return windows.selectExpr(
        *windows.columns,
        f"case when {bad} then null else cast(floor((start_s + end_s) * 0.5D * 1000000000.0D + 0.5D) as bigint) end as seek_ns",
        f"if({bad}, 'invalid window time range', null) as reject_reason",
    )
