"""Motion phases of the baseline track and per-phase metrics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import covering
from .chunks import CHUNK, islands, neighbour, running, spread
from .keep import keep
from .quantiles import Stat, column_quantiles, exact_quantiles
from .resample import emit_grid, pose_at
from .tracks import RELATIVE_CLASS, TRACK

# Default phase parameters.
PARAMETERS = {
    "resample_hz": 10.0,
    "stationary_speed_mps": 0.05,
    "turn_yaw_rate_deg_s": 8.0,
    "high_curvature_1pm": 0.12,
    "min_phase_duration_s": 1.5,
    "sustained_motion_s": 2.0,
    "near_start_radius_m": 3.0,
}
STATIC_EDGES = ("PRE_MOTION_STATIC", "POST_MOTION_STATIC")
SAMPLES_PER_BLOCK = 10_000


def motion_grid(seg: DataFrame, hz: float) -> DataFrame:
    """Start-anchored resample with planar speed, yaw rate, curvature and the
    distance to the start. A remainder above a quarter step adds a tail row."""
    step = f"(1.0D / {float(hz)!r}D)"
    count = f"greatest(2L, cast(floor((t_last - t_first) / {step}) as bigint) + 1)"
    tail = f"(t_last - (t_first + cast({count} - 1 as double) * {step}) > {step} * 0.25D)"
    last = f"({count} - 1 + if({tail}, 1L, 0L))"
    grid = emit_grid(
        seg,
        first="0L",
        last=last,
        index_of="({} - t_first) / " + step,
        time_of=f"if(i = {count}, t_last, t_first + cast(i as double) * {step})",
        cols=["x_m", "y_m", "z_m", "roll_rad", "pitch_rad"],
    )
    start = grid.where("i = 0").selectExpr(*TRACK, "x_m as x0", "y_m as y0")
    out = spread(neighbour(grid, TRACK, ["i"], ["timestamp_s", "x_m", "y_m", "yaw_rad"], "p"), start, TRACK, TRACK)
    dt = "greatest(timestamp_s - p.timestamp_s, 1e-9D)"
    out = out.selectExpr(
        "*",
        f"coalesce(hypot(x_m - p.x_m, y_m - p.y_m) / {dt}, 0.0D) as speed_mps",
        f"coalesce((yaw_rad - p.yaw_rad) / {dt}, 0.0D) as yaw_rate_rad_s",
        "hypot(x_m - x0, y_m - y0) as distance_to_start_m",
    )
    return out.withColumn(
        "curvature_1pm", F.expr("abs(yaw_rate_rad_s) / greatest(speed_mps, 1e-6D)")
    ).drop("p", "x0", "y0")


def motion_states(grid: DataFrame, params: dict[str, float] | None = None) -> DataFrame:
    """State per grid sample before short segments are merged.

    Sustained motion is a run of at least ceil(seconds * hz) moving samples; the
    first such run starts the motion and the last one ends it.
    """
    p = {**PARAMETERS, **(params or {})}
    need = max(1, math.ceil(p["sustained_motion_s"] * p["resample_hz"]))
    still = f"{p['stationary_speed_mps']!r}D"
    rows = grid.withColumn("moving", F.expr(f"speed_mps >= {still}"))
    prev = neighbour(rows, TRACK, ["i"], ["moving"], "p")
    runs = islands(prev, TRACK, ["i"], F.expr("p is null or moving <> p.moving"), "run").drop("p")
    sustained = (
        runs.where("moving")
        .groupBy(*TRACK, "run")
        .agg(F.expr("min(i) as a"), F.expr("max(i) as b"))
        .where(f"b - a + 1 >= {need}")
        .groupBy(*TRACK)
        .agg(F.expr("min(a) as motion_start"), F.expr("max(b) as motion_end"))
    )
    turn = f"{math.radians(p['turn_yaw_rate_deg_s'])!r}D"
    out = spread(runs.drop("run"), sustained, TRACK, TRACK, how="left")
    return out.selectExpr(
        "*",
        "case when motion_start is null then 'STATIONARY'"
        " when i < motion_start then 'PRE_MOTION_STATIC'"
        " when i > motion_end then 'POST_MOTION_STATIC'"
        f" when speed_mps < {still} then 'STATIONARY'"
        f" when abs(yaw_rate_rad_s) > {turn} then 'TURN'"
        f" when curvature_1pm > {p['high_curvature_1pm']!r}D then 'HIGH_CURVATURE'"
        " else 'STRAIGHT' end as state",
        "coalesce(i between motion_start and motion_end"
        f" and distance_to_start_m <= {p['near_start_radius_m']!r}D, false) as return_near_start",
    )


def state_segments(states: DataFrame) -> DataFrame:
    """Runs of one state (gaps and islands), one row per run."""
    prev = neighbour(states, TRACK, ["i"], ["state"], "p")
    runs = islands(prev, TRACK, ["i"], F.expr("p is null or state <> p.state"), "seg_no")
    return runs.groupBy(*TRACK, "seg_no").agg(
        F.expr("first(state) as state"),
        F.expr("min(i) as i0"),
        F.expr("max(i) as i1"),
        F.expr("min(timestamp_s) as start_s"),
        F.expr("max(timestamp_s) as last_s"),
        F.expr("bool_or(return_near_start) as return_near_start"),
        F.expr(f"min({CHUNK}) as {CHUNK}"),
    )


SEGMENT_DDL = (
    f"run_id string, algorithm string, seg_no bigint, state string, i0 bigint, i1 bigint,"
    f" start_s double, last_s double, return_near_start boolean, {CHUNK} bigint"
)


def _merge_block(pdf: pd.DataFrame, shortest: float, step: float) -> pd.DataFrame:
    """Repeatedly give the first too-short segment a neighbour's state."""
    todo = pdf.sort_values("i0").to_dict("records")[::-1]
    done: list[dict] = []

    def span(s: dict) -> float:
        return max(step, s["last_s"] - s["start_s"] + step)

    def joined(a: dict, b: dict) -> dict:
        return {
            **a,
            "state": b["state"],
            "i1": b["i1"],
            "last_s": b["last_s"],
            "return_near_start": a["return_near_start"] or b["return_near_start"],
        }

    while todo:
        cur = todo.pop()
        if done and done[-1]["state"] == cur["state"]:
            cur = joined(done.pop(), cur)
        if span(cur) >= shortest or (not done and not todo):
            done.append(cur)
            continue
        left = done[-1] if done else None
        right = todo[-1] if todo else None
        to_left = left is not None and (
            right is None or left["state"] == right["state"] or span(left) >= span(right)
        )
        cur["state"] = left["state"] if to_left else right["state"]
        todo.append(joined(cur, todo.pop()) if not to_left else joined(done.pop(), cur))
    return pd.DataFrame(done, columns=list(pdf.columns))


def merge_short(segs: DataFrame, min_duration_s: float, hz: float) -> DataFrame:
    """Merge segments shorter than the minimum into their neighbours.

    Segments that are long enough never change state, so nothing crosses a
    border between two long ones. The track is cut there and each block of
    segments is merged on its own.
    """
    step = 1.0 / hz
    long = f"greatest({step!r}D, last_s - start_s + {step!r}D) >= {float(min_duration_s)!r}D"
    rows = segs.withColumn("long", F.expr(long))
    rows = neighbour(rows, TRACK, ["i0"], ["long"], "p")
    rows = islands(rows, TRACK, ["i0"], F.expr("p is null or (long and p.long)"), "block")
    cols = [c.split()[0] for c in SEGMENT_DDL.split(", ")]
    return (
        rows.select(*cols, "block")
        .groupBy(*TRACK, "block")
        .applyInPandas(
            lambda pdf: _merge_block(pdf[cols], float(min_duration_s), step), SEGMENT_DDL
        )
    )


def phase_table(merged: DataFrame, hz: float = PARAMETERS["resample_hz"]) -> DataFrame:
    """Numbered phases; a phase ends where the next one starts."""
    step = f"{1.0 / hz!r}D"
    rows = neighbour(merged, TRACK, ["i0"], ["start_s"], "n", following=True)
    rows = running(rows, TRACK, ["i0"], sums={"no": F.lit(1).cast("bigint")})
    rows = rows.selectExpr("*", "coalesce(n.start_s, last_s) as e").selectExpr(
        "*", f"if(e <= start_s, start_s + {step}, e) as end_s"
    )
    return rows.selectExpr(
        "run_id",
        "algorithm",
        "format_string('phase_%03d', no - 1) as phase_id",
        "no - 1 as phase_no",
        "state",
        "start_s",
        "end_s",
        "end_s - start_s as duration_s",
        "return_near_start",
        "i1 - i0 + 1 as baseline_samples",
        "n is null as is_last",
    )


def build_phases(seg: DataFrame, params: dict[str, float] | None = None) -> DataFrame:
    """All steps from the hub table to numbered phases.

    Each stage reads its input several times, so stages are written once.
    """
    p = {**PARAMETERS, **(params or {})}
    hz = p["resample_hz"]
    return phases_of(motion_states(keep(motion_grid(seg, hz), "motion_grid"), p), p)


def phases_of(states: DataFrame, params: dict[str, float] = PARAMETERS) -> DataFrame:
    hz = params["resample_hz"]
    segs = keep(state_segments(keep(states, "motion_states")), "state_segments")
    merged = keep(merge_short(segs, params["min_phase_duration_s"], hz), "merged_segments")
    return phase_table(merged, hz)


def motion_phases(phases: DataFrame) -> DataFrame:
    return phases.where(~F.col("state").isin(*STATIC_EDGES))


# --- metrics ----------------------------------------------------------------


def spread_samples(rows: DataFrame, n: str) -> DataFrame:
    """Indices 0..n-1 per row as ``i``, in blocks, so one long row is not
    expanded by one task."""
    return (
        rows.selectExpr("*", f"explode(sequence(0L, ({n} - 1) div {SAMPLES_PER_BLOCK}L)) as block")
        .repartition("run_id", "algorithm", "block")
        .selectExpr(
            "*",
            f"explode(sequence(block * {SAMPLES_PER_BLOCK}L,"
            f" least({n} - 1, (block + 1) * {SAMPLES_PER_BLOCK}L - 1))) as i",
        )
        .drop("block")
    )


def phase_windows(phases: DataFrame, bounds: DataFrame, hz: float) -> DataFrame:
    """Phase x algorithm with the common time range and its sample count.

    ``bounds`` has the aligned pair per candidate track: ``b_first, b_last,
    c_first, c_last`` (and the pair transform).
    """
    step = f"(1.0D / {float(hz)!r}D)"
    rows = phases.drop("algorithm").join(bounds.drop("t0", "t1"), "run_id").selectExpr(
        "*",
        "greatest(start_s, b_first, c_first) as t0",
        "least(end_s, b_last, c_last) as t1",
    )
    return rows.selectExpr(
        "*",
        f"if(t1 <= t0, 0L, greatest(2L, cast(floor((t1 - t0) / {step}) as bigint) + 1)) as samples",
    )


def phase_trajectory_metrics(
    phases: DataFrame, seg: DataFrame, pairs: DataFrame, hz: float = PARAMETERS["resample_hz"], *, baseline: str
) -> DataFrame:
    """Coverage, gaps, relative error, Z change and angle ranges per phase."""
    windows = phase_windows(phases, pairs, hz)
    key = [*TRACK, "phase_id"]
    have = windows.where("samples > 0")
    grid = spread_samples(have, "samples").selectExpr(
        *key, "i", "samples", "t0", "t1", "c", "s", "tx", "ty", "tz",
        "if(i = samples - 1, t1, t0 + cast(i as double) * ((t1 - t0) / (samples - 1))) as t",
    )
    cand = keep(
        pose_at(grid, seg, t="t", rotation=False, clamp_ends=True).selectExpr(
            *key, "i", "samples", "t", "proll as roll", "ppitch as pitch",
            "c * px - s * py + tx as ax", "s * px + c * py + ty as ay", "pz + tz as az",
        ),
        "phase_samples",
    )
    base = seg.where(F.col("algorithm") == baseline).drop("algorithm")
    both = keep(
        pose_at(cand, base, t="t", keys=["run_id"], rotation=False, clamp_ends=True).selectExpr(
            *key, "i", "samples", "roll", "pitch", "az",
            "sqrt(pow(ax - px, 2) + pow(ay - py, 2) + pow(az - pz, 2)) as err", "az - pz as zerr",
        ),
        "phase_errors",
    )
    agg = both.groupBy(*key).agg(
        F.expr("sqrt(avg(err * err)) as relative_position_rmse_m"),
        F.expr("sqrt(avg(zerr * zerr)) as relative_z_rmse_m"),
        F.expr("max_by(az, i) - min_by(az, i) as z_change_m"),
        F.expr("degrees(max(roll) - min(roll)) as roll_range_deg"),
        F.expr("degrees(max(pitch) - min(pitch)) as pitch_range_deg"),
    )
    p95 = exact_quantiles(both, key, "err", [Stat("relative_position_p95_m", 0.95)]).drop("n")
    # Gaps between native candidate poses: both ends of a step lie in the window.
    native = phase_of_poses(seg, windows)
    gaps = native.where("p.timestamp_s >= t0").groupBy(*key).agg(
        F.expr("max(timestamp_s - p.timestamp_s) as max_sample_gap_s")
    )
    return (
        windows.selectExpr(
            *key,
            "state",
            "samples",
            "if(samples = 0, 0.0D, least(1.0D, (t1 - t0) / greatest(1e-9D, end_s - start_s))) as coverage_ratio",
        )
        .join(gaps, key, "left")
        .join(agg, key, "left")
        .join(p95, key, "left")
        .withColumn("metric_class", F.lit(RELATIVE_CLASS))
    )


def phase_of_poses(seg: DataFrame, windows: DataFrame) -> DataFrame:
    """Native poses inside the common range of a phase, both ends included.

    The ranges of a track touch; a pose on a border belongs to both sides, so
    the covering lookup is done for either end of each pose's step.
    """
    have = windows.where("samples > 0").select(*TRACK, "phase_id", "t0", "t1")
    poses = seg.where("p is not null").select(*TRACK, "timestamp_s", "p")
    poses = poses.selectExpr("*", "0.5D * (timestamp_s + p.timestamp_s) as mid")
    out = covering(
        poses, have, TRACK, t="mid", start="t0", end="t1", payload=["phase_id", "t0", "t1"], name="w"
    )
    return out.where("w is not null and timestamp_s <= w.t1").selectExpr(
        *TRACK, "w.phase_id as phase_id", "w.t0 as t0", "timestamp_s", "p"
    )


def assign_phase(samples: DataFrame, phases: DataFrame, time: str = "trajectory_time_s") -> DataFrame:
    """Phase of each sample: half-open intervals, the last one closed."""
    rows = phases.select("run_id", "phase_id", "start_s", "end_s", "is_last")
    return covering(
        samples.where(F.col(time).isNotNull()), rows, ["run_id"], t=time, start="start_s", end="end_s",
        payload=["phase_id", "is_last"], closed=F.col("cover.is_last"),
    ).selectExpr(*samples.columns, "cover.phase_id as phase_id")


def outside_phases(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy(*TRACK).agg(F.expr("count_if(phase_id is null) as outside_phase_window_samples"))


def phase_resource_metrics(assigned: DataFrame, phases: DataFrame, tracks: DataFrame, time="trajectory_time_s") -> DataFrame:
    """CPU, memory and thread figures per phase x track; empty cells are null."""
    key = [*TRACK, "phase_id"]
    rows = assigned.where("phase_id is not null").selectExpr(
        *key,
        f"struct({time}, seq) as at",
        "coalesce(cpu_percent, 0.0D) as cpu",
        "coalesce(cast(rss_bytes as double), 0.0D) / 1048576.0D as rss",
        "cast(coalesce(threads, 0) as double) as thr",
    )
    agg = rows.groupBy(*key).agg(
        F.expr("count(*) as resource_samples"),
        F.expr("avg(cpu) as cpu_mean_percent"),
        F.expr("max(cpu) as cpu_peak_percent"),
        F.expr("min_by(rss, at) as rss_start_mib"),
        F.expr("max_by(rss, at) as rss_end_mib"),
        F.expr("max_by(rss, at) - min_by(rss, at) as rss_growth_mib"),
        F.expr("max(rss) as rss_peak_mib"),
        F.expr("cast(max(thr) as bigint) as threads_peak"),
    )
    high = column_quantiles(
        rows,
        key,
        {
            "cpu": [Stat("cpu_median_percent"), Stat("cpu_p95_percent", 0.95)],
            "thr": [Stat("threads_p95", 0.95)],
        },
    )
    cells = phases.select("run_id", "phase_id").join(tracks.select(*TRACK).distinct(), "run_id")
    return (
        cells.join(agg, key, "left")
        .join(high, key, "left")
        .withColumn("resource_samples", F.coalesce("resource_samples", F.lit(0).cast("bigint")))
    )


def metric_matrix(metrics: DataFrame, value: str, phase_ids: list[str]) -> DataFrame:
    """Algorithm x phase with NaN for missing cells and an availability flag."""
    wide = metrics.groupBy(*TRACK).pivot("phase_id", phase_ids).agg(F.first(value))
    cells = [F.coalesce(F.col(p).cast("double"), F.lit(float("nan"))).alias(p) for p in phase_ids]
    known = [F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double")) for p in phase_ids]
    some = known[0]
    for k in known[1:]:
        some = some | k
    return wide.select(*TRACK, *cells, some.alias("available"))
