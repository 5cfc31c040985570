"""Pose tracks: standardization, step metrics, cropping and thinning.

A track is the poses of one (run_id, algorithm). Every operator takes and
returns DataFrames; rows stay spread over (track, chunk).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite, unwrap_correction
from ..functions.pose import QUAT, quat_norm, roll_pitch_yaw
from .asof import bracket
from .chunks import CHUNK, neighbour, running, spread, with_chunk, with_seq_chunk
from .keep import keep

TRACK = ["run_id", "algorithm"]
POSE = ["timestamp_s", "x_m", "y_m", "z_m", *QUAT]
ANGLES = ["roll_rad", "pitch_rad", "yaw_rad"]
METRIC_CLASS = "diagnostic/conditional/non-ground-truth"
RELATIVE_CLASS = "relative-to-baseline/diagnostic/non-ground-truth"


def _quat():
    return [F.col(c) for c in QUAT]


def rejected_poses(raw: DataFrame) -> DataFrame:
    """Rows whose quaternion cannot be normalized."""
    return raw.where((F.col("timestamp_s") != 0.0) & (quat_norm(_quat()) < 1e-12)).withColumn(
        "reject_reason", F.lit("zero quaternion")
    )


def standardize(raw: DataFrame) -> DataFrame:
    """Drop zero stamps, keep the first arrival of each stamp, normalize, add RPY.

    The dedup is a grouped ``min_by`` with map-side combine, so many copies of
    one stamp collapse before the shuffle.
    """
    payload = F.struct(*POSE[1:], "source_topic")
    first = (
        raw.where(F.col("timestamp_s") != 0.0)
        .groupBy(*TRACK, "timestamp_s")
        .agg(F.min_by(payload, "arrival_seq").alias("r"))
        .select(*TRACK, "timestamp_s", "r.*")
    )
    norm = quat_norm(_quat())
    unit = first.where(norm >= 1e-12).withColumn("n", norm)
    unit = unit.select(
        *TRACK, *POSE[:4], *((F.col(q) / F.col("n")).alias(q) for q in QUAT), "source_topic"
    )
    angles = roll_pitch_yaw(_quat())
    return unit.select("*", *(a.alias(n) for a, n in zip(angles, ANGLES)))


def arrival_backtracks(raw: DataFrame) -> DataFrame:
    """Raw rows with the stamp that arrived just before (zero stamps included)."""
    return neighbour(
        with_seq_chunk(raw, "arrival_seq"), TRACK, ["arrival_seq"], ["timestamp_s"], "p"
    )


def standardize_report(raw: DataFrame) -> DataFrame:
    """Input, output, zero, duplicate and backtrack counts per track."""
    flow = arrival_backtracks(raw).groupBy(*TRACK).agg(
        F.expr("count(*) as input_samples"),
        F.expr("count_if(timestamp_s = 0) as zero_timestamp_samples_removed"),
        F.expr("count_if(timestamp_s < p.timestamp_s) as input_time_backtracks"),
    )
    kept = (
        raw.where("timestamp_s <> 0")
        .groupBy(*TRACK, "timestamp_s")
        .agg(F.expr("count(*) as copies"))
        .groupBy(*TRACK)
        .agg(
            F.expr("count(*) as output_samples"),
            F.expr("sum(copies - 1) as duplicate_timestamps_removed"),
        )
    )
    return flow.join(kept, TRACK, "left").na.fill(0, ["output_samples", "duplicate_timestamps_removed"])


def segments(std: DataFrame, *, rows: int | None = None, finite_only: bool = True) -> DataFrame:
    """The hub table: every pose with its predecessor ``p`` and unwrapped yaw.

    ``t_first``/``t_last`` are the bounds of the track. Consumers need no
    further window: steps, interpolation and resampling are projections.
    """
    src = std.where(finite("timestamp_s", "x_m", "y_m", "z_m", "yaw_rad")) if finite_only else std
    src = src.select(*TRACK, *POSE, *ANGLES)
    src = with_chunk(src, TRACK, "timestamp_s", **({"rows": rows} if rows else {}))

    def fixed(rows: DataFrame, cols: list[str]) -> DataFrame:
        out = neighbour(rows, TRACK, ["timestamp_s"], cols, "p")
        delta = F.col("yaw_rad") - F.col("p.yaw_rad")
        return out.withColumn("yaw_fix", F.coalesce(unwrap_correction(delta), F.lit(0.0)))

    # The sums of the chunks need the yaw alone, not whole poses.
    yaws = fixed(src.select(*TRACK, CHUNK, "timestamp_s", "yaw_rad"), ["yaw_rad"])
    out = fixed(src, [*POSE, *ANGLES])
    out = running(out, TRACK, ["timestamp_s"], sums={"turns": F.col("yaw_fix")}, source=yaws)
    out = out.withColumn("yaw_u", F.expr("yaw_rad + turns")).withColumn(
        "p_yaw_u", F.expr("p.yaw_rad + turns - yaw_fix")
    )
    bounds = src.groupBy(*TRACK).agg(
        F.expr("min(timestamp_s) as t_first"), F.expr("max(timestamp_s) as t_last")
    )
    return spread(out, bounds, TRACK, TRACK, source=src)


STEP = "sqrt(pow(x_m - p.x_m, 2) + pow(y_m - p.y_m, 2) + pow(z_m - p.z_m, 2))"


def steps(seg: DataFrame) -> DataFrame:
    """Valid steps between consecutive native poses. A projection of the hub."""
    out = seg.where("p is not null").selectExpr(
        *TRACK,
        CHUNK,
        "timestamp_s",
        "timestamp_s - p.timestamp_s as dt_s",
        f"{STEP} as position_step_m",
        f"abs(yaw_rad - p.yaw_rad + yaw_fix) * 180.0D / {3.141592653589793!r}D as yaw_step_deg",
        "x_m",
        "y_m",
        "z_m",
    )
    return (
        out.where(finite("dt_s", "position_step_m", "yaw_step_deg", "x_m", "y_m", "z_m"))
        .where("dt_s > 0")
        .selectExpr(
            "*", "position_step_m / dt_s as speed_mps", "yaw_step_deg / dt_s as yaw_rate_deg_s"
        )
    )


def _ends() -> list:
    pose = "struct(x_m, y_m, z_m)"
    return [
        F.expr(f"min_by({pose}, timestamp_s) as a"),
        F.expr(f"max_by({pose}, timestamp_s) as b"),
    ]


def path_metrics(seg: DataFrame, totals: bool = False) -> DataFrame:
    """Samples, duration, length, end displacement and Z figures per track.

    With ``totals`` also per run (no algorithm) and over all (no run): the figures
    of all its segments, from the earliest to the latest pose.
    """
    agg = (seg.rollup(*TRACK) if totals else seg.groupBy(*TRACK)).agg(
        F.expr("count(*) as samples"),
        F.expr("max(timestamp_s) - min(timestamp_s) as duration_s"),
        F.expr(f"coalesce(sum({STEP}), 0.0D) as path_length_m"),
        F.expr("max(z_m) - min(z_m) as z_range_m"),
        F.expr("degrees(max(roll_rad) - min(roll_rad)) as roll_range_deg"),
        F.expr("degrees(max(pitch_rad) - min(pitch_rad)) as pitch_range_deg"),
        F.expr("min(z_m) as z_min_m"),
        F.expr("max(z_m) as z_max_m"),
        *_ends(),
    )
    gap = "sqrt(pow(b.x_m - a.x_m, 2) + pow(b.y_m - a.y_m, 2) + pow(b.z_m - a.z_m, 2))"
    out = agg.selectExpr(
        *TRACK,
        "samples",
        "duration_s",
        "path_length_m",
        f"{gap} as endpoint_displacement_m",
        "z_range_m",
        "b.z_m - a.z_m as z_end_delta_m",
        "a.z_m as z_start_m",
        "b.z_m as z_end_m",
        "z_min_m",
        "z_max_m",
        "abs(b.z_m - a.z_m) as z_end_delta_abs_m",
        "case when path_length_m > 0 then abs(b.z_m - a.z_m) / path_length_m * 10000.0D end"
        " as z_end_delta_cm_per_100m",
        "roll_range_deg",
        "pitch_range_deg",
        f"'{METRIC_CLASS}' as metric_class",
    )
    return out


def running_distance(seg: DataFrame) -> DataFrame:
    """Distance travelled so far, elapsed time and progress percent per pose."""
    out = running(
        seg.withColumn("step_m", F.expr(f"coalesce({STEP}, 0.0D)")),
        TRACK,
        ["timestamp_s"],
        sums={"distance_m": F.col("step_m"), "rn": F.lit(1).cast("bigint")},
    )
    count = seg.groupBy(*TRACK).agg(F.expr("count(*) as n"))
    return spread(out, count, TRACK, TRACK).selectExpr(
        *TRACK,
        "timestamp_s",
        "timestamp_s - t_first as elapsed_s",
        "z_m",
        "distance_m",
        "case when n > 1 then (rn - 1) / (n - 1) * 100.0D else 0.0D end as progress_percent",
    )


def common_window(std: DataFrame) -> DataFrame:
    """Latest start and earliest end over the tracks of a run.

    ``valid`` is false where the tracks do not overlap.
    """
    return (
        std.groupBy(*TRACK)
        .agg(F.expr("min(timestamp_s) as t0"), F.expr("max(timestamp_s) as t1"))
        .groupBy("run_id")
        .agg(F.expr("max(t0) as start_s"), F.expr("min(t1) as end_s"))
        .withColumn("valid", F.expr("end_s > start_s"))
    )


def crop_report(std: DataFrame, window: DataFrame) -> DataFrame:
    """Kept and discarded samples of each track for a window per run.

    The window is applied to per-track counts of the rows inside it; the rows
    are never shuffled, only their partial counts.
    """
    rows = with_window(std, window)
    return rows.groupBy(*TRACK).agg(
        F.expr("count(*) as original_samples"),
        F.expr("count_if(timestamp_s between start_s and end_s) as retained_samples"),
        F.expr("count_if(not (timestamp_s between start_s and end_s)) as discarded_samples"),
        F.expr("count_if(timestamp_s between start_s and end_s) / count(*) as retained_ratio"),
        F.expr(
            "(first(start_s) - min(timestamp_s)) + (max(timestamp_s) - first(end_s)) as discarded_duration_s"
        ),
    )


def with_window(std: DataFrame, window: DataFrame) -> DataFrame:
    cols = window.select("run_id", "start_s", "end_s")
    if CHUNK in std.columns:
        return spread(std, cols, ["run_id"], TRACK)
    return std.join(cols, "run_id")


def crop(std: DataFrame, window: DataFrame) -> DataFrame:
    return with_window(std, window).where("timestamp_s between start_s and end_s").drop("start_s", "end_s")


def start_normalized(seg: DataFrame) -> DataFrame:
    """Positions relative to the first pose with only the initial yaw removed."""
    first = seg.groupBy(*TRACK).agg(
        F.expr("min_by(struct(x_m as x0, y_m as y0, z_m as z0, yaw_rad as yaw0), timestamp_s) as s")
    ).select(*TRACK, "s.*")
    return spread(seg, first, TRACK, TRACK).selectExpr(
        *TRACK,
        "timestamp_s",
        "cos(-yaw0) * (x_m - x0) - sin(-yaw0) * (y_m - y0) as x_rel_m",
        "sin(-yaw0) * (x_m - x0) + cos(-yaw0) * (y_m - y0) as y_rel_m",
        "z_m - z0 as z_rel_m",
        "yaw_rad - yaw0 as yaw_rel_rad",
        "roll_rad",
        "pitch_rad",
    )


# --- thinning ---------------------------------------------------------------


_SIGN = np.int64(0x7FFFFFFFFFFFFFFF)


def _far_enough(last: np.ndarray, min_dt: float) -> np.ndarray:
    """For each time the least double that is ``min_dt`` or more behind it, found by bisection over the doubles."""
    bits = np.ascontiguousarray(last, np.float64).view(np.int64)
    low = bits ^ ((bits >> 63) & _SIGN)  # ordered as the doubles are
    high = np.full_like(low, np.float64(np.inf).view(np.int64))
    for _ in range(64):
        mid = (low >> 1) + (high >> 1) + (low & high & 1)
        with np.errstate(invalid="ignore"):  # an infinite time has nothing behind it
            ok = (mid ^ ((mid >> 63) & _SIGN)).view(np.float64) - last >= min_dt
        low, high = np.where(ok, low, mid), np.where(ok, mid, high)
    return (high ^ ((high >> 63) & _SIGN)).view(np.float64)


def _jumps(times: np.ndarray, min_dt: float) -> np.ndarray:
    """For each sample the next one the greedy walk keeps (len(times) at the end)."""
    return np.searchsorted(times, _far_enough(times, min_dt))


def _reached(nodes: DataFrame) -> DataFrame:
    """The nodes on the walk from the first node of each track, by pointer doubling.

    A node is an entry with the time from which the walk goes on behind its chunk;
    the first node from that time on follows it. After k rounds 2**k nodes of each
    walk are found, so no task sees more than its share of a track's nodes.
    """
    by = [*TRACK, "entry_s"]
    reached = nodes.groupBy(*TRACK).agg(F.min("entry_s").alias("entry_s"))
    chunks = nodes.groupBy(*TRACK).agg(F.count_distinct(CHUNK).alias("n"))
    hops = (chunks.agg(F.max("n")).first()[0] or 1) - 1
    if hops:
        behind = bracket(nodes.select(*by, "need_s"), nodes.select(*by), TRACK, t="need_s", sample_t="entry_s", payload=[], sides=("after",))
        jump = keep(behind.where("after is not null").selectExpr(*by, "after.t as next_s"), "jumps")
        for left in reversed(range(hops.bit_length())):
            found = reached.join(jump, by).selectExpr(*TRACK, "next_s as entry_s")
            reached = keep(reached.unionByName(found), "reached")
            if left:
                onward = jump.selectExpr(*TRACK, "entry_s as next_s", "next_s as onward_s")
                jump = keep(jump.join(onward, [*TRACK, "next_s"]).selectExpr(*by, "onward_s as next_s"), "jumps")
    return nodes.join(reached, by).selectExpr(*TRACK, CHUNK, "entry_s as start_s")


def thin(raw: DataFrame, min_dt: float, *, rows: int | None = None) -> DataFrame:
    """Keep a sample only if it is at least ``min_dt`` after the last kept one.

    The walk follows arrival order. A kept sample is always later than all
    samples before it, so everything but strict running maxima drops out first
    and the walk runs over increasing times. It is then done per chunk in three
    steps: (1) for the samples that can be the first kept one of a chunk, the last
    kept one; (2) the entries that the walk meets, by pointer doubling over all
    chunks at once; (3) the walk inside each chunk from its known start. Without a
    least distance every sample stays.
    """
    live = raw.where("timestamp_s <> 0")
    if min_dt <= 0:  # nothing is too close
        return live.select(*TRACK, "timestamp_s", "arrival_seq")
    seen = running(
        with_seq_chunk(live, "arrival_seq"),
        TRACK,
        ["arrival_seq"],
        maxima={"top": F.col("timestamp_s")},
    ).drop(CHUNK)
    # A strict running maximum is the first arrival of its own running maximum.
    rising = (
        seen.where("timestamp_s = top")
        .groupBy(*TRACK, "timestamp_s")
        .agg(F.expr("min(arrival_seq) as arrival_seq"))
    )
    rising = with_chunk(rising, TRACK, "timestamp_s", **({"rows": rows} if rows else {}))
    by = [*TRACK, CHUNK]

    def borders(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf["timestamp_s"].sort_values().to_numpy()
        after = _jumps(t, min_dt)
        entries = t[: after[0] + 1]  # the sample before an entry is too close to the first one
        last = np.where(after < len(t), after, np.arange(len(t)))
        while (last != last[last]).any():
            last = last[last]
        exits = t[last[: len(entries)]]
        return pd.DataFrame({"run_id": key[0], "algorithm": key[1], CHUNK: key[2], "entry_s": entries, "need_s": _far_enough(exits, min_dt)})

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("timestamp_s")
        t, keep = pdf["timestamp_s"].to_numpy(), []
        after = _jumps(t, min_dt)
        i = int(t.searchsorted(pdf["start_s"].iloc[0]))
        while i < len(t):
            keep.append(i)
            i = after[i]
        return pdf.iloc[keep][[*TRACK, "timestamp_s", "arrival_seq"]]

    key_ddl = f"run_id string, algorithm string, {CHUNK} bigint"
    nodes = keep(rising.groupBy(*by).applyInPandas(borders, f"{key_ddl}, entry_s double, need_s double"), "entries")
    start = _reached(nodes)
    return (
        rising.join(start, by)
        .groupBy(*by)
        .applyInPandas(walk, "run_id string, algorithm string, timestamp_s double, arrival_seq bigint")
    )
