"""Fixed-rate grids, interpolation at query times and kinematics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..functions.pose import QUAT, slerp
from .asof import bracket
from .chunks import CHUNK, neighbour, spread
from .keep import keep as write
from .tracks import TRACK

RATE_HZ = 10.0


def time_origin(std: DataFrame, profile: DataFrame | None = None, baseline: str = "algo_0") -> DataFrame:
    """Origin per run: the log's first sensor header, else the baseline's first stamp.

    ``profile`` has ``run_id, topic, header_first_s`` for the LiDAR topic.
    """
    first = std.where(F.col("algorithm") == baseline).groupBy("run_id").agg(
        F.expr("min(timestamp_s) as base_s")
    )
    if profile is None:
        return first.selectExpr(
            "run_id", "base_s as origin_s", "'baseline_standardized:first_timestamp_s' as origin_source"
        )
    head = profile.select("run_id", "topic", "header_first_s").where(finite("header_first_s"))
    return first.join(head, "run_id", "full").selectExpr(
        "run_id",
        "coalesce(header_first_s, base_s) as origin_s",
        "if(header_first_s is not null, concat('log:', topic, ':header_first_s'),"
        " 'baseline_standardized:first_timestamp_s') as origin_source",
    )


def _inside(v: str, t: str = "t") -> str:
    """Linear interpolation on the segment, clamped at its ends."""
    return (
        f"case when p is null or {t} >= timestamp_s then {v} when {t} <= p.timestamp_s then p.{v}"
        f" else p.{v} + (({t} - p.timestamp_s) / (timestamp_s - p.timestamp_s)) * ({v} - p.{v}) end"
    )


def _yaw(t: str = "t") -> str:
    return (
        f"case when p is null or {t} >= timestamp_s then yaw_u when {t} <= p.timestamp_s then p_yaw_u"
        f" else p_yaw_u + (({t} - p.timestamp_s) / (timestamp_s - p.timestamp_s)) * (yaw_u - p_yaw_u) end"
    )


def emit_grid(
    seg: DataFrame, first: str, last: str, index_of: str, time_of: str, cols: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """Grid points of each segment: a narrow explode, no union and no sort.

    A segment owns the indices from its left pose (inclusive) to its right pose
    (exclusive); the track's last segment is closed and its ends are clamped to
    the ``first``/``last`` index expressions. A track of one pose owns nothing.
    """
    lo = f"if(p.timestamp_s = t_first, {first}, cast(ceil({index_of.format('p.timestamp_s')}) as bigint))"
    hi = f"if(timestamp_s = t_last, {last}, cast(ceil({index_of.format('timestamp_s')}) as bigint) - 1)"
    grid = (
        seg.where("p is not null")
        .selectExpr("*", f"greatest({lo}, {first}) as i0", f"least({hi}, {last}) as i1")
        .where("i1 >= i0")
        .selectExpr("*", "explode(sequence(i0, i1)) as i")
        .selectExpr("*", f"{time_of} as t")
    )
    return grid.selectExpr(
        *TRACK,
        CHUNK,
        "i",
        "t as timestamp_s",
        *(f"{_inside(c)} as {c}" for c in cols),
        f"{_yaw()} as yaw_rad",
        *keep,
    )


def resample_fixed_rate(seg: DataFrame, origin: DataFrame, hz: float = RATE_HZ) -> DataFrame:
    """Poses on multiples of 1/hz after the run's origin."""
    src = spread(seg, origin.select("run_id", "origin_s"), ["run_id"], TRACK)
    rate = f"{float(hz)!r}D"
    step = f"(1.0D / {rate})"
    grid = emit_grid(
        src.withColumnRenamed("origin_s", "o"),
        first=f"cast(ceil((t_first - o) * {rate} - 1e-9D) as bigint)",
        last=f"cast(floor((t_last - o) * {rate} + 1e-9D) as bigint)",
        index_of="({} - o) * " + rate,
        time_of=f"o + cast(i as double) * {step}",
        cols=["x_m", "y_m", "z_m"],
        keep=["o"],
    )
    return grid.selectExpr(
        *TRACK, CHUNK, "i", "timestamp_s", "timestamp_s - o as bag_time_s",
        "x_m", "y_m", "z_m", "yaw_rad",
    )


def kinematics(grid: DataFrame, hz: float = RATE_HZ) -> DataFrame:
    """Grid differences: step, yaw step, speed, yaw rate, acceleration (first row 0)."""
    step = f"(1.0D / {float(hz)!r}D)"
    out = neighbour(grid, TRACK, ["i"], ["x_m", "y_m", "z_m", "yaw_rad"], "p").selectExpr(
        "*",
        "p is null as is_first",
        "coalesce(sqrt(pow(x_m - p.x_m, 2) + pow(y_m - p.y_m, 2) + pow(z_m - p.z_m, 2)), 0.0D)"
        " as delta_position_m",
        f"coalesce((yaw_rad - p.yaw_rad) * 180.0D / {3.141592653589793!r}D, 0.0D) as signed_deg",
    ).drop("p")
    out = out.selectExpr(
        "*",
        f"delta_position_m / {step} as speed_mps",
        f"signed_deg / {step} as yaw_rate_deg_s",
        "abs(signed_deg) as delta_yaw_deg",
    ).drop("signed_deg")
    out = neighbour(out, TRACK, ["i"], ["speed_mps"], "p")
    return out.selectExpr(
        *(c for c in out.columns if c != "p"),
        f"coalesce((speed_mps - p.speed_mps) / {step}, 0.0D) as acceleration_mps2",
    )


def step_view(timeline: DataFrame) -> DataFrame:
    """The timeline without its first row, named like native steps."""
    return timeline.where("not is_first").selectExpr(
        *TRACK, CHUNK, "timestamp_s", "bag_time_s", "delta_position_m as position_step_m",
        "delta_yaw_deg as yaw_step_deg", "speed_mps", "yaw_rate_deg_s", "x_m", "y_m", "z_m",
    )


SEG_PAYLOAD = [
    "timestamp_s", "x_m", "y_m", "z_m", *QUAT, "roll_rad", "pitch_rad", "yaw_u", "p", "p_yaw_u",
    "t_first",
]


def pose_at(
    queries: DataFrame,
    seg: DataFrame,
    *,
    t: str = "t",
    keys: Sequence[str] = TRACK,
    max_gap_s: float | None = None,
    rotation: bool = True,
    clamp_ends: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Interpolated pose at each query time.

    Adds ``px, py, pz``, unwrapped ``pyaw``, ``proll``, ``ppitch`` and, with
    ``rotation``, the slerped ``pqx..pqw``. ``valid`` is false (pose null)
    outside the track, or inside a gap above ``max_gap_s`` unless the query
    sits on a pose. ``clamp_ends`` holds the end poses instead.
    """
    extra = {"rows": rows} if rows else {}
    sides = ("before", "after") if clamp_ends else ("after",)
    # Stamps alone are laid on the line; of whole poses only those that a query met are read.
    out = bracket(
        queries, seg, keys, t=t, sample_t="timestamp_s", payload=[], sides=sides, exact="after", **extra
    )
    at = [*keys, "__at"]
    out = write(
        out.withColumn("__at", F.coalesce(*(f"{side}.t" for side in reversed(sides)))).drop(*sides), "pose_queries"
    )
    poses = seg.select(*keys, F.col("timestamp_s").cast("double").alias("__at"), F.struct(*SEG_PAYLOAD).alias("__s"))
    met = write(out.select(*at).where("__at is not null").distinct(), "pose_stamps")
    met = write(poses.join(met, at, "left_semi").groupBy(*at).agg(F.first("__s").alias("__s")), "poses")
    out = out.join(met, at, "left").drop("__at")
    ok = f"__s is not null and ({t} >= __s.t_first)" if not clamp_ends else "__s is not null"
    if max_gap_s is not None:
        ok += (
            f" and (__s.p is null or abs({t} - __s.timestamp_s) <= 1e-12D or abs({t} - __s.p.timestamp_s) <= 1e-12D"
            f" or __s.timestamp_s - __s.p.timestamp_s <= {float(max_gap_s)!r}D)"
        )
    out = out.selectExpr("*", f"({ok}) as valid").selectExpr(
        "*",
        f"case when __s.p is null or {t} >= __s.timestamp_s then 1.0D when {t} <= __s.p.timestamp_s then 0.0D"
        f" else ({t} - __s.p.timestamp_s) / (__s.timestamp_s - __s.p.timestamp_s) end as __f",
    )
    names = {"px": "x_m", "py": "y_m", "pz": "z_m", "proll": "roll_rad", "ppitch": "pitch_rad"}
    picks = [
        f"case when valid then coalesce(__s.p.{c} + __f * (__s.{c} - __s.p.{c}), __s.{c}) end as {n}"
        for n, c in names.items()
    ]
    picks.append("case when valid then coalesce(__s.p_yaw_u + __f * (__s.yaw_u - __s.p_yaw_u), __s.yaw_u) end as pyaw")
    out = out.selectExpr("*", *picks)
    if rotation:
        out = slerp(
            out,
            [f"if(valid, coalesce(__s.p.{q}, __s.{q}), null)" for q in QUAT],
            [f"__s.{q}" for q in QUAT],
            "__f",
            [f"p{q}" for q in QUAT],
        )
    return out.drop("__s", "__f")


def strict_pose(queries: DataFrame, seg: DataFrame, max_gap_s: float, *, t: str = "t") -> DataFrame:
    """Pose interpolation that names why a query is refused instead of failing."""
    out = pose_at(queries, seg, t=t, max_gap_s=max_gap_s)
    bounds = seg.groupBy(*TRACK).agg(
        F.expr("min(timestamp_s) as b0"), F.expr("max(timestamp_s) as b1")
    )
    return (
        out.join(bounds, TRACK, "left")
        .withColumn(
            "reject_reason",
            F.expr(
                f"case when b0 is null or {t} < b0 or {t} > b1 then 'outside the pose interval'"
                " when not valid then 'pose gap above the limit' end"
            ),
        )
        .drop("b0", "b1")
    )


def trajectory_only_timeline(timeline: DataFrame) -> DataFrame:
    """The timeline with resources explicitly unavailable."""
    return timeline.selectExpr(
        "*",
        "'unavailable' as resource_alignment_mode",
        "cast(null as double) as resource_age_s",
        "cast(null as double) as cpu_percent",
        "cast(null as double) as rss_mib",
        "cast(null as int) as threads",
        "cast(null as bigint) as write_bytes",
        "'standardized-trajectories-fixed-rate-v1' as derivation",
    )
