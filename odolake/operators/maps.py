"""Point-cloud maps: projection, voxels, extents, overlap and nearest points."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import finite, voxel
from ..functions.pose import QUAT, IDENTITY, RigidTransform, rotate, rotation_rows
from .chunks import CHUNK, with_chunk
from .keep import keep
from .quantiles import Stat, column_quantiles, exact_quantiles
from .resample import pose_at
from .tracks import TRACK

# Percentiles and limits of the map diagnostics.
LOW_SHARE, HIGH_SHARE = 0.01, 0.99
Z_SPAN_RATIO_LIMIT = 2.0
VOXEL_IOU_MIN = 0.10
NN_P95_MAX_M = 2.0
BUILD_VOXEL_M = 0.12


def comparison_voxel(build_voxel_m: float) -> float:
    return max(0.5, 4.0 * build_voxel_m)


def finite_points(cloud: DataFrame) -> DataFrame:
    return cloud.where(finite(*(F.col(c).cast("double") for c in "xyz")))


def project(
    points: DataFrame,
    seg: DataFrame,
    *,
    transforms: DataFrame | None = None,
    origin: DataFrame | None = None,
    extrinsic: RigidTransform = IDENTITY,
    max_gap_s: float | None = None,
    time: str = "point_time_s",
    rows: int | None = None,
) -> DataFrame:
    """Points of each track in the aligned display world; invalid rows stay null.

    Per-point pose, extrinsic, alignment and origin are one projection above a
    single as-of lookup.
    """
    posed = pose_at(points, seg, t=time, max_gap_s=max_gap_s, rows=rows)
    if transforms is not None:
        posed = posed.join(transforms.select(*TRACK, "c", "s", "tx", "ty", "tz"), TRACK, "left")
    else:
        posed = posed.selectExpr("*", "1.0D as c", "0.0D as s", "0.0D as tx", "0.0D as ty", "0.0D as tz")
    if origin is not None:
        posed = posed.join(origin.select("run_id", "ox", "oy", "oz"), "run_id", "left")
    else:
        posed = posed.selectExpr("*", "0.0D as ox", "0.0D as oy", "0.0D as oz")
    body = extrinsic.apply([F.col(c).cast("double") for c in "xyz"])
    turned = rotate(rotation_rows([F.col(f"p{q}") for q in QUAT]), body)
    world = [a + F.col(b) for a, b in zip(turned, ("px", "py", "pz"))]
    ok = F.col("valid") & finite(*(F.col(k).cast("double") for k in "xyz")) & finite(time)
    out = posed.select("*", *(w.alias(f"__w{k}") for w, k in zip(world, "xyz")), ok.alias("__ok"))
    return out.selectExpr(
        *points.columns,
        "__ok as valid",
        "case when __ok then c * __wx - s * __wy + tx - ox end as wx",
        "case when __ok then s * __wx + c * __wy + ty - oy end as wy",
        "case when __ok then __wz + tz - oz end as wz",
    )


def voxel_downsample(cloud: DataFrame, keys: list[str], size: float, seq: str = "seq") -> DataFrame:
    """First point (by ``seq``) of every voxel. ``min_by`` combines map-side, so
    a crowded voxel never travels whole."""
    cols = [c for c in cloud.columns if c not in keys]
    return (
        cloud.groupBy(*keys, *(voxel(a, size).alias(f"v{a}") for a in "xyz"))
        .agg(F.min_by(F.struct(*cols), seq).alias("r"))
        .select(*keys, "r.*")
    )


def reconstruct(
    scans: DataFrame, seg: DataFrame, transforms: DataFrame, origin: DataFrame, *, extrinsic=IDENTITY,
    size: float = BUILD_VOXEL_M, max_gap_s: float | None = None,
) -> DataFrame:
    """Map of every track of a run from the same raw scans.

    Scan points are paired with the tracks of their run through the small
    per-track transform table (an equi-join on run_id).
    """
    tracks = transforms.select(*TRACK)
    rows = scans.join(tracks, "run_id")
    world = project(
        rows, seg, transforms=transforms, origin=origin, extrinsic=extrinsic, max_gap_s=max_gap_s
    ).where("valid")
    cloud = world.selectExpr(*TRACK, "seq", "wx as x", "wy as y", "wz as z", "intensity")
    return voxel_downsample(cloud, TRACK, size)


def proportional_poses(scans: DataFrame, n_scans: DataFrame, poses: DataFrame) -> DataFrame:
    """Pose of scan i by proportional index, ignoring time.

    ``scans`` has ``scan_no``; ``poses`` has ``pose_no`` and ``n`` per track.
    """
    sizes = poses.groupBy(*TRACK).agg(F.expr("max(n) as n_poses"))
    want = (
        scans.join(n_scans, "run_id")
        .join(sizes, "run_id")
        .withColumn(
            "pose_no", F.expr("cast(rint(scan_no * (n_poses - 1) / greatest(1, n_scans - 1)) as bigint)")
        )
    )
    return want.join(poses.drop("n"), [*TRACK, "pose_no"])


def map_extents(cloud: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    """Full and P1-P99 extent per axis."""
    rows = finite_points(cloud)
    out = rows.groupBy(*keys).agg(
        F.expr("count(*) as map_points"),
        *(F.expr(f"cast(max({a}) as double) - cast(min({a}) as double) as extent_{a}_m") for a in "xyz"),
    )
    q = column_quantiles(
        rows, keys, {a: [Stat(f"lo_{a}", LOW_SHARE), Stat(f"hi_{a}", HIGH_SHARE)] for a in "xyz"}
    )
    return out.join(q, keys).selectExpr(
        *out.columns, *(f"hi_{a} - lo_{a} as robust_{a}_m" for a in "xyz")
    )


def shared_limits(cloud: DataFrame) -> DataFrame:
    return cloud.groupBy("run_id").agg(
        *(F.expr(f"cast({f}({a}) as double) as {a}_{f}") for a in "xyz" for f in ("min", "max"))
    )


def voxel_iou(cloud: DataFrame, baseline: str, size: float) -> DataFrame:
    """Overlap of each track's voxels with the baseline's, all candidates at once.

    Voxels are made distinct per track (map-side), the baseline's are marked on
    the same (run, voxel) key, and patterns are counted.
    """
    cells = finite_points(cloud).select(*TRACK, *(voxel(a, size).alias(f"v{a}") for a in "xyz")).distinct()
    at = ["run_id", "vx", "vy", "vz"]
    base = cells.where(F.col("algorithm") == baseline).select(*at).withColumn("in_base", F.lit(True))
    marked = cells.join(base, at, "left")
    n_base = base.groupBy("run_id").agg(F.expr("count(*) as base_voxels"))
    return (
        marked.groupBy(*TRACK)
        .agg(F.expr("count(*) as voxels"), F.expr("count(in_base) as shared_voxels"))
        .join(n_base, "run_id", "left")
        .selectExpr(
            *TRACK,
            "voxels",
            "shared_voxels",
            "coalesce(base_voxels, 0L) as base_voxels",
            "if(voxels + coalesce(base_voxels, 0L) - shared_voxels > 0,"
            " shared_voxels / (voxels + coalesce(base_voxels, 0L) - shared_voxels), 1.0D) as baseline_voxel_iou",
        )
    )


# --- nearest neighbours -----------------------------------------------------

BLOCK_POINTS = 512
"""Points of a block: one step compares a block of probes with a block of targets."""
FIRST_BLOCKS = 4
"""Blocks of targets that a block of probes meets before it is known which others can matter."""
ROWS_PER_TASK = 8 * BLOCK_POINTS
Z_BITS = 21
Z_STEPS = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def _bounds(rows: DataFrame) -> tuple:
    return tuple(rows.selectExpr(*(f"{f}({a})" for f in ("min", "max") for a in "xyz")).first())


def _blocks(rows: DataFrame, low: Sequence[float], width: float, name: str) -> DataFrame:
    """Rows with the number of their block of near places, written once.

    A cloud is cut along its Z-order (2 x 21 bits an axis of the clouds' common
    width, then the coordinates), so a crowded spot falls apart into small blocks too.
    """
    cell = "cast(least(greatest(({a} - {low!r}D) / {width!r}D, 0.0D) * {n}, {n} - 1) as bigint)"
    n = 1 << 2 * Z_BITS
    cells = {a: cell.format(a=a, low=v, width=width, n=f"{n}D") for a, v in zip("xyz", low)}
    parts = {f"__{a}1": f"shiftright({c}, {Z_BITS})" for a, c in cells.items()}
    parts |= {f"__{a}2": f"{c} & {(1 << Z_BITS) - 1}L" for a, c in cells.items()}
    rows = rows.withColumns({k: F.expr(e) for k, e in parts.items()})
    for shift, mask in Z_STEPS:
        rows = rows.withColumns({k: F.expr(f"({k} | shiftleft({k}, {shift})) & {mask}L") for k in parts})
    for i in "12":
        rows = rows.withColumn(f"__z{i}0", F.expr(f"__x{i} | shiftleft(__y{i}, 1) | shiftleft(__z{i}, 2)"))
    order = ["__z10", "__z20", "x", "y", "z"]
    rows = with_chunk(rows.drop(*parts), ["cloud"], *order)
    number = F.row_number().over(Window.partitionBy("cloud", CHUNK).orderBy(*order))
    rows = rows.withColumn("block", F.floor((number - 1) / F.lit(BLOCK_POINTS)).cast("bigint"))
    return keep(rows.drop("__z10", "__z20"), name)


def _least_squares(probes: pa.Table, blocks: pa.Table, least: np.ndarray) -> np.ndarray:
    """``least`` (squares) after a block of probes has met ``blocks``, nearest block first.

    Only the probes that a block's bounds can still bring nearer are compared with its places.
    """
    p = np.column_stack([probes[a].to_numpy() for a in "xyz"])
    near = blocks["near"].to_numpy()
    for k in np.argsort(near, kind="stable"):
        if near[k] > least.max():
            break
        places = blocks["places"][int(k)].values
        t = [places.field(a).to_numpy() for a in "xyz"]
        square = 0.0
        for c in range(3):
            gap = np.maximum(np.maximum(p[:, c] - t[c].max(), t[c].min() - p[:, c]), 0.0)
            square = square + gap * gap
        open_ = np.flatnonzero(square < least)
        square = 0.0
        for c in range(3):
            gap = p[open_, c, None] - t[c][None]
            square = square + gap * gap
        if len(open_):
            least[open_] = np.minimum(least[open_], square.min(1))
    return least


def _first_meeting(probes: pa.Table, blocks: pa.Table) -> pa.Table:
    """The probes of one block with the least square to the blocks they meet; without any they drop out."""
    least = _least_squares(probes, blocks, np.full(len(probes), np.inf))
    found = probes.append_column("least", pa.array(least))
    return found if len(blocks) else found.slice(0, 0)


def _last_meeting(probes: pa.Table, blocks: pa.Table) -> pa.Table:
    """The distances of one block's probes after the blocks that are left."""
    least = _least_squares(probes, blocks, probes["least"].to_numpy().copy())
    return probes.select(["id", "cloud"]).append_column("dist_m", pa.array(np.sqrt(least)))


def nearest_distances(probes: DataFrame, targets: DataFrame) -> DataFrame:
    """Exact distance from every probe to the nearest target of its cloud.

    ``probes``: ``probe_id`` columns in a struct ``id``, ``cloud, x, y, z``;
    ``targets``: ``cloud, x, y, z``, distinct. Both are cut into blocks of near
    places with their bounds, and the bounds alone are paired with all others of the
    cloud. A block of probes first meets its FIRST_BLOCKS nearest blocks of targets,
    point by point; the greatest distance left then says which further blocks can
    hold a nearer target, and only those are sent to it.
    """
    ends = [b for b in (_bounds(probes), _bounds(targets)) if b[0] is not None]
    low = [min((b[k] for b in ends), default=0.0) for k in range(3)]
    width = max([max(b[3 + k] for b in ends) - low[k] for k in range(3)] if ends else [0.0]) or 1.0
    box = [F.expr(f"{f}({a}) as {k}{a}") for f, k in (("min", "l"), ("max", "h")) for a in "xyz"]
    key, at = ["cloud", CHUNK, "block"], ["cloud", "c2", "b2"]
    asked = _blocks(probes.select("id", "cloud", "x", "y", "z"), low, width, "probes")
    placed = _blocks(targets.select("cloud", "x", "y", "z"), low, width, "targets")
    placed = keep(placed.groupBy(*key).agg(*box, F.expr("collect_list(struct(x, y, z)) as places")), "target_blocks")
    placed = placed.withColumnsRenamed({CHUNK: "c2", "block": "b2"})
    tasks = max(1, min(10_000, asked.count() // ROWS_PER_TASK))
    # Rows are few before they are paired: the number of tasks is told, not taken from their size.
    own = asked.groupBy(*key).agg(*box)
    other = placed.selectExpr(*at, *(f"{k}{a} as {k}{a}2" for k in "lh" for a in "xyz"))
    gap = {a: f"greatest(l{a} - h{a}2, l{a}2 - h{a}, 0.0D)" for a in "xyz"}
    middle = {a: f"(l{a} + h{a} - l{a}2 - h{a}2)" for a in "xyz"}
    pairs = own.join(other, "cloud").selectExpr(
        *key, "c2", "b2",
        " + ".join(f"pow({gap[a]}, 2)" for a in "xyz") + " as near",
        " + ".join(f"pow({middle[a]}, 2)" for a in "xyz") + " as apart",
    )
    pairs = keep(
        pairs.repartition(tasks, *key).selectExpr(
            *key, "c2", "b2", "near", f"row_number() over (partition by {', '.join(key)} order by near, apart, c2, b2) as place"
        ),
        "block_pairs",
    )
    met = [f"met_{k}" for k in key]

    def meet(rows: DataFrame, wanted: DataFrame, compare, out: T.StructType) -> DataFrame:
        sent = wanted.repartition(tasks, *at).join(placed.select(*at, "places"), at)
        sent = sent.select(*(F.col(k).alias(m) for k, m in zip(key, met)), "near", "places")
        left, right = rows.repartition(tasks, *key).groupBy(*key), sent.repartition(tasks, *met).groupBy(*met)
        return left.cogroup(right).applyInArrow(compare, out)

    rows = asked.select("id", *key, "x", "y", "z")
    least = T.StructType([*rows.schema, T.StructField("least", T.DoubleType())])
    rows = keep(meet(rows, pairs.where(f"place <= {FIRST_BLOCKS}"), _first_meeting, least), "first_met")
    reach = rows.groupBy(*key).agg(F.max("least").alias("reach"))
    further = pairs.where(f"place > {FIRST_BLOCKS}").join(reach, key).where("near < reach")
    out = T.StructType([asked.schema["id"], asked.schema["cloud"], T.StructField("dist_m", T.DoubleType())])
    return meet(rows, further.drop("place", "reach"), _last_meeting, out)


def symmetric_nn(cloud: DataFrame, baseline: str) -> DataFrame:
    """Both directions of nearest distances between each track and the baseline.

    Copies of a place are looked up once and counted. All points are used.
    """
    places = keep(
        finite_points(cloud)
        .selectExpr(*TRACK, *(f"cast({a} as double) as {a}" for a in "xyz"))
        .groupBy(*TRACK, "x", "y", "z")
        .agg(F.expr("count(*) as copies")),
        "places",
    )
    base = places.where(F.col("algorithm") == baseline)
    other = places.where(F.col("algorithm") != baseline)
    pairs = other.select(*TRACK).distinct()
    to_base = other.selectExpr(
        "struct(run_id, algorithm, 0 as side, x as px, y as py, z as pz, copies) as id",
        f"struct(run_id, '{baseline}' as algorithm) as cloud", "x", "y", "z",
    )
    from_base = base.drop("algorithm").join(pairs, "run_id").selectExpr(
        "struct(run_id, algorithm, 1 as side, x as px, y as py, z as pz, copies) as id",
        "struct(run_id, algorithm) as cloud", "x", "y", "z",
    )
    targets = places.selectExpr("struct(run_id, algorithm) as cloud", "x", "y", "z")
    found = nearest_distances(to_base.unionByName(from_base), targets)
    return found.selectExpr("id.run_id", "id.algorithm", "id.side", "id.copies as copies", "dist_m")


def nn_metrics(distances: DataFrame) -> DataFrame:
    agg = distances.groupBy(*TRACK).agg(
        F.expr("sum(dist_m * copies) / sum(copies) as nn_mean_m"),
        F.expr("sqrt(sum(dist_m * dist_m * copies) / sum(copies)) as nn_rmse_m"),
        F.expr("max(dist_m) as nn_max_m"),
        F.expr("sum(if(side = 1, copies, 0L)) as samples_reference"),
        F.expr("sum(if(side = 0, copies, 0L)) as samples_candidate"),
    )
    q = exact_quantiles(distances, TRACK, "dist_m", [Stat("nn_p95_m", 0.95)], weight="copies").drop("n")
    return agg.join(q, TRACK)


# --- health and display policy ----------------------------------------------


def map_health(metrics: DataFrame, baseline: str) -> DataFrame:
    """Baseline-relative flags. ``metrics``: ``robust_z_m, baseline_voxel_iou, nn_p95_m``."""
    base = metrics.where(F.col("algorithm") == baseline).selectExpr("run_id", "robust_z_m as base_z")
    return metrics.join(base, "run_id", "left").selectExpr(
        *metrics.columns,
        "array_compact(array("
        f"if(base_z > 1e-9D and robust_z_m > {Z_SPAN_RATIO_LIMIT}D * base_z, 'excessive_robust_z_span', null),"
        f"if(baseline_voxel_iou < {VOXEL_IOU_MIN}D, 'low_baseline_voxel_iou', null),"
        f"if(nn_p95_m > {NN_P95_MAX_M}D, 'high_symmetric_nn_p95', null))) as map_health_flags",
    ).selectExpr("*", "size(map_health_flags) = 0 as map_health_pass")


def extent_qa(
    extents: DataFrame, baseline: str, *, warn: float, suspect: float, floor: float = 0.0,
    warn_name="warning_extent", suspect_name="suspect_extent",
) -> DataFrame:
    """Extent ratio to the baseline. ``extents``: ``points, ex, ey, ez`` per track
    (``points`` null when there is no map). Maps use 5/10 with no floor;
    trajectories 3/5 with the baseline floored at 5 m per axis."""
    base = extents.where(F.col("algorithm") == baseline).selectExpr(
        "run_id", *(f"greatest(e{a}, {float(floor)!r}D) as b{a}" for a in "xyz"),
        "ex > 0 and ey > 0 and ez > 0 as base_ok" if floor == 0.0 else "ex is not null as base_ok",
    )
    rows = extents.join(base, "run_id", "left").selectExpr(
        *extents.columns,
        "coalesce(base_ok, false) as base_ok",
        "greatest(ex / bx, ey / by, ez / bz) as max_ratio",
    )
    status = (
        "case when points is null then 'map_missing' when points = 0 then 'map_empty'"
        " when not base_ok then 'qa_unavailable_baseline_map'"
        + (f" when algorithm = '{baseline}' then 'ok'" if floor > 0 else "")
        + f" when max_ratio >= {float(suspect)!r}D then '{suspect_name}'"
        f" when max_ratio >= {float(warn)!r}D then '{warn_name}' else 'ok' end as status"
    )
    return rows.selectExpr(
        *extents.columns, "if(points > 0 and base_ok, max_ratio, null) as max_ratio",
        f"algorithm = '{baseline}' as is_baseline", status,
    )


def visibility(map_qa: DataFrame, track_qa: DataFrame, selected: DataFrame, baseline: str) -> DataFrame:
    """Default display policy from both extent checks."""
    rows = (
        map_qa.selectExpr(*TRACK, "status as map_status")
        .join(track_qa.selectExpr(*TRACK, "status as track_status"), TRACK, "left")
        .join(selected.select(*TRACK).distinct().withColumn("chosen", F.lit(True)), TRACK, "left")
    )
    b = f"algorithm = '{baseline}'"
    reason = (
        f"case when not {b} and track_status = 'suspect_trajectory_extent' then 'suspect_trajectory_extent'"
        " when chosen is null then 'filtered'"
        f" when not {b} and map_status = 'suspect_extent' then 'suspect_extent'"
        f" when {b} then 'baseline' else 'nonbaseline_map_hidden' end"
    )
    return rows.selectExpr("*", f"{reason} as reason").selectExpr(
        *TRACK,
        "reason in ('baseline', 'nonbaseline_map_hidden') as algorithm_visible",
        "reason = 'baseline' and map_status <> 'map_missing' as map_visible",
        "reason",
    )
