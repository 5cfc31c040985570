"""Alignment of candidate tracks to the baseline and relative error."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pose import QUAT, rotation_rows
from .chunks import spread
from .keep import keep
from .phases import spread_samples
from .quantiles import Stat, exact_quantiles
from .resample import pose_at
from .tracks import RELATIVE_CLASS, TRACK

# Sample-count rules of the pair resamples, ten a second over the whole common
# range; results of different rules differ and carry the rule's name.
COUNT_RULES = {
    "dashboard": "greatest(2L, cast(ceil((t1 - t0) * 10.0D) as bigint) + 1)",
    "map": "greatest(2L, cast((t1 - t0) * 10.0D as bigint))",
}


def pair_bounds(seg: DataFrame, baseline: str) -> DataFrame:
    """Candidate x baseline of the same run with both time ranges."""
    ends = seg.groupBy(*TRACK).agg(
        F.expr("min(timestamp_s) as c_first"), F.expr("max(timestamp_s) as c_last")
    )
    base = ends.where(F.col("algorithm") == baseline).selectExpr(
        "run_id", "c_first as b_first", "c_last as b_last"
    )
    return ends.join(base, "run_id").selectExpr(
        "*", "greatest(b_first, c_first) as t0", "least(b_last, c_last) as t1"
    )


def pair_transforms(seg: DataFrame, baseline: str, yaw_source: str = "column") -> DataFrame:
    """Initial yaw and translation of every candidate at the common start.

    ``yaw_source`` takes the yaw from the unwrapped column or, with
    ``rotation``, from the slerped rotation. Pairs without overlap drop out.
    """
    pairs = pair_bounds(seg, baseline).where("t1 > t0")
    turn = yaw_source == "rotation"
    cand = pose_at(pairs, seg, t="t0", rotation=turn, clamp_ends=not turn)
    if turn:
        cand = _matrix_yaw(cand)
    cand = keep(
        cand.selectExpr(*pairs.columns, "px as cx", "py as cy", "pz as cz", "pyaw as cyaw"),
        "pair_starts",
    )
    base = seg.where(F.col("algorithm") == baseline).drop("algorithm")
    both = pose_at(cand, base, t="t0", keys=["run_id"], rotation=turn, clamp_ends=not turn)
    if turn:
        both = _matrix_yaw(both)
    return (
        both.selectExpr("*", "pyaw - cyaw as yaw_delta_rad")
        .selectExpr("*", "cos(yaw_delta_rad) as c", "sin(yaw_delta_rad) as s")
        .selectExpr(
            *pairs.columns, "yaw_delta_rad", "c", "s",
            "px - (c * cx - s * cy) as tx", "py - (s * cx + c * cy) as ty", "pz - cz as tz",
        )
    )


def _matrix_yaw(df: DataFrame) -> DataFrame:
    rows = rotation_rows([F.col(f"p{q}") for q in QUAT])
    return df.withColumn("pyaw", F.atan2(rows[1][0], rows[0][0]))


def pair_errors(seg: DataFrame, pairs: DataFrame, baseline: str, rule: str) -> DataFrame:
    """Position error at evenly spaced times of the common range."""
    key = [*TRACK]
    sized = pairs.selectExpr("*", f"{COUNT_RULES[rule]} as samples")
    grid = spread_samples(sized, "samples").selectExpr(
        *key, "i", "samples", "c", "s", "tx", "ty", "tz",
        "if(i = samples - 1, t1, t0 + cast(i as double) * ((t1 - t0) / (samples - 1))) as t",
    )
    cand = keep(
        pose_at(grid, seg, t="t", rotation=False, clamp_ends=True).selectExpr(
            *key, "i", "samples", "t",
            "c * px - s * py + tx as ax", "s * px + c * py + ty as ay", "pz + tz as az",
        ),
        "pair_samples",
    )
    base = seg.where(F.col("algorithm") == baseline).drop("algorithm")
    return pose_at(cand, base, t="t", keys=["run_id"], rotation=False, clamp_ends=True).selectExpr(
        *key, "i", "samples", "t",
        "sqrt(pow(ax - px, 2) + pow(ay - py, 2) + pow(az - pz, 2)) as err",
    )


def error_set(errors: DataFrame, keys: list[str], value: str = "err") -> DataFrame:
    """RMSE, mean, median, maximum and P95 of an error column."""
    agg = errors.groupBy(*keys).agg(
        F.expr("count(*) as samples"),
        F.expr(f"sqrt(avg({value} * {value})) as rmse_m"),
        F.expr(f"avg({value}) as mean_m"),
        F.expr(f"max({value}) as max_m"),
    )
    q = exact_quantiles(errors, keys, value, [Stat("median_m"), Stat("p95_m", 0.95)]).drop("n")
    return agg.join(q, keys, "left")


def relative_error(seg: DataFrame, baseline: str, rule: str = "dashboard") -> DataFrame:
    source = "rotation" if rule == "map" else "column"
    pairs = keep(pair_transforms(seg, baseline, source), "pair_transforms")
    out = error_set(keep(pair_errors(seg, pairs, baseline, rule), "pair_errors"), TRACK)
    return out.withColumn("profile", F.lit(rule)).withColumn("metric_class", F.lit(RELATIVE_CLASS))


def aligned_poses(seg: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every native pose moved into the baseline frame."""
    moves = pairs.select(*TRACK, "c", "s", "tx", "ty", "tz")
    return spread(seg, moves, TRACK, TRACK).selectExpr(
        *TRACK, "timestamp_s",
        "c * x_m - s * y_m + tx as x_m", "s * x_m + c * y_m + ty as y_m", "z_m + tz as z_m",
    )


def display_origin(seg: DataFrame, baseline: str) -> DataFrame:
    """Baseline position at the latest start of all tracks of the run."""
    start = seg.groupBy("run_id").agg(F.expr("max(t_first) as t"))
    base = seg.where(F.col("algorithm") == baseline).drop("algorithm")
    return pose_at(start, base, t="t", keys=["run_id"], rotation=False).selectExpr(
        "run_id", "t as origin_t", "px as ox", "py as oy", "pz as oz"
    )


# --- rigid and similarity fits ----------------------------------------------

AXES = ("x", "y", "z")


def fit_moments(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, means and cross-covariance sums of matched points, in one pass.

    ``pairs`` has ``ex, ey, ez`` (estimate) and ``tx, ty, tz`` (target).
    """
    cross = [
        F.expr(f"covar_pop(e{a}, t{b}) * count(*) as h_{a}{b}") for a in AXES for b in AXES
    ]
    means = [F.expr(f"avg({k}{a}) as m_{k}{a}") for k in "et" for a in AXES]
    size = F.expr("(var_pop(ex) + var_pop(ey) + var_pop(ez)) * count(*) as size_e")
    return pairs.groupBy(*keys).agg(F.expr("count(*) as n"), *means, *cross, size)


FIT_DDL = (
    ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3))
    + ", tx double, ty double, tz double, scale double"
)


def solve_fit(moments: DataFrame, keys: list[str], key_ddl: str, method: str) -> DataFrame:
    """Rotation, translation and scale from the moments: a 3x3 SVD per row.

    Methods: known_transform, translation_only, yaw_translation, SE3, Sim3.
    """
    known = ("known_transform", "translation_only", "yaw_translation", "SE3", "Sim3")
    if method not in known:
        raise ValueError(f"unknown alignment method: {method}")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                e = np.array([row[f"m_e{a}"] for a in AXES])
                t = np.array([row[f"m_t{a}"] for a in AXES])
                h = np.array([[row[f"h_{a}{b}"] for b in AXES] for a in AXES])
                rot, scale, size = np.eye(3), 1.0, 2 if method == "yaw_translation" else 3
                if method in ("yaw_translation", "SE3", "Sim3"):
                    u, s, vt = np.linalg.svd(h[:size, :size])
                    if np.linalg.det(vt.T @ u.T) < 0:
                        vt[-1] *= -1
                    rot[:size, :size] = vt.T @ u.T
                    if method == "Sim3":
                        scale = float(s.sum() / row["size_e"])
                shift = np.zeros(3) if method == "known_transform" else t - scale * rot @ e
                out.append([row[k] for k in keys] + [*rot.ravel(), *shift, scale])
            names = list(keys) + [c.split()[0] for c in FIT_DDL.split(", ")]
            yield pd.DataFrame(out, columns=names)

    return moments.mapInPandas(fit, f"{key_ddl}, {FIT_DDL}")


def apply_fit(pairs: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """Residual of every matched point after its fit (one fit row per key)."""
    f = fits.selectExpr(*keys, "struct(*) as f")
    moved = [
        f"f.scale * (f.r{i}0 * ex + f.r{i}1 * ey + f.r{i}2 * ez) + f.t{a} - t{a}"
        for i, a in enumerate(AXES)
    ]
    return pairs.join(f, keys).selectExpr(
        *keys, "sqrt(" + " + ".join(f"pow({m}, 2)" for m in moved) + ") as err"
    )
