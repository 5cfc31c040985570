"""Phase, alignment, scan-point, map and frame queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.pose import RigidTransform
from ..operators import alignment, frames, maps, phases, points, profile, resample, report
from ..operators.tracks import TRACK
from .inputs import BASELINE
from .oracle import pose_sql, r, rs
from .registry import add
from .shape import tidy

# --- phases -----------------------------------------------------------------

MOTION = ["timestamp_s", "speed_mps", "yaw_rate_rad_s", "curvature_1pm", "distance_to_start_m"]
MOTION_SQL = f"""
    (SELECT *, abs(yaw_rate_rad_s) / greatest(speed_mps, 1e-6) AS curvature_1pm
     FROM (SELECT *, coalesce(sqrt(power(px - lag(px) OVER w, 2) + power(py - lag(py) OVER w, 2)) / greatest(t - lag(t) OVER w, 1e-9), 0e0) AS speed_mps,
                  coalesce((pyaw - lag(pyaw) OVER w) / greatest(t - lag(t) OVER w, 1e-9), 0e0) AS yaw_rate_rad_s,
                  sqrt(power(px - first_value(px) OVER w, 2) + power(py - first_value(py) OVER w, 2)) AS distance_to_start_m, t AS timestamp_s
           FROM {pose_sql('''(SELECT run_id, algorithm, i, CASE WHEN i = n THEN t_last ELSE t_first + i * (1e0 / 10e0) END AS t FROM (
                SELECT *, unnest(generate_series(0, n - 1 + CASE WHEN t_last - (t_first + (n - 1) * (1e0 / 10e0)) > (1e0 / 10e0) * 0.25e0 THEN 1 ELSE 0 END)) AS i
                FROM (SELECT *, greatest(2, CAST(floor((t_last - t_first) / (1e0 / 10e0)) AS BIGINT) + 1) AS n FROM ends WHERE algorithm = 'algo_0')))''', 't')}
           WINDOW w AS (ORDER BY i)))"""
STATE_SQL = f"""
    (SELECT *, CASE WHEN i < a THEN 'PRE_MOTION_STATIC' WHEN i > b THEN 'POST_MOTION_STATIC' WHEN speed_mps < 0.05e0 THEN 'STATIONARY'
                 WHEN abs(yaw_rate_rad_s) > radians(8e0) THEN 'TURN' WHEN curvature_1pm > 0.12e0 THEN 'HIGH_CURVATURE' ELSE 'STRAIGHT' END AS state,
            i BETWEEN a AND b AND distance_to_start_m <= 3e0 AS return_near_start
     FROM {MOTION_SQL} m, (SELECT min(i) AS a, max(i + 19) AS b FROM
        (SELECT i, min(CASE WHEN speed_mps >= 0.05e0 THEN 1 ELSE 0 END) OVER k AS allm, count(*) OVER k AS c FROM {MOTION_SQL}
         WINDOW k AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) WHERE allm = 1 AND c = 20))"""

add(
    "phase_grid",
    lambda i: tidy(i.motion(), *TRACK, "i", *MOTION),
    f"SELECT run_id, algorithm, i, {rs(*MOTION)} FROM {MOTION_SQL}",
)
add(
    "phase_states",
    lambda i: tidy(i.motion(), *TRACK, "i", "state", "return_near_start"),
    f"SELECT run_id, algorithm, i, state, return_near_start FROM {STATE_SQL}",
)
add(
    "phase_segments",
    lambda i: tidy(i.phase_segments(), *TRACK, "seg_no", "state", "i0", "i1", "start_s", "last_s"),
    f"""SELECT run_id, algorithm, seg_no, first(state) AS state, min(i) AS i0, max(i) AS i1, {r('min(timestamp_s)', 'start_s')}, {r('max(timestamp_s)', 'last_s')}
        FROM (SELECT *, CAST(sum(CASE WHEN p IS DISTINCT FROM state THEN 1 ELSE 0 END) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg_no
              FROM (SELECT *, lag(state) OVER (ORDER BY i) AS p FROM {STATE_SQL})) GROUP BY run_id, algorithm, seg_no""",
)
PHASE = ["phase_no", "state", "start_s", "end_s", "duration_s", "return_near_start", "baseline_samples"]
_SPAN = "greatest(1e-1, {0}.l - {0}.s + 1e-1)"
# The merge as a recursion over the list of segments: each step gives the first
# one that is too short a neighbour's state and joins what is alike beside it.
PHASES_SQL = f"""
    (SELECT run_id, algorithm, 'phase_' || lpad(CAST(no AS VARCHAR), 3, '0') AS phase_id, no AS phase_no, x.state AS state, x.s AS start_s,
            CASE WHEN e <= x.s THEN x.s + 1e-1 ELSE e END AS end_s, x.near AS return_near_start, x.i1 - x.i0 + 1 AS baseline_samples
     FROM (SELECT *, coalesce(lead(x.s) OVER (PARTITION BY run_id, algorithm ORDER BY no), x.l) AS e FROM
       (SELECT run_id, algorithm, unnest(segs) AS x, CAST(unnest(range(len(segs))) AS BIGINT) AS no FROM
         (WITH RECURSIVE m AS (
            SELECT run_id, algorithm, list(struct_pack(state := state, i0 := i0, i1 := i1, s := s, l := l, near := near) ORDER BY i0) AS segs FROM
              (SELECT run_id, algorithm, first(state) AS state, min(i) AS i0, max(i) AS i1, min(timestamp_s) AS s, max(timestamp_s) AS l, bool_or(return_near_start) AS near
               FROM (SELECT *, sum(CASE WHEN p IS DISTINCT FROM state THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, algorithm ORDER BY i ROWS UNBOUNDED PRECEDING) AS seg_no
                     FROM (SELECT *, lag(state) OVER (PARTITION BY run_id, algorithm ORDER BY i) AS p FROM {STATE_SQL})) GROUP BY run_id, algorithm, seg_no)
            GROUP BY run_id, algorithm
            UNION ALL
            SELECT run_id, algorithm, segs[:lo - 1] || [struct_pack(state := st, i0 := segs[lo].i0, i1 := segs[hi].i1, s := segs[lo].s, l := segs[hi].l,
                     near := segs[lo].near OR segs[hi].near OR segs[k].near)] || segs[hi + 1:]
            FROM (SELECT *, CASE WHEN k > 1 AND segs[k - 1].state = st THEN k - 1 ELSE k END AS lo, CASE WHEN k < len(segs) AND segs[k + 1].state = st THEN k + 1 ELSE k END AS hi
                  FROM (SELECT *, CASE WHEN k > 1 AND (k = len(segs) OR segs[k - 1].state = segs[k + 1].state
                                            OR {_SPAN.format('segs[k - 1]')} >= {_SPAN.format('segs[k + 1]')}) THEN segs[k - 1].state ELSE segs[k + 1].state END AS st
                        FROM (SELECT *, list_position([{_SPAN.format('y')} < 1.5e0 FOR y IN segs], true) AS k FROM m)
                        WHERE k > 0 AND len(segs) > 1)))
          SELECT *, row_number() OVER (PARTITION BY run_id, algorithm ORDER BY len(segs)) AS o FROM m)
        WHERE o = 1)))"""
add(
    "phase_table",
    lambda i: tidy(i.phases(), "run_id", "phase_id", *PHASE),
    f"""SELECT run_id, phase_id, phase_no, state, {rs('start_s', 'end_s')}, {r('end_s - start_s', 'duration_s')}, return_near_start, baseline_samples
        FROM {PHASES_SQL}""",
)
add(
    "motion_phases",
    lambda i: tidy(phases.motion_phases(i.phases()), "run_id", "phase_id", "state", "start_s", "end_s"),
    f"""SELECT run_id, phase_id, state, {rs('start_s', 'end_s')} FROM {PHASES_SQL}
        WHERE state NOT IN ('PRE_MOTION_STATIC', 'POST_MOTION_STATIC')""",
)

THIRDS_SQL = """(SELECT run_id, 'phase_00' || k AS phase_id, k, a + k * ((b - a) / 3e0) AS start_s,
                        CASE WHEN k = 2 THEN b ELSE a + (k + 1) * ((b - a) / 3e0) END AS end_s
                 FROM (SELECT run_id, t_first AS a, t_last AS b, unnest([0, 1, 2]) AS k FROM ends WHERE algorithm = 'algo_0'))"""
TRANSFORM_SQL = f"""
    (SELECT *, px - (c * cx - s * cy) AS tx, py - (s * cx + c * cy) AS ty, pz - cz AS tz
     FROM (SELECT *, cos(pyaw - cyaw) AS c, sin(pyaw - cyaw) AS s, pyaw - cyaw AS yaw_delta_rad
           FROM {pose_sql("(SELECT run_id, algorithm, c_first, c_last, b_first, b_last, t0, t1, px AS cx, py AS cy, pz AS cz, pyaw AS cyaw FROM " + pose_sql("(SELECT * FROM pair WHERE t1 > t0)", "t0") + ")", "t0", "algo_0")}))"""


def _errors_sql(grid: str) -> str:
    moved = f"""(SELECT * EXCLUDE (px, py, pz, pyaw, f, p_t, s_t, s_qz, s_qw, p_qz, p_qw, seg_algorithm),
                        c * px - s * py + tx AS ax, s * px + c * py + ty AS ay, pz + tz AS az FROM {pose_sql(grid, 't')})"""
    return f"""(SELECT *, sqrt(power(ax - px, 2) + power(ay - py, 2) + power(az - pz, 2)) AS err, az - pz AS zerr
                FROM {pose_sql(moved, 't', 'algo_0')})"""


def _phase_grid_sql(given: str, extra: str = "") -> str:
    return f"""(SELECT *, CASE WHEN i = n - 1 THEN t1 ELSE t0 + i * ((t1 - t0) / (n - 1)) END AS t
     FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i
           FROM (SELECT *, CASE WHEN t1 <= t0 THEN 0 ELSE greatest(2, CAST(floor((t1 - t0) / (1e0 / 10e0)) AS BIGINT) + 1) END AS n
                 FROM (SELECT x.run_id, x.algorithm, p.phase_id, {extra} p.start_s, p.end_s, x.c, x.s, x.tx, x.ty, x.tz,
                              greatest(p.start_s, x.b_first, x.c_first) AS t0, least(p.end_s, x.b_last, x.c_last) AS t1
                       FROM {TRANSFORM_SQL} x JOIN {given} p USING (run_id))) WHERE n > 0))"""


PTM = [
    "coverage_ratio", "max_sample_gap_s", "relative_position_rmse_m", "relative_z_rmse_m", "z_change_m",
    "roll_range_deg", "pitch_range_deg", "relative_position_p95_m",
]


def _phase_metrics_sql(given: str, extra: str = "") -> str:
    """``extra``: a further column of the phases to carry along."""
    carried = f"first({extra}) AS {extra}, " if extra else ""
    grid = _phase_grid_sql(given, f"p.{extra}, " if extra else "")
    return f"""SELECT run_id, algorithm, phase_id, {extra + ', ' if extra else ''}samples, {rs('coverage_ratio')}, {r('gap', 'max_sample_gap_s')}, {rs(*PTM[2:])}
        FROM (SELECT run_id, algorithm, phase_id, {carried}first(n) AS samples, least(1e0, (first(t1) - first(t0)) / greatest(1e-9, first(end_s) - first(start_s))) AS coverage_ratio,
                     sqrt(avg(err * err)) AS relative_position_rmse_m, sqrt(avg(zerr * zerr)) AS relative_z_rmse_m,
                     arg_max(az, i) - arg_min(az, i) AS z_change_m, 0e0 AS roll_range_deg, 0e0 AS pitch_range_deg,
                     quantile_cont(err, 0.95) AS relative_position_p95_m, first(t0) AS a, first(t1) AS b
              FROM {_errors_sql(grid)} GROUP BY run_id, algorithm, phase_id) e
        LEFT JOIN LATERAL (SELECT max(q.timestamp_s - q.p_t) AS gap FROM seg q WHERE q.algorithm = e.algorithm AND q.p_t >= e.a AND q.timestamp_s <= e.b) ON true"""


add(
    "phase_trajectory_metrics",
    lambda i: tidy(
        phases.phase_trajectory_metrics(i.thirds(), i.segments(), i.transforms(), baseline=BASELINE),
        *TRACK, "phase_id", "samples", *PTM,
    ),
    _phase_metrics_sql(THIRDS_SQL),
)
add(
    "phase_report",
    lambda i: tidy(
        phases.phase_trajectory_metrics(
            i.phases().drop("phase_no", "duration_s", "baseline_samples", "return_near_start", "is_last"),
            i.segments(), i.transforms(), baseline=BASELINE,
        ),
        *TRACK, "phase_id", "state", "samples", *PTM,
    ),
    _phase_metrics_sql(PHASES_SQL, "state"),
)


def _assigned(i):
    cols = [*TRACK, "seq", "trajectory_time_s", "cpu_percent", "rss_bytes", "threads"]
    return i.shared("assigned", lambda: phases.assign_phase(i.aligned().select(*cols), i.thirds()))


ASSIGN_SQL = f"""(SELECT a.*, p.phase_id FROM aligned a LEFT JOIN {THIRDS_SQL} p
    ON a.trajectory_time_s >= p.start_s AND (a.trajectory_time_s < p.end_s OR (p.k = 2 AND a.trajectory_time_s <= p.end_s))
    WHERE a.trajectory_time_s IS NOT NULL)"""
add(
    "phase_samples",
    lambda i: tidy(_assigned(i), *TRACK, "seq", "phase_id"),
    f"SELECT run_id, algorithm, seq, phase_id FROM {ASSIGN_SQL}",
)
add(
    "outside_phases",
    lambda i: tidy(phases.outside_phases(_assigned(i))),
    f"SELECT run_id, algorithm, count(*) FILTER (WHERE phase_id IS NULL) AS outside_phase_window_samples FROM {ASSIGN_SQL} GROUP BY run_id, algorithm",
)
PRM = [
    "cpu_mean_percent", "cpu_peak_percent", "rss_start_mib", "rss_end_mib", "rss_growth_mib", "rss_peak_mib",
    "cpu_median_percent", "cpu_p95_percent", "threads_p95",
]


def _phase_resources(i):
    return i.shared(
        "phase_resources",
        lambda: phases.phase_resource_metrics(_assigned(i), i.thirds(), i.tracks().select(*TRACK)),
    )


PRM_SQL = f"""(SELECT run_id, algorithm, phase_id, count(*) AS resource_samples, avg(cpu_percent) AS cpu_mean_percent, max(cpu_percent) AS cpu_peak_percent,
       arg_min(rss_bytes / 1048576e0, {{'a': trajectory_time_s, 'b': seq}}) AS rss_start_mib, arg_max(rss_bytes / 1048576e0, {{'a': trajectory_time_s, 'b': seq}}) AS rss_end_mib,
       max(rss_bytes / 1048576e0) AS rss_peak_mib, max(threads) AS threads_peak, median(cpu_percent) AS cpu_median_percent,
       quantile_cont(cpu_percent, 0.95) AS cpu_p95_percent, quantile_cont(threads::DOUBLE, 0.95) AS threads_p95
       FROM {ASSIGN_SQL} WHERE phase_id IS NOT NULL GROUP BY run_id, algorithm, phase_id)"""
CELLS_SQL = f"(SELECT e.run_id, e.algorithm, p.phase_id FROM ends e JOIN {THIRDS_SQL} p USING (run_id))"
add(
    "phase_resource_metrics",
    lambda i: tidy(_phase_resources(i), *TRACK, "phase_id", "resource_samples", "threads_peak", *PRM),
    f"""SELECT run_id, algorithm, phase_id, coalesce(resource_samples, 0) AS resource_samples, threads_peak,
               {', '.join(r('rss_end_mib - rss_start_mib' if c == 'rss_growth_mib' else c, c) for c in PRM)}
        FROM {CELLS_SQL} LEFT JOIN {PRM_SQL} USING (run_id, algorithm, phase_id)""",
)
IDS = ["phase_000", "phase_001", "phase_002"]
add(
    "phase_metric_matrix",
    lambda i: tidy(
        phases.metric_matrix(_phase_resources(i), "rss_growth_mib", IDS),
        *TRACK, *(f"if(isnan({p}), -1.0D, {p}) as {p}" for p in IDS), "available",
    ),
    f"""SELECT run_id, algorithm, {', '.join(r(f"coalesce(max(g) FILTER (WHERE phase_id = '{p}'), -1e0)", p) for p in IDS)}, count(g) > 0 AS available
        FROM (SELECT run_id, algorithm, phase_id, rss_end_mib - rss_start_mib AS g FROM {CELLS_SQL} LEFT JOIN {PRM_SQL} USING (run_id, algorithm, phase_id))
        GROUP BY run_id, algorithm""",
)

# --- alignment --------------------------------------------------------------

MOVE = ["yaw_delta_rad", "tx", "ty", "tz", "t0", "t1"]
add(
    "pair_alignment",
    lambda i: tidy(i.transforms(), *TRACK, *MOVE),
    f"SELECT run_id, algorithm, {rs(*MOVE)} FROM {TRANSFORM_SQL}",
)


def _slerp_sql(src: str) -> str:
    """Rotation about z: the slerped quaternion (0, 0, z, w) of a pose lookup."""
    dot = "abs(coalesce(p_qz, s_qz) * s_qz + coalesce(p_qw, s_qw) * s_qw)"
    sign = "CASE WHEN coalesce(p_qz, s_qz) * s_qz + coalesce(p_qw, s_qw) * s_qw < 0 THEN -1e0 ELSE 1e0 END"
    return f"""(SELECT * EXCLUDE (lz, lw, th, sg, dt),
        CASE WHEN dt > 0.9995e0 THEN lz / sqrt(lz * lz + lw * lw) ELSE sin((1 - f) * th) / sin(th) * coalesce(p_qz, s_qz) + sin(f * th) / sin(th) * s_qz * sg END AS pqz,
        CASE WHEN dt > 0.9995e0 THEN lw / sqrt(lz * lz + lw * lw) ELSE sin((1 - f) * th) / sin(th) * coalesce(p_qw, s_qw) + sin(f * th) / sin(th) * s_qw * sg END AS pqw
        FROM (SELECT *, acos(least(1e0, dt)) AS th, coalesce(p_qz, s_qz) + f * (s_qz * sg - coalesce(p_qz, s_qz)) AS lz, coalesce(p_qw, s_qw) + f * (s_qw * sg - coalesce(p_qw, s_qw)) AS lw
              FROM (SELECT *, least(1e0, {dot}) AS dt, {sign} AS sg FROM {src})))"""


YAW_OF = "atan2(2 * (pqz * pqw), 1 - 2 * (pqz * pqz))"
ROT_SQL = f"""
    (SELECT *, px - (c * cx - s * cy) AS tx, py - (s * cx + c * cy) AS ty, pz - cz AS tz
     FROM (SELECT *, cos(yaw_delta_rad) AS c, sin(yaw_delta_rad) AS s FROM
       (SELECT *, {YAW_OF} - cyaw AS yaw_delta_rad FROM {_slerp_sql(pose_sql("(SELECT run_id, algorithm, t0, t1, px AS cx, py AS cy, pz AS cz, " + YAW_OF + " AS cyaw FROM " + _slerp_sql(pose_sql("(SELECT * FROM pair WHERE t1 > t0)", "t0")) + ")", "t0", "algo_0"))})))"""
add(
    "pair_alignment_rotation",
    lambda i: tidy(
        alignment.pair_transforms(i.segments(), BASELINE, "rotation"), *TRACK,
        "sin(yaw_delta_rad) as sin_yaw", "cos(yaw_delta_rad) as cos_yaw", "tx", "ty", "tz",
    ),
    f"SELECT run_id, algorithm, {r('s', 'sin_yaw')}, {r('c', 'cos_yaw')}, {rs('tx', 'ty', 'tz')} FROM {ROT_SQL}",
)


def _pair_grid(transform: str, n: str) -> str:
    return f"""(SELECT *, CASE WHEN i = n - 1 THEN t1 ELSE t0 + i * ((t1 - t0) / (n - 1)) END AS t
     FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i
           FROM (SELECT run_id, algorithm, c, s, tx, ty, tz, t0, t1, {n} AS n FROM {transform})))"""


ERR = ["rmse_m", "mean_m", "median_m", "p95_m", "max_m"]
ERR_SQL = f"""count(*) AS samples, {r('sqrt(avg(err * err))', 'rmse_m')}, {r('avg(err)', 'mean_m')}, {r('median(err)', 'median_m')},
              {r('quantile_cont(err, 0.95)', 'p95_m')}, {r('max(err)', 'max_m')}"""
DASH_ERR = _errors_sql(_pair_grid(TRANSFORM_SQL, "greatest(2, CAST(ceil((t1 - t0) * 10e0) AS BIGINT) + 1)"))
add(
    "relative_error",
    lambda i: tidy(i.relative(), *TRACK, "samples", *ERR, "profile"),
    f"SELECT run_id, algorithm, {ERR_SQL}, 'dashboard' AS profile FROM {DASH_ERR} GROUP BY run_id, algorithm",
)
add(
    "relative_error_map",
    lambda i: tidy(alignment.relative_error(i.segments(), BASELINE, "map"), *TRACK, "samples", *ERR, "profile"),
    f"""SELECT run_id, algorithm, {ERR_SQL}, 'map' AS profile
        FROM {_errors_sql(_pair_grid(ROT_SQL, "greatest(2, CAST(trunc((t1 - t0) * 10e0) AS BIGINT))"))} GROUP BY run_id, algorithm""",
)


def _matched(i):
    """Two point sets per label: the first three and the next three components."""
    e = "cast(embedding[{}] as double)"
    return i.table("embeddings").selectExpr(
        "concat('algo_', label) as algorithm",
        *(f"{e.format(k)} as e{a}" for k, a in enumerate("xyz")),
        *(f"{e.format(k)} * 2.0D + {e.format(k + 3)} * 0.1D + {k}.5D as t{a}" for k, a in enumerate("xyz")),
    )


MATCH_SQL = "(SELECT 'algo_' || label AS algorithm, " + ", ".join(
    f"embedding[{k + 1}]::DOUBLE AS e{a}, embedding[{k + 1}]::DOUBLE * 2e0 + embedding[{k + 4}]::DOUBLE * 1e-1 + {k}.5e0 AS t{a}"
    for k, a in enumerate("xyz")
) + " FROM embeddings)"
MOMENTS = [f"h_{a}{b}" for a in "xyz" for b in "xyz"] + [f"m_{k}{a}" for k in "et" for a in "xyz"] + ["size_e"]
add(
    "fit_moments",
    lambda i: tidy(alignment.fit_moments(_matched(i), ["algorithm"]), "algorithm", "n", *MOMENTS),
    "SELECT algorithm, count(*) AS n, "
    + ", ".join(r(f"covar_pop(e{a}, t{b}) * count(*)", f"h_{a}{b}") for a in "xyz" for b in "xyz")
    + ", " + ", ".join(r(f"avg({k}{a})", f"m_{k}{a}") for k in "et" for a in "xyz")
    + ", " + r("(var_pop(ex) + var_pop(ey) + var_pop(ez)) * count(*)", "size_e")
    + f" FROM {MATCH_SQL} GROUP BY algorithm",
)


def _fit(i, method):
    m = alignment.fit_moments(_matched(i), ["algorithm"])
    fits = alignment.solve_fit(m, ["algorithm"], "algorithm string", method)
    err = alignment.apply_fit(_matched(i), fits, ["algorithm"])
    return tidy(alignment.error_set(err, ["algorithm"]), "algorithm", "samples", *ERR)


_AXES = "xyz"
_CELLS = [f"{a}{b}" for a in _AXES for b in _AXES]


def _cofactor(a: str, b: str) -> str:
    """Cofactor of the cell (a, b) of the matrix with the columns q_xx ... q_zz."""
    (i, j), (k, m) = ([_AXES[(_AXES.index(v) + d) % 3] for d in (1, 2)] for v in (a, b))
    return f"(q_{i}{k} * q_{j}{m} - q_{i}{m} * q_{j}{k})"


def _fit_sql(method: str) -> str:
    """The fits by closed form (yaw) or by Newton's iteration to the orthogonal part of the cross-covariance."""
    moments = (
        "SELECT algorithm, "
        + ", ".join(f"covar_pop(e{a}, t{b}) * count(*) AS h_{a}{b}" for a in _AXES for b in _AXES)
        + ", " + ", ".join(f"avg({k}{a}) AS m_{k}{a}" for k in "et" for a in _AXES)
        + f", (var_pop(ex) + var_pop(ey) + var_pop(ez)) * count(*) AS size_e FROM {MATCH_SQL} GROUP BY algorithm"
    )
    if method == "yaw_translation":
        norm = "sqrt(power(h_xx + h_yy, 2) + power(h_xy - h_yx, 2))"
        cos, sin = f"(h_xx + h_yy) / {norm}", f"(h_xy - h_yx) / {norm}"
        cells = dict.fromkeys(_CELLS, "0e0") | {"xx": cos, "xy": f"-({sin})", "yx": sin, "yy": cos, "zz": "1e0"}
        turned = "SELECT *, " + ", ".join(f"{v} AS q_{c}" for c, v in cells.items()) + " FROM m"
    else:
        norm = "sqrt(" + " + ".join(f"power(h_{c}, 2)" for c in _CELLS) + ")"
        det = "(" + " + ".join(f"q_x{b} * {_cofactor('x', b)}" for b in _AXES) + ")"
        turned = (
            "SELECT m.*, " + ", ".join(f"q_{c}" for c in _CELLS) + " FROM m JOIN (SELECT * FROM polar WHERE step = 40) USING (algorithm)"
        )
        moments += f"""), polar AS (
            SELECT algorithm, 0 AS step, {', '.join(f'h_{b}{a} / {norm} AS q_{a}{b}' for a in _AXES for b in _AXES)} FROM m
            UNION ALL SELECT algorithm, step + 1, {', '.join(f'(q_{a}{b} + {_cofactor(a, b)} / {det}) / 2e0' for a in _AXES for b in _AXES)}
            FROM polar WHERE step < 40"""
    scale = "1e0"
    if method == "Sim3":
        scale = "(" + " + ".join(f"q_{a}{b} * h_{b}{a}" for a in _AXES for b in _AXES) + ") / size_e"
    moved = [
        "(k * (" + " + ".join(f"q_{a}{b} * (p.e{b} - m_e{b})" for b in _AXES) + f") + m_t{a} - p.t{a})" for a in _AXES
    ]
    return f"""WITH RECURSIVE m AS ({moments}), turned AS (SELECT *, {scale} AS k FROM ({turned}))
        SELECT algorithm, {ERR_SQL} FROM (SELECT p.algorithm, sqrt({' + '.join(f'power({v}, 2)' for v in moved)}) AS err
        FROM {MATCH_SQL} p JOIN turned USING (algorithm)) GROUP BY algorithm"""


for _method, _name in (("SE3", "se3"), ("Sim3", "sim3"), ("yaw_translation", "yaw")):
    add(f"rigid_fit_{_name}", lambda i, m=_method: _fit(i, m), _fit_sql(_method))
add(
    "position_error_set",
    lambda i: _fit(i, "translation_only"),
    f"""SELECT algorithm, {ERR_SQL} FROM (SELECT algorithm, sqrt(power(ex - tx - avg(ex - tx) OVER w, 2) + power(ey - ty - avg(ey - ty) OVER w, 2)
            + power(ez - tz - avg(ez - tz) OVER w, 2)) AS err FROM {MATCH_SQL} WINDOW w AS (PARTITION BY algorithm)) GROUP BY algorithm""",
)

# --- poses at query times ---------------------------------------------------

add(
    "slerp_pose",
    lambda i: tidy(
        resample.pose_at(
            i.timeline().selectExpr(*TRACK, "i", "timestamp_s + 0.033D as t"), i.segments(), t="t"
        ).where("valid"),
        *TRACK, "i", "px", "py", "pz", "pqz", "pqw",
    ),
    f"SELECT run_id, algorithm, i, {rs('px', 'py', 'pz', 'pqz', 'pqw')} FROM "
    + _slerp_sql(pose_sql("(SELECT run_id, algorithm, i, timestamp_s + 0.033e0 AS t FROM grid)", "t"))
    + " WHERE p_t IS NOT NULL OR t = s_t",
)
add(
    "strict_pose",
    lambda i: tidy(
        resample.strict_pose(
            i.timeline().selectExpr(*TRACK, "i", "timestamp_s + 0.033D as t"), i.segments(), 0.5, t="t"
        ),
        *TRACK, "i", "valid", "reject_reason",
    ),
    f"""SELECT run_id, algorithm, i, reject_reason IS NULL AS valid, reject_reason FROM
        (SELECT g.run_id, g.algorithm, g.i, CASE WHEN s.timestamp_s IS NULL OR (s.p_t IS NULL AND g.t < s.timestamp_s) THEN 'outside the pose interval'
                WHEN s.timestamp_s - s.p_t > 0.5e0 AND abs(g.t - s.timestamp_s) > 1e-12 AND abs(g.t - s.p_t) > 1e-12 THEN 'pose gap above the limit' END AS reject_reason
         FROM (SELECT *, timestamp_s + 0.033e0 AS t FROM grid) g
         ASOF LEFT JOIN seg s ON s.algorithm = g.algorithm AND s.timestamp_s >= g.t)""",
)
ORIGIN_SQL = f"""(SELECT run_id, t AS origin_t, px AS ox, py AS oy, pz AS oz FROM {pose_sql('(SELECT run_id, max(t_first) AS t FROM ends GROUP BY run_id)', 't', 'algo_0')})"""
add(
    "display_origin",
    lambda i: tidy(alignment.display_origin(i.segments(), BASELINE)),
    f"SELECT run_id, {rs('origin_t', 'ox', 'oy', 'oz')} FROM {ORIGIN_SQL}",
)
EXTRINSIC = RigidTransform((0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0), (0.1, 0.2, 0.3))
SCAN_SQL = """(SELECT run_id, message_id * 1000 + ordinal AS seq, x, y, z, raw_intensity AS intensity, header_s + offset_ns * 1e-9 AS point_time_s FROM points)"""
_POSED = _slerp_sql(
    pose_sql(f"(SELECT p.*, x.algorithm, x.c, x.s, x.tx, x.ty, x.tz FROM {SCAN_SQL} p JOIN {TRANSFORM_SQL} x USING (run_id))", "point_time_s")
)
WORLD_SQL = f"""(SELECT *, c * wx0 - s * wy0 + tx - ox AS wx, s * wx0 + c * wy0 + ty - oy AS wy, wz0 + tz - oz AS wz
   FROM (SELECT q.*, (1 - 2 * pqz * pqz) * (-y + 0.1e0) - 2 * pqz * pqw * (x + 0.2e0) + px AS wx0,
                2 * pqz * pqw * (-y + 0.1e0) + (1 - 2 * pqz * pqz) * (x + 0.2e0) + py AS wy0, z + 0.3e0 + pz AS wz0
         FROM (SELECT * REPLACE (x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z) FROM {_POSED} WHERE p_t IS NOT NULL OR point_time_s = s_t) q)
   JOIN {ORIGIN_SQL} USING (run_id))"""


def _world(i, gap=None):
    rows = i.scan_points().join(i.transforms().select(*TRACK), "run_id")
    return maps.project(
        rows, i.segments(), transforms=i.transforms(),
        origin=alignment.display_origin(i.segments(), BASELINE), extrinsic=EXTRINSIC, max_gap_s=gap,
    )


add(
    "project_points",
    lambda i: tidy(_world(i).where("valid"), *TRACK, "seq", "wx", "wy", "wz"),
    f"SELECT run_id, algorithm, seq, {rs('wx', 'wy', 'wz')} FROM {WORLD_SQL}",
)
add(
    "reconstruct_map",
    lambda i: tidy(
        maps.reconstruct(
            i.scan_points(), i.segments(), i.transforms(), alignment.display_origin(i.segments(), BASELINE),
            extrinsic=EXTRINSIC, size=0.5,
        ),
        *TRACK, "seq", "x", "y", "z", "intensity",
    ),
    f"""SELECT run_id, algorithm, seq, {r('wx', 'x')}, {r('wy', 'y')}, {r('wz', 'z')}, {r('intensity', 'intensity')}
        FROM (SELECT *, row_number() OVER (PARTITION BY run_id, algorithm, floor(wx / 0.5e0), floor(wy / 0.5e0), floor(wz / 0.5e0) ORDER BY seq) AS k FROM {WORLD_SQL}) WHERE k = 1""",
)


def _proportional(i):
    poses = points.positions(
        i.raw().selectExpr(*TRACK, "arrival_seq", "x_m"), TRACK, "arrival_seq"
    ).selectExpr(*TRACK, "pos as pose_no", "n", "x_m")
    scans = i.points().groupBy("run_id", "message_id").agg(F.expr("count(*) as pts")).selectExpr(
        "run_id", "message_id as scan_no", "pts"
    )
    count = scans.groupBy("run_id").agg(F.expr("count(*) as n_scans"))
    return maps.proportional_poses(scans, count, poses)


add(
    "proportional_poses",
    lambda i: tidy(_proportional(i), *TRACK, "scan_no", "pose_no", "x_m"),
    f"""SELECT p.run_id, p.algorithm, s.message_id AS scan_no, p.pose_no, {r('p.x_m', 'x_m')}
        FROM (SELECT run_id, algorithm, x_m, row_number() OVER w - 1 AS pose_no, count(*) OVER (PARTITION BY run_id, algorithm) AS n FROM raw
              WINDOW w AS (PARTITION BY run_id, algorithm ORDER BY arrival_seq)) p
        JOIN (SELECT DISTINCT message_id, (SELECT count(DISTINCT message_id) FROM points) AS m FROM points) s
          ON p.pose_no = CAST(round_even(s.message_id * (p.n - 1) / greatest(1, s.m - 1), 0) AS BIGINT)""",
)
add(
    "track_positions_aligned",
    lambda i: tidy(alignment.aligned_poses(i.segments(), i.transforms())),
    f"""SELECT a.run_id, a.algorithm, {r('a.timestamp_s', 'timestamp_s')}, {r('c * x_m - s * y_m + tx', 'x_m')}, {r('s * x_m + c * y_m + ty', 'y_m')}, {r('z_m + tz', 'z_m')}
        FROM seg a JOIN {TRANSFORM_SQL} x USING (run_id, algorithm)""",
)

# --- scan points ------------------------------------------------------------

add(
    "point_filters",
    lambda i: tidy(points.with_validity(points.in_range(i.points(), 1.0, 5.0)), "vec_id", "tag_ok", "xyz_ok"),
    """SELECT vec_id, (tag & 48) IN (0, 16) AS tag_ok, true AS xyz_ok FROM points
       WHERE sqrt(power(x::DOUBLE, 2) + power(y::DOUBLE, 2) + power(z::DOUBLE, 2)) BETWEEN 1e0 AND 5e0""",
)
add(
    "point_time_units",
    lambda i: tidy(points.relative_seconds(i.points(), "offset_ns", "ns", "absolute"), "vec_id", "time_s"),
    f"SELECT vec_id, {r('offset_ns::DOUBLE * 1e-9 - min(offset_ns::DOUBLE * 1e-9) OVER (PARTITION BY message_id)', 'time_s')} FROM points",
)
add(
    "guessed_point_time",
    lambda i: tidy(
        points.guessed_point_time(
            i.points().selectExpr("*", "cast(offset_ns as double) * case message_id % 3 when 0 then 1e-9D when 1 then 1.0D else 1e6D end as t"), "t"
        ),
        "vec_id", "point_time_s",
    ),
    f"""SELECT vec_id, {r('CASE WHEN top > 1e12 THEN t * 1e-9 WHEN top > 1e6 THEN header_s + t * 1e-9 ELSE header_s + t END', 'point_time_s')}
        FROM (SELECT *, max(t) OVER (PARTITION BY message_id) AS top FROM
          (SELECT *, offset_ns::DOUBLE * CASE message_id % 3 WHEN 0 THEN 1e-9 WHEN 1 THEN 1e0 ELSE 1e6 END AS t FROM points))""",
)
VALID = "FROM points WHERE (tag & 48) IN (0, 16)"
CONVERT_SQL = f"""(SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY offset_ns, ordinal) - 1 AS pos,
                   CAST(CAST(offset_ns AS FLOAT) * CAST(1e-9 AS FLOAT) AS FLOAT) AS time {VALID})"""
add(
    "point_conversion",
    lambda i: tidy(points.convert(i.points()), "message_id", "pos", "ordinal", "ring", "intensity", "time"),
    f"SELECT message_id, pos, ordinal, line AS ring, reflectivity::DOUBLE AS intensity, {r('time::DOUBLE', 'time')} FROM {CONVERT_SQL}",
)
add(
    "adapter_validation",
    lambda i: tidy(points.validation_totals(i.points())),
    f"""SELECT run_id, count(*) AS input_points, count(*) FILTER (WHERE ok) AS output_points, count(*) FILTER (WHERE NOT ok) AS invalid_tag_points,
               0 AS non_finite_points, count(*) FILTER (WHERE offset_ns < p) AS input_time_backtracks, min(line) FILTER (WHERE ok) AS ring_min,
               max(line) FILTER (WHERE ok) AS ring_max, count(DISTINCT message_id) AS frames,
               (SELECT count(*) FILTER (WHERE time < q) FROM (SELECT time, lag(time) OVER (PARTITION BY message_id ORDER BY pos) AS q FROM {CONVERT_SQL})) AS output_time_backtracks,
               (SELECT {r('min(time)::DOUBLE')} FROM {CONVERT_SQL}) AS time_min_s, (SELECT {r('max(time)::DOUBLE')} FROM {CONVERT_SQL}) AS time_max_s,
               count(*) FILTER (WHERE NOT ok) AS dropped_points, {r('count(*) FILTER (WHERE NOT ok) / count(*)', 'dropped_ratio')}
        FROM (SELECT *, (tag & 48) IN (0, 16) AS ok, lag(offset_ns) OVER (PARTITION BY message_id ORDER BY ordinal) AS p FROM points) GROUP BY run_id""",
)
add(
    "ring_counts",
    lambda i: tidy(points.ring_counts(i.points())),
    f"SELECT run_id, line, count(*) AS points {VALID} GROUP BY run_id, line",
)
add(
    "point_offsets",
    lambda i: tidy(
        points.to_offsets(
            i.points().selectExpr(
                "*", "1700000000000000000L + message_id * 100000000L + offset_ns - if(message_id % 5 = 0, offset_ns, 0L) as point_ns", "raw_intensity as intensity",
            )
        ),
        "message_id", "ordinal", "offset_ns", "reflectivity",
    ),
    """SELECT message_id, ordinal, ns - first_ns AS offset_ns, CAST(least(greatest(round_even(raw_intensity, 0), 0e0), 255e0) AS BIGINT) AS reflectivity
       FROM (SELECT *, first_value(ns) OVER (PARTITION BY message_id ORDER BY ordinal) AS first_ns, min(ns) OVER (PARTITION BY message_id) AS low
             FROM (SELECT *, offset_ns - CASE WHEN message_id % 5 = 0 THEN offset_ns ELSE 0 END AS ns FROM points)) WHERE low >= first_ns""",
)
add(
    "imu_scale",
    lambda i: tidy(
        points.scale_imu(
            i.points().selectExpr(
                "vec_id", "cast(x as double) as ax", "cast(y as double) as ay", "cast(z as double) as az",
                "if(vec_id % 3 = 0, array(0.0D, 0.0D), array(raw_intensity, 1.0D)) as acc_cov", "if(vec_id % 2 = 0, 'g', 'm/s^2') as unit",
            )
        ),
        "vec_id", "ax_si", "ay_si", "az_si", "acc_cov_si[0] as c0", "acc_cov_si[1] as c1",
    ),
    f"""SELECT vec_id, {', '.join(r(f'x{a}::DOUBLE * k'.replace('x' + a, a), f'a{a}_si') for a in 'xyz')},
               {r('CASE WHEN vec_id % 3 = 0 THEN 0e0 ELSE raw_intensity * k * k END', 'c0')}, {r('CASE WHEN vec_id % 3 = 0 THEN 0e0 ELSE k * k END', 'c1')}
        FROM (SELECT *, CASE WHEN vec_id % 2 = 0 THEN 9.80665e0 ELSE 1e0 END AS k FROM points)""",
)
NORM = "sqrt(power(x::DOUBLE, 2) + power(y::DOUBLE, 2) + power(z::DOUBLE, 2))"
add(
    "imu_norm_stats",
    lambda i: tidy(
        profile.series_stats(
            i.points().selectExpr("run_id", "sqrt(pow(cast(x as double), 2) + pow(cast(y as double), 2) + pow(cast(z as double), 2)) as norm"),
            ["run_id"], {"norm": "norm"},
        )
    ),
    f"""SELECT run_id, count(*) AS norm_count, {r(f'avg({NORM})', 'norm_mean')}, {r(f'stddev_pop({NORM})', 'norm_std')}, {r(f'min({NORM})', 'norm_min')},
               {r(f'max({NORM})', 'norm_max')}, {r(f'median({NORM})', 'norm_median')} FROM points GROUP BY run_id""",
)
add(
    "point_time_profile",
    lambda i: tidy(profile.point_time_profile(i.points())),
    f"""SELECT run_id, count(*) AS frame_range_count, {r('avg(g)', 'frame_range_mean')}, {r('stddev_pop(g)', 'frame_range_std')}, {r('min(g)', 'frame_range_min')},
               {r('max(g)', 'frame_range_max')}, {r('median(g)', 'frame_range_median')}, CAST(sum(b) AS BIGINT) AS input_order_time_backtracks,
               (SELECT string_agg(line || ':' || n, ';' ORDER BY line) FROM (SELECT line, count(*) AS n FROM points GROUP BY line)) AS line_counts
        FROM (SELECT run_id, message_id, (max(offset_ns) - min(offset_ns)) * 1e-9 AS g, count(*) FILTER (WHERE offset_ns < p) AS b
              FROM (SELECT *, lag(offset_ns) OVER (PARTITION BY message_id ORDER BY ordinal) AS p FROM points) GROUP BY ALL) GROUP BY run_id""",
)


def _layout(i):
    scans = i.points().select("run_id", "message_id").distinct()
    fields = scans.selectExpr(
        "run_id", "message_id",
        "inline(array(struct('x' as name, 0 as offset, 7 as datatype), struct('y' as name, 4 as offset, 7 as datatype),"
        " struct('z' as name, if(message_id % 7 = 0, 9, 8) as offset, 7 as datatype)))",
    )
    want = i.spark.createDataFrame([("x", 0, 7), ("y", 4, 7), ("z", 8, 7)], "name string, offset int, datatype int")
    return points.incompatible_layouts(fields, want)


add(
    "point_layouts",
    lambda i: tidy(_layout(i)),
    "SELECT DISTINCT run_id, message_id, 2 AS found FROM points WHERE message_id % 7 = 0",
)


def _scans(i):
    stamps = i.points().groupBy("run_id", "message_id").agg(F.expr("min(header_s) as header_s"))
    placed = points.frame_positions(stamps, ("run_id",))
    return points.read_scans(
        i.points().drop("header_s"), placed, scan_step=2, point_step=3, stop_after_s=31.5, low=0.5, high=6.0
    )


add(
    "read_scans",
    lambda i: tidy(_scans(i), "message_id", "ordinal", "point_time_s"),
    f"""SELECT message_id, ordinal, {r('header_s + offset_ns::DOUBLE * 1e-9', 'point_time_s')} FROM points
        WHERE message_id % 2 = 0 AND ordinal % 3 = 0 AND header_s <= 31.5e0 AND {NORM} BETWEEN 0.5e0 AND 6e0""",
)

# --- maps -------------------------------------------------------------------

VOX = "floor(x / {0}), floor(y / {0}), floor(z / {0})"
add(
    "voxel_downsample",
    lambda i: tidy(maps.voxel_downsample(i.cloud(), TRACK, 2.0), *TRACK, "seq", "x", "y", "z", "intensity"),
    f"""SELECT run_id, algorithm, seq, {rs('x', 'y', 'z', 'intensity')} FROM
        (SELECT *, row_number() OVER (PARTITION BY algorithm, {VOX.format('2e0')} ORDER BY seq) AS k FROM cloud) WHERE k = 1""",
)
CELL = "(SELECT DISTINCT run_id, algorithm, floor(x / 2e0) AS a, floor(y / 2e0) AS b, floor(z / 2e0) AS c FROM cloud)"
IOU_SQL = f"""(SELECT v.run_id, v.algorithm, count(*) AS voxels, count(b.run_id) AS shared_voxels, (SELECT count(*) FROM {CELL} WHERE algorithm = 'algo_0') AS base_voxels
     FROM {CELL} v LEFT JOIN {CELL} b ON b.algorithm = 'algo_0' AND v.a = b.a AND v.b = b.b AND v.c = b.c GROUP BY v.run_id, v.algorithm)"""
IOU = "shared_voxels / (voxels + base_voxels - shared_voxels)"
add(
    "voxel_iou",
    lambda i: tidy(maps.voxel_iou(i.cloud(), BASELINE, 2.0)),
    f"SELECT run_id, algorithm, voxels, shared_voxels, base_voxels, {r(IOU, 'baseline_voxel_iou')} FROM {IOU_SQL}",
)
EXT_SQL = "(SELECT run_id, algorithm, count(*) AS map_points, " + ", ".join(
    f"max({a}) - min({a}) AS extent_{a}_m, quantile_cont({a}, 0.99) - quantile_cont({a}, 0.01) AS robust_{a}_m" for a in "xyz"
) + " FROM cloud GROUP BY run_id, algorithm)"
EXT = [f"{k}_{a}_m" for k in ("extent", "robust") for a in "xyz"]
add(
    "robust_extent",
    lambda i: tidy(i.map_metrics(), *TRACK, "map_points", *EXT),
    f"SELECT run_id, algorithm, map_points, {rs(*EXT)} FROM {EXT_SQL}",
)
NN_SQL = """(SELECT c.run_id, c.algorithm, side, (SELECT sqrt(min(power(t.x - c.x, 2) + power(t.y - c.y, 2) + power(t.z - c.z, 2))) FROM cloud t WHERE t.algorithm = c.target) AS d
   FROM (SELECT run_id, algorithm, 'algo_0' AS target, 0 AS side, x, y, z FROM cloud WHERE algorithm <> 'algo_0'
         UNION ALL SELECT b.run_id, o.algorithm, o.algorithm, 1, b.x, b.y, b.z FROM cloud b JOIN (SELECT DISTINCT algorithm FROM cloud WHERE algorithm <> 'algo_0') o ON b.algorithm = 'algo_0') c)"""
add(
    "symmetric_nn",
    lambda i: tidy(maps.nn_metrics(i.nn())),
    f"""SELECT run_id, algorithm, {r('avg(d)', 'nn_mean_m')}, {r('sqrt(avg(d * d))', 'nn_rmse_m')}, {r('max(d)', 'nn_max_m')},
               count(*) FILTER (WHERE side = 1) AS samples_reference, count(*) FILTER (WHERE side = 0) AS samples_candidate, {r('quantile_cont(d, 0.95)', 'nn_p95_m')}
        FROM {NN_SQL} GROUP BY run_id, algorithm""",
)
HEALTH_SQL = f"""(SELECT *, concat_ws(';', CASE WHEN bz > 1e-9 AND robust_z_m > 2e0 * bz THEN 'excessive_robust_z_span' END,
        CASE WHEN iou < 0.1e0 THEN 'low_baseline_voxel_iou' END, CASE WHEN nn > 2e0 THEN 'high_symmetric_nn_p95' END) AS map_health_flags
   FROM (SELECT e.*, {IOU} AS iou, n.nn, (SELECT robust_z_m FROM {EXT_SQL} WHERE algorithm = 'algo_0') AS bz
         FROM {EXT_SQL} e JOIN {IOU_SQL} USING (run_id, algorithm)
         LEFT JOIN (SELECT run_id, algorithm, quantile_cont(d, 0.95) AS nn FROM {NN_SQL} GROUP BY ALL) n USING (run_id, algorithm)))"""
add(
    "map_health",
    lambda i: tidy(i.map_metrics(), *TRACK, "map_health_flags", "map_health_pass", "baseline_voxel_iou", "nn_p95_m"),
    f"SELECT run_id, algorithm, map_health_flags, map_health_flags = '' AS map_health_pass, {r('iou', 'baseline_voxel_iou')}, {r('nn', 'nn_p95_m')} FROM {HEALTH_SQL}",
)
add(
    "map_sets",
    lambda i: report.map_sets(i.health(), i.map_metrics(), BASELINE),
    f"""SELECT h.run_id, h.algorithm, (health_valid AND coalesce(m.map_health_flags = '', true)) OR h.algorithm = 'algo_0' AS in_primary, true AS in_all
        FROM health h LEFT JOIN {HEALTH_SQL} m USING (run_id, algorithm)""",
)


def _map_extents(i):
    rows = i.map_metrics().selectExpr(
        *TRACK, "map_points as points", *(f"extent_{a}_m * if(algorithm = 'algo_7', 12.0D, if(algorithm = 'algo_5', 6.0D, 1.0D)) as e{a}" for a in "xyz")
    )
    return maps.extent_qa(rows, BASELINE, warn=5.0, suspect=10.0)


def _track_extents(i):
    moved = alignment.aligned_poses(i.segments(), i.transforms())
    rows = moved.groupBy(*TRACK).agg(
        F.expr("count(*) as points"), *(F.expr(f"max({a}_m) - min({a}_m) as e{a}") for a in "xyz")
    )
    return maps.extent_qa(
        rows, BASELINE, warn=1.5, suspect=3.0, floor=5.0,
        warn_name="warning_trajectory_extent", suspect_name="suspect_trajectory_extent",
    )


MAP_QA_SQL = f"""(SELECT *, CASE WHEN algorithm = 'algo_0' THEN 'ok' WHEN max_ratio >= 10 THEN 'suspect_extent' WHEN max_ratio >= 5 THEN 'warning_extent' ELSE 'ok' END AS status
   FROM (SELECT e.run_id, e.algorithm, e.map_points AS points, e.algorithm = 'algo_0' AS is_baseline,
                greatest(e.extent_x_m * k / b.extent_x_m, e.extent_y_m * k / b.extent_y_m, e.extent_z_m * k / b.extent_z_m) AS max_ratio
         FROM (SELECT *, CASE algorithm WHEN 'algo_7' THEN 12e0 WHEN 'algo_5' THEN 6e0 ELSE 1e0 END AS k FROM {EXT_SQL}) e
         JOIN {EXT_SQL} b ON b.algorithm = 'algo_0'))"""
TRACK_EXT = f"""(SELECT a.run_id, a.algorithm, count(*) AS points, max(c * x_m - s * y_m + tx) - min(c * x_m - s * y_m + tx) AS ex,
      max(s * x_m + c * y_m + ty) - min(s * x_m + c * y_m + ty) AS ey, max(z_m + tz) - min(z_m + tz) AS ez
      FROM seg a JOIN {TRANSFORM_SQL} x USING (run_id, algorithm) GROUP BY a.run_id, a.algorithm)"""
TRACK_QA_SQL = f"""(SELECT *, CASE WHEN is_baseline THEN 'ok' WHEN max_ratio >= 3 THEN 'suspect_trajectory_extent' WHEN max_ratio >= 1.5 THEN 'warning_trajectory_extent' ELSE 'ok' END AS status
   FROM (SELECT e.run_id, e.algorithm, e.points, e.algorithm = 'algo_0' AS is_baseline,
                greatest(e.ex / greatest(b.ex, 5e0), e.ey / greatest(b.ey, 5e0), e.ez / greatest(b.ez, 5e0)) AS max_ratio
         FROM {TRACK_EXT} e JOIN {TRACK_EXT} b ON b.algorithm = 'algo_0'))"""
QA = ["points", "max_ratio", "is_baseline", "status"]
add(
    "map_extent_qa",
    lambda i: tidy(_map_extents(i), *TRACK, *QA),
    f"SELECT run_id, algorithm, points, {r('max_ratio', 'max_ratio')}, is_baseline, status FROM {MAP_QA_SQL}",
)
add(
    "track_extent_qa",
    lambda i: tidy(_track_extents(i), *TRACK, *QA),
    f"SELECT run_id, algorithm, points, {r('max_ratio', 'max_ratio')}, is_baseline, status FROM {TRACK_QA_SQL}",
)
add(
    "visibility_policy",
    lambda i: maps.visibility(
        _map_extents(i), _track_extents(i), i.runs().where("algorithm <> 'algo_9'"), BASELINE
    ),
    f"""SELECT run_id, algorithm, reason IN ('baseline', 'nonbaseline_map_hidden') AS algorithm_visible, reason = 'baseline' AS map_visible, reason
        FROM (SELECT m.run_id, m.algorithm, CASE WHEN NOT m.is_baseline AND t.status = 'suspect_trajectory_extent' THEN 'suspect_trajectory_extent' WHEN m.algorithm = 'algo_9' THEN 'filtered'
                WHEN NOT m.is_baseline AND m.status = 'suspect_extent' THEN 'suspect_extent' WHEN m.is_baseline THEN 'baseline' ELSE 'nonbaseline_map_hidden' END AS reason
              FROM {MAP_QA_SQL} m LEFT JOIN {TRACK_QA_SQL} t USING (run_id, algorithm))""",
)
add(
    "shared_limits",
    lambda i: tidy(maps.shared_limits(i.cloud())),
    "SELECT run_id, " + ", ".join(r(f"{f}({a})", f"{a}_{f}") for a in "xyz" for f in ("min", "max")) + " FROM cloud GROUP BY run_id",
)
POS_SQL = "(SELECT *, row_number() OVER (PARTITION BY algorithm ORDER BY seq) - 1 AS pos, count(*) OVER (PARTITION BY algorithm) AS n FROM cloud)"
add(
    "linspace_sample",
    lambda i: tidy(points.linspace_sample(points.positions(i.cloud(), TRACK, "seq"), 17), *TRACK, "seq"),
    f"""SELECT p.run_id, p.algorithm, p.seq FROM {POS_SQL} p
        WHERE n <= 17 OR pos = n - 1 OR pos IN (SELECT CAST(floor(k * ((p.n - 1) / 16e0)) AS BIGINT) FROM range(0, 16) t(k))""",
)
add(
    "lod_strides",
    lambda i: tidy(points.lod_clouds(points.positions(i.cloud(), TRACK, "seq"), "pos", (2, 4, 12)), *TRACK, "seq", "lod"),
    f"""SELECT run_id, algorithm, seq, lod FROM {POS_SQL} JOIN (VALUES ('dense', 2), ('medium', 4), ('sparse', 12)) l(lod, step) ON pos % step = 0""",
)
add(
    "display_stride",
    lambda i: tidy(points.display_stride(points.positions(i.cloud(), TRACK, "seq"), 10), *TRACK, "seq"),
    f"SELECT run_id, algorithm, seq FROM {POS_SQL} WHERE pos % greatest(1, n // 10) = 0",
)

# --- frames -----------------------------------------------------------------


def _bag_frames(i):
    return i.frames().selectExpr("run_id", "message_id", "recorded_timestamp_s * 1e-4D as bag_time_s")


FRAMES_SQL = "(SELECT run_id, message_id, recorded_timestamp_s * 1e-4 AS t FROM frames)"
add(
    "frame_selection",
    lambda i: tidy(frames.select_frames(_bag_frames(i), i.windows(), 3.0)),
    f"""SELECT DISTINCT g.run_id, f.message_id, {r('f.t', 'bag_time_s')}
        FROM (SELECT run_id, unnest([start_s, 0.5e0 * (start_s + end_s), end_s]) AS g FROM windows
              UNION SELECT run_id, a + k * 3e0 FROM (SELECT run_id, a, unnest(generate_series(0, CAST(floor((b + 1e-9 - a) / 3e0) AS BIGINT))) AS k
                    FROM (SELECT run_id, min(t) AS a, max(t) AS b FROM {FRAMES_SQL} GROUP BY run_id))
              UNION SELECT run_id, max(t) FROM {FRAMES_SQL} GROUP BY run_id) g,
        LATERAL (SELECT message_id, t FROM {FRAMES_SQL} ORDER BY abs(t - g.g), t LIMIT 1) f""",
)
def _transforms(i):
    """Three transforms a message, of which the second or third may be the first that is accepted."""
    return i.table("events").selectExpr(
        "'run_0' as run_id", "event_id as message_id",
        "transform(sequence(0, 2), k -> named_struct('parent', element_at(array('map', 'world', 'odom', 'tool'), cast((event_id + k) % 4 + 1 as int)),"
        " 'child', element_at(array('base_link', 'lidar', 'camera'), cast((event_id * 2 + k * k) % 3 + 1 as int)), 'x', value + k)) as transforms",
    )


add(
    "first_transforms",
    lambda i: tidy(
        profile.first_transform(_transforms(i), ("map", "odom"), ("base_link", "lidar")),
        "run_id", "message_id", "transform.parent as parent", "transform.child as child", "transform.x as x",
    ),
    f"""SELECT run_id, message_id, parent, child, {r('x', 'x')} FROM
        (SELECT 'run_0' AS run_id, event_id AS message_id, k, ['map', 'world', 'odom', 'tool'][CAST((event_id + k) % 4 + 1 AS INT)] AS parent,
                ['base_link', 'lidar', 'camera'][CAST((event_id * 2 + k * k) % 3 + 1 AS INT)] AS child, value + k AS x
         FROM events, range(3) t(k)) WHERE parent IN ('map', 'odom') AND child IN ('base_link', 'lidar')
        QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY k) = 1""",
)


def _cases(i):
    return frames.case_frames(
        i.windows().selectExpr(
            "run_id", "window_id", "start_s", "end_s", "if(window_no % 2 = 0, center_s, null) as center_s",
            "if(window_no % 3 = 0, null, view_start_s) as view_start_s", "view_end_s",
        ),
        _bag_frames(i),
    )


CASES_SQL = f"""SELECT w.run_id, w.window_id, f.message_id, {r('w.target', 'target_s')}
        FROM (SELECT *, CASE WHEN window_no % 2 = 0 THEN center_s WHEN window_no % 3 <> 0 THEN 0.5e0 * (view_start_s + view_end_s) ELSE 0.5e0 * (start_s + end_s) END AS target FROM windows) w,
        LATERAL (SELECT message_id, t FROM {FRAMES_SQL} ORDER BY abs(t - w.target), t LIMIT 1) f"""
add("case_frames", lambda i: tidy(_cases(i), "run_id", "window_id", "message_id", "target_s"), CASES_SQL)
add(
    "frames_of_cases",
    lambda i: tidy(frames.frames_of_cases(_cases(i))),
    f"SELECT run_id, message_id, count(*) AS cases FROM ({CASES_SQL}) GROUP BY run_id, message_id",
)
add(
    "window_midpoints",
    lambda i: tidy(
        frames.window_midpoints(
            i.windows().selectExpr("window_id", "start_s", "if(window_no % 4 = 0, start_s - 1.0D, end_s) as end_s")
        ),
        "window_id", "seek_ns", "reject_reason",
    ),
    """SELECT window_id, CASE WHEN window_no % 4 <> 0 THEN CAST(floor((start_s + end_s) * 0.5e0 * 1000000000e0 + 0.5e0) AS BIGINT) END AS seek_ns,
              CASE WHEN window_no % 4 = 0 THEN 'invalid window time range' END AS reject_reason FROM windows""",
)
