"""Log, health, report and artifact queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs, points, profile, report
from ..operators.tracks import TRACK
from .inputs import BASELINE
from .map_queries import DASH_ERR, EXT_SQL, HEALTH_SQL
from .oracle import r, rs
from .registry import add
from .shape import tidy

# --- logs -------------------------------------------------------------------

add(
    "log_findings",
    lambda i: tidy(i.findings(), *TRACK, "source", "part", "line", "severity", "description", "text"),
    "SELECT run_id, algorithm, source, part, line, severity, description, text FROM found",
)
add(
    "log_groups",
    lambda i: tidy(
        logs.finding_groups(i.findings()), *TRACK, "severity", "source", "description", "findings", "first_line",
        "array_join(transform(examples, e -> concat(e.line, ':', e.part)), ';') as examples",
    ),
    """SELECT run_id, algorithm, severity, source, description, count(*) AS findings, min(line) AS first_line,
              string_agg(CASE WHEN k <= 6 THEN line || ':' || part END, ';' ORDER BY line, part) AS examples
       FROM (SELECT *, row_number() OVER (PARTITION BY run_id, algorithm, severity, source, description ORDER BY line, part) AS k FROM found)
       GROUP BY run_id, algorithm, severity, source, description""",
)


def _categories(i):
    return i.shared("categories", lambda: report.categories(i.runs(), logs.severity_by_track(i.findings())))


add(
    "log_anomalies",
    lambda i: tidy(logs.serious(logs.finding_groups(i.findings()), _categories(i))),
    """SELECT run_id, algorithm, category, severity, source, description, count(*) AS findings
       FROM found JOIN category USING (run_id, algorithm) WHERE severity IN ('CRITICAL', 'HIGH') GROUP BY ALL
       UNION ALL
       SELECT run_id, algorithm, category, 'CRITICAL', '', 'algorithm run crashed', 0 FROM category
       WHERE category = 'RUNTIME_CRASH' AND algorithm NOT IN (SELECT algorithm FROM found WHERE severity IN ('CRITICAL', 'HIGH'))""",
)
add(
    "run_category",
    lambda i: tidy(_categories(i), *TRACK, "category", "consistency_issues"),
    """SELECT run_id, algorithm, category, concat_ws(';',
              CASE WHEN status = 'SUCCESS' AND reason IS NOT NULL THEN 'reason_on_success' END,
              CASE WHEN status = 'SUCCESS' AND exit_code NOT IN (0, -15) THEN 'exit_code=' || exit_code END) AS consistency_issues FROM category""",
)
add(
    "category_counts",
    lambda i: tidy(report.category_counts(_categories(i))),
    "SELECT run_id, category, count(*) AS algorithms FROM category GROUP BY ALL",
)
add(
    "run_classification",
    lambda i: tidy(
        logs.classify_run(
            i.table("documents").selectExpr(
                "doc_id",
                "concat(text, if(doc_id % 17 = 0, ' Out of Memory', ''), if(doc_id % 19 = 0, ' timestamp invalid', '')) as log",
                "if(doc_id % 5 = 0, 1, 0) as exit_code", "doc_id % 7 as odometry_count",
            )
        ),
        "doc_id", "run_class",
    ),
    """SELECT doc_id, CASE WHEN contains(t, 'out of memory') OR contains(t, 'bad_alloc') THEN 'OUT_OF_MEMORY'
              WHEN contains(t, 'time sync') OR (contains(t, 'timestamp') AND contains(t, 'invalid')) THEN 'TIME_SYNC_FAILED'
              WHEN doc_id % 5 = 0 THEN 'RUNTIME_CRASH' WHEN doc_id % 7 = 0 THEN 'NO_ODOMETRY' ELSE 'SUCCESS' END AS run_class
       FROM (SELECT doc_id, lower(text || CASE WHEN doc_id % 17 = 0 THEN ' Out of Memory' ELSE '' END || CASE WHEN doc_id % 19 = 0 THEN ' timestamp invalid' ELSE '' END) AS t FROM documents)""",
)
add(
    "resource_time_reports",
    lambda i: tidy(
        logs.resource_time(
            i.table("documents").selectExpr(
                "doc_id",
                "concat(text, '\\n\\tElapsed (wall clock) time (h:mm:ss or m:ss): ', doc_id % 60, ':07 \\n\\tMaximum resident set size (kbytes): ', n_chars * 3) as text",
            )
        ),
        "doc_id", "max_rss_kb", "elapsed_wall",
    ),
    "SELECT doc_id, n_chars * 3 AS max_rss_kb, (doc_id % 60) || ':07' AS elapsed_wall FROM documents",
)

# --- health and report ------------------------------------------------------

add(
    "nominal_path_divergence",
    lambda i: tidy(
        i.health(), *TRACK, "status", "duration_s", "path_length_m", "nominal_path_m", "minimum_s", "health_flags", "health_valid", "selection_eligible",
    ),
    f"SELECT run_id, algorithm, status, {rs('duration_s', 'path_length_m', 'nominal_path_m', 'minimum_s')}, health_flags, health_valid,"
    " (status IS NULL OR status = 'SUCCESS') AND health_flags = '' AS selection_eligible FROM health",
)
add(
    "stable_tracks",
    lambda i: tidy(report.stable_tracks(i.health(), BASELINE)),
    """SELECT run_id, algorithm, algorithm = 'algo_0' OR health_valid AS stable, CASE WHEN algorithm = 'algo_0' OR health_valid THEN ''
              ELSE concat_ws(';', CASE WHEN status <> 'SUCCESS' THEN 'status:' || status END, nullif(health_flags, '')) END AS reasons FROM health""",
)
add(
    "labelled_tracks",
    lambda i: tidy(report.labelled(i.health(), report.registry(i.spark)), *TRACK, "label"),
    "SELECT run_id, algorithm, algorithm || CASE WHEN health_valid THEN '' ELSE ' [health-fail]' END AS label FROM health",
)
add(
    "run_state",
    lambda i: report.run_state(i.runs()),
    "SELECT run_id, CASE WHEN bool_or(status <> 'SUCCESS') THEN 'failed' ELSE 'completed' END AS run_state FROM runs GROUP BY run_id",
)
REL_SQL = f"(SELECT run_id, algorithm, sqrt(avg(err * err)) AS rmse_m, quantile_cont(err, 0.95) AS p95_m FROM {DASH_ERR} GROUP BY run_id, algorithm)"
RES_SQL = "(SELECT run_id, algorithm, avg(cpu_percent) AS mean_cpu_percent, max(rss_bytes) / 1048576e0 AS peak_rss_mib FROM samples GROUP BY run_id, algorithm)"
JMP_SQL = """(SELECT run_id, algorithm, count(*) FILTER (WHERE position_jump) AS position_jump_count, count(*) FILTER (WHERE yaw_jump) AS yaw_jump_count,
      max(position_step_m) AS max_position_step_m, max(yaw_step_deg) AS max_yaw_step_deg FROM flagged GROUP BY run_id, algorithm)"""
REPORT_SQL = f"""(SELECT h.run_id, h.algorithm, h.run_group, h.status, CASE WHEN health_valid THEN 'normal' ELSE health_flags END AS trajectory_health,
      CASE WHEN m.algorithm IS NULL THEN 'N/A' WHEN m.map_health_flags = '' THEN 'normal' ELSE m.map_health_flags END AS map_health,
      health_valid AND coalesce(m.map_health_flags = '', true) AS recommendation_eligible,
      CASE WHEN h.algorithm = 'algo_0' THEN 0e0 ELSE e.rmse_m END AS relative_rmse_m, CASE WHEN h.algorithm = 'algo_0' THEN 0e0 ELSE e.p95_m END AS relative_p95_m,
      p.duration_s, p.path_length_m, p.z_range_m, mean_cpu_percent, peak_rss_mib, m.map_points, m.robust_z_m AS robust_z_span_m, m.iou AS baseline_voxel_iou,
      m.nn AS symmetric_nn_p95_m, position_jump_count, yaw_jump_count, max_position_step_m, max_yaw_step_deg, health_valid, m.algorithm IS NOT NULL AS map_available,
      m.map_health_flags = '' AS map_health_pass
   FROM health h LEFT JOIN path p USING (run_id, algorithm) LEFT JOIN {RES_SQL} USING (run_id, algorithm) LEFT JOIN {REL_SQL} e USING (run_id, algorithm)
   LEFT JOIN {HEALTH_SQL} m USING (run_id, algorithm) LEFT JOIN {JMP_SQL} USING (run_id, algorithm))"""
NUM = [
    "relative_rmse_m", "relative_p95_m", "duration_s", "path_length_m", "z_range_m", "mean_cpu_percent", "peak_rss_mib",
    "robust_z_span_m", "baseline_voxel_iou", "symmetric_nn_p95_m", "max_position_step_m", "max_yaw_step_deg",
]
FLAT = ["status", "trajectory_health", "map_health", "recommendation_eligible", "map_points", "position_jump_count", "yaw_jump_count"]
add(
    "comparison_report",
    lambda i: tidy(i.report(), *TRACK, *FLAT, *NUM),
    f"SELECT run_id, algorithm, {', '.join(FLAT)}, {rs(*NUM)} FROM {REPORT_SQL}",
)
add(
    "best_algorithm",
    lambda i: tidy(report.best_algorithms(i.report(), BASELINE)),
    "SELECT run_id, "
    + ", ".join(
        f"(list_sort(list({{'v': {f}, 'a': algorithm}}) FILTER (WHERE recommendation_eligible AND {f} IS NOT NULL{x}))[1]).a AS {n}"
        for n, f, x in (
            ("closest_to_baseline", "relative_rmse_m", " AND algorithm <> 'algo_0'"),
            ("lowest_z_range", "z_range_m", ""),
            ("lowest_mean_cpu", "mean_cpu_percent", ""),
            ("lowest_peak_rss", "peak_rss_mib", ""),
        )
    )
    + f" FROM {REPORT_SQL} GROUP BY run_id",
)


def _names(ok: str, name: str) -> str:
    return f"coalesce(string_agg(algorithm, ';' ORDER BY algorithm) FILTER (WHERE {ok}), '') AS {name}"


add(
    "recommendations",
    lambda i: report.recommendations(i.report(), i.runs().select(*TRACK, "run_group")),
    "SELECT run_id, "
    + ", ".join(
        (
            _names("health_valid", "health_valid_algorithms"),
            _names("health_valid AND map_available AND map_health_pass", "map_consistent_algorithms"),
            _names("recommendation_eligible AND run_group = 'full_slam'", "full_slam_candidates"),
            _names("NOT recommendation_eligible", "not_recommended_this_run"),
        )
    )
    + f" FROM {REPORT_SQL} GROUP BY run_id",
)
add(
    "comparison_groups",
    lambda i: report.comparison_groups(i.runs()),
    "SELECT run_id, run_group, string_agg(algorithm, ';' ORDER BY algorithm) AS algorithms FROM runs GROUP BY ALL",
)
add(
    "metric_name_guard",
    lambda i: tidy(
        report.metric_name_guard(
            i.report().selectExpr(
                *TRACK, "inline(array(struct('relative_rmse_m' as metric, relative_rmse_m as value), "
                " struct('z_range_m' as metric, z_range_m as value), struct('frame_rate_hz' as metric, duration_s as value)))",
            ),
            False,
        ),
        *TRACK, "metric",
    ),
    "SELECT run_id, algorithm, unnest(['relative_rmse_m', 'frame_rate_hz']) AS metric FROM runs",
)


def _gnu(i):
    return i.runs().selectExpr(*TRACK, "messages * 100 as max_rss_kb")


SUMMARY = ["path_length_m", "z_range_m", "mean_cpu_percent", "peak_rss_mib", "relative_rmse_m", "relative_p95_m"]
add(
    "metric_summary",
    lambda i: tidy(
        report.metric_summary(
            i.health(), i.path(), i.resource_summary().where("algorithm <> 'algo_4'"), _gnu(i), i.relative(), BASELINE
        )
    ),
    f"""SELECT h.run_id, h.algorithm, h.status, health_flags, {r('p.path_length_m', 'path_length_m')}, {r('z_range_m', 'z_range_m')}, {r('mean_cpu_percent', 'mean_cpu_percent')},
               {r('coalesce(peak_rss_mib, messages * 100 / 1024e0)', 'peak_rss_mib')}, {r("CASE WHEN h.algorithm = 'algo_0' THEN 0e0 ELSE rmse_m END", 'relative_rmse_m')},
               {r("CASE WHEN h.algorithm = 'algo_0' THEN 0e0 ELSE p95_m END", 'relative_p95_m')}
        FROM health h LEFT JOIN path p USING (run_id, algorithm) LEFT JOIN {RES_SQL} q ON q.algorithm = h.algorithm AND q.algorithm <> 'algo_4'
        LEFT JOIN runs USING (run_id, algorithm) LEFT JOIN {REL_SQL} e USING (run_id, algorithm)""",
)
BUNDLE = ["path_length_m", "z_range_m", "mean_cpu_percent", "peak_rss_mib", "relative_rmse_m", "relative_p95_m"]
add(
    "bundle_summary",
    lambda i: tidy(report.bundle_summary(i.report())),
    f"""SELECT run_id, algorithm, status, health_valid AS trajectory_health_pass, recommendation_eligible, {rs(*BUNDLE)},
               position_jump_count, yaw_jump_count FROM {REPORT_SQL}""",
)
add(
    "map_items",
    lambda i: tidy(
        report.map_items(
            # Each algorithm is a run of its own here; three of them have enhanced rows.
            i.map_metrics().where("algorithm < 'algo_3'").selectExpr("algorithm as run_id", "algorithm", "map_points"),
            i.map_metrics().selectExpr("algorithm as run_id", "algorithm", "map_points"),
        )
    ),
    f"SELECT algorithm AS run_id, algorithm, map_points, CASE WHEN algorithm < 'algo_3' THEN 'enhanced' ELSE 'legacy' END AS map_source FROM {EXT_SQL}",
)
add(
    "run_overlay",
    lambda i: tidy(
        report.overlay(
            i.jump_summary().selectExpr(*TRACK, "event_count", "concat('/data/', run_id, '/', algorithm) as path"),
            i.jump_summary().selectExpr(
                "'run_1' as run_id", "algorithm", "samples as event_count", "concat('/data/run_1/', algorithm) as path"
            ),
            "algo_3", "run_2", ["path"],
        )
    ),
    """SELECT 'run_2' AS run_id, algorithm, CASE WHEN algorithm = 'algo_3' THEN samples ELSE event_count END AS event_count, '/data/run_2/' || algorithm AS path,
              CASE WHEN algorithm = 'algo_3' THEN 'run_1' ELSE 'run_0' END AS source_run, CASE WHEN algorithm = 'algo_3' THEN 'override' ELSE 'preserved' END AS composition
       FROM (SELECT algorithm, count(*) AS samples, count(*) FILTER (WHERE position_jump) + count(*) FILTER (WHERE yaw_jump) AS event_count FROM flagged GROUP BY algorithm)""",
)
add(
    "report_order",
    lambda i: tidy(report.report_order(i.runs().where("pos % 2 = 1"), i.tracks().select(*TRACK))),
    "SELECT run_id, algorithm, a AS pos FROM runs WHERE a % 2 = 1",
)
add(
    "missing_algorithms",
    lambda i: report.missing_algorithms(i.runs(), i.windows()),
    "SELECT run_id, algorithm FROM runs WHERE algorithm NOT IN (SELECT algorithm FROM windows)",
)
add(
    "output_dirs",
    lambda i: report.output_dirs(i.runs()).select(*TRACK, "effective_dir"),
    """SELECT run_id, algorithm, CASE WHEN a = 2 THEN 'attempt_2' WHEN a % 2 = 0 THEN 'out/' || a ELSE run_id || '/raw/' || algorithm END AS effective_dir FROM runs""",
)
add(
    "reproducibility",
    lambda i: report.reproducibility(
        i.runs().selectExpr(
            *TRACK, "'abc' as benchmark_commit", "if(pos = 1, '', 'f00') as dataset_sha256", "messages > 0 as has_provenance",
            "true as has_calibration", "messages as source_artifacts",
        )
    ),
    """SELECT run_id, true AS benchmark_commit_recorded, bool_and(a <> 1) AS dataset_sha256_recorded, bool_and(messages > 0) AS algorithm_provenance_recorded,
              true AS calibration_disclosed, bool_and(messages > 0) AS core_source_artifacts_hashed FROM runs GROUP BY run_id""",
)
add(
    "input_contract",
    lambda i: profile.input_contract(
        points.validation_totals(i.points()),
        i.messages().select("run_id", "topic", "type").distinct(),
        i.messages().where("topic in ('/click', '/view')").select("run_id", "topic").distinct().selectExpr(
            "run_id", "topic", "if(topic = '/click', 'lidar', 'imu') as kind", "if(topic = '/click', 'CustomMsg', 'Imu2') as type",
            "'g' as unit", "'offset_time/uint32/ns/relative_to_header' as time_contract",
        ),
    ),
    """SELECT 'run_0' AS run_id, unnest(['topic:lidar', 'topic:imu', 'imu_acceleration_unit', 'point_time_contract', 'point_time_validation']) AS "check",
              unnest([true, false, true, true, true]) AS ok""",
)

# --- artifacts --------------------------------------------------------------


def _artifacts(i):
    return i.table("documents").selectExpr(
        "'run_0' as run_id", "concat('docs/', source, '/', doc_id, '.txt') as path",
        "sha2(cast(text as binary), 256) as sha256", "cast(octet_length(text) as bigint) as size_bytes", "doc_id",
    )


ART_SQL = "(SELECT 'run_0' AS run_id, 'docs/' || source || '/' || doc_id || '.txt' AS path, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, doc_id FROM documents)"
add(
    "artifact_hashes",
    lambda i: tidy(_artifacts(i).drop("doc_id")),
    f"SELECT run_id, path, sha256, size_bytes FROM {ART_SQL}",
)
add(
    "artifact_verify",
    lambda i: tidy(
        report.verify_artifacts(
            _artifacts(i).where("doc_id % 11 <> 0").selectExpr("run_id", "path", "if(doc_id % 13 = 0, 'x', sha256) as sha256", "size_bytes"),
            _artifacts(i).where("doc_id % 7 <> 0"),
        ),
        "run_id", "path", "verdict",
    ),
    f"""SELECT run_id, path, CASE WHEN doc_id % 11 = 0 THEN 'unregistered' WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 13 = 0 THEN 'changed' ELSE 'ok' END AS verdict
        FROM {ART_SQL} WHERE NOT (doc_id % 11 = 0 AND doc_id % 7 = 0)""",
)
add(
    "source_plan",
    lambda i: report.source_plan(
        _artifacts(i).selectExpr("run_id", "path", "doc_id % 2 = 0 as required"), _artifacts(i).where("doc_id % 5 <> 0")
    ),
    f"""SELECT run_id, path, doc_id % 2 = 0 AS required, doc_id % 5 <> 0 AS present,
               CASE WHEN doc_id % 5 <> 0 THEN 'use' WHEN doc_id % 2 = 0 THEN 'missing_required' ELSE 'omitted_optional' END AS decision FROM {ART_SQL}""",
)
