"""Health rules, categories, report assembly and selections over small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..functions.text import claims_truth
from .quantiles import Stat, exact_quantiles
from .tracks import RELATIVE_CLASS, TRACK

# Label, group and mode of the known algorithms.
REGISTRY = (
    ("kiss_icp", "KISS-ICP", "lidar_only_odometry", "odometry"),
    ("mola_lo", "MOLA-LO", "lidar_only_odometry", "odometry"),
    ("mola_lio", "MOLA-LIO", "lidar_imu_odometry", "odometry"),
    ("fast_livo2", "FAST-LIVO2", "lidar_imu_odometry", "odometry"),
    ("point_lio", "Point-LIO", "lidar_imu_odometry", "odometry"),
    ("dlio", "DLIO", "lidar_imu_odometry", "odometry"),
    ("glim_odometry", "GLIM odometry", "lidar_imu_odometry", "odometry"),
    ("glim_full_slam", "GLIM full SLAM", "full_slam", "full_slam"),
    ("lio_sam_no_loop", "LIO-SAM (loop off)", "full_slam", "full_slam"),
    ("lio_sam_loop", "LIO-SAM (loop on)", "full_slam", "full_slam"),
)
SMOKE_MARGIN_S = 5.0
FULL_COVERAGE = 0.98


def registry(spark) -> DataFrame:
    return spark.createDataFrame(REGISTRY, "algorithm string, label string, taxonomy string, mode string")


def labelled(rows: DataFrame, dimension: DataFrame) -> DataFrame:
    """Label from a registry, with a mark on unhealthy tracks. The join is left to the planner, which knows its size."""
    return rows.join(dimension.select("algorithm", "label"), "algorithm", "left").withColumn(
        "label",
        F.expr("concat(coalesce(label, algorithm), if(health_valid, '', ' [health-fail]'))"),
    )


def nominal_path(metrics: DataFrame) -> DataFrame:
    """Upper median of the plausible path lengths of a run."""
    ok = metrics.where(finite("path_length_m")).where("path_length_m between 0 and 1000")
    return exact_quantiles(ok, ["run_id"], "path_length_m", [Stat("nominal_path_m", upper=True)]).drop("n")


def health_flags(metrics: DataFrame, runs: DataFrame, manifest_duration_s: float | None) -> DataFrame:
    """Short-track and divergence flags, status flag, validity and reasons.

    ``metrics``: ``duration_s, path_length_m``; ``runs``: ``status,
    smoke_duration_s, limit_s``.
    """
    full = "cast(null as double)" if manifest_duration_s is None else f"{float(manifest_duration_s)!r}D"
    rows = runs.join(metrics.select(*TRACK, "duration_s", "path_length_m"), TRACK, "left").join(
        nominal_path(metrics), "run_id", "left"
    )
    rows = rows.selectExpr(
        "*",
        # The first limit that is set decides, even when it is not positive.
        "case when smoke_duration_s is not null then if(smoke_duration_s > 0, smoke_duration_s, null)"
        " when limit_s > 0 then limit_s end as limited",
    ).selectExpr(
        "*",
        f"case when limited is not null then greatest(0.0D, limited - {SMOKE_MARGIN_S}D)"
        f" when {full} > 0 then {full} * {FULL_COVERAGE}D end as minimum_s",
    )
    flags = rows.selectExpr(
        "*",
        "array_compact(array(if(duration_s < minimum_s, 'trajectory_short', null),"
        "if(path_length_m > greatest(1000.0D, nominal_path_m * 5.0D), 'path_divergence', null)))"
        " as health_flags",
    )
    return flags.selectExpr(
        *TRACK,
        "status",
        "duration_s",
        "path_length_m",
        "nominal_path_m",
        "minimum_s",
        "health_flags",
        "coalesce(status = 'SUCCESS', false) and size(health_flags) = 0 as health_valid",
        "if(coalesce(status = 'SUCCESS', false), health_flags,"
        " concat(array(concat('status:', coalesce(status, 'UNKNOWN'))), health_flags)) as all_flags",
        "(status is null or status = 'SUCCESS') and size(health_flags) = 0 as selection_eligible",
    )


def stable_tracks(health: DataFrame, baseline: str) -> DataFrame:
    return health.selectExpr(
        *TRACK,
        f"algorithm = '{baseline}' or health_valid as stable",
        f"if(algorithm = '{baseline}' or health_valid, cast(array() as array<string>),"
        " if(size(all_flags) > 0, all_flags, array('health_not_valid'))) as reasons",
    )


def metric_name_guard(metrics: DataFrame, truth_available: bool) -> DataFrame:
    """Long-format metrics whose name claims ground truth that is not there."""
    if truth_available:
        return metrics.where(F.lit(False))
    return metrics.where(claims_truth(F.col("metric")))


def categories(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Category per track and the consistency issues of its record.

    ``runs``: ``has_result, status, state, reason, exit_code, messages``;
    ``findings``: ``findings, serious_findings`` per track.
    """
    rows = runs.join(findings, TRACK, "left").na.fill(0, ["findings", "serious_findings"])
    return rows.selectExpr(
        "*",
        "case when status = 'RUNTIME_CRASH' then 'RUNTIME_CRASH'"
        " when not has_result then if(state = 'running', 'RUNNING', 'PENDING')"
        " when coalesce(status <> 'SUCCESS', true) then coalesce(status, 'None')"
        " when serious_findings > 0 then 'SUCCESS_NEEDS_REVIEW'"
        " when findings > 0 or coalesce(reason, '') <> '' then 'SUCCESS_WITH_WARNINGS'"
        " else 'SUCCESS' end as category",
        "array_compact(array("
        "if(status = 'SUCCESS' and coalesce(reason, '') <> '', 'reason_on_success', null),"
        "if(status = 'SUCCESS' and exit_code not in (0, -15), concat('exit_code=', exit_code), null),"
        "if(status = 'SUCCESS' and messages <= 0, 'no_track_messages', null)"
        ")) as consistency_issues",
    )


def category_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("run_id", "category").agg(F.expr("count(*) as algorithms"))


def run_state(runs: DataFrame) -> DataFrame:
    """failed / completed / running / completed_partial / initialized per run."""
    terminal = "status = 'SUCCESS'"
    return runs.groupBy("run_id").agg(
        F.expr(
            f"case when bool_or(has_result and not coalesce({terminal}, false)) then 'failed'"
            " when bool_and(has_result) then 'completed'"
            " when bool_or(coalesce(state = 'running', false)) then 'running'"
            " when bool_or(has_result) then 'completed_partial' else 'initialized' end as run_state"
        )
    )


def map_items(enhanced: DataFrame, legacy: DataFrame) -> DataFrame:
    """Enhanced map metrics of a run if it has any, else its legacy ones."""
    old = legacy.join(enhanced.select("run_id").distinct(), "run_id", "left_anti")
    return enhanced.withColumn("map_source", F.lit("enhanced")).unionByName(
        old.withColumn("map_source", F.lit("legacy")), allowMissingColumns=True
    )


def metric_summary(health: DataFrame, path: DataFrame, monitor: DataFrame, gnu: DataFrame, relative: DataFrame, baseline: str) -> DataFrame:
    """Summary rows: monitor values over time-report values, baseline pinned to 0."""
    rows = (
        health.select(*TRACK, "status", "health_flags")
        .join(path.select(*TRACK, F.col("path_length_m").alias("path_m"), "z_range_m"), TRACK, "left")
        .join(monitor.select(*TRACK, "mean_cpu_percent", F.col("peak_rss_mib").alias("mon_rss")), TRACK, "left")
        .join(gnu.select(*TRACK, F.expr("max_rss_kb / 1024.0D as gnu_rss")), TRACK, "left")
        .join(relative.select(*TRACK, "rmse_m", "p95_m"), TRACK, "left")
    )
    pin = f"algorithm = '{baseline}'"
    return rows.selectExpr(
        *TRACK,
        "status",
        "array_join(health_flags, ';') as health_flags",
        "path_m as path_length_m",
        "z_range_m",
        "mean_cpu_percent",
        "coalesce(mon_rss, gnu_rss) as peak_rss_mib",
        f"if({pin}, 0.0D, rmse_m) as relative_rmse_m",
        f"if({pin}, 0.0D, p95_m) as relative_p95_m",
    )


def comparison_report(
    health: DataFrame, path: DataFrame, resource: DataFrame, relative: DataFrame,
    maps: DataFrame, jumps: DataFrame, baseline: str,
) -> DataFrame:
    """The flat comparison table: left joins of small per-track tables."""
    maps = maps.selectExpr(
        *TRACK, "map_points", "robust_z_m as robust_z_span_m", "baseline_voxel_iou",
        "nn_p95_m as symmetric_nn_p95_m", "map_health_flags", "map_health_pass", "true as map_available",
    )
    rows = (
        health.select(*TRACK, "status", "health_flags", "health_valid")
        .join(path.select(*TRACK, "duration_s", "path_length_m", "z_range_m"), TRACK, "left")
        .join(resource.select(*TRACK, "mean_cpu_percent", "peak_rss_mib"), TRACK, "left")
        .join(relative.select(*TRACK, "rmse_m", "p95_m"), TRACK, "left")
        .join(maps, TRACK, "left")
        .join(
            jumps.select(*TRACK, "position_jump_count", "yaw_jump_count", "max_position_step_m", "max_yaw_step_deg"),
            TRACK,
            "left",
        )
    )
    pin = f"algorithm = '{baseline}'"
    return rows.selectExpr(
        *TRACK,
        "status",
        "if(health_valid, 'normal', array_join(health_flags, ';')) as trajectory_health",
        "if(map_available, if(map_health_pass, 'normal', array_join(map_health_flags, ';')), 'N/A') as map_health",
        "health_valid and coalesce(map_health_pass, true) as recommendation_eligible",
        f"if({pin}, 0.0D, rmse_m) as relative_rmse_m",
        f"if({pin}, 0.0D, p95_m) as relative_p95_m",
        "duration_s", "path_length_m", "z_range_m", "mean_cpu_percent", "peak_rss_mib",
        "map_points", "robust_z_span_m", "baseline_voxel_iou", "symmetric_nn_p95_m",
        "position_jump_count", "yaw_jump_count", "max_position_step_m", "max_yaw_step_deg",
        "health_valid", "coalesce(map_available, false) as map_available", "map_health_pass",
        f"'{RELATIVE_CLASS}' as metric_class",
    )


BEST_FIELDS = {
    "closest_to_baseline": ("relative_rmse_m", True),
    "lowest_z_range": ("z_range_m", False),
    "lowest_mean_cpu": ("mean_cpu_percent", False),
    "lowest_peak_rss": ("peak_rss_mib", False),
}


def best_algorithms(report: DataFrame, baseline: str) -> DataFrame:
    """Best eligible algorithm per field; ties go to the smaller name."""
    picks = []
    for name, (field, drop_base) in BEST_FIELDS.items():
        ok = f"recommendation_eligible and {field} is not null"
        if drop_base:
            ok += f" and algorithm <> '{baseline}'"
        picks.append(
            F.expr(f"min(case when {ok} then struct({field} as v, algorithm as a) end).a as {name}")
        )
    return report.groupBy("run_id").agg(*picks)


def recommendations(report: DataFrame, groups: DataFrame) -> DataFrame:
    """Name lists per run. A list holds at most the algorithms of one run."""
    rows = report.join(groups, TRACK, "left")

    def names(ok: str, name: str):
        return F.expr(
            f"array_join(array_sort(collect_set(case when {ok} then algorithm end)), ';') as {name}"
        )

    return rows.groupBy("run_id").agg(
        names("health_valid", "health_valid_algorithms"),
        names("health_valid and map_available and map_health_pass", "map_consistent_algorithms"),
        names("recommendation_eligible and run_group = 'full_slam'", "full_slam_candidates"),
        names("not recommendation_eligible", "not_recommended_this_run"),
    )


def comparison_groups(rows: DataFrame) -> DataFrame:
    """Algorithms per taxonomy group; no ranking across groups."""
    return rows.groupBy("run_id", "run_group").agg(
        F.expr("array_join(array_sort(collect_set(algorithm)), ';') as algorithms")
    )


def map_sets(health: DataFrame, map_health: DataFrame | None, baseline: str) -> DataFrame:
    rows = health.select(*TRACK, "health_valid")
    if map_health is not None:
        rows = rows.join(map_health.select(*TRACK, "map_health_pass"), TRACK, "left")
    else:
        rows = rows.withColumn("map_health_pass", F.lit(None).cast("boolean"))
    return rows.selectExpr(
        *TRACK,
        f"(health_valid and coalesce(map_health_pass, true)) or algorithm = '{baseline}' as in_primary",
        "true as in_all",
    )


def reproducibility(provenance: DataFrame) -> DataFrame:
    """Checklist per run from per-algorithm provenance rows."""
    return provenance.groupBy("run_id").agg(
        F.expr("bool_and(coalesce(benchmark_commit, '') <> '') as benchmark_commit_recorded"),
        F.expr("bool_and(coalesce(dataset_sha256, '') <> '') as dataset_sha256_recorded"),
        F.expr("bool_and(has_provenance) as algorithm_provenance_recorded"),
        F.expr("bool_and(has_calibration) as calibration_disclosed"),
        F.expr("bool_and(source_artifacts > 0) as core_source_artifacts_hashed"),
    )


def overlay(base: DataFrame, override: DataFrame, algorithm: str, new_run: str, paths: list[str] = ()) -> DataFrame:
    """Base run with one algorithm's rows replaced, as a new run.

    ``paths`` columns have their run folder rewritten to the new run.
    """

    def moved(df: DataFrame, origin: str) -> DataFrame:
        out = df.withColumn("source_run", F.col("run_id")).withColumn("composition", F.lit(origin))
        for p in paths:
            out = out.withColumn(p, F.replace(F.col(p), F.col("run_id"), F.lit(new_run)))
        return out.withColumn("run_id", F.lit(new_run))

    return moved(base.where(F.col("algorithm") != algorithm), "preserved").unionByName(
        moved(override.where(F.col("algorithm") == algorithm), "override")
    )


def missing_algorithms(declared: DataFrame, available: DataFrame) -> DataFrame:
    return declared.select(*TRACK).join(available.select(*TRACK).distinct(), TRACK, "left_anti")


def report_order(declared: DataFrame, available: DataFrame) -> DataFrame:
    """Algorithms with data in declared order; without any, all by name."""
    have = available.select(*TRACK).distinct()
    listed = declared.join(have, TRACK, "left_semi").select(*TRACK, F.col("pos").cast("bigint").alias("pos"))
    rest = have.join(listed.select("run_id").distinct(), "run_id", "left_anti").selectExpr(
        *TRACK, "row_number() over (partition by run_id order by algorithm) - 1L as pos"
    )
    return listed.unionByName(rest)


def output_dirs(runs: DataFrame) -> DataFrame:
    return runs.withColumn(
        "effective_dir",
        F.expr("coalesce(result_output_dir, output_dir, concat(run_id, '/raw/', algorithm))"),
    )


def existing_output_dirs(runs: DataFrame, folders: DataFrame) -> DataFrame:
    """Output folder of each track: the recorded one (of the result first) if it exists, else the default.

    ``folders``: dir of every folder that exists.
    """
    named = runs.withColumn("dir", F.expr("coalesce(nullif(result_output_dir, ''), nullif(output_dir, ''))"))
    there = folders.select("dir").distinct().withColumn("exists", F.lit(True))
    return named.join(there, "dir", "left").withColumn(
        "effective_dir", F.expr("if(coalesce(exists, false), dir, concat(run_id, '/raw/', algorithm))")
    ).drop("dir", "exists")


def fallback_order(listed: DataFrame, files: DataFrame) -> DataFrame:
    """Algorithms to rebuild per run, in order, and those left out.

    ``listed``: run_id, source, priority, pos, algorithm, where the source of the
    least priority that a run has counts alone. ``files``: run_id, algorithm of
    every trajectory there is. Without any listed one, all that are there follow
    by name, their source being the files. decision is use or omitted.
    """
    have = files.select(*TRACK).distinct().withColumn("there", F.lit(True))
    best = listed.groupBy("run_id").agg(F.min("priority").alias("priority"))
    rows = listed.join(best, ["run_id", "priority"]).join(have, TRACK, "left").withColumn("there", F.coalesce("there", F.lit(False)))
    usable = rows.where("there").select("run_id").distinct()
    found = have.join(usable, "run_id", "left_anti").selectExpr(
        *TRACK, "'files' as source", "row_number() over (partition by run_id order by algorithm) - 1L as pos", "'use' as decision"
    )
    ranked = rows.selectExpr(
        *TRACK, "source", "row_number() over (partition by run_id, there order by pos, algorithm) - 1L as pos",
        "if(there, 'use', 'omitted') as decision",
    )
    return ranked.unionByName(found)


def bundle_summary(report: DataFrame) -> DataFrame:
    """The twelve-column export."""
    return report.select(
        *TRACK, "status", F.col("health_valid").alias("trajectory_health_pass"), "recommendation_eligible",
        "path_length_m", "z_range_m", "mean_cpu_percent", "peak_rss_mib", "relative_rmse_m",
        "relative_p95_m", "position_jump_count", "yaw_jump_count",
    )


# --- artifacts --------------------------------------------------------------


def verify_artifacts(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """Recorded against recomputed hashes: matches, changes, missing and extra."""
    r = recorded.selectExpr("run_id", "path", "sha256 as recorded_sha", "size_bytes as recorded_size")
    f = found.selectExpr("run_id", "path", "sha256 as found_sha", "size_bytes as found_size")
    return r.join(f, ["run_id", "path"], "full").withColumn(
        "verdict",
        F.expr(
            "case when recorded_sha is null then 'unregistered' when found_sha is null then 'missing'"
            " when recorded_sha = found_sha and recorded_size = found_size then 'ok' else 'changed' end"
        ),
    )


def source_plan(expected: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Required and optional inputs of a run with their presence."""
    have = artifacts.select("run_id", "path").distinct().withColumn("present", F.lit(True))
    return expected.join(have, ["run_id", "path"], "left").selectExpr(
        "run_id", "path", "required", "coalesce(present, false) as present",
        "case when coalesce(present, false) then 'use' when required then 'missing_required'"
        " else 'omitted_optional' end as decision",
    )
