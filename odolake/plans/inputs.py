"""Tables of the engine derived from the driver's parquet files.

Pose tracks come from ``events``, clouds and scans from ``embeddings``, log
lines from ``documents``, a second resource set from ``lineitem``. Tables that
several plans read are written once per session and version of the input files.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment, jumps, logs, maps, phases, profile, report, resample, resources, tracks
from ..operators.keep import keep
from ..session import tune

BASELINE = "algo_0"
RUN = "run_0"
EPOCH_US = 1704067200000000
MANIFEST_DURATION_S = 259.0

_SHARED: dict[tuple[str, str, int, str], DataFrame] = {}

WALL = f"((unix_micros(cast(ts as timestamp)) - {EPOCH_US}L) / 1e6D)"


def forget() -> None:
    """Build the shared tables anew on their next use."""
    _SHARED.clear()


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = tune(spark), sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @functools.cached_property
    def version(self) -> int:
        """A hash over path, time and length of the folder's files: one row, by listing them."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
        return files.load(self.dir).selectExpr("bit_xor(xxhash64(path, modificationTime, length)) as h").first()["h"] or 0

    def shared(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table that several plans read, written once for each version of the input files."""
        key = (self.spark.sparkContext.applicationId, self.dir, self.version, name)
        if key not in _SHARED:
            _SHARED[key] = keep(build(), name)
        return _SHARED[key]

    # --- pose tracks --------------------------------------------------------

    def raw(self) -> DataFrame:
        """Clean pseudo-trajectories."""
        base = self.table("events").selectExpr(
            f"'{RUN}' as run_id",
            "concat('algo_', user_id % 10) as algorithm",
            "user_id % 10 as a",
            "event_id as arrival_seq",
            "value",
            f"{WALL} * 1e-4D as timestamp_s",
        ).selectExpr("*", "least(greatest(timestamp_s - 20.0D, 0.0D), 200.0D) as tau")
        return base.selectExpr(
            "*",
            "atan2(sin(tau / 15.0D + pi() / 2.0D), cos(tau / 15.0D + pi() / 2.0D)) as yaw",
        ).selectExpr(
            "run_id",
            "algorithm",
            "arrival_seq",
            "timestamp_s",
            "8.0D * (1.0D + 1e-2D * a) * cos(tau / 15.0D) + value / 90000.0D"
            " + if(arrival_seq % 97 = 0 and a <> 0, 25.0D, 0.0D) as x_m",
            "8.0D * (1.0D + 1e-2D * a) * sin(tau / 15.0D) as y_m",
            "2e-2D * tau + 5e-2D * a as z_m",
            "0.0D as qx",
            "0.0D as qy",
            "sin(yaw / 2.0D) as qz",
            "cos(yaw / 2.0D) as qw",
            "'/odometry' as source_topic",
        )

    def dirty(self) -> DataFrame:
        """The same poses with repeated, zero and late stamps."""
        raw = self.raw()
        first = raw.selectExpr(
            *(c for c in raw.columns if c not in ("arrival_seq", "timestamp_s")),
            "4 * arrival_seq + if(arrival_seq % 83 = 0, 802L, 0L) as arrival_seq",
            "if(arrival_seq % 71 = 0, 0.0D, timestamp_s) as timestamp_s",
        )
        again = raw.where("arrival_seq % 50 = 0").selectExpr(
            *(c for c in raw.columns if c not in ("arrival_seq", "x_m")),
            "4 * arrival_seq + 1 as arrival_seq",
            "x_m + 1.0D as x_m",
        )
        return first.unionByName(again)

    def tracks(self) -> DataFrame:
        return self.shared("tracks", lambda: tracks.standardize(self.raw()))

    def segments(self) -> DataFrame:
        return self.shared("segments", lambda: tracks.segments(self.tracks()))

    def steps(self) -> DataFrame:
        return tracks.steps(self.segments())

    def limits(self) -> DataFrame:
        return self.shared("limits", lambda: jumps.thresholds(self.steps()))

    def flagged(self) -> DataFrame:
        return self.shared("flagged", lambda: jumps.flagged_steps(self.steps(), self.limits()))

    def origin(self) -> DataFrame:
        return self.shared("origin", lambda: resample.time_origin(self.tracks(), baseline=BASELINE))

    def timeline(self) -> DataFrame:
        return self.shared(
            "timeline",
            lambda: resample.kinematics(resample.resample_fixed_rate(self.segments(), self.origin())),
        )

    def jump_events(self) -> DataFrame:
        return self.shared("jump_events", lambda: jumps.cluster_events(jumps.jump_events(self.flagged())))

    def windows(self) -> DataFrame:
        return self.shared("windows", lambda: jumps.anomaly_windows(self.jump_events()))

    def timeline_flagged(self) -> DataFrame:
        def build():
            rows = resample.step_view(self.timeline())
            return jumps.flagged_steps(rows, jumps.thresholds(rows))

        return self.shared("timeline_flagged", build)

    def timeline_events(self) -> DataFrame:
        return self.shared(
            "timeline_events",
            lambda: jumps.cluster_events(jumps.jump_events(self.timeline_flagged(), "bag_time_s")),
        )

    def path(self) -> DataFrame:
        return self.shared("path", lambda: tracks.path_metrics(self.segments()))

    def transforms(self) -> DataFrame:
        return self.shared(
            "transforms", lambda: alignment.pair_transforms(self.segments(), BASELINE, "column")
        )

    def relative(self) -> DataFrame:
        return self.shared(
            "relative", lambda: alignment.relative_error(self.segments(), BASELINE, "dashboard")
        )

    # --- message log --------------------------------------------------------

    def messages(self) -> DataFrame:
        return self.table("events").selectExpr(
            f"'{RUN}' as run_id",
            "concat('/', event_type) as topic",
            "case event_type when 'click' then 'CustomMsg' when 'view' then 'Imu' when 'error' then 'Unknown'"
            " else 'Odometry' end as type",
            "event_id as message_id",
            "event_id as arrival_seq",
            f"(unix_micros(cast(ts as timestamp)) - {EPOCH_US}L) * 1000L as recorded_ns",
            f"{WALL} as recorded_s",
            f"{WALL} - 2e-2D - (event_id % 7) * 3e-3D - if(event_id % 83 = 0, 1000.0D, 0.0D) as header_s",
            "concat('frame_', event_id % 3) as frame_id",
            "cast(ts as timestamp) as ts",
            "value",
        )

    def profiles(self) -> DataFrame:
        return self.shared("profiles", lambda: profile.topic_profile(self.messages()))

    def frames(self) -> DataFrame:
        """Index of the '/click' topic on the run's own time axis."""
        lidar = self.messages().where("topic = '/click'")
        return profile.frame_index(lidar, None)

    # --- resources ----------------------------------------------------------

    def samples(self) -> DataFrame:
        return self.table("events").selectExpr(
            f"'{RUN}' as run_id",
            "concat('algo_', user_id % 10) as algorithm",
            "event_id as seq",
            f"{WALL} as wall_s",
            "value as cpu_percent",
            "1048576L * (100 + cast(get_json_object(props, '$.k') as bigint)) as rss_bytes",
            "cast(1 + cast(get_json_object(props, '$.k') as bigint) % 8 as int) as threads",
            "event_id * 10 as write_bytes",
        )

    def ship_samples(self) -> DataFrame:
        """A second sample set with many equal times."""
        return self.table("lineitem").selectExpr(
            f"'{RUN}' as run_id",
            "concat('algo_', l_suppkey % 10) as algorithm",
            "l_orderkey * 8 + l_linenumber as seq",
            "unix_micros(cast(l_shipdate as timestamp)) / 86400000000.0D as day",
            "l_quantity as cpu_percent",
            "cast(l_extendedprice as bigint) as rss_bytes",
            "cast(1 + l_linenumber as int) as threads",
            "l_orderkey as write_bytes",
        )

    def anchors(self) -> DataFrame:
        return (
            self.table("events")
            .where("event_id % 10 = 0 and user_id % 10 < 7")
            .selectExpr(
                f"'{RUN}' as run_id",
                "concat('algo_', user_id % 10) as algorithm",
                f"(unix_micros(cast(ts as timestamp)) - {EPOCH_US}L) * 1000L as wall_time_ns",
                "cast(null as bigint) as ros_time_ns",
                f"{WALL} * 1e-4D + 0.1D as ros_time_s",
            )
        )

    def playback(self) -> DataFrame:
        """Lifecycle events: playback starts with the first sample of a track."""
        first = self.samples().groupBy("run_id", "algorithm").agg(
            F.expr("min(wall_s) as w"), F.expr("min(seq) as pos")
        )
        return first.where("algorithm <> 'algo_9'").selectExpr(
            "run_id",
            "algorithm",
            "pos",
            "'running' as bag_playback",
            "date_format(timestamp_micros(cast(floor(w) as bigint) * 1000000), \"yyyy-MM-dd'T'HH:mm:ss\") as at",
        )

    def evidence(self) -> DataFrame:
        """Offset evidence of the LiDAR topic."""
        lidar = self.profiles().where("topic = '/click'")
        return resources.offset_evidence(lidar)

    def aligned(self) -> DataFrame:
        return self.shared(
            "aligned",
            lambda: resources.align(
                self.samples(), self.anchors(), self.playback(), self.evidence(), playback_rate=1e-4
            ),
        )

    # --- phases -------------------------------------------------------------

    def baseline_segments(self) -> DataFrame:
        return self.segments().where(F.col("algorithm") == BASELINE)

    def motion(self) -> DataFrame:
        def build():
            grid = keep(
                phases.motion_grid(self.baseline_segments(), phases.PARAMETERS["resample_hz"]), "motion_grid"
            )
            return phases.motion_states(grid)

        return self.shared("motion", build)

    def phase_segments(self) -> DataFrame:
        return self.shared("phase_segments", lambda: phases.state_segments(self.motion()))

    def phases(self) -> DataFrame:
        p = phases.PARAMETERS

        def build():
            merged = phases.merge_short(self.phase_segments(), p["min_phase_duration_s"], p["resample_hz"])
            return phases.phase_table(keep(merged, "merged_segments"), p["resample_hz"])

        return self.shared("phases", build)

    def thirds(self) -> DataFrame:
        """Three equal parts of the baseline track, as given phases."""
        ends = self.baseline_segments().groupBy("run_id", "algorithm").agg(
            F.expr("min(timestamp_s) as a"), F.expr("max(timestamp_s) as b")
        )
        return ends.selectExpr("*", "explode(array(0, 1, 2)) as k").selectExpr(
            "run_id",
            "algorithm",
            "concat('phase_00', k) as phase_id",
            "'STRAIGHT' as state",
            "a + k * ((b - a) / 3.0D) as start_s",
            "if(k = 2, b, a + (k + 1) * ((b - a) / 3.0D)) as end_s",
            "k = 2 as is_last",
        )

    # --- points and clouds --------------------------------------------------

    def points(self) -> DataFrame:
        e = "cast(embedding[{}] as double)"
        return self.table("embeddings").selectExpr(
            f"'{RUN}' as run_id",
            "vec_id div 20 as message_id",
            "cast(vec_id % 20 as int) as ordinal",
            *(f"cast({e.format(i)} * 20.0D as float) as {a}" for i, a in enumerate("xyz")),
            "cast(abs(label) * 30 as smallint) as reflectivity",
            "cast(case vec_id % 11 when 0 then 32 else 16 end as smallint) as tag",
            "cast(vec_id % 4 as smallint) as line",
            "(vec_id * 7919 % 100000) * 1000 as offset_ns",
            "(vec_id div 20) * 1e-1D + 30.0D as header_s",
            f"{e.format(3)} * 200.0D as raw_intensity",
            "vec_id",
        )

    def cloud(self) -> DataFrame:
        e = "cast(embedding[{}] as double)"
        return self.table("embeddings").selectExpr(
            f"'{RUN}' as run_id",
            "concat('algo_', label) as algorithm",
            "vec_id as seq",
            *(f"cast({e.format(i)} * 20.0D as float) as {a}" for i, a in enumerate("xyz")),
            "embedding[3] as intensity",
        )

    def scan_points(self) -> DataFrame:
        """Scan points with absolute point times inside the tracks."""
        return self.points().selectExpr(
            "run_id", "message_id * 1000 + ordinal as seq", "message_id", "x", "y", "z",
            "raw_intensity as intensity", "header_s + offset_ns * 1e-9D as point_time_s",
        )

    def nn(self) -> DataFrame:
        return self.shared("nn", lambda: maps.symmetric_nn(self.cloud(), BASELINE))

    def map_metrics(self) -> DataFrame:
        def build():
            ext = maps.map_extents(self.cloud())
            iou = maps.voxel_iou(self.cloud(), BASELINE, 2.0).select("run_id", "algorithm", "baseline_voxel_iou")
            nn = maps.nn_metrics(self.nn()).select("run_id", "algorithm", "nn_p95_m")
            rows = ext.join(iou, tracks.TRACK, "left").join(nn, tracks.TRACK, "left")
            return maps.map_health(rows, BASELINE)

        return self.shared("map_metrics", build)

    # --- logs and run records -----------------------------------------------

    def log_lines(self) -> DataFrame:
        return self.table("documents").selectExpr(
            f"'{RUN}' as run_id",
            "concat('algo_', doc_id % 10) as algorithm",
            "concat(source, '.log') as source",
            "doc_id",
            "posexplode(split(text, '\\n', -1)) as (pos, line_text)",
        ).selectExpr(
            "run_id",
            "algorithm",
            "source",
            "doc_id as part",
            "cast(pos + 1 as bigint) as line",
            "concat(line_text, if(doc_id % 13 = 0, ' [ERROR] exception', ''),"
            " if(doc_id % 17 = 0, ' out of memory', ''),"
            " if(doc_id % 19 = 0, ' timestamp went backwards', '')) as text",
        )

    def findings(self) -> DataFrame:
        return logs.findings(self.log_lines())

    def runs(self) -> DataFrame:
        """One record per track, derived from the event counts."""
        return (
            self.table("events")
            .groupBy(F.expr("user_id % 10").alias("a"))
            .agg(F.expr("count(*) as messages"))
            .selectExpr(
                f"'{RUN}' as run_id",
                "concat('algo_', a) as algorithm",
                "case a % 3 when 0 then 'lidar_only_odometry' when 1 then 'lidar_imu_odometry'"
                " else 'full_slam' end as run_group",
                "if(a = 8, 'RUNTIME_CRASH', 'SUCCESS') as status",
                "true as has_result",
                "'completed' as state",
                "if(a = 3, 'retried', null) as reason",
                "cast(case a when 8 then 139 when 4 then -15 when 5 then 2 else 0 end as int) as exit_code",
                "messages",
                "if(a = 6, 300.0D, null) as smoke_duration_s",
                "cast(null as double) as limit_s",
                "if(a = 2, 'attempt_2', null) as result_output_dir",
                "if(a % 2 = 0, concat('out/', a), null) as output_dir",
                "a as pos",
            )
        )

    def health(self) -> DataFrame:
        return self.shared(
            "health", lambda: report.health_flags(self.path(), self.runs(), MANIFEST_DURATION_S)
        )

    def resource_summary(self) -> DataFrame:
        return resources.summary(self.samples())

    def jump_summary(self) -> DataFrame:
        return self.shared("jump_summary", lambda: jumps.jump_summary(self.flagged()))

    def report(self) -> DataFrame:
        return self.shared(
            "report",
            lambda: report.comparison_report(
                self.health(), self.path(), self.resource_summary(), self.relative(),
                self.map_metrics(), self.jump_summary(), BASELINE,
            ),
        )
