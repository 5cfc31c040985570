"""Streaming queries, drained over the whole input."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import points
from ..operators.tracks import TRACK
from ..session import shared_dir
from ..streaming import live
from .inputs import Inputs
from .map_queries import CONVERT_SQL
from .oracle import r, rs
from .registry import add
from .shape import tidy


class LiveInputs(Inputs):
    """The same tables, read as streams."""

    def table(self, name: str):
        schema = super().table(name).schema
        return live.stream_table(self.spark, self.dir, name, schema)


def _live(i: Inputs) -> LiveInputs:
    return LiveInputs(i.spark, i.dir)


add(
    "stream_resource_summary",
    lambda i: tidy(live.drain(live.resource_running(_live(i).samples()), "resources", "complete")),
    f"""SELECT run_id, algorithm, count(*) AS samples, {r('avg(cpu_percent)', 'mean_cpu_percent')}, {r('max(cpu_percent)', 'peak_cpu_percent')},
               {r('max(rss_bytes) / 1048576e0', 'peak_rss_mib')}, max(threads) AS peak_threads,
               {r("arg_max(cpu_percent, {'a': wall_s, 'b': seq})", 'latest_cpu_percent')} FROM samples GROUP BY run_id, algorithm""",
)
add(
    "stream_topic_rates",
    lambda i: tidy(
        live.drain(
            live.topic_rates(_live(i).messages(), "1 hour", "10 seconds"), "rates", "update", ["run_id", "topic", "window_start"]
        ),
        "run_id", "topic", "unix_micros(window_start) as window_us", "messages",
    ),
    """SELECT run_id, topic, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_us, count(*) AS messages FROM messages GROUP BY ALL""",
)


STANDARD = ["timestamp_s", "x_m", "y_m", "z_m", "qz", "qw", "yaw_rad"]


def _poses(i: Inputs):
    raw = _live(i).dirty()
    return raw.selectExpr("*", "timestamp_micros(cast(floor(timestamp_s * 1000000.0D) as bigint)) as ts")


add(
    "stream_standardize",
    lambda i: tidy(
        live.drain(live.standardize(_poses(i), "1 hour"), "poses", "update", live.STANDARD_KEY),
        *TRACK, *STANDARD, "copies",
    ),
    f"""SELECT run_id, algorithm, {rs('timestamp_s', 'x_m', 'y_m', 'z_m')}, {r('qz / n', 'qz')}, {r('qw / n', 'qw')},
               {r('atan2(2 * (qw / n * (qz / n)), 1 - 2 * (qz / n * (qz / n)))', 'yaw_rad')}, copies
        FROM (SELECT *, sqrt(qz * qz + qw * qw) AS n, count(*) OVER (PARTITION BY run_id, algorithm, timestamp_s) AS copies,
                     row_number() OVER (PARTITION BY run_id, algorithm, timestamp_s ORDER BY arrival_seq) AS k
              FROM dirty WHERE timestamp_s <> 0) WHERE k = 1""",
)
add(
    "stream_point_counters",
    lambda i: tidy(
        live.drain(live.conversion_counters(points.with_validity(_live(i).points())), "points", "complete")
    ),
    """SELECT run_id, count(*) AS input_points, count(*) FILTER (WHERE (tag & 48) IN (0, 16)) AS output_points,
              count(*) FILTER (WHERE (tag & 48) NOT IN (0, 16)) AS invalid_tag_points, 0 AS non_finite_points FROM points GROUP BY run_id""",
)
add(
    "stream_heartbeat",
    lambda i: tidy(
        live.drain(
            live.heartbeat(
                _live(i).messages().selectExpr(
                    "run_id", "topic as event", "type as state", "recorded_s as wall_s", "message_id as pos",
                    "floor(recorded_s / 86400.0D) * 86400.0D as phase_started_s",
                )
            ),
            "heartbeat", "complete",
        )
    ),
    f"""SELECT run_id, arg_max(topic, message_id) AS last_event, arg_max(type, message_id) AS state,
               {r('max(recorded_s) - arg_max(floor(recorded_s / 86400e0) * 86400e0, message_id)', 'phase_elapsed_s')},
               {r('max(recorded_s) - min(recorded_s)', 'elapsed_s')} FROM messages GROUP BY run_id""",
)
add(
    "stream_anchor_throttle",
    lambda i: tidy(
        live.drain(
            live.throttle_anchors(
                _live(i).messages().where("topic = '/view'").selectExpr(
                    "run_id", "recorded_ns as wall_time_ns", "cast(header_s * 1e9D as bigint) as ros_time_ns", "message_id as seq"
                ),
                3600.0,
            ),
            "anchors",
        ),
        "run_id", "wall_time_ns", "sequence", "wall_backtracks", "ros_backtracks",
    ),
    """WITH RECURSIVE v AS (SELECT row_number() OVER (ORDER BY event_id) AS seq, (epoch_us(ts) - 1704067200000000) * 1000 AS w,
              (epoch_us(ts) - 1704067200000000) / 1e6 - 2e-2 - (event_id % 7) * 3e-3 - CASE WHEN event_id % 83 = 0 THEN 1000e0 ELSE 0e0 END AS h
              FROM events WHERE event_type = 'view'),
       k AS (SELECT seq, w, h, 0 AS n FROM v WHERE seq = 1 UNION ALL
             SELECT v.seq, v.w, v.h, k.n + 1 FROM k JOIN v ON v.seq = (SELECT min(x.seq) FROM v x WHERE x.seq > k.seq AND x.w - k.w >= 3600000000000))
       SELECT 'run_0' AS run_id, w AS wall_time_ns, n AS sequence, 0 AS wall_backtracks,
              CAST(sum(CASE WHEN h < p THEN 1 ELSE 0 END) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ros_backtracks
       FROM (SELECT *, lag(h) OVER (ORDER BY n) AS p FROM k)""",
)


def _live_steps(i: Inputs):
    poses = standardize_live(_live(i).raw())
    return live.drain(live.online_steps(poses), "steps")


def standardize_live(raw):
    """Yaw and event time of a clean pose stream (stateless)."""
    return raw.selectExpr(
        *TRACK, "timestamp_s", "x_m", "y_m", "z_m", "atan2(2 * qw * qz, 1 - 2 * qz * qz) as yaw_rad",
        "timestamp_micros(cast(floor(timestamp_s * 1000000.0D) as bigint)) as ts",
    )


STEP = ["timestamp_s", "dt_s", "position_step_m", "yaw_step_deg"]
add(
    "stream_steps",
    lambda i: tidy(_live_steps(i), *TRACK, *STEP),
    f"SELECT run_id, algorithm, {', '.join(r(c, c) for c in STEP)} FROM steps",
)


def _sessions(i: Inputs):
    # The step table is itself written and read as a stream; sessions close in event time.
    folder = f"{shared_dir(i.spark)}/live-steps-{uuid.uuid4().hex}"
    steps = _live_steps(i)
    steps.write.parquet(folder)
    # Files written at once have no order in event time, so they are one batch.
    stream = i.spark.readStream.schema(steps.schema).parquet(folder)
    sessions, ending = live.jump_sessions(stream, i.limits(), "1 second", "10 seconds")
    return live.drain(sessions, "sessions", ending=ending)


add(
    "stream_jump_windows",
    lambda i: tidy(_sessions(i)),
    f"""SELECT run_id, algorithm, count(*) AS jump_steps, {r('max(position_step_m)', 'peak_position_step_m')},
               {r('max(yaw_step_deg)', 'peak_yaw_step_deg')}, {r('min(timestamp_s)', 'start_s')}, {r('max(timestamp_s)', 'end_s')}
        FROM (SELECT *, sum(opens) OVER (PARTITION BY run_id, algorithm ORDER BY us) AS session
              FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY run_id, algorithm ORDER BY us) <= 1000000 THEN 0 ELSE 1 END AS opens
                    FROM (SELECT *, CAST(floor(timestamp_s * 1e6) AS BIGINT) AS us FROM steps JOIN limits USING (run_id, algorithm)
                          WHERE position_step_m > position_threshold_m OR yaw_step_deg > yaw_threshold_deg)))
        GROUP BY run_id, algorithm, session""",
)


def _imu(i: Inputs):
    return i.points().selectExpr(
        "vec_id", "cast(x as double) as ax", "cast(y as double) as ay", "cast(z as double) as az",
        "if(vec_id % 3 = 0, array(0.0D, 0.0D), array(raw_intensity, 1.0D)) as acc_cov", "if(vec_id % 2 = 0, 'g', 'm/s^2') as unit",
    )


add(
    "stream_imu_scale",
    lambda i: tidy(live.drain(points.scale_imu(_imu(_live(i))), "imu"), "vec_id", "ax_si", "ay_si", "az_si", "acc_cov_si[1] as c1"),
    f"""SELECT vec_id, {', '.join(r(f'{a}::DOUBLE * k', f'a{a}_si') for a in 'xyz')}, {r('CASE WHEN vec_id % 3 = 0 THEN 0e0 ELSE k * k END', 'c1')}
        FROM (SELECT *, CASE WHEN vec_id % 2 = 0 THEN 9.80665e0 ELSE 1e0 END AS k FROM points)""",
)
add(
    "stream_valid_points",
    lambda i: tidy(
        live.drain(points.with_validity(_live(i).points()).where("tag_ok and xyz_ok"), "valid_points"),
        "run_id", "message_id", "ordinal", "cast(x as double) as x", "cast(y as double) as y", "cast(z as double) as z", "line", "offset_ns",
    ),
    f"""SELECT run_id, message_id, ordinal, {', '.join(r(f'{a}::DOUBLE', a) for a in 'xyz')}, line, offset_ns FROM points WHERE (tag & 48) IN (0, 16)""",
)


def _scans(i: Inputs):
    """Whole scans, a row each, as a stream."""
    folder = f"{shared_dir(i.spark)}/live-scans-{uuid.uuid4().hex}"
    fields = ["x", "y", "z", "reflectivity", "tag", "line", "offset_ns", "ordinal"]
    scans = i.points().groupBy(*points.SCAN).agg(F.collect_list(F.struct(*fields)).alias("points"))
    scans.write.parquet(folder)
    return i.spark.readStream.schema(scans.schema).option("maxFilesPerTrigger", live.FILES_PER_BATCH).parquet(folder)


add(
    "stream_point_conversion",
    lambda i: tidy(live.drain(live.convert_scans(_scans(i)), "records"), "message_id", "pos", "ordinal", "ring", "intensity", "time"),
    f"SELECT message_id, pos, ordinal, line AS ring, reflectivity::DOUBLE AS intensity, {r('time::DOUBLE', 'time')} FROM {CONVERT_SQL}",
)


# Poses in PARTS deliveries by arrival; every 37th comes one delivery later.
PARTS, DELAY_S = 4, 2.0


def _late(i: Inputs):
    poses = i.dirty().selectExpr("*", "timestamp_micros(cast(floor(timestamp_s * 1000000.0D) as bigint)) as ts")
    top = poses.agg(F.max("arrival_seq")).first()[0] or 0
    part = f"least(arrival_seq * {PARTS} div {top + 1}, {PARTS - 1}) + if(arrival_seq % 37 = 5, 1, 0)"
    base = f"{shared_dir(i.spark)}/live-late-{uuid.uuid4().hex}"
    live_poses = live.LatePoses(poses.schema, DELAY_S, base)
    folder = f"{base}/deliveries"
    for k in range(PARTS + 1):
        poses.where(f"{part} = {k}").write.mode("append").parquet(folder)
        live_poses.run(i.spark.readStream.schema(poses.schema).parquet(folder))
    return live_poses.result(i.spark)


_LATE_SQL = f"""(SELECT *, us <= max(top) OVER (PARTITION BY 1 ORDER BY part RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {int(DELAY_S * 1e6)} AS late
        FROM (SELECT *, max(us) OVER (PARTITION BY part) AS top
              FROM (SELECT *, CAST(floor(timestamp_s * 1e6) AS BIGINT) AS us,
                           least(arrival_seq * {PARTS} // ((SELECT max(arrival_seq) FROM dirty) + 1), {PARTS - 1}) + CASE WHEN arrival_seq % 37 = 5 THEN 1 ELSE 0 END AS part
                    FROM dirty WHERE timestamp_s <> 0)))"""
add(
    "stream_late_poses",
    lambda i: tidy(_late(i)[1], *TRACK, "timestamp_s", "x_m", "arrival_seq"),
    f"SELECT run_id, algorithm, {r('timestamp_s', 'timestamp_s')}, {r('x_m', 'x_m')}, arrival_seq FROM {_LATE_SQL} WHERE late",
)
add(
    "stream_timely_poses",
    lambda i: tidy(_late(i)[0], *TRACK, "timestamp_s", "x_m", "y_m", "copies"),
    f"""SELECT run_id, algorithm, {r('timestamp_s', 'timestamp_s')}, {r('arg_min(x_m, arrival_seq)', 'x_m')}, {r('arg_min(y_m, arrival_seq)', 'y_m')}, count(*) AS copies
        FROM (SELECT * FROM {_LATE_SQL} WHERE late IS NOT TRUE) GROUP BY run_id, algorithm, timestamp_s""",
)
