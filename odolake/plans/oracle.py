"""Shared SQL building blocks for the comparison queries (DuckDB dialect).

``sql(body)`` puts exactly the named blocks a body refers to, and those they
refer to, in front of it.
"""

from __future__ import annotations

import re

EPOCH_US = 1704067200000000


def r(expr: str, name: str | None = None) -> str:
    out = f"round({expr}, 6) + 0.0"
    return f"{out} AS {name}" if name else out


def rs(*names: str) -> str:
    return ", ".join(r(n, n) for n in names)


WALL = f"((epoch_us(ts) - {EPOCH_US}) / 1e6)"

BLOCKS: dict[str, str] = {
    "raw": f"""
        SELECT 'run_0' AS run_id, 'algo_' || a AS algorithm, a, arrival_seq, value, timestamp_s, tau,
               8e0 * (1e0 + 1e-2 * a) * cos(tau / 15e0) + value / 90000e0
                 + CASE WHEN arrival_seq % 97 = 0 AND a <> 0 THEN 25e0 ELSE 0e0 END AS x_m,
               8e0 * (1e0 + 1e-2 * a) * sin(tau / 15e0) AS y_m,
               2e-2 * tau + 5e-2 * a AS z_m,
               sin(atan2(sin(tau / 15e0 + pi() / 2e0), cos(tau / 15e0 + pi() / 2e0)) / 2e0) AS qz,
               cos(atan2(sin(tau / 15e0 + pi() / 2e0), cos(tau / 15e0 + pi() / 2e0)) / 2e0) AS qw
        FROM (SELECT *, least(greatest(timestamp_s - 20e0, 0e0), 200e0) AS tau
              FROM (SELECT user_id % 10 AS a, event_id AS arrival_seq, value,
                           {WALL} * 1e-4 AS timestamp_s FROM events))""",
    "tracks": """
        SELECT run_id, algorithm, timestamp_s, x_m, y_m, z_m, 0e0 AS qx, 0e0 AS qy, qz / n AS qz, qw / n AS qw,
               0e0 AS roll_rad, 0e0 AS pitch_rad,
               atan2(2 * (qw / n * (qz / n)), 1 - 2 * (qz / n * (qz / n))) AS yaw_rad
        FROM (SELECT *, sqrt(qz * qz + qw * qw) AS n FROM raw)""",
    "dirty": """
        SELECT run_id, algorithm, 4 * arrival_seq + CASE WHEN arrival_seq % 83 = 0 THEN 802 ELSE 0 END AS arrival_seq,
               CASE WHEN arrival_seq % 71 = 0 THEN 0e0 ELSE timestamp_s END AS timestamp_s, x_m, y_m, z_m, qz, qw
        FROM raw
        UNION ALL
        SELECT run_id, algorithm, 4 * arrival_seq + 1, timestamp_s, x_m + 1e0, y_m, z_m, qz, qw
        FROM raw WHERE arrival_seq % 50 = 0""",
    "lagged": """
        SELECT *, lag(timestamp_s) OVER w AS p_t, lag(x_m) OVER w AS p_x, lag(y_m) OVER w AS p_y,
               lag(z_m) OVER w AS p_z, lag(yaw_rad) OVER w AS p_yaw, lag(qz) OVER w AS p_qz, lag(qw) OVER w AS p_qw,
               min(timestamp_s) OVER (PARTITION BY run_id, algorithm) AS t_first,
               max(timestamp_s) OVER (PARTITION BY run_id, algorithm) AS t_last
        FROM tracks WINDOW w AS (PARTITION BY run_id, algorithm ORDER BY timestamp_s)""",
    "folded": """
        SELECT *, CASE WHEN p_yaw IS NULL OR abs(yaw_rad - p_yaw) < pi() THEN 0e0
                  ELSE (yaw_rad - p_yaw + pi() - floor((yaw_rad - p_yaw + pi()) / (2 * pi())) * (2 * pi())) - pi()
                       - (yaw_rad - p_yaw) END AS yaw_fix
        FROM lagged""",
    "seg": """
        SELECT *, yaw_rad + turns AS yaw_u, p_yaw + turns - yaw_fix AS p_yaw_u
        FROM (SELECT *, sum(yaw_fix) OVER (PARTITION BY run_id, algorithm ORDER BY timestamp_s
                                           ROWS UNBOUNDED PRECEDING) AS turns FROM folded)""",
    "steps": """
        SELECT *, position_step_m / dt_s AS speed_mps, yaw_step_deg / dt_s AS yaw_rate_deg_s
        FROM (SELECT run_id, algorithm, timestamp_s, timestamp_s - p_t AS dt_s,
                     sqrt(power(x_m - p_x, 2) + power(y_m - p_y, 2) + power(z_m - p_z, 2)) AS position_step_m,
                     abs(yaw_rad - p_yaw + yaw_fix) * 180e0 / pi() AS yaw_step_deg, x_m, y_m, z_m
              FROM seg WHERE p_t IS NOT NULL) WHERE dt_s > 0""",
    "medians": """
        SELECT run_id, algorithm, median(position_step_m) AS mp, median(yaw_step_deg) AS my
        FROM steps GROUP BY ALL""",
    "limits": """
        SELECT run_id, algorithm,
               greatest(0.5e0, mp + 10e0 * 1.4826e0 * median(abs(position_step_m - mp))) AS position_threshold_m,
               greatest(10e0, my + 10e0 * 1.4826e0 * median(abs(yaw_step_deg - my))) AS yaw_threshold_deg
        FROM steps JOIN medians USING (run_id, algorithm) GROUP BY run_id, algorithm, mp, my""",
    "flagged": """
        SELECT *, position_step_m > position_threshold_m AS position_jump, yaw_step_deg > yaw_threshold_deg AS yaw_jump
        FROM steps JOIN limits USING (run_id, algorithm)""",
    "jumps": """
        SELECT *, timestamp_s AS event_s,
               CASE type WHEN 'yaw_jump' THEN yaw_step_deg ELSE position_step_m END / greatest(threshold, 1e-12) AS severity
        FROM (SELECT *, 'position_jump' AS type, position_threshold_m AS threshold FROM flagged WHERE position_jump
              UNION ALL
              SELECT *, 'yaw_jump', yaw_threshold_deg FROM flagged WHERE yaw_jump)""",
    "clustered": """
        SELECT *, algorithm || ':window_' || printf('%04d', window_no) AS window_id
        FROM (SELECT *, CAST(sum(CASE WHEN p IS NULL OR event_s - p > 1e0 + 1e-12 THEN 1 ELSE 0 END)
                             OVER (PARTITION BY run_id, algorithm ORDER BY event_s, type ROWS UNBOUNDED PRECEDING) AS BIGINT) AS window_no
              FROM (SELECT *, lag(event_s) OVER (PARTITION BY run_id, algorithm ORDER BY event_s, type) AS p FROM jumps))""",
    "windows": """
        SELECT run_id, algorithm, window_id, window_no, min(event_s) AS start_s, max(event_s) AS end_s,
               count(*) AS event_count, max(severity) AS severity, max(position_step_m) AS peak_position_step_m,
               max(yaw_step_deg) AS peak_yaw_step_deg, string_agg(DISTINCT type, ';' ORDER BY type) AS types,
               0.5e0 * (min(event_s) + max(event_s)) AS center_s,
               greatest(0e0, min(event_s) - 0.5e0) AS view_start_s, max(event_s) + 0.5e0 AS view_end_s,
               greatest(0e0, max(event_s) - min(event_s)) AS duration_s
        FROM clustered GROUP BY run_id, algorithm, window_id, window_no""",
    "origin": """
        SELECT run_id, min(timestamp_s) AS origin_s FROM tracks WHERE algorithm = 'algo_0' GROUP BY run_id""",
    "ends": """
        SELECT DISTINCT run_id, algorithm, t_first, t_last FROM seg""",
    "grid": """
        SELECT g.run_id, g.algorithm, g.i, g.t AS timestamp_s, g.t - g.o AS bag_time_s,
               CASE WHEN s.p_t IS NULL OR g.t >= s.timestamp_s THEN s.x_m WHEN g.t <= s.p_t THEN s.p_x ELSE s.p_x + ((g.t - s.p_t) / (s.timestamp_s - s.p_t)) * (s.x_m - s.p_x) END AS x_m,
               CASE WHEN s.p_t IS NULL OR g.t >= s.timestamp_s THEN s.y_m WHEN g.t <= s.p_t THEN s.p_y ELSE s.p_y + ((g.t - s.p_t) / (s.timestamp_s - s.p_t)) * (s.y_m - s.p_y) END AS y_m,
               CASE WHEN s.p_t IS NULL OR g.t >= s.timestamp_s THEN s.z_m WHEN g.t <= s.p_t THEN s.p_z ELSE s.p_z + ((g.t - s.p_t) / (s.timestamp_s - s.p_t)) * (s.z_m - s.p_z) END AS z_m,
               CASE WHEN s.p_t IS NULL OR g.t >= s.timestamp_s THEN s.yaw_u WHEN g.t <= s.p_t THEN s.p_yaw_u ELSE s.p_yaw_u + ((g.t - s.p_t) / (s.timestamp_s - s.p_t)) * (s.yaw_u - s.p_yaw_u) END AS yaw_rad
        FROM (SELECT *, origin_s AS o, origin_s + i * (1e0 / 10e0) AS t, least(origin_s + i * (1e0 / 10e0), t_last) AS tc
              FROM (SELECT *, unnest(generate_series(CAST(ceil((t_first - origin_s) * 10e0 - 1e-9) AS BIGINT),
                                                     CAST(floor((t_last - origin_s) * 10e0 + 1e-9) AS BIGINT))) AS i
                    FROM ends JOIN origin USING (run_id))) g
        ASOF JOIN seg s ON g.run_id = s.run_id AND g.algorithm = s.algorithm AND g.tc <= s.timestamp_s""",
    "kin1": """
        SELECT *, coalesce(sqrt(power(x_m - lag(x_m) OVER w, 2) + power(y_m - lag(y_m) OVER w, 2) + power(z_m - lag(z_m) OVER w, 2)), 0e0) AS delta_position_m,
               coalesce((yaw_rad - lag(yaw_rad) OVER w) * 180e0 / pi(), 0e0) AS signed_deg,
               row_number() OVER w = 1 AS is_first
        FROM grid WINDOW w AS (PARTITION BY run_id, algorithm ORDER BY i)""",
    "timeline": """
        SELECT *, delta_position_m / (1e0 / 10e0) AS speed_mps, signed_deg / (1e0 / 10e0) AS yaw_rate_deg_s,
               abs(signed_deg) AS delta_yaw_deg,
               coalesce((delta_position_m / (1e0 / 10e0) - lag(delta_position_m / (1e0 / 10e0)) OVER w) / (1e0 / 10e0), 0e0) AS acceleration_mps2
        FROM kin1 WINDOW w AS (PARTITION BY run_id, algorithm ORDER BY i)""",
    "tl_med": """
        SELECT run_id, algorithm, median(delta_position_m) AS mp, median(delta_yaw_deg) AS my
        FROM timeline WHERE NOT is_first GROUP BY run_id, algorithm""",
    "tl_limits": """
        SELECT run_id, algorithm,
               greatest(0.5e0, mp + 10e0 * 1.4826e0 * median(abs(delta_position_m - mp))) AS position_threshold_m,
               greatest(10e0, my + 10e0 * 1.4826e0 * median(abs(delta_yaw_deg - my))) AS yaw_threshold_deg
        FROM timeline JOIN tl_med USING (run_id, algorithm) WHERE NOT is_first GROUP BY run_id, algorithm, mp, my""",
    "tl_jumps": """
        SELECT *, CASE type WHEN 'yaw_jump' THEN delta_yaw_deg ELSE delta_position_m END / greatest(threshold, 1e-12) AS severity
        FROM (SELECT *, bag_time_s AS event_s, 'position_jump' AS type, position_threshold_m AS threshold
              FROM timeline JOIN tl_limits USING (run_id, algorithm) WHERE NOT is_first AND delta_position_m > position_threshold_m
              UNION ALL
              SELECT *, bag_time_s, 'yaw_jump', yaw_threshold_deg
              FROM timeline JOIN tl_limits USING (run_id, algorithm) WHERE NOT is_first AND delta_yaw_deg > yaw_threshold_deg)""",
    "tl_clustered": """
        SELECT *, algorithm || ':window_' || printf('%04d', window_no) AS window_id
        FROM (SELECT *, CAST(sum(CASE WHEN p IS NULL OR event_s - p > 1e0 + 1e-12 THEN 1 ELSE 0 END)
                             OVER (PARTITION BY run_id, algorithm ORDER BY event_s, type ROWS UNBOUNDED PRECEDING) AS BIGINT) AS window_no
              FROM (SELECT *, lag(event_s) OVER (PARTITION BY run_id, algorithm ORDER BY event_s, type) AS p FROM tl_jumps))""",
    "tl_windows": """
        SELECT run_id, algorithm, window_id, min(event_s) AS start_s, max(event_s) AS end_s,
               string_agg(DISTINCT type, ';' ORDER BY type) AS types
        FROM tl_clustered GROUP BY run_id, algorithm, window_id""",
    "path": """
        SELECT run_id, algorithm, count(*) AS samples, max(timestamp_s) - min(timestamp_s) AS duration_s,
               coalesce(sum(sqrt(power(x_m - p_x, 2) + power(y_m - p_y, 2) + power(z_m - p_z, 2))), 0e0) AS path_length_m,
               sqrt(power(arg_max(x_m, timestamp_s) - arg_min(x_m, timestamp_s), 2) + power(arg_max(y_m, timestamp_s) - arg_min(y_m, timestamp_s), 2)
                    + power(arg_max(z_m, timestamp_s) - arg_min(z_m, timestamp_s), 2)) AS endpoint_displacement_m,
               max(z_m) - min(z_m) AS z_range_m, arg_max(z_m, timestamp_s) - arg_min(z_m, timestamp_s) AS z_end_delta_m,
               arg_min(z_m, timestamp_s) AS z_start_m, arg_max(z_m, timestamp_s) AS z_end_m,
               min(z_m) AS z_min_m, max(z_m) AS z_max_m,
               degrees(max(roll_rad) - min(roll_rad)) AS roll_range_deg, degrees(max(pitch_rad) - min(pitch_rad)) AS pitch_range_deg
        FROM seg GROUP BY run_id, algorithm""",
    "messages": f"""
        SELECT 'run_0' AS run_id, '/' || event_type AS topic,
               CASE event_type WHEN 'click' THEN 'CustomMsg' WHEN 'view' THEN 'Imu' WHEN 'error' THEN 'Unknown' ELSE 'Odometry' END AS type,
               event_id AS message_id, event_id AS arrival_seq, (epoch_us(ts) - {EPOCH_US}) * 1000 AS recorded_ns, {WALL} AS recorded_s,
               {WALL} - 2e-2 - (event_id % 7) * 3e-3 - CASE WHEN event_id % 83 = 0 THEN 1000e0 ELSE 0e0 END AS header_s,
               'frame_' || (event_id % 3) AS frame_id, ts, value
        FROM events""",
    "msg_dt": """
        SELECT *, recorded_s - lag(recorded_s) OVER w AS recorded_dt_s, header_s - lag(header_s) OVER w AS header_dt_s,
               recorded_s - header_s AS rmh_s
        FROM messages WINDOW w AS (PARTITION BY run_id, topic ORDER BY arrival_seq)""",
    "frames": """
        SELECT run_id, topic, message_id, recorded_ns / 1000000000e0 AS recorded_timestamp_s, header_s AS header_timestamp_s,
               header_s - first_value(header_s) OVER w AS bag_time_s,
               coalesce(recorded_ns < lag(recorded_ns) OVER w, false) AS recorded_backtrack,
               coalesce(header_s < lag(header_s) OVER w, false) AS header_backtrack
        FROM messages WHERE topic = '/click' WINDOW w AS (PARTITION BY run_id, topic ORDER BY message_id)""",
    "samples": f"""
        SELECT 'run_0' AS run_id, 'algo_' || (user_id % 10) AS algorithm, event_id AS seq, {WALL} AS wall_s, value AS cpu_percent,
               1048576 * (100 + CAST(json_extract_string(props, '$.k') AS BIGINT)) AS rss_bytes,
               1 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 8 AS threads, event_id * 10 AS write_bytes
        FROM events""",
    "ship": """
        SELECT 'run_0' AS run_id, 'algo_' || (l_suppkey % 10) AS algorithm, l_orderkey * 8 + l_linenumber AS seq,
               epoch_us(l_shipdate) / 86400000000e0 AS day, l_quantity AS cpu_percent
        FROM lineitem""",
    "anchors": f"""
        SELECT 'run_0' AS run_id, 'algo_' || (user_id % 10) AS algorithm,
               CAST((epoch_us(ts) - {EPOCH_US}) * 1000 AS DOUBLE) * 1e-9 AS w, {WALL} * 1e-4 + 1e-1 AS r
        FROM events WHERE event_id % 10 = 0 AND user_id % 10 < 7""",
    "anchor_seg": """
        SELECT *, lead(w) OVER k AS w1, lead(r) OVER k AS r1 FROM anchors
        WINDOW k AS (PARTITION BY run_id, algorithm ORDER BY w, r)""",
    "mapped": """
        SELECT s.*, a.r + ((s.wall_s - a.w) / (a.w1 - a.w)) * (a.r1 - a.r) AS strict_s
        FROM samples s LEFT JOIN anchor_seg a
          ON s.run_id = a.run_id AND s.algorithm = a.algorithm AND a.w1 IS NOT NULL
         AND s.wall_s >= a.w AND (s.wall_s < a.w1 OR (s.wall_s = a.w1 AND a.w1 = (SELECT max(b.w) FROM anchors b WHERE b.algorithm = a.algorithm)))""",
    "offset_row": """
        SELECT median(rmh_s) AS offset_s, arg_min(recorded_s, arrival_seq) AS recorded_first_s FROM msg_dt WHERE topic = '/click'""",
    "playback": """
        SELECT run_id, algorithm, floor(min(wall_s)) AS playback_s FROM samples WHERE algorithm <> 'algo_9' GROUP BY run_id, algorithm""",
    "aligned": """
        SELECT *, recorded_time_s - offset_s AS trajectory_time_s
        FROM (SELECT m.*, offset_s,
                     CASE WHEN m.algorithm < 'algo_7' THEN 'strict/clock-anchored'
                          WHEN p.playback_s IS NOT NULL THEN 'approximate/lifecycle-aligned' ELSE 'trajectory-only' END AS tier,
                     CASE WHEN m.algorithm < 'algo_7' THEN strict_s
                          ELSE recorded_first_s + (wall_s - p.playback_s) * 1e-4 END AS recorded_time_s
              FROM mapped m CROSS JOIN offset_row LEFT JOIN playback p USING (run_id, algorithm))""",
    "points": """
        SELECT 'run_0' AS run_id, vec_id // 20 AS message_id, vec_id % 20 AS ordinal,
               CAST(CAST(embedding[1] AS DOUBLE) * 20e0 AS FLOAT) AS x, CAST(CAST(embedding[2] AS DOUBLE) * 20e0 AS FLOAT) AS y,
               CAST(CAST(embedding[3] AS DOUBLE) * 20e0 AS FLOAT) AS z, abs(label) * 30 AS reflectivity,
               CASE vec_id % 11 WHEN 0 THEN 32 ELSE 16 END AS tag, vec_id % 4 AS line,
               (vec_id * 7919 % 100000) * 1000 AS offset_ns, (vec_id // 20) * 1e-1 + 30e0 AS header_s,
               CAST(embedding[4] AS DOUBLE) * 200e0 AS raw_intensity, vec_id, label
        FROM embeddings""",
    "cloud": """
        SELECT 'run_0' AS run_id, 'algo_' || label AS algorithm, vec_id AS seq,
               CAST(CAST(embedding[1] AS DOUBLE) * 20e0 AS FLOAT)::DOUBLE AS x, CAST(CAST(embedding[2] AS DOUBLE) * 20e0 AS FLOAT)::DOUBLE AS y,
               CAST(CAST(embedding[3] AS DOUBLE) * 20e0 AS FLOAT)::DOUBLE AS z, CAST(embedding[4] AS DOUBLE) AS intensity
        FROM embeddings""",
    "runs": """
        SELECT 'run_0' AS run_id, 'algo_' || a AS algorithm, a,
               CASE a % 3 WHEN 0 THEN 'lidar_only_odometry' WHEN 1 THEN 'lidar_imu_odometry' ELSE 'full_slam' END AS run_group,
               CASE a WHEN 8 THEN 'RUNTIME_CRASH' ELSE 'SUCCESS' END AS status,
               CASE a WHEN 3 THEN 'retried' END AS reason, CASE a WHEN 8 THEN 139 WHEN 4 THEN -15 WHEN 5 THEN 2 ELSE 0 END AS exit_code,
               messages, CASE a WHEN 6 THEN 300e0 END AS smoke_duration_s
        FROM (SELECT user_id % 10 AS a, count(*) AS messages FROM events GROUP BY 1)""",
    "nominal": """
        SELECT run_id, list_sort(list(path_length_m))[count(*) // 2 + 1] AS nominal_path_m
        FROM path WHERE path_length_m BETWEEN 0 AND 1000 GROUP BY run_id""",
    "health": """
        SELECT *, concat_ws(';', CASE WHEN duration_s < minimum_s THEN 'trajectory_short' END,
                                 CASE WHEN path_length_m > greatest(1000e0, nominal_path_m * 5e0) THEN 'path_divergence' END) AS health_flags,
               status = 'SUCCESS' AND NOT coalesce(duration_s < minimum_s, false)
                 AND NOT coalesce(path_length_m > greatest(1000e0, nominal_path_m * 5e0), false) AS health_valid
        FROM (SELECT r.run_id, r.algorithm, r.run_group, r.status, p.duration_s, p.path_length_m, nominal_path_m,
                     CASE WHEN smoke_duration_s > 0 THEN greatest(0e0, smoke_duration_s - 5e0) ELSE 259e0 * 0.98e0 END AS minimum_s
              FROM runs r LEFT JOIN path p USING (run_id, algorithm) LEFT JOIN nominal USING (run_id))""",
    "lines": """
        SELECT 'run_0' AS run_id, 'algo_' || (doc_id % 10) AS algorithm, source || '.log' AS source, doc_id AS part, line,
               line_text || CASE WHEN doc_id % 13 = 0 THEN ' [ERROR] exception' ELSE '' END
                         || CASE WHEN doc_id % 17 = 0 THEN ' out of memory' ELSE '' END
                         || CASE WHEN doc_id % 19 = 0 THEN ' timestamp went backwards' ELSE '' END AS text
        FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line_text,
                     CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS BIGINT) AS line FROM documents)""",
    "found": r"""
        SELECT run_id, algorithm, source, part, line, severity,
               CASE severity WHEN 'CRITICAL' THEN 'process died or memory ran out'
                             WHEN 'HIGH' THEN 'error, exception or sensor time going back'
                             ELSE 'time synchronisation, deskew or data validity warning' END AS description,
               regexp_replace(text, '^\s+|\s+$', '', 'g') AS text
        FROM (SELECT *, CASE
                WHEN regexp_matches(text, 'NotEnoughMemoryException|terminate called|process has died|segmentation fault|out of memory|\bOOM\b', 'i') THEN 'CRITICAL'
                WHEN regexp_matches(text, '\[(?:ERROR|FATAL|CRITICAL)\]|\b(abort|exception|assert)\b|loop back|lidar loop back|imu loop back', 'i') THEN 'HIGH'
                WHEN regexp_matches(text, 'Excessive time|HARD time lag|timestamps? went backwards|Observation discarded|non-valid|discarded as', 'i') THEN 'MEDIUM' END AS severity
              FROM lines) WHERE severity IS NOT NULL""",
    "found_by": """
        SELECT run_id, algorithm, count(*) AS findings, count(*) FILTER (WHERE severity IN ('CRITICAL', 'HIGH')) AS serious_findings
        FROM found GROUP BY run_id, algorithm""",
    "category": """
        SELECT r.*, CASE WHEN status = 'RUNTIME_CRASH' THEN 'RUNTIME_CRASH' WHEN coalesce(serious_findings, 0) > 0 THEN 'SUCCESS_NEEDS_REVIEW'
                         WHEN coalesce(findings, 0) > 0 OR reason IS NOT NULL THEN 'SUCCESS_WITH_WARNINGS' ELSE 'SUCCESS' END AS category
        FROM runs r LEFT JOIN found_by USING (run_id, algorithm)""",
    "pair": """
        SELECT e.run_id, e.algorithm, e.t_first AS c_first, e.t_last AS c_last, b.t_first AS b_first, b.t_last AS b_last,
               greatest(e.t_first, b.t_first) AS t0, least(e.t_last, b.t_last) AS t1
        FROM ends e JOIN ends b ON e.run_id = b.run_id AND b.algorithm = 'algo_0'""",
}


def pose_sql(queries: str, time: str, base: str | None = None, alias: str = "q", slerp: bool = False) -> str:
    """FROM-able SELECT that adds the clamped interpolated pose to ``queries``."""
    f = f"CASE WHEN s.p_t IS NULL OR {alias}.{time} >= s.timestamp_s THEN 1e0 WHEN {alias}.{time} <= s.p_t THEN 0e0 ELSE ({alias}.{time} - s.p_t) / (s.timestamp_s - s.p_t) END"
    where = f"'{base}'" if base else f"{alias}.algorithm"

    def lin(c: str, p: str) -> str:
        return f"coalesce({p} + ({f}) * ({c} - {p}), {c})"

    return f"""(SELECT {alias}.*, {lin('s.x_m', 's.p_x')} AS px, {lin('s.y_m', 's.p_y')} AS py, {lin('s.z_m', 's.p_z')} AS pz,
                 {lin('s.yaw_u', 's.p_yaw_u')} AS pyaw, ({f}) AS f, s.p_t, s.timestamp_s AS s_t, s.qz AS s_qz, s.qw AS s_qw, s.p_qz, s.p_qw
          FROM (SELECT *, {where.replace(alias + '.', '')} AS seg_algorithm FROM {queries}) {alias}
          ASOF JOIN seg s ON s.run_id = {alias}.run_id AND s.algorithm = {alias}.seg_algorithm AND s.timestamp_s >= {alias}.{time})"""


def sql(body: str) -> str:
    need: list[str] = []

    def visit(text: str, skip: str | None = None) -> None:
        for name in BLOCKS:
            if name != skip and name not in need and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(BLOCKS[name], name)
                need.append(name)

    visit(body)
    head = ",\n".join(f"{n} AS ({BLOCKS[n]})" for n in need)
    return f"WITH {head}\n{body}" if head else body
