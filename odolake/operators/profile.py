"""Message-log profiling: topics, rates, offsets, frame index, contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import nearest
from .chunks import neighbour, spread, with_seq_chunk
from .keep import keep
from .points import SCAN, _scan_chunks
from .quantiles import Stat, column_quantiles

TOPIC = ["run_id", "topic"]


def series_stats(rows: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """Count, mean, median, population std, minimum and maximum per column.

    ``values`` maps a column to the prefix of its result names.
    """
    aggs = [
        F.expr(f"{f}({c}) as {p}_{n}")
        for c, p in values.items()
        for n, f in (("count", "count"), ("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))
    ]
    med = column_quantiles(rows, keys, {c: [Stat(f"{p}_median")] for c, p in values.items()})
    return rows.groupBy(*keys).agg(*aggs).join(med, keys, "left")


def with_previous(messages: DataFrame) -> DataFrame:
    rows = with_seq_chunk(messages, "arrival_seq")
    return neighbour(rows, TOPIC, ["arrival_seq"], ["recorded_s", "header_s"], "p").selectExpr(
        "*", "recorded_s - p.recorded_s as recorded_dt_s", "header_s - p.header_s as header_dt_s",
        "recorded_s - header_s as rmh_s",
    )


def first_transform(messages: DataFrame, parents: tuple[str, ...], children: tuple[str, ...]) -> DataFrame:
    """The first transform of each message whose parent and child are among the accepted ones.

    ``messages`` has ``transforms array<struct<parent, child, ...>>``; messages
    without a match drop out.
    """
    hit = F.filter("transforms", lambda t: t["parent"].isin(*parents) & t["child"].isin(*children))
    out = messages.withColumn("transform", F.get(hit, F.lit(0))).where("transform is not null")
    return out.drop("transforms")


def topic_profile(messages: DataFrame) -> DataFrame:
    """Counts, frame ids, first and last stamps, reversals and offset stats.

    ``messages`` needs ``recorded_s, header_s, frame_id, arrival_seq``. The
    frame ids of a topic are a handful of names.
    """
    # Read by the counts and by every pass of the medians, so it is written once.
    offsets = ["recorded_dt_s", "header_dt_s", "rmh_s"]
    rows = keep(with_previous(messages).select(*TOPIC, "arrival_seq", "frame_id", "recorded_s", "header_s", *offsets), "profile_rows")
    base = rows.groupBy(*TOPIC).agg(
        F.expr("count(*) as messages"),
        F.expr("array_join(array_sort(collect_set(frame_id)), ';') as frame_ids"),
        F.expr("min_by(recorded_s, arrival_seq) as recorded_first_s"),
        F.expr("max_by(recorded_s, arrival_seq) as recorded_last_s"),
        F.expr("min_by(header_s, arrival_seq) as header_first_s"),
        F.expr("max_by(header_s, arrival_seq) as header_last_s"),
        F.expr("count_if(recorded_dt_s <= 0) as recorded_time_reversals"),
        F.expr("count_if(header_dt_s <= 0) as header_time_reversals"),
    )
    stats = series_stats(
        rows, TOPIC, {"recorded_dt_s": "recorded_dt", "header_dt_s": "header_dt", "rmh_s": "rmh"}
    )
    return base.join(stats, TOPIC, "left")


def unavailable_topics(messages: DataFrame, known_types: DataFrame) -> DataFrame:
    """Topics whose type has no reader, with their message counts."""
    return (
        messages.groupBy("run_id", "topic", "type")
        .agg(F.expr("count(*) as messages"))
        .join(known_types, "type", "left_anti")
    )


def topic_rates(messages: DataFrame, width: str = "1 second") -> DataFrame:
    """Messages per topic and tumbling window."""
    return (
        messages.groupBy(*TOPIC, F.window("ts", width).alias("w"))
        .agg(F.expr("count(*) as messages"), F.expr("avg(value) as mean_value"))
        .selectExpr(*TOPIC, "w.start as window_start", "messages", "mean_value")
    )


def sensor_skew(lidar: DataFrame, imu: DataFrame, rows: int | None = None) -> DataFrame:
    """LiDAR header time minus the nearest IMU header time (later one on a tie)."""
    out = nearest(
        lidar, imu, ["run_id"], t="header_s", sample_t="header_s", order=["seq"], payload=["seq"],
        tie="later", **({"rows": rows} if rows else {}),
    )
    return out.selectExpr(*lidar.columns, "header_s - hit.t as lidar_minus_imu_s")


def first_topics(inventory: DataFrame, lidar_types: list[str], imu_types: list[str]) -> DataFrame:
    """First LiDAR and IMU topic by type in inventory order, and all messages."""

    def pick(types: list[str], name: str):
        listed = ", ".join(f"'{t}'" for t in types)
        return F.expr(f"min_by(topic, case when type in ({listed}) then pos end) as {name}")

    return inventory.groupBy("run_id").agg(
        pick(lidar_types, "lidar_topic"),
        pick(imu_types, "imu_topic"),
        F.expr("sum(messages) as message_count"),
    )


def frame_index(messages: DataFrame, origin: DataFrame | None) -> DataFrame:
    """Id, recorded, header and bag time of each frame with backtrack flags.

    Without an origin the first frame's header is used. The payload column is
    never read.
    """
    rows = messages.select("run_id", "topic", "message_id", "recorded_ns", "header_s")
    rows = with_seq_chunk(rows, "message_id")
    prev = neighbour(rows, TOPIC, ["message_id"], ["recorded_ns", "header_s"], "p")
    first = rows.groupBy("run_id").agg(F.expr("min_by(header_s, message_id) as first_header_s"))
    if origin is not None:
        first = first.join(origin.select("run_id", "origin_s"), "run_id", "left").selectExpr(
            "run_id", "coalesce(origin_s, first_header_s) as o"
        )
    else:
        first = first.withColumnRenamed("first_header_s", "o")
    return spread(prev, first, ["run_id"], TOPIC).selectExpr(
        "run_id",
        "topic",
        "message_id",
        "recorded_ns / 1000000000.0D as recorded_timestamp_s",
        "header_s as header_timestamp_s",
        "header_s - o as bag_time_s",
        "coalesce(recorded_ns < p.recorded_ns, false) as recorded_backtrack",
        "coalesce(header_s < p.header_s, false) as header_backtrack",
    )


def point_time_profile(points: DataFrame) -> DataFrame:
    """Per-run scan ranges, in-order backtracks and counts per line."""


    prev = neighbour(_scan_chunks(points, "ordinal"), SCAN, ["ordinal"], ["offset_ns"], "p")
    scans = prev.groupBy(*SCAN).agg(
        F.expr("(max(offset_ns) - min(offset_ns)) * 1e-9D as range_s"),
        F.expr("count_if(offset_ns < p.offset_ns) as backtracks"),
    )
    lines = points.groupBy("run_id", "line").agg(F.expr("count(*) as n")).groupBy("run_id").agg(
        F.expr(
            "array_join(transform(array_sort(collect_list(struct(line, n))),"
            " e -> concat(e.line, ':', e.n)), ';') as line_counts"
        )
    )
    back = scans.groupBy("run_id").agg(F.expr("sum(backtracks) as input_order_time_backtracks"))
    return series_stats(scans, ["run_id"], {"range_s": "frame_range"}).join(back, "run_id").join(lines, "run_id")


def input_contract(totals: DataFrame, topics: DataFrame, declared: DataFrame) -> DataFrame:
    """Pass/fail rows: topic types as declared, known units, clean point times.

    ``declared`` has one row per run with ``kind, topic, type`` rows and units.
    """
    typed = (
        declared.join(
            topics.select("run_id", "topic", F.col("type").alias("actual")), ["run_id", "topic"], "left"
        )
        .selectExpr("run_id", "concat('topic:', kind) as check", "coalesce(actual = type, false) as ok")
    )
    units = declared.where("kind = 'imu'").selectExpr(
        "run_id", "'imu_acceleration_unit' as check", "coalesce(unit in ('g', 'm/s^2'), false) as ok"
    )
    times = declared.where("kind = 'lidar'").selectExpr(
        "run_id", "'point_time_contract' as check",
        "coalesce(time_contract <> '' and not contains(time_contract, 'UNRESOLVED'), false) as ok",
    )
    clean = totals.selectExpr(
        "run_id", "'point_time_validation' as check",
        "output_time_backtracks = 0 and non_finite_points = 0 as ok",
    )
    return typed.unionByName(units).unionByName(times).unionByName(clean)
