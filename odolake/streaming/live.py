"""Live tables as Structured Streaming plans.

Aggregations keep one small state row per key. Exact medians need all values,
so jump thresholds come from a batch table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.pose import QUAT, quat_norm, roll_pitch_yaw
from ..operators.chunks import CHUNK, ROWS_PER_CHUNK, with_chunk
from ..operators.keep import discard, keep
from ..operators.points import SCAN, TAG_MASK, TAG_OK
from ..operators.tracks import ANGLES, POSE, STEP, TRACK
from ..session import shared_dir


# Bounds a micro-batch, and with it what one keyed step function sees at a time.
FILES_PER_BATCH = 64


END = "9999-01-01 00:00:00"
"""The event time that ends an input."""


def has_files(spark: SparkSession, folder: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class Ending:
    """An empty second source; the one row that ``close`` puts there passes the watermark over all that is open."""

    def __init__(self, stream: DataFrame, event_time: str):
        self.spark, self.schema, self.event_time = stream.sparkSession, stream.schema, event_time
        self.folder = f"{shared_dir(self.spark)}/stream-end-{uuid.uuid4().hex}"
        self.spark.createDataFrame([], self.schema).write.parquet(self.folder)

    def follow(self, stream: DataFrame, delay: str) -> DataFrame:
        """The stream under a watermark, ready to be closed. The last row itself never gets past it."""
        last = self.spark.readStream.schema(self.schema).parquet(self.folder)
        return stream.unionByName(last).withWatermark(self.event_time, delay).where(F.col(self.event_time) < F.lit(END).cast("timestamp"))

    def close(self) -> None:
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name != self.event_time]
        row = self.spark.range(1).select(*nothing, F.lit(END).cast("timestamp").alias(self.event_time))
        row.select(*self.schema.names).write.mode("append").parquet(self.folder)


def drain(stream: DataFrame | StepPlan, name: str, mode: str = "append", keys: list[str] | None = None, ending: Ending | None = None) -> DataFrame:
    """Process everything available into a table of the shared folder.

    Append results go through the file sink; windows still open at the end of
    the input are not among them, unless ``ending`` closes them: the query is
    then resumed from its checkpoint once more and must end with an empty state.
    Complete and update results are written per batch and hold open windows too:
    for ``complete`` the last batch is the result, for ``update`` the last row of
    every key. A plan of steps becomes the table of its ``OnlineSteps``.
    """
    if isinstance(stream, StepPlan):
        spark = stream.poses.sparkSession
        steps = OnlineSteps(f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}")
        steps.run(stream.poses)
        return steps.result(spark)
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        sink = writer.outputMode("append").format("parquet").option("path", f"{base}/rows")
        sink.start().awaitTermination()
        if ending:
            ending.close()
            query = sink.start()
            query.awaitTermination()
            left = sum(op["numRowsTotal"] for op in (query.lastProgress or {"stateOperators": []})["stateOperators"])
            if left:
                raise RuntimeError(f"{left} rows of state are left behind the end of the input")
        if not has_files(spark, f"{base}/rows"):
            return spark.createDataFrame([], stream.schema)
        return spark.read.schema(stream.schema).parquet(f"{base}/rows")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={epoch}")

    query = writer.outputMode(mode).foreachBatch(write).start()
    query.awaitTermination()
    if not has_files(spark, f"{base}/rows"):
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.parquet(f"{base}/rows")
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        rows = rows.where(F.col("batch") == last)
    elif keys:
        cols = [c for c in rows.columns if c != "batch"]
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("r"))
        return newest.select(*(F.col(f"r.{c}").alias(c) for c in cols))
    return rows.drop("batch")


def resource_running(samples: DataFrame) -> DataFrame:
    """Mean and peak figures so far and the latest sample per track."""
    return samples.groupBy(*TRACK).agg(
        F.expr("count(*) as samples"),
        F.expr("avg(cpu_percent) as mean_cpu_percent"),
        F.expr("max(cpu_percent) as peak_cpu_percent"),
        F.expr("max(rss_bytes) / 1048576.0D as peak_rss_mib"),
        F.expr("max(threads) as peak_threads"),
        F.expr("max_by(cpu_percent, struct(wall_s, seq)) as latest_cpu_percent"),
    )


def topic_rates(messages: DataFrame, width: str = "1 second", delay: str = "10 seconds") -> DataFrame:
    """Tumbling message counts per topic."""
    return (
        messages.withWatermark("ts", delay)
        .groupBy("run_id", "topic", F.window("ts", width).alias("w"))
        .agg(F.expr("count(*) as messages"))
        .selectExpr("run_id", "topic", "w.start as window_start", "w.end as window_end", "messages")
    )


STANDARD_KEY = [*TRACK, "timestamp_s"]


def standardize(poses: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Drop zero stamps, keep the first arrival of each stamp, normalize, add RPY.

    ``poses`` needs ``ts`` (event time) and ``arrival_seq``. A stamp is one small
    state row until the watermark has passed it; in update mode it is given again
    should an earlier arrival of it come in a later batch, so ``drain`` takes the
    last row per STANDARD_KEY. ``copies`` counts the arrivals of the stamp.
    """
    first = (
        poses.where("timestamp_s <> 0")
        .withWatermark("ts", delay)
        .groupBy(*STANDARD_KEY, "ts")
        .agg(F.min_by(F.struct(*POSE[1:]), "arrival_seq").alias("r"), F.expr("count(*) as copies"))
        .select(*STANDARD_KEY, "r.*", "copies")
    )
    quat = [F.col(q) for q in QUAT]
    norm = quat_norm(quat)
    unit = first.where(norm >= 1e-12).select(
        *STANDARD_KEY, "x_m", "y_m", "z_m", *((F.col(q) / norm).alias(q) for q in QUAT), "copies"
    )
    return unit.select("*", *(a.alias(n) for a, n in zip(roll_pitch_yaw(quat), ANGLES)))


def _with(schema: T.StructType, **more: str) -> T.StructType:
    added = T.StructType()
    for name, kind in more.items():
        added.add(name, kind)
    return T.StructType([*schema.fields, *added.fields])


class LatePoses:
    """First arrivals of every stamp, and the poses that came too late, as tables.

    The watermark is the greatest event time of the epochs before, less ``delay_s``.
    A pose at or behind it goes to the late table; any other one meets the open
    stamps, which are the state: one row for each stamp ahead of the watermark.
    Stamps that the watermark has passed are closed and written. Every epoch
    writes tables of its own number, so one that is repeated after a failure
    leaves what it would have left. Rows with a zero stamp are dropped, as by
    ``standardize``; every other row is counted in ``copies`` or is late.
    """

    def __init__(self, schema, delay_s: float, base: str):
        self.schema, self.delay_us, self.base = schema, int(delay_s * 1e6), base

    def _table(self, spark: SparkSession, kind: str, epoch: int) -> DataFrame | None:
        path = f"{self.base}/{kind}/epoch={epoch}"
        return spark.read.parquet(path) if has_files(spark, path) else None

    @staticmethod
    def _first(poses: DataFrame) -> DataFrame:
        row = F.struct(*POSE[1:], "arrival_seq")
        first = poses.groupBy(*STANDARD_KEY, "ts").agg(F.min_by(row, "arrival_seq").alias("r"), F.sum("copies").alias("copies"))
        return first.select(*STANDARD_KEY, "ts", "r.*", "copies")

    def step(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        marks = self._table(spark, "mark", epoch - 1)
        top = marks.first()[0] if marks is not None else None
        us = F.unix_micros("ts")
        late = us <= top - self.delay_us if top is not None else F.lit(False)
        path = f"{self.base}/split/epoch={epoch}"
        batch.where("timestamp_s <> 0").withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(path)
        split = spark.read.schema(_with(batch.schema, late="boolean")).parquet(path)
        fresh = split.where("not late").drop("late")
        seen = fresh.agg(F.max(us)).first()[0]
        top = max((t for t in (top, seen) if t is not None), default=None)
        poses = fresh.select(*STANDARD_KEY, "ts", *POSE[1:], "arrival_seq", F.lit(1).cast("bigint").alias("copies"))
        state = self._table(spark, "open", epoch - 1)
        stamps = self._first(poses if state is None else poses.unionByName(state))
        passed = us <= top - self.delay_us if top is not None else F.lit(False)
        stamps.where(passed).write.mode("overwrite").parquet(f"{self.base}/closed/epoch={epoch}")
        stamps.where(~passed).write.mode("overwrite").parquet(f"{self.base}/open/epoch={epoch}")
        spark.range(1).select(F.lit(top).cast("bigint").alias("top_us")).write.mode("overwrite").parquet(f"{self.base}/mark/epoch={epoch}")
        self.epoch = epoch

    def run(self, stream: DataFrame) -> None:
        """Process what is available; further calls go on from there."""
        writer = stream.writeStream.option("checkpointLocation", f"{self.base}/checkpoint").trigger(availableNow=True)
        writer.foreachBatch(self.step).start().awaitTermination()

    def result(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(one row per stamp, late poses); stamps still open are given as they stand."""
        epochs = [] if not has_files(spark, f"{self.base}/mark") else [r[0] for r in spark.read.parquet(f"{self.base}/mark").select("epoch").distinct().collect()]
        if not epochs:
            late = spark.createDataFrame([], self.schema)
            return self._first(late.withColumn("copies", F.lit(1).cast("bigint"))).drop("arrival_seq"), late
        last = max(epochs)
        closed = spark.read.parquet(f"{self.base}/closed").where(F.col("epoch") <= last).drop("epoch")
        stamps = closed.unionByName(self._table(spark, "open", last)).drop("arrival_seq")
        rows = spark.read.schema(_with(self.schema, epoch="integer", late="boolean")).parquet(f"{self.base}/split")
        return stamps, rows.where("late").drop("late", "epoch")


def conversion_counters(points: DataFrame) -> DataFrame:
    """Running totals of a point stream already flagged for validity."""
    return points.groupBy("run_id").agg(
        F.expr("count(*) as input_points"),
        F.expr("count_if(tag_ok and xyz_ok) as output_points"),
        F.expr("count_if(not tag_ok) as invalid_tag_points"),
        F.expr("count_if(tag_ok and not xyz_ok) as non_finite_points"),
    )


def convert_scans(scans: DataFrame) -> DataFrame:
    """Output records of scans that arrive whole: one row per valid point, in time order.

    A scan is a row with ``points``, an array of structs. It is checked, put in the
    order of (offset, ordinal) and mapped inside its row, so nothing is kept between
    batches and nothing is shuffled. A null or empty scan has no record.
    """
    finite_ = " and ".join(f"not isnan(p.{c}) and abs(p.{c}) < double('infinity')" for c in "xyz")
    tags = ", ".join(map(str, TAG_OK))
    good = f"filter(points, p -> (p.tag & {TAG_MASK}) in ({tags}) and {finite_})"
    # A field order that sorts by offset, then ordinal.
    ordered = f"array_sort(transform({good}, p -> struct(p.offset_ns, p.ordinal, p.x, p.y, p.z, p.reflectivity, p.line)))"
    return scans.selectExpr(*SCAN, f"posexplode({ordered}) as (pos, p)").selectExpr(
        *SCAN, "cast(pos as bigint) as pos", "p.x", "p.y", "p.z", "cast(p.reflectivity as float) as intensity", "cast(p.line as int) as ring",
        "cast(cast(p.offset_ns as float) * cast(1e-9 as float) as float) as time", "p.offset_ns", "p.ordinal",
    )


def heartbeat(events: DataFrame) -> DataFrame:
    """Latest event per run and the seconds since its phase began."""
    return events.groupBy("run_id").agg(
        F.expr("max_by(event, struct(wall_s, pos)) as last_event"),
        F.expr("max_by(state, struct(wall_s, pos)) as state"),
        F.expr("max(wall_s) - max_by(phase_started_s, struct(wall_s, pos)) as phase_elapsed_s"),
        F.expr("max(wall_s) - min(wall_s) as elapsed_s"),
    )


ANCHOR_OUT = "run_id string, wall_time_ns bigint, ros_time_ns bigint, sequence bigint, wall_backtracks bigint, ros_backtracks bigint"
ANCHOR_STATE = "wall bigint, ros bigint, sequence bigint, wall_back bigint, ros_back bigint"


def throttle_anchors(clock: DataFrame, min_interval_s: float = 0.1) -> DataFrame:
    """Keep a clock reading only if enough wall time passed since the last kept one.

    State is the last kept pair, its number and the backtrack counters. Rows of
    a batch are taken in arrival order (``seq``).
    """
    gap = int(min_interval_s * 1e9)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        wall, ros, n, wall_back, ros_back = state.get if state.exists else (None, None, 0, 0, 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for w, r in zip(rows["wall_time_ns"], rows["ros_time_ns"]):
            if wall is not None and w - wall < gap:
                continue
            wall_back += int(wall is not None and w < wall)
            ros_back += int(ros is not None and r < ros)
            out.append((key[0], int(w), int(r), n, wall_back, ros_back))
            wall, ros, n = int(w), int(r), n + 1
        if wall is not None:
            state.update((wall, ros, n, wall_back, ros_back))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ANCHOR_OUT.split(", ")])

    return clock.groupBy("run_id").applyInPandasWithState(
        step, ANCHOR_OUT, ANCHOR_STATE, "append", GroupStateTimeout.NoTimeout
    )


STEP_OUT = (
    "run_id string, algorithm string, ts timestamp, timestamp_s double, dt_s double,"
    " position_step_m double, yaw_step_deg double"
)
STATE = ["timestamp_s", "x_m", "y_m", "z_m", "yaw_rad"]


def _beside_track(rows: DataFrame, other: DataFrame, *more: str) -> DataFrame:
    """``rows`` with the columns of their track's row of ``other``; a track without a name is one as well."""
    on = [*TRACK, *more]
    named = other.withColumnsRenamed({c: f"__{c}" for c in on})
    return rows.join(named, F.expr(" and ".join(f"{c} <=> __{c}" for c in on)), "left").drop(*(f"__{c}" for c in on))


class OnlineSteps:
    """Steps between consecutive poses of live tracks, as a table; late poses are skipped.

    The state is the last pose of every track. Poses of a micro-batch are cut into
    chunks of their tracks' time order and the last pose of a chunk is carried to the
    next one, so a task sees one chunk, however many poses of a track arrive at once.
    Every epoch writes tables of its own number, so one that is repeated after a
    failure leaves what it would have left.
    """

    def __init__(self, base: str, rows: int = ROWS_PER_CHUNK):
        self.base, self.rows = base, rows

    def step(self, batch: DataFrame, epoch: int) -> None:
        spark, before = batch.sparkSession, f"{self.base}/state/epoch={epoch - 1}"
        last = spark.read.parquet(before) if has_files(spark, before) else None
        # Only poses ahead of all before them count: one of each stamp, none behind the state.
        ahead = batch.where("timestamp_s is not null and not isnan(timestamp_s)")
        ahead = ahead.groupBy(*TRACK, "timestamp_s").agg(F.min(F.struct(*STATE[1:], "ts")).alias("r")).select(*TRACK, "timestamp_s", "r.*")
        if last is not None:
            ahead = _beside_track(ahead, last).where("last is null or timestamp_s > last.timestamp_s").drop("last")
        ahead = keep(ahead, "ahead")
        poses = with_chunk(ahead, TRACK, "timestamp_s", rows=self.rows)
        pose = F.struct(*STATE)
        ends = poses.groupBy(*TRACK, CHUNK).agg(F.max_by(pose, "timestamp_s").alias("end"))
        carry = ends.select(*TRACK, CHUNK, F.lag("end").over(Window.partitionBy(*TRACK).orderBy(CHUNK)).alias("came"))
        if last is not None:
            carry = _beside_track(carry, last).withColumn("came", F.coalesce("came", "last")).drop("last")
        inside = Window.partitionBy(*TRACK, CHUNK).orderBy("timestamp_s")
        out = _beside_track(poses.withColumn("p", F.lag(pose).over(inside)), carry, CHUNK).withColumn("p", F.coalesce("p", "came"))
        turn = f"pmod(yaw_rad - p.yaw_rad + {np.pi!r}D, {2 * np.pi!r}D) - {np.pi!r}D"
        steps = out.where("p is not null").selectExpr(
            *TRACK, "ts", "timestamp_s", "timestamp_s - p.timestamp_s as dt_s",
            f"nullif({STEP}, double('NaN')) as position_step_m", f"nullif(degrees(abs({turn})), double('NaN')) as yaw_step_deg",
        )
        steps.write.mode("overwrite").parquet(f"{self.base}/rows/epoch={epoch}")
        state = ends.select(*TRACK, F.col("end").alias("last"))
        state = (state if last is None else state.unionByName(last)).groupBy(*TRACK).agg(F.max_by("last", "last.timestamp_s").alias("last"))
        state.write.mode("overwrite").parquet(f"{self.base}/state/epoch={epoch}")
        discard(ahead, poses)

    def run(self, stream: DataFrame) -> None:
        """Process what is available; further calls go on from there."""
        writer = stream.writeStream.option("checkpointLocation", f"{self.base}/checkpoint").trigger(availableNow=True)
        writer.foreachBatch(self.step).start().awaitTermination()

    def result(self, spark: SparkSession) -> DataFrame:
        if not has_files(spark, f"{self.base}/rows"):
            return spark.createDataFrame([], STEP_OUT)
        return spark.read.schema(f"{STEP_OUT}, epoch int").parquet(f"{self.base}/rows").drop("epoch")


@dataclass(frozen=True)
class StepPlan:
    """A pose stream whose steps ``drain`` takes through ``OnlineSteps``."""

    poses: DataFrame


def online_steps(poses: DataFrame) -> StepPlan:
    """Steps between consecutive poses of a live track, to be drained."""
    return StepPlan(poses)


def jump_sessions(steps: DataFrame, limits: DataFrame, gap: str = "1 second", delay: str = "10 seconds") -> tuple[DataFrame, Ending]:
    """Windows of jumps per track from a step stream and a threshold table, and the ending that closes the last ones.

    A session closes after ``gap`` without a jump, once the watermark has passed
    it; then it leaves the state, which holds one row per open session.
    """
    hits = steps.join(limits, TRACK).where(
        "position_step_m > position_threshold_m or yaw_step_deg > yaw_threshold_deg"
    ).select(*TRACK, "ts", "timestamp_s", "position_step_m", "yaw_step_deg")
    ending = Ending(hits, "ts")
    sessions = (
        ending.follow(hits, delay)
        .groupBy(*TRACK, F.session_window("ts", gap).alias("w"))
        .agg(
            F.expr("count(*) as jump_steps"),
            F.expr("max(position_step_m) as peak_position_step_m"),
            F.expr("max(yaw_step_deg) as peak_yaw_step_deg"),
            F.expr("min(timestamp_s) as start_s"),
            F.expr("max(timestamp_s) as end_s"),
        )
        .drop("w")
    )
    return sessions, ending


def stream_table(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A parquet file of a folder as a stream."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", f"{name}.parquet")
        .option("maxFilesPerTrigger", FILES_PER_BATCH)
        .parquet(folder)
    )
