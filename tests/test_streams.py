"""Sessions in bounded state, late rows, scans inside their rows."""

import datetime as dt

import pytest

from odolake.operators import points
from odolake.streaming import live

BASE = dt.datetime(2024, 1, 1)


def at(second):
    return BASE + dt.timedelta(seconds=second)


STEPS = "run_id string, algorithm string, ts timestamp, timestamp_s double, position_step_m double, yaw_step_deg double"
LIMITS = "run_id string, algorithm string, position_threshold_m double, yaw_threshold_deg double"


def test_sessions_close_by_the_watermark_and_leave_no_state(spark, tmp_path):
    folder = str(tmp_path / "steps")
    jumps = {"a": [1, 2, 3, 30, 31, 200], "b": [5, 100, 101]}
    rows = [("r", k, at(t), float(t), float(t), 0.0) for k, ts in jumps.items() for t in ts]
    rows += [("r", "a", at(t), float(t), 0.0, 0.0) for t in range(300)]
    for part in range(4):  # four micro-batches in event time
        own = [x for x in rows if part * 75 <= x[3] < (part + 1) * 75]
        spark.createDataFrame(own, STEPS).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(STEPS).option("maxFilesPerTrigger", 1).parquet(folder)
    limits = spark.createDataFrame([("r", "a", 0.5, 1.0), ("r", "b", 0.5, 1.0)], LIMITS)
    sessions, ending = live.jump_sessions(stream, limits, "2 seconds", "10 seconds")
    found = live.drain(sessions, "sessions", ending=ending).collect()  # raises if state is left
    want = {("a", 3, 1.0, 3.0), ("a", 2, 30.0, 31.0), ("a", 1, 200.0, 200.0), ("b", 1, 5.0, 5.0), ("b", 2, 100.0, 101.0)}
    assert {(r.algorithm, r.jump_steps, r.start_s, r.end_s) for r in found} == want and len(found) == 5
    assert max(r.peak_position_step_m for r in found) == 200.0


def test_a_source_without_files_drains_to_nothing(spark, tmp_path):
    folder = tmp_path / "none"
    folder.mkdir()
    stream = spark.readStream.schema(STEPS).parquet(str(folder))
    assert live.drain(stream.select("run_id", "ts"), "none").collect() == []
    assert live.drain(stream.groupBy("run_id").count(), "none", "complete").collect() == []


POSES = "run_id string, algorithm string, ts timestamp, timestamp_s double, x_m double, y_m double, z_m double, qx double, qy double, qz double, qw double, arrival_seq long"


def pose(t, seq, x=0.0):
    return ("r", "a", at(t), float(t), x, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, seq)


def test_every_pose_is_in_the_result_or_late(spark, tmp_path):
    deliveries = [
        [pose(1, 1, 1.0), pose(10, 2), pose(1, 3, 2.0), pose(0, 4)],
        [pose(1, 5), pose(7, 6), pose(9, 0, 9.0), pose(9, 8), pose(10, 1, 5.0), pose(20, 9)],
        [],
        [pose(15, 10), pose(16, 11), pose(20, 12), pose(17, 13), pose(17, 14)],
    ]
    folder, run = str(tmp_path / "in"), None
    run = live.LatePoses(spark.createDataFrame([], POSES).schema, 4.0, str(tmp_path / "out"))
    for d in deliveries:
        spark.createDataFrame(d, POSES).write.mode("append").parquet(folder)
        run.run(spark.readStream.schema(POSES).parquet(folder))
    rows, late = run.result(spark)
    # Behind the watermark: 10 - 4 = 6 for the second delivery, 20 - 4 = 16 for the last one.
    assert sorted(r.arrival_seq for r in late.collect()) == [5, 10, 11]
    got = {r.timestamp_s: (r.copies, r.x_m) for r in rows.collect()}
    assert got == {1.0: (2, 1.0), 7.0: (1, 0.0), 9.0: (2, 9.0), 10.0: (2, 5.0), 17.0: (2, 0.0), 20.0: (2, 0.0)}
    given = sum(p[3] != 0 for d in deliveries for p in d)
    assert sum(c for c, _ in got.values()) + late.count() == given


def test_late_poses_of_nothing(spark, tmp_path):
    run = live.LatePoses(spark.createDataFrame([], POSES).schema, 1.0, str(tmp_path / "out"))
    rows, late = run.result(spark)
    assert rows.collect() == [] and late.collect() == []


POINT = "struct<x:float,y:float,z:float,reflectivity:smallint,tag:smallint,line:smallint,offset_ns:bigint,ordinal:int>"


def test_scans_are_converted_inside_their_rows(spark, tmp_path):
    good = [(1.0, 2.0, 3.0, 7, 16, 1, 500, 0), (1.0, 2.0, 3.0, 8, 0, 2, 100, 1), (1.0, 2.0, 3.0, 9, 16, 3, 100, 2)]
    bad = [(float("nan"), 0.0, 0.0, 1, 16, 0, 1, 3), (float("inf"), 0.0, 0.0, 1, 16, 0, 1, 4), (0.0, 0.0, 0.0, 1, 32, 0, 1, 5)]
    scans = spark.createDataFrame([("r", 1, good + bad), ("r", 2, []), ("r", 3, None), ("r", 4, good[:1])], f"run_id string, message_id long, points array<{POINT}>")
    folder = str(tmp_path / "scans")
    scans.write.parquet(folder)
    stream = spark.readStream.schema(scans.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = live.drain(live.convert_scans(stream), "records").orderBy("message_id", "pos").collect()
    assert [(r.message_id, r.pos, r.ordinal, r.ring, r.intensity) for r in out] == [(1, 0, 1, 2, 8.0), (1, 1, 2, 3, 9.0), (1, 2, 0, 1, 7.0), (4, 0, 0, 1, 7.0)]
    flat = scans.selectExpr("run_id", "message_id", "inline(points)")
    batch = points.convert(flat).orderBy("message_id", "pos").select(*out[0].asDict()).collect()
    assert out == batch


@pytest.mark.parametrize("cuts", [(), (3,), (2, 4, 5)])
def test_steps_do_not_depend_on_the_batches(spark, tmp_path, cuts):
    rows = [("r", k, at(t), float(t), float(t * t), 0.0, 0.0, t * 0.5) for k in ("a", "b") for t in (0, 1, 1, 3, 4, 6, 7)]
    schema = "run_id string, algorithm string, ts timestamp, timestamp_s double, x_m double, y_m double, z_m double, yaw_rad double"
    folder = str(tmp_path / "poses")
    edges = [-1, *cuts, 99]
    for low, high in zip(edges, edges[1:]):
        spark.createDataFrame([x for x in rows if low < x[3] <= high], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = live.drain(live.online_steps(stream), "steps").orderBy("algorithm", "timestamp_s").collect()
    assert [(r.algorithm, r.timestamp_s, r.dt_s, r.position_step_m) for r in out] == [
        (k, float(t), float(t - p), float(t * t - p * p)) for k in ("a", "b") for p, t in ((0, 1), (1, 3), (3, 4), (4, 6), (6, 7))
    ]
    assert all(abs(r.yaw_step_deg - r.dt_s * 0.5 * 57.29577951308232) < 1e-9 for r in out)


LIVE = "run_id string, algorithm string, ts timestamp, timestamp_s double, x_m double, y_m double, z_m double, yaw_rad double"


def test_steps_cross_chunks_and_batches(spark, tmp_path):
    folder = str(tmp_path / "poses")
    batches = [
        [("a", t, 2.0 * t, 0.0) for t in range(1, 21)] + [("a", 5, 10.0, 0.0), (None, 1, 0.0, 3.1), (None, 2, 0.0, -3.1)],
        [("a", 19, 99.0, 0.0), ("a", 20, 99.0, 0.0), ("a", 23, 49.0, 0.0), ("b", 1, 0.0, 0.0), (None, 4, None, -3.1), ("a", None, 1.0, 1.0)],
        [("b", 3, 0.0, 0.5)],
    ]
    steps = live.OnlineSteps(str(tmp_path / "out"), rows=4)
    for rows in batches:
        at_ = [("r", k, at(t or 0), None if t is None else float(t), x, 0.0, 0.0, yaw) for k, t, x, yaw in rows]
        spark.createDataFrame(at_, LIVE).coalesce(1).write.mode("append").parquet(folder)
        steps.run(spark.readStream.schema(LIVE).parquet(folder))
    got = {(r.algorithm, r.timestamp_s): r for r in steps.result(spark).collect()}
    assert len(got) == 19 + 1 + 1 + 2 == steps.result(spark).count()
    assert all((got["a", t].dt_s, got["a", t].position_step_m) == (1.0, 2.0) for t in range(2, 21))
    assert (got["a", 23].dt_s, got["a", 23].position_step_m) == (3.0, 9.0)
    assert got["b", 3].dt_s == 2.0 and got["b", 3].yaw_step_deg == pytest.approx(28.647889756541162)
    assert got[None, 2].yaw_step_deg == pytest.approx(4.766, abs=1e-3) and got[None, 2].ts == at(2)
    assert got[None, 4].dt_s == 2.0 and got[None, 4].position_step_m is None
