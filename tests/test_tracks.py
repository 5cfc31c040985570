"""Tracks, jumps, grids, clocks and phases on hand-built cases."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from odolake.functions.pose import RigidTransform
from odolake.operators import alignment, jumps, phases, profile, resample, resources, tracks
from odolake.operators.chunks import spread
from odolake.operators.keep import keep

RAW = "run_id string, algorithm string, arrival_seq bigint, timestamp_s double, x_m double, y_m double, z_m double, qx double, qy double, qz double, qw double, source_topic string"


def raw(spark, rows, algorithm="a"):
    """rows: (t, x, y, z, yaw)."""
    data = [
        ("r", algorithm, i, float(t), float(x), float(y), float(z), 0.0, 0.0, math.sin(w / 2), math.cos(w / 2), "/o")
        for i, (t, x, y, z, w) in enumerate(rows)
    ]
    return spark.createDataFrame(data, RAW)


def seg(spark, poses, algorithm="a", **kw):
    return keep(tracks.segments(tracks.standardize(raw(spark, poses, algorithm)), **kw))


def test_standardize_case(spark):
    df = raw(spark, [(2, 2, 0, 0, 0), (0, 0, 0, 0, 0), (1, 1, 0, 0, 0), (1, 9, 0, 0, 0)])
    out = tracks.standardize(df).orderBy("timestamp_s").collect()
    assert [(r["timestamp_s"], r["x_m"]) for r in out] == [(1.0, 1.0), (2.0, 2.0)]
    rep = tracks.standardize_report(df).first()
    assert (rep["input_samples"], rep["output_samples"]) == (4, 2)
    assert rep["zero_timestamp_samples_removed"] == rep["duplicate_timestamps_removed"] == rep["input_time_backtracks"] == 1


def test_zero_quaternion_is_rejected(spark):
    df = raw(spark, [(1, 0, 0, 0, 0)]).withColumn("qw", F.lit(0.0))
    assert tracks.standardize(df).count() == 0
    assert tracks.rejected_poses(df).count() == 1


def test_common_window_case(spark):
    std = tracks.standardize(raw(spark, [(t + 1e-9, 0, 0, 0, 0) for t in range(0, 4)], "a")).unionByName(
        tracks.standardize(raw(spark, [(t, 0, 0, 0, 0) for t in range(1, 5)], "b"))
    )
    win = tracks.common_window(std).first()
    assert (round(win["start_s"]), round(win["end_s"]), win["valid"]) == (1, 3, True)


@pytest.mark.parametrize("rows", [5, 100_000])
def test_thinning_follows_arrival_order(spark, rows):
    rng = np.random.default_rng(5)
    t = np.round(np.cumsum(rng.random(150) * 0.4) + rng.normal(0, 0.8, 150) + 5, 3)
    df = raw(spark, [(x, 0, 0, 0, 0) for x in t])
    want, last = [], None
    for i, x in enumerate(t):
        if x == 0 or (last is not None and x - last < 1.0):
            continue
        want.append(i)
        last = x
    got = sorted(r["arrival_seq"] for r in tracks.thin(df, 1.0, rows=rows).collect())
    assert got == want


@pytest.mark.parametrize("min_dt", [0.3, 7.0, 1000.0])
def test_thinning_across_many_chunks(spark, min_dt):
    """Chunks of four rows: the least distance spans none, several or all of them."""
    rng = np.random.default_rng(8)
    t = {"a": np.round(np.cumsum(rng.random(240)), 2) - 60.0, "b": np.round(np.cumsum(rng.random(30) * 9), 2) + 1.0}
    df = raw(spark, [(x, 0, 0, 0, 0) for x in t["a"]], "a").unionByName(raw(spark, [(x, 0, 0, 0, 0) for x in t["b"]], "b"))
    want = []
    for name, times in t.items():
        last = None
        for i, x in enumerate(times):
            if x != 0 and (last is None or x - last >= min_dt):
                want.append((name, i))
                last = x
    got = sorted((r["algorithm"], r["arrival_seq"]) for r in tracks.thin(df, min_dt, rows=4).collect())
    assert got == sorted(want)


def test_least_time_far_enough():
    last = np.array([0.1, -1.0, 1e300, -1e-300, 5.0, 0.3, -0.5, np.inf])
    for d in (0.2, 1.0, 1e-9):
        x = tracks._far_enough(last, d)
        assert (x[:-1] - last[:-1] >= d).all() and (np.nextafter(x, -np.inf)[:-1] - last[:-1] < d).all()


def test_yaw_unwrap_and_relative_steps(spark):
    s = tracks.steps(seg(spark, [(1, 0, 0, 0, 3.13), (2, 0, 0, 0, -3.13), (3, 0, 0, 0, -3.12)]))
    assert s.agg(F.max("yaw_step_deg")).first()[0] < 2.0


def test_unwrap_equals_numpy(spark):
    yaw = np.random.default_rng(2).uniform(-math.pi, math.pi, 80)
    out = seg(spark, [(i + 1, 0, 0, 0, w) for i, w in enumerate(yaw)], rows=9).orderBy("timestamp_s").toPandas()
    np.testing.assert_allclose(out["yaw_u"], np.unwrap(out["yaw_rad"]), atol=1e-9)


def test_position_and_yaw_jumps(spark):
    s = tracks.steps(seg(spark, [(100, 0, 0, 0, 0), (101, 0.1, 0, 0, 0), (102, 0.2, 0, 0, 0), (103, 5.2, 0, 0, 0)]))
    ev = jumps.jump_events(jumps.flagged_steps(s, jumps.thresholds(s))).collect()
    assert [(e["type"], e["event_s"], round(e["position_step_m"], 9)) for e in ev] == [("position_jump", 103.0, 5.0)]
    s = tracks.steps(seg(spark, [(i + 1, 0, 0, 0, w) for i, w in enumerate((0, 0.01, 0.02, 1.0))]))
    ev = jumps.jump_events(jumps.flagged_steps(s, jumps.thresholds(s))).collect()
    assert [e["type"] for e in ev] == ["yaw_jump"] and ev[0]["yaw_step_deg"] > 50


def test_window_clustering_case(spark):
    rows = [("r", "a", 0, t, "position_jump", 0.5, step, 0.0, step / 0.5) for t, step in ((353.10, 0.6), (353.90, 0.85), (356.50, 0.7))]
    ev = spark.createDataFrame(rows, "run_id string, algorithm string, chunk bigint, event_s double, type string, threshold double, position_step_m double, yaw_step_deg double, severity double")
    win = jumps.anomaly_windows(jumps.cluster_events(ev)).orderBy("start_s").collect()
    assert len(win) == 2
    first = win[0]
    assert (first["window_id"], first["event_count"], first["peak_position_step_m"]) == ("a:window_0001", 2, 0.85)
    assert (round(first["view_start_s"], 6), round(first["view_end_s"], 6)) == (352.6, 354.4)


def test_representative_windows_case(spark):
    rows = [
        ("r", "a", "a:1", 9.0, 1.0, ["position_jump"]), ("r", "a", "a:2", 8.0, 2.0, ["position_jump"]),
        ("r", "b", "b:1", 7.0, 1.0, ["yaw_jump"]), ("r", "b", "b:2", 6.0, 2.0, ["position_jump"]),
        ("r", "c", "c:1", 1.0, 1.0, ["position_jump"]), ("r", "c", "c:2", 0.5, 2.0, ["position_jump"]),
        ("r", "a", "a:1", 3.0, 1.0, ["position_jump"]),
    ]
    win = spark.createDataFrame(rows, "run_id string, algorithm string, window_id string, severity double, start_s double, types array<string>")
    sick = spark.createDataFrame([("r", "c")], "run_id string, algorithm string")
    got = jumps.representative_windows(win, sick, 4).orderBy("rank").collect()
    assert [g["window_id"] for g in got] == ["a:1", "a:2", "b:1", "c:1"]


def test_fixed_rate_case(spark):
    s = seg(spark, [(100, 0, 0, 0, 0), (100.05, 0.05, 0, 0, 0), (100.20, 0.2, 0, 0, 0)])
    origin = resample.time_origin(tracks.standardize(raw(spark, [(100, 0, 0, 0, 0)], "algo_0")))
    out = resample.kinematics(resample.resample_fixed_rate(s, origin)).orderBy("i").toPandas()
    np.testing.assert_allclose(out["timestamp_s"], [100.0, 100.1, 100.2])
    np.testing.assert_allclose(out["delta_position_m"], [0, 0.1, 0.1], atol=1e-9)
    np.testing.assert_allclose(out["speed_mps"], [0, 1.0, 1.0], atol=1e-8)


def test_origin_prefers_the_log(spark):
    std = tracks.standardize(raw(spark, [(100, 0, 0, 0, 0)], "algo_0"))
    log = spark.createDataFrame([("r", "/lidar", 90.0)], "run_id string, topic string, header_first_s double")
    row = resample.time_origin(std, log).first()
    assert (row["origin_s"], row["origin_source"]) == (90.0, "log:/lidar:header_first_s")


def test_slerp_midpoint_and_gap(spark):
    s = seg(spark, [(1, 0, 0, 0, 0), (2, 10, 0, 0, math.pi)])
    q = spark.createDataFrame([("r", "a", 1.5), ("r", "a", 1.0), ("r", "a", 2.5)], "run_id string, algorithm string, t double")
    out = {r["t"]: r for r in resample.pose_at(q, s).collect()}
    assert out[1.5]["px"] == 5.0
    assert (round(out[1.5]["pqz"], 9), round(out[1.5]["pqw"], 9)) == (round(math.sin(math.pi / 4), 9), round(math.cos(math.pi / 4), 9))
    assert not out[2.5]["valid"]
    gap = {r["t"]: r["valid"] for r in resample.pose_at(q, s, max_gap_s=0.25).collect()}
    assert gap == {1.5: False, 1.0: True, 2.5: False}
    why = {r["t"]: r["reject_reason"] for r in resample.strict_pose(q, s, 0.25).collect()}
    assert why[1.5] == "pose gap above the limit" and why[2.5] == "outside the pose interval" and why[1.0] is None


def test_rigid_transform_inverse():
    t = RigidTransform((0, -1, 0, 1, 0, 0, 0, 0, 1), (1, 2, 3))
    i = t.inverse()
    r, ri = np.reshape(t.rotation, (3, 3)), np.reshape(i.rotation, (3, 3))
    np.testing.assert_allclose(r @ ri, np.eye(3))
    np.testing.assert_allclose(ri @ np.array(t.translation) + np.array(i.translation), 0, atol=1e-12)


def test_rigid_fit_case(spark):
    e = np.array([[0, 0, 0], [1, 0, 0], [0, 2, 0]], float)
    r = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1]], float)
    t = e @ r.T + [3, 4, 5]
    df = spark.createDataFrame([("p", *map(float, a), *map(float, b)) for a, b in zip(e, t)], "k string, ex double, ey double, ez double, tx double, ty double, tz double")
    m = alignment.fit_moments(df, ["k"])
    for method in ("SE3", "Sim3", "yaw_translation"):
        fit = alignment.solve_fit(m, ["k"], "k string", method)
        row = fit.first()
        assert row["scale"] == pytest.approx(1.0)
        np.testing.assert_allclose([[row[f"r{i}{j}"] for j in range(3)] for i in range(3)], r, atol=1e-12)
        assert alignment.error_set(alignment.apply_fit(df, fit, ["k"]), ["k"]).first()["rmse_m"] < 1e-12
    with pytest.raises(ValueError):
        alignment.solve_fit(m, ["k"], "k string", "other")


ANCHORS = "run_id string, algorithm string, wall_time_ns bigint, ros_time_ns bigint, ros_time_s double"


def test_clock_mapping_case(spark):
    anchors = spark.createDataFrame([("r", "a", 100 * 10**9, None, 1000.0), ("r", "a", 110 * 10**9, None, 1012.0)], ANCHORS)
    s = spark.createDataFrame([("r", "a", x) for x in (105.0, 99.0, 111.0, 100.0, 110.0)], "run_id string, algorithm string, wall_s double")
    got = {r["wall_s"]: r["recorded_time_s"] for r in resources.map_clock(s, anchors).collect()}
    assert got[105.0] == pytest.approx(1006.0) and got[99.0] is None and got[111.0] is None
    assert got[100.0] == 1000.0 and got[110.0] == pytest.approx(1012.0)


def test_alignment_tiers(spark):
    anchors = spark.createDataFrame([("r", "a", 1000 * 10**9, None, 2000.0), ("r", "a", 1010 * 10**9, None, 2010.0)], ANCHORS)
    samples = spark.createDataFrame([("r", x, 1, 1005.0) for x in "abc"], "run_id string, algorithm string, seq bigint, wall_s double")
    events = spark.createDataFrame(
        [("r", "b", 0, "running", "1970-01-01T00:16:50+00:00")], "run_id string, algorithm string, pos int, bag_playback string, at string"
    )
    ev = spark.createDataFrame([("r", 0.2, 3000.0)], "run_id string, offset_s double, recorded_first_s double")
    got = {r["algorithm"]: r for r in resources.align(samples, anchors, events, ev).collect()}
    assert got["a"]["tier"] == resources.STRICT and got["a"]["trajectory_time_s"] == pytest.approx(2004.8)
    assert got["b"]["tier"] == resources.APPROXIMATE and got["b"]["trajectory_time_s"] == pytest.approx(3000 - 5 - 0.2)
    assert got["c"]["tier"] == resources.NO_TIME and got["c"]["trajectory_time_s"] is None


def _brute_merge(states, times, shortest, step):
    states = list(states)

    def runs():
        out, a = [], 0
        for i in range(1, len(states) + 1):
            if i == len(states) or states[i] != states[a]:
                out.append((a, i - 1, states[a]))
                a = i
        return out

    def span(s):
        return max(step, times[s[1]] - times[s[0]] + step)

    while True:
        segs = runs()
        k = next((i for i, s in enumerate(segs) if span(s) < shortest), None)
        if k is None or len(segs) == 1:
            return runs()
        left = segs[k - 1] if k else None
        right = segs[k + 1] if k + 1 < len(segs) else None
        if left is None or (right is not None and left[2] != right[2] and span(left) < span(right)):
            new = right[2]
        else:
            new = left[2]
        for i in range(segs[k][0], segs[k][1] + 1):
            states[i] = new


def test_short_segment_merge_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    step, rows, want = 0.1, [], {}
    for track in range(25):
        n = int(rng.integers(5, 160))
        states = np.repeat(rng.choice(list("ABC"), n), rng.integers(1, 30 if track % 2 else 8, n))[:200]
        times = 5 + step * np.arange(len(states))
        name = f"t{track}"
        rows += [("r", name, int(i // 13), int(i), float(t), str(s), False) for i, (t, s) in enumerate(zip(times, states))]
        want[name] = [(a, b, str(s)) for a, b, s in _brute_merge(states, times, 1.0, step)]
    df = spark.createDataFrame(rows, "run_id string, algorithm string, chunk bigint, i bigint, timestamp_s double, state string, return_near_start boolean")
    out = phases.merge_short(phases.state_segments(df), 1.0, 1 / step).toPandas()
    got = {k: sorted(zip(g.i0, g.i1, g.state)) for k, g in out.groupby("algorithm")}
    assert got == want


def test_static_edges(spark):
    rows, x = [], 0.0
    for i in range(60):
        x += 0.5 if 20 <= i < 40 else 0.0
        rows.append((1 + i * 0.5, x, 0, 0, 0))
    out = phases.build_phases(seg(spark, rows, rows=17), {"resample_hz": 2.0, "min_phase_duration_s": 1.0}).orderBy("phase_no").collect()
    states = [r["state"] for r in out]
    assert states[0] == "PRE_MOTION_STATIC" and states[-1] == "POST_MOTION_STATIC" and "STRAIGHT" in states
    assert out[-1]["is_last"] and all(a["end_s"] == b["start_s"] for a, b in zip(out, out[1:]))


def _moved_by(df):
    """Joins of the plan as it is before any stage has run."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("SortMergeJoin"), plan.count("BroadcastHashJoin")


def test_values_of_tracks_reach_rows_that_stay_where_they_are(spark):
    rows = keep(spark.range(20_000).selectExpr("'r' as run_id", "concat('a', id % 3) as algorithm", "id div 5000 as chunk", "id", "rand(1) as v"))
    values = rows.groupBy("run_id", "algorithm").agg(F.expr("max(id) as top"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 20_000)
    try:
        out = spread(rows, values, tracks.TRACK, tracks.TRACK)
        assert _moved_by(out) == (0, 1)
        assert out.count() == 20_000
        assert {(r["algorithm"], r["top"]) for r in out.select("algorithm", "top").distinct().collect()} == {("a0", 19998), ("a1", 19999), ("a2", 19997)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_turns_are_summed_from_yaws_alone(spark, monkeypatch):
    narrow = []
    real = tracks.running
    monkeypatch.setattr(tracks, "running", lambda df, *a, **b: narrow.append(b["source"].columns) or real(df, *a, **b))
    yaws = [0.9 * k for k in range(40)]  # several turns over several chunks
    out = seg(spark, [(k + 1, k, 0, 0, y) for k, y in enumerate(yaws)], rows=5)
    assert "x_m" not in narrow[0]
    rows = out.orderBy("timestamp_s").select("yaw_u", "p_yaw_u").collect()
    np.testing.assert_allclose([r[0] for r in rows], yaws, atol=1e-6)
    np.testing.assert_allclose([r[1] for r in rows[1:]], yaws[:-1], atol=1e-6)


@pytest.mark.parametrize("rows", [4, 100_000])
def test_pose_lookup_lays_stamps_alone_on_the_line(spark, monkeypatch, rows):
    s = seg(spark, [(t, t * t, -t, 1, 0.1 * t) for t in range(1, 13)])
    twice = s.unionByName(s)  # a pose that comes twice gives its queries no second row
    asked = [0.5, 1.0, 1.25, 7.5, 7.5, 11.75, 12.0, 40.0, None]
    q = spark.createDataFrame([("r", "a", t) for t in asked], "run_id string, algorithm string, t double")
    lines = []
    monkeypatch.setattr(resample, "bracket", lambda *a, f=resample.bracket, **b: lines.append(b["payload"]) or f(*a, **b))
    got = resample.pose_at(q, twice, clamp_ends=True, rotation=False, rows=rows).select("t", "px", "pyaw", "valid").collect()
    assert lines == [[]]
    assert len(got) == len(asked)
    for r in got:
        if r["t"] is None:
            assert not r["valid"] and r["px"] is None
        else:
            assert r["px"] == pytest.approx(np.interp(r["t"], range(1, 13), [t * t for t in range(1, 13)]))
            assert r["pyaw"] == pytest.approx(np.interp(r["t"], range(1, 13), [0.1 * t for t in range(1, 13)]))


def test_clock_counts_reach_samples_that_stay_where_they_are(spark):
    samples = keep(spark.range(20_000).selectExpr("'r' as run_id", "'a' as algorithm", "id as seq", "cast(id as double) as wall_s", "rand(1) as v"))
    anchors = keep(spark.range(2000).selectExpr("'r' as run_id", "'a' as algorithm", "id * 10000000000 as wall_time_ns", "cast(null as bigint) as ros_time_ns", "id * 20.0D as ros_time_s"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 20_000)
    try:
        out = resources.map_clock(samples, anchors)
        assert _moved_by(out)[1] == 1
        assert out.where("recorded_time_s is null and wall_s <= 19990 or abs(recorded_time_s - wall_s * 2) > 1e-6").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_profile_rows_are_built_once(spark, monkeypatch):
    data = [("r", "/t", i, float(i), i - 0.25 * (i % 2), "f") for i in range(6)]
    rows = spark.createDataFrame(data, "run_id string, topic string, arrival_seq bigint, recorded_s double, header_s double, frame_id string")
    real = profile.with_previous
    reads = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(profile, "with_previous", lambda m: real(m).withColumn("rmh_s", F.udf(lambda v: (reads.add(1), v)[1], "double")("rmh_s")))
    row = profile.topic_profile(rows).first()
    assert reads.value == len(data)
    assert (row["messages"], row["rmh_median"], row["header_first_s"]) == (6, 0.125, 0.0)
    assert row["recorded_dt_median"] == 1.0
