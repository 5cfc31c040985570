"""Clouds, nearest points, scan points, health and selection."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from odolake.operators import frames, maps, points, report

CLOUD = "run_id string, algorithm string, seq bigint, x float, y float, z float, intensity float"


def cloud(spark, **clouds):
    rows = [
        ("r", name, i, *(float(v) for v in p), 0.0) for name, pts in clouds.items() for i, p in enumerate(pts)
    ]
    return spark.createDataFrame(rows, CLOUD)


def test_robust_extent_case(spark):
    pts = [(0, 0, 0)] * 500 + [(10, 20, 30)] * 500 + [(1000, 1000, 1000)]
    row = maps.map_extents(cloud(spark, a=pts)).first()
    assert (row["robust_x_m"], row["robust_y_m"], row["robust_z_m"]) == (10, 20, 30)


def test_voxel_iou_cases(spark):
    base = [(0.1, 0.1, 0.1), (3, 3, 3)]
    got = maps.voxel_iou(cloud(spark, b=base, same=base, far=[(x + 100, y, z) for x, y, z in base]), "b", 0.5)
    assert {r["algorithm"]: r["baseline_voxel_iou"] for r in got.collect()} == {"b": 1.0, "same": 1.0, "far": 0.0}


def test_symmetric_nn_case(spark):
    c = cloud(spark, b=[(0, 0, 0), (10, 0, 0)], a=[(1, 0, 0), (11, 0, 0)])
    row = maps.nn_metrics(maps.symmetric_nn(c, "b")).first()
    assert (row["nn_mean_m"], row["nn_rmse_m"], row["nn_p95_m"], row["samples_reference"]) == (1.0, 1.0, 1.0, 2)


def test_nn_is_exact_on_crowded_and_far_points(spark):
    """A third of the points crowd one spot, many are copies, some are far off."""
    rng = np.random.default_rng(4)
    crowd = rng.normal(0, 1e-3, (150, 3))
    base = np.vstack([crowd, np.repeat([[5.0, 5, 5]], 60, 0), rng.uniform(-50, 50, (90, 3))]).astype("float32")
    other = np.vstack([rng.normal(0.5, 1e-3, (120, 3)), rng.uniform(-5e4, 5e4, (20, 3)), crowd[:10]]).astype("float32")
    d = maps.symmetric_nn(cloud(spark, b=base, a=other), "b").toPandas()
    a, b = other.astype(float), base.astype(float)
    full = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    want = np.sort(np.concatenate([full.min(1), full.min(0)]))
    got = np.sort(np.repeat(d["dist_m"].to_numpy(), d["copies"].to_numpy()))
    np.testing.assert_allclose(got, want, atol=1e-9)
    m = maps.nn_metrics(maps.symmetric_nn(cloud(spark, b=base, a=other), "b")).first()
    assert m["nn_p95_m"] == pytest.approx(np.percentile(want, 95))


def test_map_health_case(spark):
    rows = [("r", "b", 10.0, 1.0, None), ("r", "bad", 25.0, 0.05, 3.0), ("r", "good", 12.0, 0.5, 0.4)]
    df = spark.createDataFrame(rows, "run_id string, algorithm string, robust_z_m double, baseline_voxel_iou double, nn_p95_m double")
    got = {r["algorithm"]: r["map_health_flags"] for r in maps.map_health(df, "b").collect()}
    assert len(got["bad"]) == 3 and got["good"] == [] and got["b"] == []


def test_extent_qa_case(spark):
    rows = [("r", "b", 5, 139.9, 138.0, 41.0), ("r", "far", 5, 59472.0, 8088.0, 15141.0), ("r", "mid", 5, 96.9, 115.9, 148.5), ("r", "none", None, None, None, None), ("r", "zero", 0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "run_id string, algorithm string, points bigint, ex double, ey double, ez double")
    got = {r["algorithm"]: r["status"] for r in maps.extent_qa(df, "b", warn=5.0, suspect=10.0).collect()}
    assert got == {"b": "ok", "far": "suspect_extent", "mid": "ok", "none": "map_missing", "zero": "map_empty"}


def test_point_conversion_case(spark):
    rows = [("r", 1, 0, 1.0, 0.0, 0.0, 9, 16, 3, 20), ("r", 1, 1, 2.0, 0.0, 0.0, 8, 0, 1, 10), ("r", 1, 2, float("nan"), 0.0, 0.0, 8, 0, 1, 5), ("r", 1, 3, 1.0, 0.0, 0.0, 8, 32, 1, 30)]
    df = spark.createDataFrame(rows, "run_id string, message_id bigint, ordinal int, x float, y float, z float, reflectivity smallint, tag smallint, line smallint, offset_ns bigint")
    out = points.convert(df).orderBy("pos").collect()
    assert [(r["offset_ns"], r["ring"]) for r in out] == [(10, 1), (20, 3)]
    t = points.validation_totals(df).first()
    assert (t["input_points"], t["output_points"], t["invalid_tag_points"], t["non_finite_points"]) == (4, 2, 1, 1)
    assert (t["input_time_backtracks"], t["output_time_backtracks"]) == (2, 0)


def test_time_units_and_errors(spark):
    df = spark.createDataFrame([("r", 1, 1.0e9), ("r", 1, 1.1e9)], "run_id string, message_id bigint, t double")
    got = sorted(r["time_s"] for r in points.relative_seconds(df, "t", "ns", "absolute").collect())
    np.testing.assert_allclose(got, [0.0, 0.1], atol=1e-12)
    with pytest.raises(ValueError):
        points.relative_seconds(df, "t", "min", "absolute")
    with pytest.raises(ValueError):
        points.relative_seconds(df, "t", "ns", "UNRESOLVED")


@pytest.mark.parametrize("n,m", [(50, 7), (10, 10), (101, 100), (1000, 17)])
def test_linspace_sample_equals_numpy(spark, n, m):
    df = spark.range(n).selectExpr("'r' as run_id", "'a' as algorithm", "id as seq")
    got = sorted(r["seq"] for r in points.linspace_sample(points.positions(df, ["run_id", "algorithm"], "seq"), m).collect())
    assert got == sorted(set(np.linspace(0, n - 1, m, dtype=np.int64).tolist()))


def test_frame_selection_case(spark):
    f = spark.createDataFrame([("r", i, float(i)) for i in range(7)], "run_id string, message_id bigint, bag_time_s double")
    w = spark.createDataFrame([("r", 1.9, 2.1), ("r", 5.0, 5.0)], "run_id string, start_s double, end_s double")
    assert sorted(r["message_id"] for r in frames.select_frames(f, w, 3.0).collect()) == [0, 2, 3, 5, 6]


RUNS = "run_id string, algorithm string, status string, smoke_duration_s double, limit_s double"


def test_short_run_cases(spark):
    runs = spark.createDataFrame([("r", "ok60", "SUCCESS", 60.0, None), ("r", "short60", "SUCCESS", 60.0, None), ("r", "full", "SUCCESS", None, None), ("r", "shortfull", "SUCCESS", None, None), ("r", "crash", "FAILED", None, None)], RUNS)
    m = spark.createDataFrame([("r", "ok60", 56.5, 10.0), ("r", "short60", 52.0, 10.0), ("r", "full", 620.0, 10.0), ("r", "shortfull", 600.0, 5000.0)], "run_id string, algorithm string, duration_s double, path_length_m double")
    got = {r["algorithm"]: r for r in report.health_flags(m, runs, 622.994).collect()}
    assert [got[k]["health_flags"] for k in ("ok60", "short60", "full")] == [[], ["trajectory_short"], []]
    assert got["shortfull"]["health_flags"] == ["trajectory_short", "path_divergence"]
    assert got["crash"]["all_flags"] == ["status:FAILED"] and not got["crash"]["health_valid"]


def test_nominal_path_case(spark):
    rows = [("r", str(i), v) for i, v in enumerate([None, 40.72, float("nan"), 40.52, 41.67, 5000.0])]
    df = spark.createDataFrame(rows, "run_id string, algorithm string, path_length_m double")
    assert report.nominal_path(df).first()["nominal_path_m"] == 40.72


def test_metric_name_guard(spark):
    df = spark.createDataFrame([("ate_rmse_m",), ("z_range_m",), ("Accuracy",), ("frame_rate",)], "metric string")
    assert sorted(r[0] for r in report.metric_name_guard(df, False).collect()) == ["Accuracy", "ate_rmse_m", "frame_rate"]
    assert report.metric_name_guard(df, True).count() == 0


def test_overlay_keeps_the_base(spark):
    base = spark.createDataFrame([("base", "a", "base/raw/a"), ("base", "b", "base/raw/b")], "run_id string, algorithm string, path string")
    over = spark.createDataFrame([("over", "b", "over/raw/b"), ("over", "a", "over/raw/a")], base.schema)
    got = report.overlay(base, over, "b", "new", ["path"]).orderBy("algorithm").collect()
    assert [(r["path"], r["source_run"]) for r in got] == [("new/raw/a", "base"), ("new/raw/b", "over")]
    assert base.count() == 2


def test_voxel_downsample_keeps_first(spark):
    c = cloud(spark, a=[(0.3, 0, 0), (0.1, 0, 0), (2, 0, 0)])
    got = maps.voxel_downsample(c, ["run_id", "algorithm"], 1.0).orderBy("seq").collect()
    assert [r["seq"] for r in got] == [0, 2]


def test_nn_meets_few_blocks(spark, monkeypatch):
    """Many blocks of several clouds: exact distances, and a block of probes meets a part of the blocks only."""
    monkeypatch.setattr(maps, "BLOCK_POINTS", 16)
    rng = np.random.default_rng(7)
    base = np.vstack([rng.normal(0, 5, (700, 3)), rng.normal(3, 1e-4, (300, 3))]).astype("float32")
    others = {k: (rng.normal(s, 5, (400, 3))).astype("float32") for k, s in (("a", 0.0), ("c", 40.0))}
    d = maps.symmetric_nn(cloud(spark, b=base, **others), "b").toPandas()
    for name, pts in others.items():
        full = np.sqrt(((pts.astype(float)[:, None] - base.astype(float)[None]) ** 2).sum(-1))
        for side, want in ((0, full.min(1)), (1, full.min(0))):
            got = d[(d["algorithm"] == name) & (d["side"] == side)]
            np.testing.assert_array_equal(np.sort(got["dist_m"].to_numpy()), np.sort(want))
    places = maps._blocks(
        spark.createDataFrame([("b", *map(float, p)) for p in base], "cloud string, x double, y double, z double"), [-50.0] * 3, 100.0, "t"
    ).toPandas().groupby("block")[["x", "y", "z"]]
    assert places.size().max() == 16 and len(places) == 63
    assert (places.max() - places.min()).max(axis=1).median() < 12  # near places, not slices through the cloud


def test_only_probes_that_a_block_can_bring_nearer_are_compared():
    import numpy as np
    import pyarrow as pa

    probes = pa.table({"id": [0, 1], "cloud": ["c", "c"], "x": [0.0, 9.0], "y": [0.0, 0.0], "z": [0.0, 0.0], "least": [1.0, 64.0]})
    near, far = [{"x": 8.0, "y": 0.0, "z": 0.0}], [{"x": 99.0, "y": 0.0, "z": 0.0}]
    blocks = pa.table({"near": [1.0, 8100.0], "places": [near, far]})
    found = maps._last_meeting(probes, blocks)
    assert found["dist_m"].to_pylist() == [1.0, 1.0]
    assert maps._last_meeting(probes, blocks.slice(0, 0))["dist_m"].to_pylist() == [1.0, 8.0]
    first = maps._first_meeting(probes.drop_columns(["least"]), blocks.slice(0, 1))
    assert np.array_equal(first["least"].to_numpy(), [64.0, 1.0])
    assert maps._first_meeting(probes.drop_columns(["least"]), blocks.slice(0, 0)).num_rows == 0
